"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "ordscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    Parallelism is left to AQE: ``shuffle.partitions`` is only the upper bound
    that AQE coalesces from, so a cluster passes a large number here and small
    results still end up in few partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_base(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when driver and executors are one
    process, so anything but a local master without that setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="spark-ordscope-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path (not yet created) in this application's part of the scratch folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_base(spark)}/{app}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    Spark re-runs a shared sub-plan for every branch that needs other columns of
    it. A table in the shared scratch folder is computed once, survives lost
    executors, and carries its real size into join planning. Use it after an
    aggregation or deduplication, where the table is far smaller than its input.
    """
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a plain scan at least one partition per core.

    Large tables have far more splits than cores and pass through unchanged; only
    a scan with fewer splits is redistributed. For scans and projections only:
    asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if splits < cores else scan
