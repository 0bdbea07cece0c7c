"""Windowed throughput and failure runs over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope.operators import requests
from ordscope.session import materialise
from ordscope.sources import versions

_WRITER = "alerts"


def windowed_throughput(
    stream: DataFrame,
    time_col: str = "ts",
    backend_col: str = "backend",
    duration_col: str = "duration_s",
    window: str = "24 hours",
    slide: str | None = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Units, units per minute and mean duration per backend and event-time window.

    Works on batch and streaming frames. State is a few sums per open window and
    backend; the watermark bounds how many windows stay open.
    """
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    source = stream.withWatermark(time_col, delay) if stream.isStreaming else stream
    agg = source.groupBy(span.alias("w"), backend_col).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.avg(duration_col).alias("mean_duration_s"),
    )
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60.0
    return agg.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        backend_col,
        "n_units",
        (F.col("n_units") / minutes).alias("per_minute"),
        "mean_duration_s",
    )


def failure_alerts(
    batch: DataFrame,
    state_path: str,
    alerts_path: str,
    epoch: int,
    keys: Sequence[str],
    order_cols: Sequence[str],
    chunk: Column,
    failed: Column,
    limit: int,
) -> None:
    """Fold one micro-batch: report runs of at least ``limit`` failures, as long as they are by then.

    The state is one row per key: length and start of the run the key is in, in a table
    bucketed by key (see ``sources.versions``), of which a batch reads and rewrites the
    buckets it touches. A run that goes on in a later batch is reported again under the
    same start; :func:`current_alerts` keeps its longest form, so the answer does not
    depend on where batches were cut. Runs inside the batch come from the two-level
    running total, so a key that sends most of the batch is spread over its chunks. A
    replayed batch starts from the state before it and rewrites the same alert folder.
    Rows without a key are a key of their own.
    """
    spark = batch.sparkSession
    keys = list(keys)
    labelled = requests.running_total(
        batch.withColumn("__failed", failed), keys, order_cols, F.when(F.col("__failed"), 0).otherwise(1), chunk, "run"
    )
    runs = labelled.groupBy(*keys, "run").agg(
        F.count_if("__failed").alias("n_failed"),
        F.min(F.when(F.col("__failed"), F.col(order_cols[0]))).alias("run_start"),
        F.max(F.when(F.col("__failed"), F.col(order_cols[0]))).alias("run_end"),
    )
    runs = materialise(runs.withColumn("state_key", F.to_json(F.struct(*keys))), "runs")

    old = versions.before_epoch(spark, state_path, _WRITER, epoch)
    types = dict(batch.dtypes)
    if old:
        touched = runs.select(versions.bucket_of(F.col("state_key"), old.n_buckets)).distinct().collect()  # at most the buckets
        carried = versions.read_buckets(spark, state_path, old, [r[0] for r in touched]).drop(*keys)
    else:
        carried = spark.createDataFrame([], f"state_key string, carry bigint, since {types[order_cols[0]]}")
    runs = runs.join(carried, "state_key", "left").withColumn(
        "carried_in", F.when(F.col("run") == 0, F.coalesce("carry", F.lit(0))).otherwise(F.lit(0))
    )
    start = F.when(F.col("carried_in") > 0, F.col("since")).otherwise(F.col("run_start"))
    runs = materialise(
        runs.withColumns({"run_length": F.col("n_failed") + F.col("carried_in"), "run_start": start}).drop("carry", "since"),
        "runs",
    )
    runs.where((F.col("n_failed") > 0) & (F.col("run_length") >= limit)).select(*keys, "run_length", "run_start", "run_end").write.mode("overwrite").parquet(
        f"{alerts_path}/epoch={epoch}"
    )
    trailing = runs.groupBy("state_key", *keys).agg(
        F.max_by("run_length", "run").alias("carry"), F.max_by("run_start", "run").alias("since")
    )

    def merge(state: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if state is None else state.join(new.select("state_key"), "state_key", "left_anti").unionByName(new)

    versions.upsert(trailing, state_path, "state_key", merge, writer=_WRITER, epoch=epoch)


def current_alerts(spark: SparkSession, alerts_path: str, keys: Sequence[str]) -> DataFrame:
    """``keys, run_length, run_start, run_end``: every reported run as long as it got."""
    reported = spark.read.parquet(alerts_path)
    return reported.groupBy(*keys, "run_start").agg(
        F.max("run_length").alias("run_length"), F.max("run_end").alias("run_end")
    )
