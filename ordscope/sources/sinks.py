"""Writers: cached stage output, text results, ledger. Tables that are replaced: ``versions``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope.sources.readers import path_exists


def write_cached(df: DataFrame, path: str) -> None:
    """Write once; an existing output is kept and the job is skipped."""
    df.write.mode("ignore").parquet(path)


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Output of a stage, computed only if it is not there yet."""
    if not path_exists(spark, path):
        write_cached(build(), path)
    return spark.read.parquet(path)


def write_result_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """Small result table as CSV; doubles with a fixed number of decimals, half to even, NULL as an empty field."""

    def fixed(value: Column) -> Column:
        return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", F.bround(value, decimals)))

    columns = [fixed(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append run-summary rows."""
    df.write.mode("append").parquet(path)
