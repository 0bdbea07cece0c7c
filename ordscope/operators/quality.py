"""Data-quality gate: every check is one row of a tidy table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.sources.literals import literal_table


def sum_violations(
    df: DataFrame, keys: Sequence[str], value_col: str, tolerance: float = fv.SUM_TOLERANCE
) -> DataFrame:
    """Keys whose values do not add up to 1."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.sum(value_col).alias("total"))
        .where(F.abs(F.col("total") - 1.0) > tolerance)
    )


def _check(df: DataFrame, name: str, passed, detail, severity: str = "blocking") -> DataFrame:
    return df.select(
        F.lit(name).alias("name"),
        passed.alias("passed"),
        F.lit(severity).alias("severity"),
        detail.alias("detail"),
    )


def check_sums(
    df: DataFrame, name: str, keys: Sequence[str], value_col: str, severity: str = "blocking"
) -> DataFrame:
    """One row: do all groups add up to 1?"""
    sums = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum(value_col).alias("s"))
    result = sums.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(F.col("s") - 1.0) > fv.SUM_TOLERANCE).alias("bad"),
    )
    detail = F.format_string("%d of %d groups do not sum to 1", F.col("bad"), F.col("n"))
    return _check(result, name, F.col("bad") == 0, detail, severity)


def check_columns(
    df: DataFrame, name: str, columns: Sequence[str], severity: str = "blocking"
) -> DataFrame:
    """One row: are the columns there? Decided from the schema, no data is read."""
    missing = sorted(set(columns) - set(df.columns))
    row = [(name, not missing, severity, f"missing columns: {missing}")]
    return literal_table(df.sparkSession, row, "name string, passed boolean, severity string, detail string")


def check_unique(df: DataFrame, name: str, key: str, severity: str = "blocking") -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    result = per_key.agg(F.count_if(F.col("n") > 1).alias("bad"), F.count(F.lit(1)).alias("n"))
    detail = F.format_string("%d of %d keys repeat", F.col("bad"), F.col("n"))
    return _check(result, name, F.col("bad") == 0, detail, severity)


def check_row_count(df: DataFrame, name: str, expected: int, severity: str = "blocking") -> DataFrame:
    result = df.agg(F.count(F.lit(1)).alias("n"))
    detail = F.format_string(f"%d rows (need {expected})", F.col("n"))
    return _check(result, name, F.col("n") == expected, detail, severity)


def check_range(
    df: DataFrame, name: str, column: str, low: float, high: float, severity: str = "warn"
) -> DataFrame:
    result = df.agg(
        F.count_if(F.col(column).isNotNull() & ~F.col(column).between(low, high)).alias("bad"),
        F.count(F.lit(1)).alias("n"),
    )
    detail = F.format_string("%d of %d values out of range", F.col("bad"), F.col("n"))
    return _check(result, name, F.col("bad") == 0, detail, severity)


def gate(*checks: DataFrame) -> DataFrame:
    """All checks in one table."""
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: DataFrame) -> DataFrame:
    """Same table, but the query fails if a blocking check did not pass."""
    bad = ~F.col("passed") & (F.col("severity") == "blocking")
    message = F.concat(F.lit("check failed: "), F.col("name"), F.lit(" - "), F.col("detail"))
    return checks.withColumn(
        "passed", F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.col("passed"))
    )
