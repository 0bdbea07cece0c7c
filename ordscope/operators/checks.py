"""Guards shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} missing columns: {missing}")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grouping here ignores rows without a key (Spark would form a NULL group)."""
    return df.dropna(subset=list(keys)) if keys else df


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The rows whose key is known; the query fails if a key occurs more than once.

    Rows with a NULL key match nothing and are left out here. The count is a
    window on the keys, so the input is evaluated once, and a join on the same keys
    uses the window's partitioning and order again.
    """
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    message = F.concat(F.lit(f"{what}: duplicate key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    counted = df.where(known).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the left side's keys and all other columns of both stay."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(names[k])), keys, F.lit(True))
    return left.join(renamed, same, how).drop(*names.values())
