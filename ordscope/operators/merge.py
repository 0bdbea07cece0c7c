"""Last-write-wins merging of shards and the checks around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.operators.checks import require_columns


def _keep_best(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    drop: Sequence[str] = (),
    invariant: Sequence[str] = (),
    least: bool = False,
) -> DataFrame:
    """One row per key: the one with the greatest (or ``least``) ``order``.

    An aggregate rather than a window: duplicates collapse map-side, so a key
    repeated in a third of all rows costs one row per map task in the shuffle.
    Columns in ``invariant`` must not vary within a key; the query fails if one does.
    """
    rest = [c for c in df.columns if c not in keys and c not in drop]
    best = df.groupBy(*keys).agg(
        (F.min_by if least else F.max_by)(F.struct(F.lit(True).alias("__any"), *rest), order).alias("__row"),
        *_spread(invariant),
    )
    if invariant:
        message = F.concat(F.lit("ambiguous ids: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        best = best.where(
            F.when(_varies(invariant), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
    kept = best.select(*keys, "__row.*")
    return kept.select(*[c for c in df.columns if c not in drop])


def _spread(columns: Sequence[str]) -> list[Column]:
    """Smallest and largest value per column: two numbers that combine map-side."""
    return [F.min(c).alias(f"__lo_{c}") for c in columns] + [F.max(c).alias(f"__hi_{c}") for c in columns]


def _varies(columns: Sequence[str]) -> Column:
    """Does any of the columns take more than one value? NULLs are not values."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(f"__lo_{c}") < F.col(f"__hi_{c}"), F.lit(False))
    return bad


def latest_by_key(
    df: DataFrame,
    key: str = "image_id",
    order_col: str = "timestamp",
    source_order: Sequence[str] = ("src_ord", "source", "row_ord"),
    drop_source_order: bool = False,
    invariant: Sequence[str] = (),
) -> DataFrame:
    """Highest order value per key; unknown order last; ties keep the earliest inserted row.

    Insertion order must be explicit, a distributed table has none: ``source_order``
    are the columns of it, the table's rank, its name, the row's place. Without the
    order column the last inserted row wins.
    """
    require_columns(df, [key], "shards")
    present = [c for c in source_order if c in df.columns]
    drop = present if drop_source_order else ()
    if order_col not in df.columns:
        return last_by_position(df, key, present, drop_source_order, invariant)
    # The least in this order: known before unknown, late before early, then as inserted.
    order = F.struct(
        F.col(order_col).isNull().alias("unknown"),
        _descending(df, order_col).alias("value"),
        *[F.col(c).alias(f"o_{c}") for c in present],
    )
    return _keep_best(df, [key], order, drop, invariant, least=True)


def _descending(df: DataFrame, column: str) -> Column:
    """A number that falls as the column rises."""
    value, kind = F.col(column), dict(df.dtypes)[column]
    if kind.startswith(("timestamp", "date")):
        return -F.unix_micros(value.cast("timestamp"))
    return -value


def last_by_position(
    df: DataFrame,
    key: str = "image_id",
    source_order: Sequence[str] = ("src_ord", "row_ord"),
    drop_source_order: bool = False,
    invariant: Sequence[str] = (),
) -> DataFrame:
    """Keep the last inserted row per key."""
    require_columns(df, [key, *source_order], "shards")
    order = F.struct(*[F.col(c).alias(f"o_{c}") for c in source_order])
    return _keep_best(df, [key], order, list(source_order) if drop_source_order else (), invariant)


def duplicate_summary(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows, distinct keys, surplus rows, keys that occur more than once.

    Two-level aggregate instead of ``count(distinct)``: the first level is keyed
    by the id, so it spreads over the cluster and combines map-side.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count_if(known).alias("n_unique"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(known)).cast("long").alias("n_surplus"),
        F.count_if(known & (F.col("n") > 1)).alias("n_duplicated_keys"),
    )


def ambiguous_keys(
    df: DataFrame, key: str = "image_id", columns: Sequence[str] = ("model", "occupation", "seed")
) -> DataFrame:
    """Keys that map to more than one value of any of the columns."""
    require_columns(df, [key, *columns], "shards")
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *_spread(columns))
    return per_key.where(_varies(columns)).select(key, "n_rows")


def drop_mislabelled(df: DataFrame, model: str, backend: str) -> DataFrame:
    """Delete rows with exactly this model and backend; rows with NULLs stay."""
    hit = F.col("model").eqNullSafe(F.lit(model)) & F.col("backend").eqNullSafe(F.lit(backend))
    return df.where(~hit)


def merge_summary(before: DataFrame, key: str = "image_id") -> DataFrame:
    """Row counts a merge reports: input rows, kept rows, dropped rows."""
    return duplicate_summary(before, key).select(
        F.col("n_rows").alias("n_input"),
        F.col("n_unique").alias("n_merged"),
        F.col("n_surplus").alias("n_dropped"),
    )


def import_summary(canonical: DataFrame, shards: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows before, shard rows, rows after the merge, duplicates left (always 0)."""
    tagged = canonical.select(key, F.lit(1).alias("old")).unionByName(
        shards.select(key, F.lit(0).alias("old"))
    )
    per_key = tagged.groupBy(key).agg(F.sum("old").alias("old"), F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("old"), F.lit(0)).cast("long").alias("rows_before"),
        F.coalesce(F.sum(F.col("n") - F.col("old")), F.lit(0)).cast("long").alias("shard_rows"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(F.col("old") == 0).alias("rows_added"),
    )
