"""Progress figures: completion per grid, matrices, throughput, pending top list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.ids import format_eta
from ordscope.operators.grid import flag_done
from ordscope.operators.quantiles import exact_quantiles
from ordscope.sources.literals import literal_table


def grid_progress(cells: DataFrame, done: DataFrame | None = None, id_col: str = "image_id") -> DataFrame:
    """Done and total units per grid, completion percentage.

    One left join against the distinct done ids answers both counts; cells that were
    enumerated with their column ``done`` need none.
    """
    slim = cells.select("grid", id_col) if done is not None else cells
    return (
        flag_done(slim, done, id_col)
        .groupBy("grid")
        .agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("total"))
        .withColumn("pct", percent(F.col("done"), F.col("total")))
    )


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0))


def eta_seconds(done: Column, total: Column, per_minute: Column) -> Column:
    """Seconds left at the given rate; NULL without progress or when finished."""
    return F.when((per_minute > 0) & (done < total), (total - done) / per_minute * 60.0)


def with_eta(progress: DataFrame, throughput: DataFrame) -> DataFrame:
    """Attach the total rate of all backends (a scalar) and the resulting ETA."""
    rate = throughput.agg(F.coalesce(F.sum("per_minute"), F.lit(0.0)).alias("r")).scalar()
    out = progress.withColumn("per_minute", rate)
    out = out.withColumn("eta_s", eta_seconds(F.col("done"), F.col("total"), F.col("per_minute")))
    return out.withColumn("eta", format_eta(F.col("eta_s")))


def count_matrix(
    df: DataFrame,
    row_col: str,
    column_col: str,
    rows: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Dense count matrix in fixed order; combinations without rows are 0.

    The column values are known, so each is one conditional count in a single
    aggregate. Absent matrix rows come from a fixed list appended after it.
    """
    counted = (
        df.where(F.col(row_col).isin(*rows))
        .groupBy(row_col)
        .agg(*[F.count_if(F.col(column_col) == c).alias(c) for c in columns])
    )
    order = [(i, r) for i, r in enumerate(rows)]
    frame = literal_table(df.sparkSession, order, f"row_order int, `{row_col}` string")
    joined = F.broadcast(frame).join(counted, row_col, "left")
    return joined.select(
        "row_order", row_col, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns]
    )


def recent_throughput(
    df: DataFrame,
    now: Column | int | None = None,
    backend_col: str = "backend",
    time_col: str = "timestamp",
    duration_col: str = "duration_s",
    window_s: int = fv.SECONDS_PER_DAY,
) -> DataFrame:
    """Units, units per minute and exact median duration per backend in a trailing window.

    A NULL backend is a group of its own; the median is NULL if no duration is known.
    """
    if now is None:
        now = F.unix_timestamp(F.current_timestamp())
    cutoff = (F.lit(now) if isinstance(now, int) else now) - window_s
    recent = df.where(F.col(time_col) >= cutoff)
    counts = recent.groupBy(backend_col).agg(
        F.count(F.lit(1)).alias("n_units"),
        (
            F.count(F.lit(1)) / F.greatest(F.max(time_col) - F.min(time_col), F.lit(1)) * 60.0
        ).alias("per_minute"),
    )
    medians = exact_quantiles(recent, [backend_col], duration_col, {"p50_duration_s": 0.5}).drop("n")
    medians = medians.withColumnRenamed(backend_col, "__backend")
    return counts.join(medians, F.col(backend_col).eqNullSafe(F.col("__backend")), "left").drop("__backend")


def latest_time(df: DataFrame, time_col: str = "timestamp") -> Column:
    """Greatest time as a scalar subquery, a deterministic stand-in for "now"."""
    return df.agg(F.max(time_col).alias("t")).scalar()


def pending_top(
    pending: DataFrame, k: int = 10, keys: Sequence[str] = ("model", "language"),
    first_seen: Sequence[str] = ("prio", "ord_group", "ord_language", "ord_model", "replicate"),
) -> DataFrame:
    """The k key combinations with most pending units; ties in enumeration order."""
    order = F.min(F.struct(*first_seen))
    return (
        pending.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_pending"), order.alias("__first"))
        .orderBy(F.desc("n_pending"), "__first")
        .limit(k)
        .drop("__first")
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row counts per key; NULL keys form a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def table_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and distinct values of a few low-cardinality columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in columns],
    )
