"""Histograms, dense distributions, group metrics, weighted index.

Physical shape: one aggregate with map-side partial counts (one long per bin)
turns raw rows into one row per (cell, group). A group that holds a third of all
rows therefore reaches the shuffle as one small row per map task. Everything
after that works on arrays of ``len(bins)`` numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import distances as dist
from ordscope.operators.checks import drop_null_keys, require_columns


def eligible_rows(df: DataFrame, bin_col: str = "bin", flag_col: str | None = "has_signal") -> DataFrame:
    """Rows whose flag is true (NULL counts as false) and whose bin is known."""
    if flag_col and flag_col in df.columns:
        df = df.where(F.coalesce(F.col(flag_col), F.lit(False)))
    return df.where(F.col(bin_col).isNotNull()).withColumn(bin_col, F.col(bin_col).try_cast("int")).where(F.col(bin_col).isNotNull())


def count_bins(
    df: DataFrame,
    keys: Sequence[str],
    bin_col: str = "bin",
    bins: Sequence[int] = fv.BINS,
    flag_col: str | None = "has_signal",
    weight_col: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key: all rows, rows in support, dense array of counts.

    Keys whose rows are all ineligible stay (with zero counts). A missing bin
    column counts as "no observation". ``weight_col`` sums survey weights
    instead of counting rows.
    """
    require_columns(df, keys, "panel")
    df = drop_null_keys(df, keys)
    if bin_col in df.columns:
        value = F.col(bin_col).try_cast("int")  # NaN and infinities count as unknown
    else:
        value = F.lit(None).cast("int")
    ok = F.lit(True)
    if flag_col and flag_col in df.columns:
        ok = F.coalesce(F.col(flag_col), F.lit(False))
    if weight_col:
        cells = [
            F.coalesce(F.sum(F.when(ok & (value == b), F.col(weight_col).cast("double"))), F.lit(0.0))
            for b in bins
        ]
    else:
        cells = [F.count_if(ok & (value == b)) for b in bins]
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*cells).alias("counts"), *extra
    )
    zero = F.lit(0.0) if weight_col else F.lit(0).cast("long")
    return out.withColumn("n_support", F.aggregate("counts", zero, lambda a, x: a + x))


def roll_up(hist: DataFrame, keys: Sequence[str], bins: Sequence[int] = fv.BINS) -> DataFrame:
    """Re-aggregate an existing histogram to coarser keys, without the raw rows."""
    out = hist.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(len(bins))]).alias("counts"),
        F.sum("n_support").alias("n_support"),
    )
    return out


def with_probabilities(hist: DataFrame, bins: Sequence[int] = fv.BINS, name: str = "probs") -> DataFrame:
    """Counts to probabilities; uniform (and flagged) where nothing was observed."""
    k = len(bins)
    empty = F.col("n_support") == 0
    share = F.transform("counts", lambda c: c.cast("double") / F.col("n_support").cast("double"))
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    return hist.withColumn("is_uniform_fallback", empty).withColumn(
        name, F.when(empty, uniform).otherwise(share)
    )


def ordinal_histogram(
    df: DataFrame,
    keys: Sequence[str],
    bin_col: str = "bin",
    bins: Sequence[int] = fv.BINS,
    flag_col: str | None = "has_signal",
    weight_col: str | None = None,
) -> DataFrame:
    """Dense distribution per key: ``n_rows, counts, n_support, probs, is_uniform_fallback``."""
    return with_probabilities(count_bins(df, keys, bin_col, bins, flag_col, weight_col), bins)


def to_long(
    df: DataFrame,
    keys: Sequence[str],
    bins: Sequence[int] = fv.BINS,
    arrays: Sequence[str] = ("probs",),
    names: Sequence[str] = ("prob",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (key, bin): the dense support without any join."""
    per_bin = F.array(
        *[
            F.struct(
                F.lit(b).alias("bin"),
                *[F.get(a, F.lit(i)).alias(n) for a, n in zip(arrays, names)],
            )
            for i, b in enumerate(bins)
        ]
    )
    return df.select(*keys, *keep, F.inline(per_bin))


def from_long(
    df: DataFrame,
    keys: Sequence[str],
    bins: Sequence[int] = fv.BINS,
    bin_col: str = "bin",
    prob_col: str = "prob",
    name: str = "probs",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Long distribution to one array per key; absent bins become 0."""
    cells = [
        F.coalesce(F.sum(F.when(F.col(bin_col) == b, F.col(prob_col).cast("double"))), F.lit(0.0))
        for b in bins
    ]
    return drop_null_keys(df, keys).groupBy(*keys).agg(F.array(*cells).alias(name), *extra)


def group_metrics(
    observed: DataFrame,
    baseline: DataFrame,
    on: Sequence[str],
    bins: Sequence[int] = fv.BINS,
    validate: bool = False,
) -> DataFrame:
    """Distance, shift and signed distance of each observed distribution.

    ``observed`` has ``probs``; ``baseline`` has ``base_probs`` and ``weight``,
    keyed by ``on``. Observed keys without a baseline are dropped (that cell is
    not auditable). Both sides are already aggregated, so AQE broadcasts the
    baseline when its measured size allows and sort-merges otherwise.
    """
    joined = observed.join(baseline, list(on), "inner")
    d = dist.wasserstein1(F.col("probs"), F.col("base_probs"), bins, validate)
    shift = dist.signed_shift(F.col("probs"), F.col("base_probs"), bins)
    return joined.withColumns({"distance": d, "delta": shift}).withColumn(
        "signed_distance", dist.signed_distance(F.col("distance"), F.col("delta"))
    )


def weighted_index(metrics: DataFrame, cell_keys: Sequence[str]) -> DataFrame:
    """Weighted sum of signed distances per cell.

    Groups without a weight do not enter the sum; they are counted. Weights are
    not renormalised over the groups present, ``covered_weight`` shows their sum.
    """
    return metrics.groupBy(*cell_keys).agg(
        F.sum(F.col("weight") * F.col("signed_distance")).alias("index_value"),
        F.sum("n_rows").alias("n_units"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("weight").alias("covered_weight"),
        F.count_if(F.col("weight").isNull()).alias("n_missing_weight"),
    )


def expand_multi(
    df: DataFrame,
    countries: Sequence[str],
    country_col: str = "country",
    marker: str = fv.MULTI_COUNTRY,
) -> DataFrame:
    """Rows of the catch-all country become one row per country.

    Apply it to aggregated rows; the later join stays a plain equi-join.
    """
    targets = F.when(
        F.col(country_col) == marker, F.array(*[F.lit(c) for c in countries])
    ).otherwise(F.array(F.col(country_col)))
    rest = [c for c in df.columns if c != country_col]
    return df.select(
        *rest,
        (F.col(country_col) == marker).alias("is_multi"),
        F.explode(targets).alias(country_col),
    )


def signal_rate(df: DataFrame, keys: Sequence[str] = (), flag_col: str = "has_signal") -> DataFrame:
    """Share of rows with a true flag, NULL counted as false."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.coalesce(F.col(flag_col), F.lit(False)).cast("double")).alias("signal_rate"),
    )
