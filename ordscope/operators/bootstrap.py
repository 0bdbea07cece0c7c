"""Bootstrap intervals for group distances, shifts and the weighted index.

Resampling n rows with replacement and re-counting them is the same as drawing
the counts of the K bins plus "ineligible" from a multinomial. The draws therefore
start from the histogram: their cost is replicates x groups x bins and does not depend
on the number of raw rows.

A multinomial is a chain of binomials, bin after bin, each of the rows and of the
share that are left. Every binomial is inverted at a number between 0 and 1 that is a
hash of (seed, keys, replicate, bin): reruns and retried tasks agree, and so does any
other engine that inverts the same distribution function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.distances import signed_distance
from ordscope.functions.probability import binomial_quantile
from ordscope.operators.checks import join_null_safe
from ordscope.operators.distributions import (
    group_metrics,
    roll_up,
    weighted_index,
)
from ordscope.session import materialise


def interval_levels(ci_level: float) -> tuple[float, float]:
    alpha = (1.0 - ci_level) / 2.0
    return alpha, 1.0 - alpha


def _uniforms(stream: str, n_replicates: int, n_bins: int) -> np.ndarray:
    """Replicates x bins numbers in (0, 1): 60 bits of an MD5 each, two to a digest."""
    out = np.empty((n_replicates, n_bins))
    for r in range(n_replicates):
        for half in range((n_bins + 1) // 2):
            digest = md5(f"{stream}|{r}|{half}".encode()).hexdigest()
            for side in range(min(2, n_bins - 2 * half)):
                out[r, 2 * half + side] = float(int(digest[16 * side : 16 * side + 15], 16))
    return (out + 0.5) / float(1 << 60)


def _replicate_metrics(counts, n_rows, base, bins, n_replicates, stream):
    """Distances and shifts of ``n_replicates`` multinomial resamples of one group."""
    counts = np.asarray(counts, dtype=np.int64)
    left, rest = np.full(n_replicates, int(n_rows)), int(n_rows)
    draws = np.zeros((n_replicates, len(bins)), np.int64)
    uniforms = _uniforms(stream, n_replicates, len(bins))
    for i, count in enumerate(counts.tolist()):
        if count:
            draws[:, i] = binomial_quantile(uniforms[:, i], left, count / rest)
        left, rest = left - draws[:, i], rest - count
    total = draws.sum(axis=1, keepdims=True)
    probs = np.where(total > 0, draws / np.maximum(total, 1), 1.0 / len(bins))
    diff = probs - np.asarray(base, dtype=float)
    distance = np.abs(np.cumsum(diff, axis=1)[:, :-1]) @ np.diff(bins)
    return distance, diff @ bins


def replicate_table(
    metrics: DataFrame,
    cell_keys: Sequence[str],
    group_key: str = "grp",
    bins: Sequence[int] = fv.BINS,
    n_replicates: int = fv.N_REPLICATES,
    seed: int = fv.BASE_SEED,
    ci_level: float = fv.CI_LEVEL,
) -> DataFrame:
    """One row per (cell, group) with intervals and arrays of replicate distances and shifts.

    ``metrics`` is the output of ``group_metrics``. Each row has its own stream, named
    by the seed and its keys: replicates do not depend on partitioning, and different
    cells are not correlated.
    """
    keys = [*cell_keys, group_key]
    scale = np.asarray(sorted(bins), dtype=float)
    order = [list(bins).index(b) for b in sorted(bins)]
    carried = metrics.select(
        *keys,
        "weight",
        "n_rows",
        "distance",
        "delta",
        F.array(*[F.get("counts", F.lit(i)) for i in order]).alias("counts"),
        F.array(*[F.get("base_probs", F.lit(i)) for i in order]).alias("base_probs"),
        F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("stream"),
    )
    out_fields = [f for f in carried.schema.fields if f.name not in ("counts", "base_probs", "stream")]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_fields)
    out_schema += (
        ", distance_lower double, distance_upper double, delta_lower double, delta_upper double"
        ", rep_distance array<double>, rep_delta array<double>"
    )
    levels = interval_levels(ci_level)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [
                _replicate_metrics(c, n, b, scale, n_replicates, s)
                for c, n, b, s in zip(batch["counts"], batch["n_rows"], batch["base_probs"], batch["stream"])
            ]
            batch = batch.drop(columns=["counts", "base_probs", "stream"])
            for name, which in (("distance", 0), ("delta", 1)):
                bounds = [np.quantile(p[which], levels) for p in pairs]
                batch[f"{name}_lower"] = [float(x) for x, _ in bounds]
                batch[f"{name}_upper"] = [float(x) for _, x in bounds]
            batch["rep_distance"] = [d for d, _ in pairs]
            batch["rep_delta"] = [m for _, m in pairs]
            yield batch

    # The rows are few bytes but cost CPU, so spread them over all cores instead
    # of letting AQE coalesce them by size.
    parallelism = metrics.sparkSession.sparkContext.defaultParallelism
    return carried.repartition(parallelism, *keys).mapInPandas(draw, out_schema)


def group_intervals(replicates: DataFrame, ci_level: float = fv.CI_LEVEL) -> DataFrame:
    """Interval of distance and shift per (cell, group)."""
    return replicates.withColumns(
        {"n_replicates": F.size("rep_distance"), "ci_level": F.lit(ci_level)}
    ).drop("rep_distance", "rep_delta")


def index_intervals(
    replicates: DataFrame, cell_keys: Sequence[str], ci_level: float = fv.CI_LEVEL
) -> DataFrame:
    """Interval of the weighted index per cell.

    Replicate r of the index is the weighted sum of replicate r of every group.
    """
    lo, hi = interval_levels(ci_level)
    per_replicate = (
        replicates.where(F.col("weight").isNotNull())
        .select(
            *cell_keys,
            "weight",
            F.posexplode(F.arrays_zip("rep_distance", "rep_delta")).alias("rep", "r"),
        )
        .groupBy(*cell_keys, "rep")
        .agg(
            F.sum(
                F.col("weight") * signed_distance(F.col("r.rep_distance"), F.col("r.rep_delta"))
            ).alias("index_value")
        )
    )
    # One value per replicate, so the exact percentile holds n_replicates numbers.
    return per_replicate.groupBy(*cell_keys).agg(
        F.percentile("index_value", F.array(F.lit(lo), F.lit(hi))).alias("__ci"),
        F.count(F.lit(1)).alias("n_replicates"),
    ).select(
        *cell_keys,
        F.get("__ci", F.lit(0)).alias("index_lower"),
        F.get("__ci", F.lit(1)).alias("index_upper"),
        "n_replicates",
        F.lit(ci_level).alias("ci_level"),
    )


def bootstrap_by_cell(
    hist: DataFrame,
    baseline: DataFrame,
    cell_keys: Sequence[str],
    on: Sequence[str],
    group_key: str = "grp",
    bins: Sequence[int] = fv.BINS,
    n_replicates: int = fv.N_REPLICATES,
    ci_level: float = fv.CI_LEVEL,
    seed: int = fv.BASE_SEED,
) -> DataFrame:
    """Index with interval for every cell in one job.

    ``hist`` comes from ``ordinal_histogram`` with keys ``cell_keys + group``.
    """
    # One row per (cell, group), read by both branches below.
    metrics = materialise(group_metrics(hist, baseline, on, bins), "metrics")
    point = weighted_index(metrics, cell_keys)
    reps = replicate_table(metrics, cell_keys, group_key, bins, n_replicates, seed, ci_level)
    return join_null_safe(point, index_intervals(reps, cell_keys, ci_level), cell_keys, "left")


__all__ = [
    "bootstrap_by_cell",
    "group_intervals",
    "index_intervals",
    "interval_levels",
    "replicate_table",
    "roll_up",
]
