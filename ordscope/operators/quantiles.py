"""Exact quantiles of arbitrarily large groups, by radix selection.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task. Here each value has an order-preserving 64-bit key. A first pass counts rows per
leading 16 bits (map-side combined, at most 65 536 counts per group); the cumulative
counts name the few prefixes that hold a wanted rank. While such a prefix holds more
rows than a task should sort, the next 16 bits are counted within it: at most four
passes, the later ones over the rows of these prefixes only. No row is sampled and no
group passes through one task, however close its values lie.

The prefixes are a materialised table: the next pass can then be planned with its real
size and filters the rows by a broadcast join instead of shuffling all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordscope.session import materialise


def coarse_bucket(value: Column, per_octave: int = 1024) -> Column:
    """Monotone bucket number: fixed relative resolution on both sides of zero."""
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1100.0) * per_octave)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


@F.pandas_udf(T.LongType())
def radix_key(values: pd.Series) -> pd.Series:
    """A 64-bit integer in the order of the doubles; both zeros are one."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))


def rank_position(n: Column, p: float, exclusive: bool) -> Column:
    """Fractional 1-based rank of quantile ``p`` among ``n`` sorted values."""
    if exclusive:
        return F.least(F.greatest(p * (n + 1), F.lit(1.0)), n.cast("double"))
    return p * (n - 1) + 1.0


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value_col: str,
    quantiles: Mapping[str, float | tuple[float, bool]],
    sort_rows: int = 1 << 16,
) -> DataFrame:
    """``keys`` + ``n`` (non-NULL values) + one exact, interpolated column per quantile.

    A quantile is ``p`` (inclusive definition, as NumPy) or ``(p, True)`` for the
    exclusive one. NULL keys form a group. ``sort_rows`` is the most rows that one task
    sorts.
    """
    keys = list(keys) or ["__all"]
    named = [(name, *(q if isinstance(q, tuple) else (q, False))) for name, q in quantiles.items()]
    rows = df.withColumn("__all", F.lit(1)) if keys == ["__all"] else df
    rows = rows.select(*keys, F.col(value_col).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    rows = rows.withColumn("__k", radix_key("__v"))

    def wanted() -> Column:
        """Does a prefix with rows from ``__before`` to ``__upto`` hold a rank that is asked for?"""
        out = F.lit(False)
        for _, p, exclusive in named:
            low = F.floor(rank_position(F.col("__n"), p, exclusive))
            for rank in (low, F.least(low + 1, F.col("__n"))):
                out = out | ((F.col("__before") < rank) & (rank <= F.col("__upto")))
        return out

    def prefix(bits: int) -> Column:
        return F.shiftright("__k", 64 - bits)

    def held(table: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
        named_keys = {k: f"__t_{i}" for i, k in enumerate(keys)}
        match = [F.col(k).eqNullSafe(F.col(t)) for k, t in named_keys.items()] + [prefix(bits) == F.col("__p")]
        return table.join(targets.withColumnsRenamed(named_keys), match).drop(*named_keys.values())

    counts = rows.groupBy(*keys, prefix(16).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    counts = counts.withColumn("__before", F.col("__upto") - F.col("__c"))
    targets = materialise(counts.where(wanted()).drop("__upto"), "ranks")
    bits = 16
    while bits < 64 and (targets.agg(F.max("__c")).first()[0] or 0) > sort_rows:
        if bits == 16:
            rows = materialise(held(rows, targets, bits).select(*keys, "__v", "__k"), "candidates")
        within = held(rows, targets.withColumnRenamed("__before", "__start").drop("__c"), bits)
        counts = within.groupBy(*keys, "__p", "__start", "__n", prefix(bits + 16).alias("__next")).agg(F.count(F.lit(1)).alias("__c"))
        order = Window.partitionBy(*keys, "__p").orderBy("__next").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.col("__start") + F.sum("__c").over(order)).withColumn("__before", F.col("__upto") - F.col("__c"))
        kept = counts.where(wanted()).select(*keys, F.col("__next").alias("__p"), "__c", "__n", "__before")
        targets = materialise(kept, "ranks")
        bits += 16

    inside = Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        held(rows, targets.drop("__c"), bits)
        .groupBy(*keys, "__p", "__v", "__n", "__before")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__rank_hi", F.col("__before") + F.sum("__c").over(inside))
        .withColumn("__rank_lo", F.col("__rank_hi") - F.col("__c"))
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("__rank_lo") < rank) & (rank <= F.col("__rank_hi")), F.col("__v")))

    aggregates = [F.max("__n").alias("n")]
    for name, p, exclusive in named:
        pos = rank_position(F.col("__n"), p, exclusive)
        low = F.floor(pos)
        at_low, at_high = value_at(low), value_at(F.least(low + 1, F.col("__n")))
        aggregates.append((at_low + (at_high - at_low) * F.max(pos - low)).alias(name))
    return hits.groupBy(*keys).agg(*aggregates).drop("__all")
