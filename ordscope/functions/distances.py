"""Distances and moments over dense probability arrays.

A distribution is one ``array<double>`` aligned with the list of bins. Compared
with one row per bin this needs no window and no bin-level join: the work per
(cell, group) is a fold over a dozen numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordscope.fixed_values import BINS, DISTRIBUTION_TOLERANCE, SHIFT_TOLERANCE
from ordscope.functions.literals import array_of, structs_of


def bin_array(bins: Sequence[int] = BINS) -> Column:
    return array_of(float(b) for b in bins)


def distribution_error(p: Column, bins: Sequence[int] = BINS) -> Column:
    """Message describing why ``p`` is not a distribution over ``bins``, else NULL."""
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return (
        F.when(p.isNull() | (F.size(p) == 0), F.lit("distribution must be non-empty"))
        .when(F.size(p) != len(bins), F.lit("shape mismatch"))
        .when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0)), F.lit("negative or missing probability"))
        .when(F.abs(total - 1.0) > DISTRIBUTION_TOLERANCE, F.lit("must sum to 1"))
    )


def checked(value: Column, bins: Sequence[int], *distributions: Column) -> Column:
    """``value``, or a query error if one of the distributions is malformed."""
    error = F.coalesce(*[distribution_error(p, bins) for p in distributions])
    return F.when(error.isNotNull(), F.raise_error(error).cast("double")).otherwise(value)


def wasserstein1(p: Column, q: Column, bins: Sequence[int] = BINS, validate: bool = False) -> Column:
    """Sum over bins of |CDF_p - CDF_q| times the gap to the next bin."""
    order = sorted(range(len(bins)), key=lambda i: bins[i])
    gaps = [(i, float(bins[j] - bins[i])) for i, j in zip(order, order[1:])]
    if not gaps:
        value = F.lit(0.0)
    else:
        start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0.0).alias("total"))

        def step(acc: Column, s: Column) -> Column:
            cdf = acc["cdf"] + F.get(p, s["pos"]) - F.get(q, s["pos"])
            return F.struct(cdf.alias("cdf"), (acc["total"] + F.abs(cdf) * s["gap"]).alias("total"))

        value = F.aggregate(structs_of(gaps, ("pos", "gap")), start, step, lambda acc: acc["total"])
    return checked(value, bins, p, q) if validate else value


def expected_bin(p: Column, bins: Sequence[int] = BINS, validate: bool = False) -> Column:
    products = F.zip_with(p, bin_array(bins), lambda x, b: x * b)
    value = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return checked(value, bins, p) if validate else value


def signed_shift(p: Column, q: Column, bins: Sequence[int] = BINS) -> Column:
    return expected_bin(p, bins) - expected_bin(q, bins)


def signed_distance(distance: Column, shift: Column) -> Column:
    """Distance carrying the sign of the shift; zero when there is no shift.

    Two distributions with equal means leave a shift of a few ulps whose sign only
    reflects the order of additions, so anything below the tolerance counts as none.
    """
    return F.when(F.abs(shift) < SHIFT_TOLERANCE, F.lit(0.0)).otherwise(distance * F.signum(shift))


def cumulative(p: Column) -> Column:
    """Running sums of an array, same length."""
    return F.aggregate(
        p,
        F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)),
    )
