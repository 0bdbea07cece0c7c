"""Ordinal mappings and the multi-source consensus rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.literals import array_of


def consensus(values: Sequence[Column], tolerance: int = 1) -> Column:
    """Half-even median of the available values with agreement counts.

    Returns ``struct<bin int, n_available int, n_concordant int, concordant boolean>``.
    """
    ints = [v.cast("int") for v in values]
    present = F.array_sort(F.array_compact(F.array(*ints)))
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in ints), F.lit(0))
    upper = F.get(present, F.floor(n / 2).cast("int"))
    lower = F.get(present, F.ceil(n / 2).cast("int") - 1)
    median = F.when(n > 0, F.bround((lower + upper) / 2.0).cast("int"))
    near = sum(
        (F.when(F.abs(v - median) <= tolerance, 1).otherwise(0) for v in ints), F.lit(0)
    )
    return F.struct(
        median.alias("bin"),
        n.alias("n_available"),
        near.alias("n_concordant"),
        (near >= 2).alias("concordant"),
    )


def stretch(fraction: Column, bins: Sequence[int] = fv.BINS) -> Column:
    """Bin at a fraction 0..1 of the scale, rounded half to even."""
    last = len(bins) - 1
    idx = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * last).cast("int")
    if list(bins) == list(range(bins[0], bins[0] + len(bins))):
        return idx + bins[0]
    return F.get(array_of(bins), idx)


def midpoint(bins: Sequence[int] = fv.BINS) -> int:
    return int((bins[0] + bins[-1]) / 2)


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def angle_to_bin(angle: Column, bins: Sequence[int] = fv.BINS) -> Column:
    """Light end maps to the first bin, dark end to the last; missing to the middle."""
    a = angle.cast("double")
    span = fv.ANGLE_LIGHT_END - fv.ANGLE_DARK_END
    return F.when(is_missing(a), F.lit(midpoint(bins))).otherwise(
        stretch((fv.ANGLE_LIGHT_END - a) / span, bins)
    )


def angle_to_label(angle: Column) -> Column:
    a = angle.cast("double")
    label = F.when(is_missing(a), F.lit("unknown"))
    for low, high, name in zip(fv.ANGLE_EDGES, fv.ANGLE_EDGES[1:], fv.ANGLE_LABELS):
        label = label.when((a >= low) & (a < high), F.lit(name))
    return label.otherwise(F.lit("unknown"))


def tone_to_bin(tone: Column, n_tones: int = 10, bins: Sequence[int] = fv.BINS) -> Column:
    """Stretch an anchor number 1..n onto the bins; outside (or missing) to the middle."""
    t = tone.cast("int")
    inside = t.between(1, n_tones)
    return F.when(inside, stretch((t - 1) / float(n_tones - 1), bins)).otherwise(
        F.lit(midpoint(bins))
    )


def angle_from_medians(l_med: Column, b_med: Column) -> Column:
    """Angle in degrees between (50, 0) and the median point of a patch.

    A median below 1e-9 in size is zero: it is what rounding leaves of a grey patch.
    """
    return (
        F.when(l_med.isNull() | b_med.isNull(), F.lit(None).cast("double"))
        .when(F.abs(b_med) < 1e-9, F.when(l_med >= 50.0, 90.0).otherwise(-90.0))
        .otherwise(F.degrees(F.atan2(l_med - 50.0, b_med)))
    )


def nearest_anchor(
    r: Column, g: Column, b: Column, anchors: Sequence[tuple[int, int, int]] = fv.COLOUR_ANCHORS
) -> Column:
    """1-based number of the nearest anchor; the lowest number wins a tie."""
    scored = F.array(
        *[
            F.struct(
                (
                    (r - float(ar)) * (r - float(ar))
                    + (g - float(ag)) * (g - float(ag))
                    + (b - float(ab)) * (b - float(ab))
                ).alias("d"),
                F.lit(i).alias("tone"),
            )
            for i, (ar, ag, ab) in enumerate(anchors, start=1)
        ]
    )
    missing = r.isNull() | g.isNull() | b.isNull()
    return F.when(missing, F.lit(fv.COLOUR_NEUTRAL_TONE)).otherwise(F.array_min(scored)["tone"])


def palette_to_bin(code: Column, palette: Sequence[str] = fv.PALETTE_DARK_TO_LIGHT) -> Column:
    """Palette code to bin (darkest code is the highest bin); unknown codes to NULL."""
    pos = F.array_position(array_of(c.lower() for c in palette), F.lower(F.trim(code)))
    return F.when(pos > 0, (len(palette) + 1 - pos).cast("int"))


def dominant_label(scores: Column) -> Column:
    """Key of the largest value of a ``map<string,double>``; the first entry wins a tie."""
    best = F.aggregate(
        F.map_entries(scores),
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")),
        lambda acc, e: F.when(
            acc["value"].isNull() | (e["value"] > acc["value"]),
            F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ).otherwise(acc),
    )
    return best["key"]
