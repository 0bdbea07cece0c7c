"""Empirical baselines: survey distributions per tier, prior distributions, fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.distances import bin_array
from ordscope.operators.checks import require_columns
from ordscope.operators.distributions import count_bins, to_long, with_probabilities


def prior_probs(centre: Column, bins: Sequence[int] = fv.BINS, sd: float = fv.PRIOR_SD) -> Column:
    """Discretised normal density around ``centre``, normalised over the bins."""
    density = F.transform(bin_array(bins), lambda b: F.exp(-0.5 * F.pow((b - centre) / sd, 2)))
    total = F.aggregate(density, F.lit(0.0), lambda a, x: a + x)
    return F.transform(density, lambda x: x / total)


def country_rows(df: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    """Keep rows of the given country codes and name the country.

    ``try_cast`` to double matches numeric codes, ``'8'`` and ``'8.0'`` alike.
    """
    number = F.expr(f"try_cast({column} as double)")
    name = F.lit(None).cast("string")
    for country, code in codes.items():
        name = F.when(number == float(code), F.lit(country)).otherwise(name)
    return df.withColumn("country", name).where(F.col("country").isNotNull())


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail on an empty input. An action: used at ingest, where the caller wants the error."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def valid_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Inclusive range on a column with large-integer sentinels; result is an int."""
    number = F.expr(f"try_cast({column} as double)")
    return df.where(number.between(low, high)).withColumn(column, number.cast("int"))


def tier_of_level(level: Column, tiers: Mapping[str, Sequence[int]] = fv.TIER_LEVELS) -> Column:
    expr = F.lit(None).cast("string")
    for tier, levels in tiers.items():
        expr = F.when(level.isin(*levels), F.lit(tier)).otherwise(expr)
    return expr


def survey_rows(
    survey: DataFrame,
    codes: Mapping[str, int] = fv.SURVEY_COUNTRY_CODES,
    columns: Mapping[str, str] = fv.SURVEY_COLUMNS,
    bins: Sequence[int] = fv.BINS,
    level_range: tuple[int, int] = fv.LEVEL_RANGE,
) -> DataFrame:
    """Valid respondents as ``country, bin, level`` (plus a weight column if present)."""
    cols = {**fv.SURVEY_COLUMNS, **columns}
    require_columns(survey, [cols["country"], cols["bin"], cols["level"]], "survey")
    keep = ["weight"] if "weight" in survey.columns else []
    rows = country_rows(survey, cols["country"], codes)
    rows = valid_range(rows, cols["bin"], min(bins), max(bins))
    rows = valid_range(rows, cols["level"], *level_range)
    return rows.select("country", F.col(cols["bin"]).alias("bin"), F.col(cols["level"]).alias("level"), *keep)


def tier_distributions(
    rows: DataFrame,
    tiers: Mapping[str, Sequence[int]] = fv.TIER_LEVELS,
    bins: Sequence[int] = fv.BINS,
    weight_col: str | None = None,
    low_n: int = fv.LOW_N,
) -> DataFrame:
    """Distribution per (country, tier) with ``n`` and ``low_n``; empty tiers are uniform.

    Every tier of every country present gets a row: zero-count rows for all tiers
    are added to the aggregated counts (three rows per country), not to the data.
    """
    counted = count_bins(
        rows.withColumn("tier", tier_of_level(F.col("level"), tiers)).where("tier is not null"),
        ["country", "tier"],
        bins=bins,
        flag_col=None,
        weight_col=weight_col,
    )
    zero = F.lit(0.0) if weight_col else F.lit(0).cast("long")
    blank = rows.select("country").distinct().select(
        "country",
        F.explode(F.array(*[F.lit(t) for t in tiers])).alias("tier"),
        F.lit(0).cast("long").alias("n_rows"),
        F.array_repeat(zero, len(bins)).alias("counts"),
        zero.alias("n_support"),
    )
    merged = counted.unionByName(blank).groupBy("country", "tier").agg(
        F.max_by("n_rows", "n_rows").alias("n_rows"),
        F.max_by("counts", "n_rows").alias("counts"),
        F.max_by("n_support", "n_rows").alias("n_support"),
    )
    return (
        with_probabilities(merged, bins, "base_probs")
        .withColumn("n_respondents", F.col("n_rows"))
        .withColumn("low_n", F.col("n_rows") < low_n)
    )


def survey_baseline(
    survey: DataFrame,
    groups: DataFrame,
    codes: Mapping[str, int] = fv.SURVEY_COUNTRY_CODES,
    columns: Mapping[str, str] = fv.SURVEY_COLUMNS,
    tiers: Mapping[str, Sequence[int]] = fv.TIER_LEVELS,
    bins: Sequence[int] = fv.BINS,
    weight_col: str | None = None,
) -> DataFrame:
    """Baseline per (country, group): every group takes its tier's distribution.

    ``groups`` (``grp, tier``) is the fixed crosswalk. All countries are computed
    in one job instead of one pass per country.
    """
    per_tier = tier_distributions(survey_rows(survey, codes, columns, bins), tiers, bins, weight_col)
    return (
        per_tier.join(groups.select("grp", "tier"), "tier", "inner")
        .withColumn("is_synthetic", F.lit(False))
        .select("country", "grp", "base_probs", "is_synthetic", "n_respondents", "tier", "low_n")
    )


def prior_baseline(groups: DataFrame, countries: Sequence[str], bins: Sequence[int] = fv.BINS) -> DataFrame:
    """Prior distribution per (country, group) from ``grp, prior_centre``."""
    return groups.select(
        F.explode(F.array(*[F.lit(c) for c in countries])).alias("country"),
        "grp",
        prior_probs(F.col("prior_centre"), bins).alias("base_probs"),
        F.lit(True).alias("is_synthetic"),
        F.lit(None).cast("long").alias("n_respondents"),
        F.lit(None).cast("string").alias("tier"),
        F.lit(None).cast("boolean").alias("low_n"),
    )


def real_or_prior(real: DataFrame | None, prior: DataFrame) -> DataFrame:
    """Survey rows where they exist, prior rows for every other (country, group)."""
    if real is None:
        return prior
    rest = prior.join(real.select("country", "grp"), ["country", "grp"], "left_anti")
    return real.unionByName(rest)


def baseline_long(baseline: DataFrame, bins: Sequence[int] = fv.BINS) -> DataFrame:
    """Presentation form: one row per (country, group, bin)."""
    keep = [c for c in ("weight", "is_synthetic", "n_respondents", "tier", "low_n") if c in baseline.columns]
    return to_long(baseline, ["country", "grp"], bins, ("base_probs",), ("prob",), keep)
