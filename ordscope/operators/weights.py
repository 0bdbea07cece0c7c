"""Rank-based weights from prior or survey incomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.ids import major_code
from ordscope.operators.quantiles import exact_quantiles
from ordscope.sources.dimensions import groups_dim, prior_income_dim


def percentile_rank_weights(
    incomes: DataFrame, country_col: str = "country", income_col: str = "income"
) -> DataFrame:
    """Average-tie percentile rank per country, normalised to sum to 1.

    The input has one row per (country, group), so the window covers a
    dimension-sized partition.
    """
    part = Window.partitionBy(country_col)
    ordered = part.orderBy(income_col)
    ties = Window.partitionBy(country_col, income_col)
    bad = F.col(income_col).isNull() | (F.col(income_col) <= 0)
    income = F.when(bad, F.raise_error(F.lit("incomes must be strictly positive")).cast("double")).otherwise(
        F.col(income_col).cast("double")
    )
    ranked = (
        incomes.withColumn(income_col, income)
        .withColumn("__rank", F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
        .withColumn("pct_rank", F.col("__rank") / F.count(F.lit(1)).over(part))
    )
    return ranked.withColumn("weight", F.col("pct_rank") / F.sum("pct_rank").over(part)).drop("__rank")


def prior_weights(
    spark: SparkSession, countries: Sequence[str] = fv.COUNTRIES, groups: Sequence[str] | None = None
) -> DataFrame:
    """Weights from the fixed income priors."""
    unknown = [c for c in countries if c not in fv.PRIOR_INCOME]
    if unknown:
        raise KeyError(f"no income prior for countries: {unknown}")
    names = list(groups) if groups is not None else list(fv.GROUP_NAMES)
    missing = [g for g in names if g not in fv.GROUP_NAMES]
    if missing:
        raise KeyError(f"no income prior for groups: {missing}")
    prior = prior_income_dim(spark).where(F.col("country").isin(*countries) & F.col("grp").isin(*names))
    return percentile_rank_weights(prior).withColumn("weight_source", F.lit("prior"))


def valid_incomes(df: DataFrame, income_col: str, sentinels: Sequence[int] = fv.INCOME_SENTINELS) -> DataFrame:
    """Drop sentinel codes, then everything that is not a number."""
    x = F.expr(f"try_cast({income_col} as double)")
    return (
        df.withColumn("__x", x)
        .where(F.col("__x").isNotNull() & ~F.isnan("__x") & ~F.col("__x").isin(*[float(s) for s in sentinels]))
        .withColumn(income_col, F.col("__x"))
        .drop("__x")
    )


def mean_by_key(df: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value_col).alias("mean_value"))


def survey_incomes(
    survey: DataFrame,
    groups: DataFrame,
    country_col: str = "country",
    income_col: str = "income",
    category_col: str = "category",
) -> DataFrame:
    """Income per (country, group): mean of the group's major category, else the country's median.

    ``groups`` has ``grp`` and ``major``. Countries without a valid income are absent.
    """
    valid = valid_incomes(survey.dropna(subset=[country_col]), income_col)
    means = mean_by_key(
        valid.withColumn("major", F.expr(f"try_cast({category_col} as int)")), [country_col, "major"], income_col
    )
    medians = exact_quantiles(valid, [country_col], income_col, {"overall_median": 0.5}).drop("n")
    # The group list is a small fixed dimension: attach it as one array per
    # country and explode, instead of a join without a key.
    listed = groups.agg(
        F.sort_array(F.collect_list(F.struct("grp", "major"))).alias("__groups")
    )
    per_group = (
        medians.withColumn("__groups", listed.scalar())
        .select(country_col, "overall_median", F.inline("__groups"))
    )
    return per_group.join(means, [country_col, "major"], "left").select(
        country_col, "grp", F.coalesce("mean_value", "overall_median").alias("income")
    )


def survey_weights(
    survey: DataFrame,
    groups: DataFrame,
    prior: DataFrame,
    country_col: str = "country",
    income_col: str = "income",
    category_col: str = "category",
) -> DataFrame:
    """Weights from survey incomes; countries that cannot be computed use the prior.

    The four fallbacks (column absent, no category, no rows, only sentinels) all
    mean "this country yields no income", so they are one anti-join.
    """
    columns = ["country", "grp", "income", "weight", "weight_source"]
    prior = prior.select(*columns)
    if not {country_col, income_col, category_col} <= set(survey.columns):
        return prior
    incomes = survey_incomes(survey, groups, country_col, income_col, category_col)
    ranked = (
        percentile_rank_weights(incomes.withColumnRenamed(country_col, "country"))
        .withColumn("weight_source", F.lit("survey"))
        .select(*columns)
    )
    missing = prior.join(ranked.select("country").distinct(), "country", "left_anti")
    return ranked.unionByName(missing)


def groups_with_major(spark: SparkSession) -> DataFrame:
    """``grp, major`` from the crosswalk, with the major code derived where blank."""
    return groups_dim(spark).select(
        "grp", major_code(F.col("major"), F.col("minor")).cast("int").alias("major")
    )


def attach_weights(df: DataFrame, weights: DataFrame, keys: Sequence[str] = ("country", "grp")) -> DataFrame:
    """Left join of weights, only when the table does not carry one already."""
    if "weight" in df.columns:
        return df
    return df.join(weights.select(*keys, "weight"), list(keys), "left")
