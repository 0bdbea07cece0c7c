"""Category-based imputation and loading of national surveys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators.checks import require_columns
from ordscope.operators.distributions import ordinal_histogram

# Columns of a normalised respondent table.
NORMALISED_COLUMNS: dict[str, str] = {
    "country": "string",
    "respondent_id": "string",
    "minor": "string",
    "bin": "int",
    "bin_source": "string",
    "income_monthly": "double",
    "weight": "double",
}


def category_imputation(
    reference: DataFrame,
    target: DataFrame,
    category_col: str = "category",
    group_keys: Sequence[str] = ("country", "grp"),
    bins: Sequence[int] = fv.BINS,
) -> DataFrame:
    """Baseline for a table without bins: sum over categories of P(bin|cat) * P(cat|group).

    ``reference`` has ``category, bin``; ``target`` has the group keys and a
    category. Both are aggregated before the join, so the join is category-sized.
    Categories never seen in the reference are left out and the rest renormalised
    (``covered_share`` tells how much was usable).
    """
    given = ordinal_histogram(reference.where(F.col("bin").isNotNull()), [category_col], bins=bins, flag_col=None)
    given = given.where("n_support > 0").select(category_col, "probs")
    shares = target.dropna(subset=[*group_keys]).groupBy(*group_keys, category_col).agg(
        F.count(F.lit(1)).alias("n")
    )
    mixed = shares.join(given, category_col, "left").groupBy(*group_keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("probs").isNotNull(), F.col("n"))).alias("__used"),
        F.array(
            *[F.sum(F.get("probs", F.lit(i)) * F.col("n")) for i in range(len(bins))]
        ).alias("__mass"),
    )
    return mixed.where(F.col("__used") > 0).select(
        *group_keys,
        "n_rows",
        (F.col("__used") / F.col("n_rows")).alias("covered_share"),
        F.transform("__mass", lambda m: m / F.col("__used")).alias("base_probs"),
    )


def normalise_survey(
    df: DataFrame,
    country: str | Column,
    columns: Mapping[str, str],
    code_crosswalk: DataFrame | None = None,
    observed: bool = True,
) -> DataFrame:
    """Rename a national survey to the normalised respondent schema.

    ``columns`` maps normalised names to source names. A crosswalk
    (``national_code, minor``) translates national occupation codes; it is a
    small dimension that AQE broadcasts by its measured size.
    """
    require_columns(df, columns.values(), "survey")
    picked = df.select(*[F.col(src).alias(dst) for dst, src in columns.items()])
    if code_crosswalk is not None:
        picked = (
            picked.withColumnRenamed("minor", "national_code")
            .withColumn("national_code", F.col("national_code").cast("string"))
            .join(code_crosswalk.select("national_code", "minor"), "national_code", "left")
            .drop("national_code")
        )
    picked = picked.withColumn("country", F.lit(country) if isinstance(country, str) else country)
    picked = picked.withColumn("bin_source", F.lit("observed" if observed else "imputed"))
    return picked.select(
        *[
            (F.col(c) if c in picked.columns else F.lit(None)).cast(t).alias(c)
            for c, t in NORMALISED_COLUMNS.items()
        ]
    )
