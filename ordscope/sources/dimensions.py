"""Small dimension tables built from the fixed values.

Their size is known when the code is written (at most a few hundred rows), so
these are the only tables that are ever broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.sources.literals import literal_table


def groups_dim(spark: SparkSession) -> DataFrame:
    """Crosswalk: names, codes, tier, prior centre and national codes per group."""
    rows = [
        (i, *g, *fv.NATIONAL_CODES.get(g[0], ("", "", "", "")))
        for i, g in enumerate(fv.GROUPS)
    ]
    return literal_table(
        spark,
        rows,
        "grp_index int, grp string, spanish string, portuguese string, minor string, major string, "
        "tier string, prior_centre double, code_co string, code_mx string, code_br string, code_pe string",
    )


def prior_income_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (country, grp, float(income))
        for country, incomes in fv.PRIOR_INCOME.items()
        for grp, income in incomes.items()
    ]
    return literal_table(spark, rows, "country string, grp string, income double")





def groups_by_tier(spark: SparkSession, tier: str) -> DataFrame:
    return groups_dim(spark).where(F.col("tier") == tier).orderBy("grp_index").select("grp")


def minor_codes(spark: SparkSession) -> DataFrame:
    return groups_dim(spark).select("minor").distinct().orderBy("minor")


def lookup_groups(df: DataFrame, key_col: str = "grp") -> DataFrame:
    """Attach the crosswalk; the query fails on a group that is not registered."""
    dim = groups_dim(df.sparkSession)
    known = F.col("grp_index").isNotNull()
    joined = df.join(F.broadcast(dim.withColumnRenamed("grp", key_col)), key_col, "left")
    message = F.concat(F.lit("no crosswalk registered for group "), F.coalesce(key_col, F.lit("NULL")))
    # In a filter, so that the check stays whichever columns are read.
    return joined.where(F.when(known, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
