"""Estimation over index and group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.operators import regression


def estimate(
    index_table: DataFrame, group_rows: DataFrame | None, cluster_by: str = "grp"
) -> dict[str, DataFrame]:
    """Language effects from the index table; pooled gradient from the group table."""
    results = {}
    if {"language", "country", "model", "index_value"} <= set(index_table.columns):
        results["fixed_effects"] = regression.fixed_effects_test(index_table)
    if group_rows is not None:
        results["pooled_gradient"] = regression.pooled_gradient(group_rows, cluster_by=cluster_by)
    return results


def directional_claims(
    group_rows: DataFrame, cell_keys: Sequence[str], cluster_by: str = "grp"
) -> DataFrame:
    """Per-cell one-sided test, adjusted over all cells, with the effect threshold."""
    tests = regression.with_shift_p(regression.shift_test(group_rows, cell_keys, cluster_by=cluster_by))
    return regression.benjamini_hochberg(tests, effect_col="mean_delta")


def cell_gradients(group_rows: DataFrame, cell_keys: Sequence[str]) -> DataFrame:
    """Gradient per cell; cells with fewer than two distinct weights have no slope."""
    rows = group_rows.where(F.col("weight").isNotNull() & F.col("delta").isNotNull())
    return regression.fit_gradient(rows, cell_keys)
