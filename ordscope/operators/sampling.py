"""Stratified sampling for blind labelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators.checks import require_columns


def stratified_sample(
    df: DataFrame,
    stratum: str,
    id_col: str,
    n_per_stratum: int = fv.SAMPLE_PER_GROUP,
    seed: int = fv.BASE_SEED,
    flag_col: str | None = "has_signal",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Up to n rows per stratum, without replacement, reproducible from ids.

    The order is a hash of seed and id. ``row_number() <= n`` is planned as a
    window group limit: every map task keeps at most n rows per stratum before
    the shuffle, so a stratum that holds most of the data is not moved.
    """
    require_columns(df, [stratum, id_col, *(carry or ()), *([flag_col] if flag_col else [])], "panel")
    rows = df.where(F.coalesce(F.col(flag_col), F.lit(False))) if flag_col else df
    rows = rows.where(F.col(stratum).isNotNull())
    if carry is not None:
        rows = rows.select(*dict.fromkeys([stratum, id_col, *carry]))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    order = Window.partitionBy(stratum).orderBy("__hash", id_col)
    return (
        rows.withColumn("__hash", key)
        .withColumn("__rn", F.row_number().over(order))
        .where(F.col("__rn") <= n_per_stratum)
        .drop("__hash", "__rn")
    )


def labelling_sheet(sample: DataFrame) -> DataFrame:
    """Canonical projection: fixed column order, empty label columns."""
    blank = {"label_a": "int", "label_b": "int", "adjudication": "int"}
    given = [c for c in fv.LABELLING_COLUMNS if c not in blank and c != "notes"]
    require_columns(sample, given, "panel")
    return sample.select(
        *[
            F.lit(None).cast(blank[c]).alias(c)
            if c in blank
            else (F.lit("").alias(c) if c == "notes" else F.col(c))
            for c in fv.LABELLING_COLUMNS
        ]
    )


def sample_for_validation(
    panel: DataFrame, n_per_group: int = fv.SAMPLE_PER_GROUP, seed: int = fv.BASE_SEED, require_signal: bool = True
) -> DataFrame:
    """Stratified labelling sheet by occupation."""
    sample = stratified_sample(
        panel,
        "occupation",
        "image_id",
        n_per_group,
        seed,
        "has_face" if require_signal else None,
        ["language", "model", "country", "path"],
    )
    return labelling_sheet(sample)
