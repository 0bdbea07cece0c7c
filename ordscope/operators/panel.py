"""Panel assembly: joins between metadata, phenotypes and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.functions.ids import canonical_path
from ordscope.operators.checks import assert_unique


def build_panel(
    metadata: DataFrame, phenotype: DataFrame, key: str = "image_id", validate: bool = True
) -> DataFrame:
    """Left join of phenotypes onto metadata, one to one.

    Both uniqueness checks work on the join key's partitioning, so their shuffle is the
    one the join needs anyway.
    """
    if not validate:
        return metadata.join(phenotype, key, "left")
    panel = assert_unique(metadata, [key], "metadata").join(assert_unique(phenotype, [key], "phenotype"), key, "left")
    # Rows without a key match nothing but stay.
    return panel.unionByName(metadata.where(F.col(key).isNull()), allowMissingColumns=True)


def repair_paths(
    metadata: DataFrame, files: DataFrame, root: str, group_col: str = "occupation", seed_col: str = "seed"
) -> DataFrame:
    """Path status per row: ``ok``, ``fixed`` (canonical file exists) or ``orphan``.

    File existence is a join against a listing table (``path``) instead of one
    file-system call per row.
    """
    listing = files.select(F.col("path").alias("__p")).distinct()
    with_canonical = metadata.withColumn("__canonical", canonical_path(F.col(group_col), F.col(seed_col), root))
    joined = (
        with_canonical.join(
            listing.withColumnRenamed("__p", "__registered"), F.col("path") == F.col("__registered"), "left"
        )
        .join(listing.withColumnRenamed("__p", "__found"), F.col("__canonical") == F.col("__found"), "left")
    )
    registered, found = F.col("__registered").isNotNull(), F.col("__found").isNotNull()
    return joined.select(
        *[c for c in metadata.columns if c != "path"],
        F.when(registered, F.col("path")).when(found, F.col("__canonical")).otherwise(F.col("path")).alias("path"),
        F.when(registered, F.lit("ok")).when(found, F.lit("fixed")).otherwise(F.lit("orphan")).alias("path_status"),
    )
