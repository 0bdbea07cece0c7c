"""Classifier columns: schema extension and the classification of detector output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ordinal


def added_columns(df: DataFrame) -> list[str]:
    return [name for name, _, _ in fv.CLASSIFIER_COLUMNS if name not in df.columns]


def extend_schema(df: DataFrame) -> DataFrame:
    """Add absent classifier columns with their sentinels; existing ones stay. Idempotent."""
    new = {
        name: F.lit(sentinel).cast(kind)
        for name, kind, sentinel in fv.CLASSIFIER_COLUMNS
        if name not in df.columns
    }
    return df.withColumns(new) if new else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "missing" on disk; NULL means it here."""
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def classify(
    df: DataFrame,
    has_face: str = "has_face",
    l_med: str = "l_med",
    b_med: str = "b_med",
    rgb: tuple[str, str, str] = ("r_med", "g_med", "b_med_rgb"),
    palette: str = "palette_code",
    tolerance: int = 1,
) -> DataFrame:
    """Classifier columns from detector output and patch statistics.

    Rows without a detection keep the sentinels. All of it is column arithmetic in
    one projection.
    """
    face = F.coalesce(F.col(has_face), F.lit(False))
    angle = ordinal.angle_from_medians(F.col(l_med), F.col(b_med))
    tone = ordinal.nearest_anchor(*[F.col(c) for c in rgb])
    staged = df.withColumns({"__angle": angle, "__tone": tone})
    angle_bin = ordinal.angle_to_bin(F.col("__angle"))
    tone_bin = ordinal.tone_to_bin(F.col("__tone"))
    palette_bin = ordinal.palette_to_bin(F.col(palette))
    staged = staged.withColumns({"__ab": angle_bin, "__tb": tone_bin, "__pb": palette_bin})
    staged = staged.withColumn(
        "__c", ordinal.consensus([F.col("__ab"), F.col("__tb"), F.col("__pb")], tolerance)
    )
    count = F.col("n_faces") if "n_faces" in df.columns else F.when(face, 1).otherwise(0)
    out = {
        "has_face": face,
        "n_faces": F.coalesce(count, F.lit(0)).cast("int"),
        "ita_value": F.when(face, F.col("__angle")),
        "ita_label": F.when(face, ordinal.angle_to_label(F.col("__angle"))).otherwise(F.lit(fv.NO_DETECTION_LABEL)),
        "ita_bin": F.when(face, F.col("__ab")),
        "mst_value": F.when(face, F.col("__tone")),
        "mst_bin": F.when(face, F.col("__tb")),
        "palette_bin": F.when(face, F.col("__pb")),
        "consensus_bin": F.when(face, F.col("__c.bin")),
        "n_classifiers": F.when(face, F.col("__c.n_available")).otherwise(0),
        "n_concordant": F.when(face, F.col("__c.n_concordant")).otherwise(0),
        "concordant_2of3": F.when(face, F.col("__c.concordant")).otherwise(F.lit(False)),
    }
    return staged.withColumns(out).drop("__angle", "__tone", "__ab", "__tb", "__pb", "__c")


def detections_best(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Best detection per key (largest box, highest accuracy): an argmax aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), score).alias("__best")).select(*keys, "__best.*")
