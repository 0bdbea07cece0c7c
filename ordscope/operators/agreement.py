"""Rater agreement from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per label pair, rows with a missing label dropped."""
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*by, F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cohens_kappa(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), weights: str | None = "linear"
) -> DataFrame:
    """Cohen's kappa per key: ``statistic, value, n, note``.

    Linear weights use the position of a label in the sorted union of labels.
    Raw rows are touched once (confusion counts, at most labels squared). The
    expected disagreement needs no label pairs: sum |i-j| r_i c_j equals a sum
    over cut points of products of cumulative marginals.
    """
    if weights not in ("linear", None):
        raise ValueError(f"unknown weights {weights!r}")
    keys = list(by) or ["__all"]
    source = df if by else df.withColumn("__all", F.lit(1))
    counts = confusion(source, a, b, keys)
    marginals = (
        counts.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("label"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c")),
                    F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c")),
                )
            ),
        )
        .groupBy(*keys, "label")
        .agg(F.sum("r").cast("double").alias("r"), F.sum("c").cast("double").alias("c"))
    )
    upto = Window.partitionBy(*keys).orderBy("label")
    marginals = (
        marginals.withColumn("pos", F.row_number().over(upto))
        .withColumn("cr", F.sum("r").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("cc", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("r").over(Window.partitionBy(*keys)))
    )
    total = F.col("total")
    expected = marginals.groupBy(*keys).agg(
        F.max("total").cast("long").alias("n"),
        F.sum(
            (F.col("cr") * (total - F.col("cc")) + (total - F.col("cr")) * F.col("cc")) / total
        ).alias("expected_linear"),
        (F.max("total") - F.sum(F.col("r") * F.col("c") / total)).alias("expected_nominal"),
    )
    if weights == "linear":
        pos = marginals.select(*keys, "label", "pos")
        placed = (
            counts.join(pos.withColumnsRenamed({"label": "a", "pos": "pa"}), [*keys, "a"])
            .join(pos.withColumnsRenamed({"label": "b", "pos": "pb"}), [*keys, "b"])
        )
        observed = placed.groupBy(*keys).agg(
            F.sum(F.abs(F.col("pa") - F.col("pb")) * F.col("n")).cast("double").alias("observed")
        )
        denominator = F.col("expected_linear")
    else:
        observed = counts.groupBy(*keys).agg(
            F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("observed")
        )
        denominator = F.col("expected_nominal")
    few = F.col("n") < 2
    name = "cohens_kappa_linear" if weights == "linear" else "cohens_kappa"
    nan = F.lit(float("nan"))
    result = expected.join(observed, keys).select(
        *keys,
        F.lit(name).alias("statistic"),
        F.when(few | (denominator == 0), nan).otherwise(1.0 - F.col("observed") / denominator).alias("value"),
        "n",
        F.when(few, F.lit("too few jointly labelled rows")).otherwise(F.lit("")).alias("note"),
    )
    return result.drop("__all")


def raters_vs_reference(
    df: DataFrame, raters: Sequence[str], reference: str, weights: str | None = "linear"
) -> DataFrame:
    """Kappa of every rater column against one reference column, in one job."""
    melted = df.select(
        F.col(reference).alias("__ref"),
        F.inline(
            F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).cast("int").alias("__label")) for r in raters])
        ),
    )
    return cohens_kappa(melted, "__label", "__ref", ["rater"], weights)


def label_vs_consensus(
    labels: DataFrame,
    panel: DataFrame,
    raters: Sequence[str] = ("label_a", "label_b"),
    id_col: str = "image_id",
    consensus_col: str = "consensus_bin",
) -> DataFrame:
    """Left join of the labelling sheet to the consensus, then kappa per rater."""
    joined = labels.select(id_col, *raters).join(panel.select(id_col, consensus_col), id_col, "left")
    return raters_vs_reference(joined, raters, consensus_col)
