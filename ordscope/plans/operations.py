"""Shard merge, progress report, missing manifest, labelling, quality gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids
from ordscope.operators import agreement, grid, merge, progress, quality, sampling
from ordscope.session import materialise
from ordscope.sources.readers import path_exists, read_shards, union_all
from ordscope.sources import versions


def merged_shards(rows: DataFrame, key: str = "image_id", order_col: str = "timestamp") -> DataFrame:
    """Deduplicated table; the query fails on ids that mean two different units.

    The ambiguity check looks at the rows before deduplication (afterwards it could
    never fire) and rides on the same aggregate.
    """
    invariant = [c for c in ("model", "occupation", "seed") if c in rows.columns]
    return merge.latest_by_key(rows, key, order_col, drop_source_order=True, invariant=invariant).drop("source")


def run_merge(
    spark: SparkSession, canonical: str, shards: Sequence[str], dry_run: bool = False
) -> DataFrame:
    """Merge shards into the canonical table (see ``sources.versions``); returns the summary counts.

    The merge is committed against the version it read: if another merge came between,
    it fails and changes nothing.
    """
    old = versions.current(spark, canonical)
    rows = read_shards(spark, None, shards) if any(path_exists(spark, p) for p in shards) else None
    if old:
        table = versions.read_version(spark, canonical, old)
        first = table.withColumns({"source": F.lit("canonical"), "src_ord": F.lit(0), "row_ord": F.lit(0).cast("long")})
        rows = first if rows is None else union_all([first, rows])
    if rows is None:
        raise FileNotFoundError("no canonical table and no shards")
    merged = merged_shards(rows)
    summary = merge.merge_summary(rows)
    if dry_run:
        return summary
    # The counts describe the input, so take them before the commit.
    counts = spark.createDataFrame(summary.collect(), summary.schema)
    versions.replace_table(merged, canonical, base=old.number if old else 0)
    return counts


def progress_report(
    cells: DataFrame, metadata: DataFrame, now: Column | int | str | None = None, top: int = 10
) -> dict[str, DataFrame]:
    """The tables of a progress report over deduplicated metadata.

    ``now`` is epoch seconds, a column, ``"latest"`` (newest row) or the clock. Cells may
    carry a column ``done``, from enumeration with the same metadata.
    """
    # Five tables read the deduplicated log; sort it out once.
    columns = ["image_id", "model", "language", "backend", "duration_s", "timestamp", "src_ord", "row_ord"]
    slim = metadata.select(*[c for c in columns if c in metadata.columns])
    unique = materialise(merge.latest_by_key(slim, drop_source_order=True), "unique")
    if isinstance(now, str):
        now = progress.latest_time(unique)
    rates = progress.recent_throughput(unique, now)
    cells = grid.flag_done(cells, None if "done" in cells.columns else unique)
    by_grid = progress.grid_progress(cells)
    main = cells.where(F.col("grid") == "main")
    # Only the done cells meet the log. They are far more than the group table's size lets the planner expect.
    done_main = unique.join(main.where("done").select("image_id").hint("merge"), "image_id", "left_semi")
    return {
        "duplicates": merge.duplicate_summary(metadata),
        "grids": progress.with_eta(by_grid, rates),
        "matrix": progress.count_matrix(done_main, "model", "language", fv.MAIN_MODELS, fv.MAIN_LANGUAGES),
        "throughput": rates,
        "pending_top": progress.pending_top(grid.pending_cells(main), top),
    }


def manifest_report(cells: DataFrame, metadata: DataFrame, n_shards: int = 4) -> dict[str, DataFrame]:
    """Missing manifest with its checks and the counts per grid, runner and model."""
    manifest = grid.missing_manifest(cells, None if "done" in cells.columns else metadata, n_shards)
    return {
        "manifest": manifest,
        "problems": grid.manifest_problems(manifest),
        "summary": progress.count_by(manifest, "grid", "recommended_runner", "model"),
    }


def labelling_analysis(labels: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """Kappa between the raters and of each rater against the consensus."""
    human = agreement.cohens_kappa(labels, "label_a", "label_b").select(
        F.lit("label_a~label_b").alias("rater"), "statistic", "value", "n", "note"
    )
    if panel is None:
        return human
    return human.unionByName(agreement.label_vs_consensus(labels, panel))


def quality_report(
    baseline_long: DataFrame, weights: DataFrame, groups: DataFrame, cells: DataFrame
) -> DataFrame:
    """Tidy checks table: sums of probabilities and weights, expected sizes."""
    return quality.gate(
        quality.check_columns(baseline_long, "baseline-columns", ["grp", "bin", "prob"]),
        quality.check_sums(baseline_long, "baseline-sums", ["country", "grp"], "prob"),
        quality.check_sums(weights, "weight-sums", ["country"], "weight"),
        quality.check_row_count(groups, "crosswalk", len(fv.GROUPS)),
        quality.check_row_count(cells, "main-grid", grid.expected_sizes()["main"]),
    )
