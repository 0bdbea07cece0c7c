"""From panel and baseline to the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators import baselines, bootstrap, distributions, panel, weights
from ordscope.sources.dimensions import groups_dim

CELL_KEYS = ("country", "language", "model")


def ground_truth(
    spark: SparkSession,
    countries: Sequence[str] = fv.COUNTRIES,
    survey: DataFrame | None = None,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Baseline distribution and weight per (country, group), survey first, prior else."""
    dim = groups_dim(spark)
    if groups is not None:
        unknown = sorted(set(groups) - set(fv.GROUP_NAMES))
        if unknown:
            raise KeyError(f"no prior calibrated for groups: {unknown}")
        dim = dim.where(F.col("grp").isin(*groups))
    prior = baselines.prior_baseline(dim, countries)
    real = None
    w = weights.prior_weights(spark, countries, groups)
    if survey is not None:
        codes = {c: fv.SURVEY_COUNTRY_CODES[c] for c in countries}
        real = baselines.survey_baseline(survey, dim, codes)
        income, category = fv.SURVEY_COLUMNS["income"], fv.SURVEY_COLUMNS["category"]
        if income in survey.columns and "occupation_major" in survey.columns:
            rows = baselines.country_rows(survey, fv.SURVEY_COLUMNS["country"], codes)
            rows = rows.withColumnsRenamed({income: "income"}).drop(category)
            rows = rows.withColumnRenamed("occupation_major", "category")
            majors = weights.groups_with_major(spark).join(dim.select("grp"), "grp", "left_semi")
            w = weights.survey_weights(rows, majors, w)
    base = baselines.real_or_prior(real, prior)
    return weights.attach_weights(base, w)


def audit_panel(metadata: DataFrame, phenotype: DataFrame, key: str = "image_id") -> DataFrame:
    """Panel with the audit's column names (country proxy renamed, generic flag and bin)."""
    joined = panel.build_panel(metadata, phenotype, key)
    names = {
        "country_proxy": "country",
        "occupation": "grp",
        "has_face": "has_signal",
        "consensus_bin": "bin",
    }
    return joined.withColumnsRenamed({k: v for k, v in names.items() if k in joined.columns})


def group_table(
    panel_rows: DataFrame,
    baseline: DataFrame,
    cell_keys: Sequence[str] = CELL_KEYS,
    group_key: str = "grp",
    bins: Sequence[int] = fv.BINS,
    bin_col: str = "bin",
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Distance, shift, weight and signed distance per (cell, group).

    ``countries`` expands catch-all cells to one row per country before the join.
    """
    hist = distributions.ordinal_histogram(panel_rows, [*cell_keys, group_key], bin_col, bins)
    if countries is not None:
        hist = distributions.expand_multi(hist, countries)
    on = [k for k in ("country", group_key) if k in baseline.columns and k in hist.columns]
    return distributions.group_metrics(hist, baseline, on, bins)


def index_by_cell(group_rows: DataFrame, cell_keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    return distributions.weighted_index(group_rows, cell_keys)


def index_with_interval(
    panel_rows: DataFrame,
    baseline: DataFrame,
    cell_keys: Sequence[str] = CELL_KEYS,
    group_key: str = "grp",
    bins: Sequence[int] = fv.BINS,
    n_replicates: int = fv.N_REPLICATES,
    ci_level: float = fv.CI_LEVEL,
    seed: int = fv.BASE_SEED,
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Index with bootstrap interval per cell, one plan from panel to result."""
    hist = distributions.ordinal_histogram(panel_rows, [*cell_keys, group_key], bins=bins)
    if countries is not None:
        hist = distributions.expand_multi(hist, countries)
    on = [k for k in ("country", group_key) if k in baseline.columns and k in hist.columns]
    return bootstrap.bootstrap_by_cell(
        hist, baseline, cell_keys, on, group_key, bins, n_replicates, ci_level, seed
    )


def sensitivity(
    panel_rows: DataFrame,
    baseline: DataFrame,
    sources: Sequence[str],
    cell_keys: Sequence[str] = CELL_KEYS,
    group_key: str = "grp",
    bins: Sequence[int] = fv.BINS,
    concordant_col: str | None = None,
) -> DataFrame:
    """Index per single source column, plus the fully concordant subset.

    The sources are stacked in one projection, so the panel is scanned and
    shuffled once for all of them. ``median_delta`` is the unweighted median
    shift over groups.
    """
    variants = [F.struct(F.lit(s).alias("variant"), F.col(s).cast("int").alias("__bin")) for s in sources]
    if concordant_col:
        variants += [
            F.struct(
                F.lit("concordant_only").alias("variant"),
                F.when(F.col(concordant_col), F.col(sources[0]).cast("int")).alias("__bin"),
            )
        ]
    flag = ["has_signal"] if "has_signal" in panel_rows.columns else []
    stacked = panel_rows.select(*cell_keys, group_key, *flag, F.inline(F.array(*variants)))
    hist = distributions.ordinal_histogram(stacked, [*cell_keys, group_key, "variant"], "__bin", bins)
    on = [k for k in ("country", group_key) if k in baseline.columns]
    metrics = distributions.group_metrics(hist, baseline, on, bins)
    # One shift per group: the median holds at most as many values as groups.
    medians = metrics.groupBy(*cell_keys, "variant").agg(F.median("delta").alias("median_delta"))
    index = distributions.weighted_index(metrics, [*cell_keys, "variant"])
    return index.join(medians, [*cell_keys, "variant"])
