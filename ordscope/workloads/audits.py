"""Distribution, weight, index and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import distances
from ordscope.operators import baselines, bootstrap, distributions, imputation, weights
from ordscope.plans import audit
from ordscope.session import materialise
from ordscope.sources.dimensions import groups_dim
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import query, r, tidy

KEYS = [*b.CELL, "grp"]
OBS_SQL = f"WITH {b.PANEL_SQL}, {b.BINS_SQL}, {b.hist_sql('obs', 'country, language, model, grp')}"
INDEX_SQL = f"WITH {b.PANEL_SQL}, {b.BINS_SQL}, {b.METRICS_SQL}"


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the panel: everything the index needs, per (cell, group)."""
    rows = b.panel(spark, sf_dir)
    every = [F.count_if(F.col("bin") == x) for x in fv.BINS]
    counted = distributions.count_bins(
        rows,
        KEYS,
        extra=(
            F.array(*every).alias("all_counts"),
            F.sum("income").alias("income_sum"),
        ),
    )
    # Observed side and baseline both come from these few rows: count once.
    return materialise(counted, "cells")


def baseline_of(cells: DataFrame) -> DataFrame:
    """Baseline and weight per (country, group), rolled up from the cell counts."""
    rolled = cells.groupBy("country", "grp").agg(
        F.array(*[F.sum(F.get("all_counts", F.lit(i))) for i in range(len(fv.BINS))]).alias("counts"),
        (F.sum("income_sum") / F.sum("n_rows")).alias("income"),
    )
    rolled = rolled.withColumn(
        "n_support", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    )
    base = distributions.with_probabilities(rolled, name="base_probs")
    return weights.percentile_rank_weights(base).select("country", "grp", "base_probs", "income", "weight")


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cell_counts(spark, sf_dir)
    observed = distributions.with_probabilities(cells).drop("all_counts", "income_sum")
    return distributions.group_metrics(observed, baseline_of(cells), ["country", "grp"])


@query(
    "A1_ordinal_histogram",
    OBS_SQL + f" SELECT country, language, model, grp, CAST(bin AS BIGINT) AS bin, n, n_rows, {r('prob')} AS prob, is_uniform_fallback FROM obs",
)
def a1(spark, sf_dir):
    hist = distributions.ordinal_histogram(b.panel(spark, sf_dir), KEYS)
    long = distributions.to_long(
        hist, KEYS, arrays=("counts", "probs"), names=("n", "prob"), keep=("n_rows", "is_uniform_fallback")
    )
    return tidy(long)


SURVEY_TIER_SQL = f"""WITH {b.SURVEY_SQL}, {b.BINS_SQL},
valid AS (SELECT * FROM survey WHERE colorr BETWEEN 1 AND 11 AND edre BETWEEN 0 AND 6),
tiered AS (
  SELECT *, colorr AS bin, CASE WHEN edre IN (5, 6) THEN 'high' WHEN edre IN (3, 4) THEN 'medium' ELSE 'low' END AS tier
  FROM valid
),
names(code, country) AS ({b.sql_values([(v, k) for k, v in b.REGION_CODES.items()])}),
tiers(tier) AS (VALUES ('high'), ('medium'), ('low')),
counts AS (SELECT pais, tier, bin, count(*) AS n, sum(weight) AS w FROM tiered GROUP BY pais, tier, bin),
present AS (SELECT DISTINCT pais FROM valid),
dense AS (
  SELECT names.country, t.tier, bins.bin, coalesce(c.n, 0) AS n, coalesce(c.w, 0) AS w,
         CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY names.country, t.tier) AS BIGINT) AS n_respondents,
         sum(coalesce(c.w, 0)) OVER (PARTITION BY names.country, t.tier) AS w_total
  FROM present p JOIN names ON names.code = p.pais CROSS JOIN tiers t CROSS JOIN bins
  LEFT JOIN counts c ON c.pais = p.pais AND c.tier = t.tier AND c.bin = bins.bin
),
tier_dist AS (
  SELECT *, CASE WHEN n_respondents = 0 THEN 1.0::DOUBLE / 11 ELSE n::DOUBLE / n_respondents END AS prob,
         CASE WHEN n_respondents = 0 THEN 1.0::DOUBLE / 11 ELSE w::DOUBLE / w_total END AS wprob FROM dense
)"""


@query(
    "A2_tier_distribution",
    SURVEY_TIER_SQL
    + f" SELECT country, tier, CAST(bin AS BIGINT) AS bin, {r('prob')} AS prob, {r('wprob')} AS weighted_prob, n_respondents, n_respondents < 30 AS low_n FROM tier_dist",
)
def a2(spark, sf_dir):
    rows = baselines.survey_rows(b.survey(spark, sf_dir), b.REGION_CODES)
    plain = baselines.tier_distributions(rows)
    weighted = baselines.tier_distributions(rows, weight_col="weight")
    keys = ["country", "tier"]
    both = plain.join(weighted.select(*keys, F.col("base_probs").alias("weighted_probs")), keys)
    return tidy(
        distributions.to_long(
            both, keys, arrays=("base_probs", "weighted_probs"), names=("prob", "weighted_prob"),
            keep=("n_respondents", "low_n"),
        )
    )


GROUP_TIERS_SQL = f"groups(grp, tier, centre, idx) AS ({b.sql_values([(g[0], g[5], g[6], i) for i, g in enumerate(fv.GROUPS)])})"
SURVEY_GROUND_SQL = SURVEY_TIER_SQL + f", {GROUP_TIERS_SQL}"


@query(
    "A3_survey_ground_truth",
    SURVEY_GROUND_SQL
    + f" SELECT d.country, g.grp, CAST(bin AS BIGINT) AS bin, {r('prob')} AS prob, false AS is_synthetic, n_respondents, g.tier FROM tier_dist d JOIN groups g ON g.tier = d.tier",
)
def a3(spark, sf_dir):
    base = baselines.survey_baseline(b.survey(spark, sf_dir), groups_dim(spark), b.REGION_CODES)
    return tidy(baselines.baseline_long(base).drop("low_n"))


PRIOR_SQL = """prior AS (
  SELECT grp, bin, exp(-0.5 * ((bin - centre) / 1.7) ** 2) / sum(exp(-0.5 * ((bin - centre) / 1.7) ** 2)) OVER (PARTITION BY grp) AS prob
  FROM groups CROSS JOIN bins
)"""


@query(
    "A4_real_or_prior",
    SURVEY_GROUND_SQL
    + f""", {PRIOR_SQL},
real AS (SELECT d.country, g.grp, bin, prob, false AS is_synthetic FROM tier_dist d JOIN groups g ON g.tier = d.tier WHERE d.country <> 'ASIA'),
wanted AS (SELECT names.country, p.grp, p.bin, p.prob, true AS is_synthetic FROM names CROSS JOIN prior p),
merged AS (SELECT * FROM real UNION ALL SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM real x WHERE x.country = w.country AND x.grp = w.grp))
SELECT country, grp, CAST(bin AS BIGINT) AS bin, {r('prob')} AS prob, is_synthetic FROM merged""",
)
def a4(spark, sf_dir):
    codes = {k: v for k, v in b.REGION_CODES.items() if k != "ASIA"}  # one country without a survey
    real = baselines.survey_baseline(b.survey(spark, sf_dir), groups_dim(spark), codes)
    prior = baselines.prior_baseline(groups_dim(spark), list(b.REGION_CODES))
    merged = baselines.real_or_prior(real, prior).select("country", "grp", "base_probs", "is_synthetic")
    return tidy(baselines.baseline_long(merged))


@query(
    "A5_prior_distribution",
    f"""WITH {b.PANEL_SQL}, {b.BINS_SQL},
centres AS (SELECT country, grp, 1 + 10 * avg(coalesce(has_signal, false)::INTEGER) AS centre FROM panel GROUP BY country, grp),
dens AS (SELECT country, grp, bin, exp(-0.5 * ((bin - centre) / 1.7) ** 2) AS d FROM centres CROSS JOIN bins)
SELECT country, grp, CAST(bin AS BIGINT) AS bin, {r('d / sum(d) OVER (PARTITION BY country, grp)')} AS prob FROM dens""",
)
def a5(spark, sf_dir):
    rates = distributions.signal_rate(b.panel(spark, sf_dir), ["country", "grp"])
    priors = rates.select("country", "grp", baselines.prior_probs(1 + 10 * F.col("signal_rate")).alias("base_probs"))
    return tidy(baselines.baseline_long(priors))


@query(
    "A6_wasserstein",
    INDEX_SQL + f" SELECT country, language, model, grp, {r('distance')} AS distance FROM signed",
)
def a6(spark, sf_dir):
    cells = cell_counts(spark, sf_dir)
    observed = distributions.with_probabilities(cells).drop("all_counts", "income_sum")
    joined = distributions.group_metrics(observed, baseline_of(cells), ["country", "grp"], validate=True)
    return tidy(joined.select(*KEYS, "distance"))


@query(
    "A7_expected_bin",
    OBS_SQL + f" SELECT country, language, model, grp, {r('sum(prob * bin)', 9)} AS expected_bin FROM obs GROUP BY ALL",
)
def a7(spark, sf_dir):
    hist = distributions.ordinal_histogram(b.panel(spark, sf_dir), KEYS)
    return tidy(hist.select(*KEYS, distances.expected_bin(F.col("probs"), validate=True).alias("expected_bin")), 9)


@query(
    "A8_signed_shift",
    INDEX_SQL + f" SELECT country, language, model, grp, {r('delta')} AS delta FROM signed",
)
def a8(spark, sf_dir):
    return tidy(metrics_of(spark, sf_dir).select(*KEYS, "delta"))


@query(
    "A9_group_metrics",
    INDEX_SQL
    + f" SELECT country, language, model, grp, n_rows, {r('distance')} AS distance, {r('delta')} AS delta, {r('weight')} AS weight, {r('signed_distance')} AS signed_distance FROM signed",
)
def a9(spark, sf_dir):
    cols = [*KEYS, "n_rows", "distance", "delta", "weight", "signed_distance"]
    return tidy(metrics_of(spark, sf_dir).select(*cols))


@query(
    "A10_weighted_index",
    INDEX_SQL
    + f" SELECT country, language, model, {r('sum(weight * signed_distance)')} AS index_value, CAST(sum(n_rows) AS BIGINT) AS n_units, count(*) AS n_groups, {r('sum(weight)')} AS covered_weight, count(*) - count(weight) AS n_missing_weight FROM signed GROUP BY country, language, model",
)
def a10(spark, sf_dir):
    return tidy(audit.index_by_cell(metrics_of(spark, sf_dir)))


@query(
    "A11_group_table",
    INDEX_SQL
    + f" SELECT grp, model, count(*) AS n_cells, {r('avg(distance)')} AS mean_distance, {r('avg(delta)')} AS mean_delta, {r('min(signed_distance)')} AS lowest, {r('max(signed_distance)')} AS highest FROM signed GROUP BY grp, model",
)
def a11(spark, sf_dir):
    """Group table through the public plan, summarised over cells."""
    cells = cell_counts(spark, sf_dir)
    rows = audit.group_table(b.panel(spark, sf_dir), baseline_of(cells))
    return tidy(
        rows.groupBy("grp", "model").agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.avg("distance").alias("mean_distance"),
            F.avg("delta").alias("mean_delta"),
            F.min("signed_distance").alias("lowest"),
            F.max("signed_distance").alias("highest"),
        )
    )


def _draw_sql(n_replicates: int) -> str:
    """The chain of binomials per (group, replicate), inverted on summed probabilities; then replicate metrics."""
    bins = list(fv.BINS)
    counts = ", ".join(f"CAST(coalesce(max(o.n) FILTER (o.bin = {x}), 0) AS BIGINT) AS c{x}" for x in bins)
    steps = [
        f"""
gg AS (
  SELECT k.country, k.language, k.model, k.grp, CAST(k.n_rows AS BIGINT) AS n_rows, {counts}
  FROM obs_keys k LEFT JOIN obs o ON o.country = k.country AND o.language = k.language AND o.model = k.model AND o.grp = k.grp
  GROUP BY ALL
),
d0 AS (
  SELECT *, '{fv.BASE_SEED}|' || country || '|' || language || '|' || model || '|' || grp AS gid, n_rows AS lft, n_rows AS rst
  FROM gg CROSS JOIN (SELECT unnest(range(0, {n_replicates})) AS rep)
)"""
    ]
    for i, x in enumerate(bins):
        digits = "substr(h, 1, 15)" if i % 2 == 0 else "substr(h, 17, 15)"
        steps.append(f"""
q{x} AS (SELECT DISTINCT gid, lft, rst, c{x} AS c FROM d{i} WHERE lft > 0 AND c{x} > 0 AND c{x} < rst),
f{x} AS (
  SELECT gid, lft, k, sum(exp(lgamma(lft + 1.0) - lgamma(k + 1.0) - lgamma(lft - k + 1.0) + k * ln(c::DOUBLE / rst) + (lft - k) * ln(1.0 - c::DOUBLE / rst)))
    OVER (PARTITION BY gid, lft ORDER BY k) AS f
  FROM (SELECT *, unnest(range(0, lft + 1)) AS k FROM q{x})
),
u{x} AS (
  SELECT *, (('0x' || {digits})::BIGINT::DOUBLE + 0.5) / {1 << 60}.0::DOUBLE AS u FROM (SELECT *, md5(gid || '|' || rep || '|{i // 2}') AS h FROM d{i})
),
d{x} AS (
  SELECT * EXCLUDE (u, h, lft, rst, k), k AS k{x}, lft - k AS lft, rst - c{x} AS rst FROM (
    SELECT u.*, CASE WHEN c{x} = 0 OR u.lft = 0 THEN 0 WHEN c{x} = rst THEN u.lft ELSE coalesce(t.k, u.lft) END AS k
    FROM u{x} u ASOF LEFT JOIN f{x} t ON t.gid = u.gid AND t.lft = u.lft AND u.u <= t.f)
)""")
    last = bins[-1]
    dense = " UNION ALL ".join(
        f"SELECT country, language, model, grp, rep, {x} AS bin, k{x} AS n, n_rows - lft AS tot FROM d{last}" for x in bins
    )
    steps.append(f"""
rep_dense AS ({dense}),
rep_diff AS (
  SELECT e.country, e.language, e.model, e.grp, e.rep, e.bin,
         CASE WHEN tot = 0 THEN 1.0::DOUBLE / {len(bins)} ELSE e.n::DOUBLE / tot END - b.prob AS diff
  FROM rep_dense e JOIN base b ON b.country = e.country AND b.grp = e.grp AND b.bin = e.bin
),
rep_cdf AS (
  SELECT *, sum(diff) OVER (PARTITION BY country, language, model, grp, rep ORDER BY bin) AS cdf_diff FROM rep_diff
),
rep_metric AS (
  SELECT country, language, model, grp, rep, sum(CASE WHEN bin < {last} THEN abs(cdf_diff) ELSE 0 END) AS distance, sum(diff * bin) AS delta
  FROM rep_cdf GROUP BY ALL
)""")
    return ",".join(steps)


def _interval_sql(n_replicates: int) -> str:
    return (
        INDEX_SQL
        + ","
        + _draw_sql(n_replicates)
        + f""",
rep_index AS (
  SELECT m.country, m.language, m.model, m.rep, sum(CASE WHEN abs(m.delta) < 1e-12 THEN 0 ELSE w.weight * m.distance * sign(m.delta) END) AS index_value
  FROM rep_metric m JOIN weights w ON w.country = m.country AND w.grp = m.grp GROUP BY ALL
),
ci AS (
  SELECT country, language, model, quantile_cont(index_value, 0.025) AS lo, quantile_cont(index_value, 0.975) AS hi, count(*) AS n_replicates
  FROM rep_index GROUP BY ALL
),
point AS (
  SELECT country, language, model, sum(weight * signed_distance) AS index_value, CAST(sum(n_rows) AS BIGINT) AS n_units, count(*) AS n_groups
  FROM signed GROUP BY ALL
)
SELECT p.country, p.language, p.model, {r('p.index_value')} AS index_value, {r('ci.lo')} AS index_lower, {r('ci.hi')} AS index_upper,
       p.n_units, p.n_groups, ci.n_replicates, 0.95::DOUBLE AS ci_level
FROM point p JOIN ci ON ci.country = p.country AND ci.language = p.language AND ci.model = p.model"""
    )


INTERVAL_COLUMNS = [*b.CELL, "index_value", "index_lower", "index_upper", "n_units", "n_groups", "n_replicates", "ci_level"]


@query(
    "A12_bootstrap_groups",
    INDEX_SQL
    + ","
    + _draw_sql(fv.N_REPLICATES)
    + f""",
bounds AS (
  SELECT country, language, model, grp, quantile_cont(distance, 0.025) AS distance_lower, quantile_cont(distance, 0.975) AS distance_upper,
         quantile_cont(delta, 0.025) AS delta_lower, quantile_cont(delta, 0.975) AS delta_upper, count(*) AS n_replicates
  FROM rep_metric GROUP BY ALL
)
SELECT s.country, s.language, s.model, s.grp, {r('weight')} AS weight, CAST(n_rows AS BIGINT) AS n_rows, {r('distance')} AS distance, {r('delta')} AS delta,
  {r('distance_lower')} AS distance_lower, {r('distance_upper')} AS distance_upper, {r('delta_lower')} AS delta_lower, {r('delta_upper')} AS delta_upper,
  n_replicates, 0.95::DOUBLE AS ci_level
FROM signed s JOIN bounds i ON i.country = s.country AND i.language = s.language AND i.model = s.model AND i.grp = s.grp""",
)
def a12(spark, sf_dir):
    reps = bootstrap.replicate_table(metrics_of(spark, sf_dir), b.CELL)
    return tidy(bootstrap.group_intervals(reps))


@query("A13_bootstrap_by_cell", _interval_sql(fv.N_REPLICATES))
def a13(spark, sf_dir):
    """Interval per cell, with the number of replicates as an argument."""
    cells = cell_counts(spark, sf_dir)
    hist = distributions.with_probabilities(cells).drop("all_counts", "income_sum")
    out = bootstrap.bootstrap_by_cell(hist, baseline_of(cells), b.CELL, ["country", "grp"])
    return tidy(out.select(*INTERVAL_COLUMNS))


@query("L4_index_with_interval", _interval_sql(fv.N_REPLICATES))
def l4(spark, sf_dir):
    """Flagship: index with a 1 000-replicate interval per cell, from the panel's rows."""
    cells = cell_counts(spark, sf_dir)
    out = audit.index_with_interval(b.panel(spark, sf_dir), baseline_of(cells), b.CELL)
    return tidy(out.select(*INTERVAL_COLUMNS))


@query(
    "A14_mean_and_median",
    f"""WITH {b.PANEL_SQL},
means AS (SELECT country, grp, avg(income) AS mean_value FROM panel GROUP BY country, grp),
med AS (SELECT country, quantile_cont(income, 0.5) AS overall_median FROM panel GROUP BY country)
SELECT country, grp, {r('mean_value')} AS mean_value, {r('overall_median')} AS overall_median FROM means JOIN med USING (country)""",
)
def a14(spark, sf_dir):
    from ordscope.operators.quantiles import exact_quantiles

    rows = b.panel(spark, sf_dir)
    means = weights.mean_by_key(rows, ["country", "grp"], "income")
    medians = exact_quantiles(rows, ["country"], "income", {"overall_median": 0.5}).drop("n")
    return tidy(means.join(medians, "country"))


@query(
    "W1_percentile_rank_weights",
    f"WITH {b.PANEL_SQL}, {b.WEIGHTS_SQL} SELECT country, grp, {r('income')} AS income, {r('pct_rank')} AS pct_rank, {r('weight')} AS weight FROM weights",
)
def w1(spark, sf_dir):
    incomes = weights.mean_by_key(b.panel(spark, sf_dir), ["country", "grp"], "income")
    ranked = weights.percentile_rank_weights(incomes.withColumnRenamed("mean_value", "income"))
    return tidy(ranked)


W2_SQL = f"""WITH {b.SURVEY_SQL},
names(code, country) AS ({b.sql_values([(v, k) for k, v in b.REGION_CODES.items() if k != 'ASIA'])}),
groups(grp, major) AS ({b.sql_values([(g[0], int(g[4])) for g in fv.GROUPS])}),
prior_income(grp, income) AS ({b.sql_values([(g, float(i)) for g, i in fv.PRIOR_INCOME['CO'].items()])}),
valid AS (
  SELECT n.country, s.occup AS major, TRY_CAST(s.income AS DOUBLE) AS x FROM survey s JOIN names n ON n.code = s.pais
  WHERE TRY_CAST(s.income AS DOUBLE) IS NOT NULL AND TRY_CAST(s.income AS DOUBLE) NOT IN (88, 98, 99, 888888, 999999, -1)
),
means AS (SELECT country, major, avg(x) AS m FROM valid WHERE major IS NOT NULL GROUP BY country, major),
med AS (SELECT country, quantile_cont(x, 0.5) AS md FROM valid GROUP BY country),
survey_income AS (
  SELECT med.country, g.grp, coalesce(means.m, med.md) AS income, 'survey' AS weight_source
  FROM med CROSS JOIN groups g LEFT JOIN means ON means.country = med.country AND means.major = g.major
),
all_income AS (
  SELECT * FROM survey_income UNION ALL
  SELECT c.country, p.grp, p.income, 'prior' FROM (VALUES ('ASIA'), ('AFRICA'), ('AMERICA'), ('EUROPE'), ('MIDDLE EAST')) c(country) CROSS JOIN prior_income p
  WHERE c.country NOT IN (SELECT country FROM survey_income)
),
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY country ORDER BY income) + (count(*) OVER (PARTITION BY country, income) - 1) / 2.0) / count(*) OVER (PARTITION BY country) AS pct
  FROM all_income
)
SELECT country, grp, {r('income')} AS income, {r('pct / sum(pct) OVER (PARTITION BY country)')} AS weight, weight_source FROM ranked"""


def survey_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {k: v for k, v in b.REGION_CODES.items() if k != "ASIA"}
    rows = baselines.country_rows(b.survey(spark, sf_dir), "pais", codes)
    rows = rows.select("country", "income", F.col("occup").alias("category"))
    prior_income = weights.prior_weights(spark, ["CO"]).select("grp", "income")
    listed = prior_income.select(
        F.explode(F.array(*[F.lit(c) for c in b.REGION_CODES])).alias("country"), "grp", "income"
    )
    prior = weights.percentile_rank_weights(listed).withColumn("weight_source", F.lit("prior"))
    return weights.survey_weights(rows, weights.groups_with_major(spark), prior)


@query("W2_survey_weights", W2_SQL)
def w2(spark, sf_dir):
    return tidy(survey_weight_table(spark, sf_dir))


@query(
    "L1_ground_truth_one_country",
    SURVEY_GROUND_SQL
    + f""",
w_src AS (SELECT * FROM ({W2_SQL}))
SELECT d.country, g.grp, CAST(bin AS BIGINT) AS bin, {r('prob')} AS prob, false AS is_synthetic, w.weight
FROM tier_dist d JOIN groups g ON g.tier = d.tier JOIN w_src w ON w.country = d.country AND w.grp = g.grp
WHERE d.country = 'AFRICA'""",
)
def l1(spark, sf_dir):
    codes = {"AFRICA": b.REGION_CODES["AFRICA"]}
    base = baselines.survey_baseline(b.survey(spark, sf_dir), groups_dim(spark), codes)
    full = weights.attach_weights(base, survey_weight_table(spark, sf_dir))
    return tidy(baselines.baseline_long(full).drop("low_n", "tier", "n_respondents"))


@query(
    "L2_ground_truth_all",
    SURVEY_GROUND_SQL
    + f""", {PRIOR_SQL},
w_src AS (SELECT * FROM ({W2_SQL})),
real AS (SELECT d.country, g.grp, bin, prob, false AS is_synthetic FROM tier_dist d JOIN groups g ON g.tier = d.tier WHERE d.country <> 'ASIA'),
merged AS (SELECT * FROM real UNION ALL SELECT 'ASIA', p.grp, p.bin, p.prob, true FROM prior p)
SELECT m.country, m.grp, CAST(bin AS BIGINT) AS bin, {r('prob')} AS prob, m.is_synthetic, w.weight
FROM merged m JOIN w_src w ON w.country = m.country AND w.grp = m.grp""",
)
def l2(spark, sf_dir):
    codes = {k: v for k, v in b.REGION_CODES.items() if k != "ASIA"}
    real = baselines.survey_baseline(b.survey(spark, sf_dir), groups_dim(spark), codes)
    base = baselines.real_or_prior(real, baselines.prior_baseline(groups_dim(spark), list(b.REGION_CODES)))
    full = weights.attach_weights(base, survey_weight_table(spark, sf_dir))
    cols = full.select("country", "grp", "base_probs", "is_synthetic", "weight")
    return tidy(baselines.baseline_long(cols))


@query(
    "L3_panel_signal_rate",
    f"WITH {b.PANEL_SQL} SELECT country, model, count(*) AS n_rows, {r('avg(coalesce(has_signal, false)::INTEGER)')} AS signal_rate FROM panel GROUP BY country, model",
)
def l3(spark, sf_dir):
    return tidy(distributions.signal_rate(b.panel(spark, sf_dir), ["country", "model"]))


@query(
    "A31_signal_rate",
    f"WITH {b.PANEL_SQL} SELECT count(*) AS n_rows, {r('avg(coalesce(has_signal, false)::INTEGER)')} AS signal_rate FROM panel",
)
def a31(spark, sf_dir):
    return tidy(distributions.signal_rate(b.panel(spark, sf_dir)))


@query(
    "J11_multi_country_baseline",
    f"""WITH {b.PANEL_SQL}, {b.BINS_SQL}, {b.hist_sql('base', 'country, grp', 'true')},
mpanel AS (SELECT *, CASE WHEN language = 'N' THEN 'MULTI' ELSE country END AS cell_country FROM panel),
obs AS (
  SELECT cell_country, language, model, grp, bin, count(*) FILTER (WHERE coalesce(has_signal, false)) AS n FROM mpanel WHERE bin IS NOT NULL GROUP BY ALL
),
cells AS (SELECT cell_country, language, model, grp, count(*) AS n_rows FROM mpanel GROUP BY ALL),
dense AS (
  SELECT c.cell_country, c.language, c.model, c.grp, c.n_rows, bins.bin, coalesce(o.n, 0) AS n,
         sum(coalesce(o.n, 0)) OVER (PARTITION BY c.cell_country, c.language, c.model, c.grp) AS tot
  FROM cells c CROSS JOIN bins LEFT JOIN obs o ON o.cell_country = c.cell_country AND o.language = c.language AND o.model = c.model AND o.grp = c.grp AND o.bin = bins.bin
)
SELECT b.country, d.cell_country = 'MULTI' AS is_multi, d.language, d.model, d.grp, d.n_rows,
       {r('sum((CASE WHEN tot = 0 THEN 1.0::DOUBLE / 11 ELSE d.n::DOUBLE / tot END - b.prob) * d.bin)')} AS delta
FROM dense d JOIN base b ON b.grp = d.grp AND b.bin = d.bin AND (b.country = d.cell_country OR d.cell_country = 'MULTI')
GROUP BY ALL""",
)
def j11(spark, sf_dir):
    """Catch-all cells are compared with every country's baseline."""
    rows = b.panel(spark, sf_dir)
    cells = cell_counts(spark, sf_dir)
    multi = rows.withColumn("country", F.when(F.col("language") == "N", fv.MULTI_COUNTRY).otherwise(F.col("country")))
    table = audit.group_table(multi, baseline_of(cells), countries=list(b.REGION_CODES))
    return tidy(table.select("country", "is_multi", "language", "model", "grp", "n_rows", "delta"))


@query(
    "J2_attach_weights",
    f"""WITH {b.PANEL_SQL}, {b.WEIGHTS_SQL}, kept AS (SELECT * FROM weights WHERE grp <> 'Brand#7')
SELECT p.country, p.grp, count(*) AS n_rows, count(*) FILTER (WHERE k.weight IS NULL) AS n_missing_weight, {r('coalesce(max(k.weight), -1)')} AS weight
FROM panel p LEFT JOIN kept k ON k.country = p.country AND k.grp = p.grp GROUP BY p.country, p.grp""",
)
def j2(spark, sf_dir):
    rows = b.panel(spark, sf_dir)
    kept = baseline_of(cell_counts(spark, sf_dir)).where(F.col("grp") != "Brand#7")
    joined = weights.attach_weights(rows, kept)
    return tidy(
        joined.groupBy("country", "grp").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("weight").isNull()).alias("n_missing_weight"),
            F.coalesce(F.max("weight"), F.lit(-1.0)).alias("weight"),
        )
    )


@query(
    "J10_dense_support",
    OBS_SQL + " SELECT country, CAST(bin AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS n FROM obs GROUP BY country, bin",
)
def j10(spark, sf_dir):
    hist = distributions.count_bins(b.panel(spark, sf_dir), ["country"])
    return tidy(distributions.to_long(hist, ["country"], arrays=("counts",), names=("n",)))


@query(
    "W5_cumulative_distribution",
    OBS_SQL
    + f" SELECT country, language, model, grp, CAST(bin AS BIGINT) AS bin, {r('sum(prob) OVER (PARTITION BY country, language, model, grp ORDER BY bin)')} AS cdf FROM obs",
)
def w5(spark, sf_dir):
    hist = distributions.ordinal_histogram(b.panel(spark, sf_dir), KEYS)
    hist = hist.withColumn("cdf", distances.cumulative(F.col("probs")))
    return tidy(distributions.to_long(hist, KEYS, arrays=("cdf",), names=("cdf",)))


X4_SQL = f"""WITH {b.PANEL_SQL}, {b.BINS_SQL}, {b.METRICS_SQL},
stacked AS (
  SELECT country, language, model, grp, has_signal, 'quantity' AS variant, CAST(bin AS INTEGER) AS bin FROM panel
  UNION ALL SELECT country, language, model, grp, has_signal, 'price', CAST(floor(l_extendedprice / 10000.0) AS INTEGER) + 1 FROM panel
  UNION ALL SELECT country, language, model, grp, has_signal, 'concordant_only',
    CASE WHEN abs(bin - (CAST(floor(l_extendedprice / 10000.0) AS INTEGER) + 1)) <= 2 THEN CAST(bin AS INTEGER) END FROM panel
), {b.hist_sql('var', 'country, language, model, grp, variant', source='stacked')},
vdiff AS (
  SELECT v.country, v.language, v.model, v.grp, v.variant, v.n_rows, v.bin, v.prob - b.prob AS diff,
         sum(v.prob - b.prob) OVER (PARTITION BY v.country, v.language, v.model, v.grp, v.variant ORDER BY v.bin) AS cdf_diff
  FROM var v JOIN base b ON b.country = v.country AND b.grp = v.grp AND b.bin = v.bin
),
vmetric AS (
  SELECT country, language, model, grp, variant, sum(CASE WHEN bin < 11 THEN abs(cdf_diff) ELSE 0 END) AS distance, sum(diff * bin) AS delta
  FROM vdiff GROUP BY ALL
)
SELECT m.country, m.language, m.model, m.variant, {r('sum(CASE WHEN abs(m.delta) < 1e-12 THEN 0 ELSE w.weight * m.distance * sign(m.delta) END)')} AS index_value, {r('median(m.delta)')} AS median_delta
FROM vmetric m JOIN weights w ON w.country = m.country AND w.grp = m.grp GROUP BY ALL"""


@query("X4_index_per_source", X4_SQL)
def x4(spark, sf_dir):
    price = (F.floor(F.col("l_extendedprice") / 10000.0) + 1).cast("int")
    rows = b.panel(spark, sf_dir).withColumns(
        {"quantity": F.col("bin"), "price": price, "close": F.abs(F.col("bin") - price) <= 2}
    )
    out = audit.sensitivity(
        rows, baseline_of(cell_counts(spark, sf_dir)), ["quantity", "price"], concordant_col="close"
    )
    return tidy(out.select(*b.CELL, "variant", "index_value", "median_delta"))


@query(
    "X5_category_imputation",
    f"""WITH {b.SURVEY_SQL}, {b.BINS_SQL},
ref AS (SELECT category, colorr AS bin FROM survey WHERE colorr BETWEEN 1 AND 11),
given AS (SELECT category, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY category) AS p FROM ref GROUP BY category, bin),
shares AS (
  SELECT pais, edre, category, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pais, edre) AS s FROM survey GROUP BY pais, edre, category
)
SELECT CAST(pais AS VARCHAR) AS country, CAST(edre AS VARCHAR) AS grp, CAST(bins.bin AS BIGINT) AS bin, {r('sum(s * coalesce(g.p, 0))')} AS prob
FROM shares CROSS JOIN bins LEFT JOIN given g ON g.category = shares.category AND g.bin = bins.bin GROUP BY ALL""",
)
def x5(spark, sf_dir):
    rows = b.survey(spark, sf_dir)
    reference = rows.where(F.col("colorr").between(1, 11)).select("category", F.col("colorr").alias("bin"))
    target = rows.select(F.col("pais").alias("country"), F.col("edre").cast("string").alias("grp"), "category")
    out = imputation.category_imputation(reference, target)
    return tidy(baselines.baseline_long(out))
