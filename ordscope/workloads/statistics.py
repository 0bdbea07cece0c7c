"""Regression, agreement and testing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators import agreement, merge, regression
from ordscope.plans import audit, estimation
from ordscope.plans import operations as plans
from ordscope.workloads import audits
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import f_sf_sql, normal_cdf_sql, query, r, t_cdf_sql, tidy
from ordscope.workloads.relational import META_SQL

# ---- gradients ---------------------------------------------------------------


@query(
    "A24_gradient",
    audits.INDEX_SQL
    + f" SELECT country, language, model, {r('regr_intercept(delta, weight)')} AS alpha, {r('regr_slope(delta, weight)')} AS beta, count(*) AS n_obs, {r('sqrt(greatest(regr_syy(delta, weight) - regr_slope(delta, weight) ** 2 * regr_sxx(delta, weight), 0) / count(*))')} AS sigma FROM signed GROUP BY ALL",
)
def a24(spark, sf_dir):
    return tidy(estimation.cell_gradients(audits.metrics_of(spark, sf_dir), b.CELL))


def _clustered_sql(name: str, cluster: str) -> str:
    return f"""
{name}_m AS (
  SELECT {cluster}, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM xy GROUP BY {cluster}
),
{name}_s AS (
  SELECT m.*, sy - line.a * m.n - line.b * sx AS s0, sxy - line.a * sx - line.b * sxx AS s1 FROM {name}_m m, line
),
{name} AS (
  SELECT count(*) AS n_clusters,
         (count(*)::DOUBLE / (count(*) - 1)) * ((sum(n) - 1) / (sum(n) - 2)) *
         ((sum(sx) / sum(n)) ** 2 * sum(s0 * s0) - 2 * (sum(sx) / sum(n)) * sum(s0 * s1) + sum(s1 * s1))
         / (sum(sxx) - sum(sx) ** 2 / sum(n)) ** 2 AS v
  FROM {name}_s
)"""


XY_SQL = """xy AS (SELECT l_quantity / 10.0 AS x, l_extendedprice / 10000.0 AS y, l_suppkey, l_linenumber FROM lineitem),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM xy)"""


def xy(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 10.0).alias("x"), (F.col("l_extendedprice") / 10000.0).alias("y"), "l_suppkey", "l_linenumber"
    )


def normal_p_sql(z: str) -> str:
    return f"{r('2.0 * ' + normal_cdf_sql(f'(-abs({z}))'))} AS p_two_sided, {r(normal_cdf_sql(f'({z})'))} AS p_one_sided"


@query(
    "A25_pooled_gradient",
    f"WITH {XY_SQL}, {_clustered_sql('c', 'l_suppkey')} SELECT {r('line.b')} AS beta, {r('line.a')} AS alpha, {r('sqrt(v)')} AS std_error, {r('line.b / sqrt(v)', 4)} AS t_statistic, line.n AS n_obs, n_clusters, {r('r2')} AS r_squared, 'l_suppkey' AS cluster_variable, {normal_p_sql('line.b / sqrt(v)')} FROM line, c",
)
def a25(spark, sf_dir):
    fit = regression.pooled_gradient(xy(spark, sf_dir), "x", "y", "l_suppkey")
    return tidy(fit.withColumn("t_statistic", F.round("t_statistic", 4)))


@query(
    "X3_two_way_gradient",
    f"WITH {XY_SQL}, {_clustered_sql('ca', 'l_suppkey')}, {_clustered_sql('cb', 'l_linenumber')}, {_clustered_sql('cab', 'l_suppkey, l_linenumber')} SELECT {r('line.b')} AS beta, {r('sqrt(ca.v + cb.v - cab.v)')} AS std_error, {normal_p_sql('line.b / sqrt(ca.v + cb.v - cab.v)')}, line.n AS n_obs, ca.n_clusters AS n_clusters_a, cb.n_clusters AS n_clusters_b, {r('r2')} AS r_squared FROM line, ca, cb, cab",
)
def x3(spark, sf_dir):
    fit = regression.two_way_gradient(xy(spark, sf_dir), "x", "y", "l_suppkey", "l_linenumber")
    return tidy(fit.drop("t_statistic"))


# ---- general least squares ----------------------------------------------------------

SCALING_SQL = """sc AS (
  SELECT l_extendedprice / 10000.0 AS y, ln(l_quantity + 1) AS x1, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS x2, l_returnflag AS f FROM lineitem
)"""


def scaling_rows(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 10000.0).alias("index_value"),
        F.log(F.col("l_quantity") + 1).alias("log_parameters"),
        F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("debias_explicit"),
        F.col("l_returnflag").alias("architecture_family"),
    )


@query(
    "A26_gram_matrix",
    f"""WITH {SCALING_SQL},
feat AS (
  SELECT y, 'Intercept' AS t, 1.0 AS v, row_number() OVER () AS id, x1, x2, f FROM sc
),
long AS (
  SELECT id, 'Intercept' AS t, 1.0::DOUBLE AS v FROM feat UNION ALL SELECT id, 'log_parameters', x1 FROM feat
  UNION ALL SELECT id, 'debias_explicit', x2 FROM feat UNION ALL SELECT id, 'architecture_family=' || f, 1.0 FROM feat
  UNION ALL SELECT id, '__y', y FROM feat
)
SELECT a.t AS i, b.t AS j, {r('sum(a.v * b.v)', 3)} AS value FROM long a JOIN long b ON a.id = b.id WHERE a.t <> '__y' OR b.t = '__y' GROUP BY a.t, b.t""",
)
def a26_gram(spark, sf_dir):
    spec = regression.OlsSpec("index_value", ("log_parameters", "debias_explicit"), ("architecture_family",))
    return tidy(regression.gram_matrix(scaling_rows(spark, sf_dir), spec), 3)


BALANCED_SQL = (
    audits.INDEX_SQL
    + f""",
idx AS (SELECT country, language, model, sum(weight * signed_distance) AS y FROM signed GROUP BY ALL),
fit AS (
  SELECT *, avg(y) OVER () AS m, avg(y) OVER (PARTITION BY country) AS mc, avg(y) OVER (PARTITION BY language) AS ml, avg(y) OVER (PARTITION BY model) AS mm FROM idx
),
ss AS (
  SELECT count(*) AS n, sum((ml - m) ** 2) AS ss_l, sum((y - mc - ml - mm + 2 * m) ** 2) AS rss, sum((y - m) ** 2) AS tss,
         count(DISTINCT language) - 1 AS q, count(DISTINCT country) + count(DISTINCT language) + count(DISTINCT model) - 2 AS k
  FROM fit
)
SELECT 'language' AS factor, {r('(ss_l / q) / (rss / (n - k))')} AS f_statistic,
  {r(f_sf_sql('((ss_l / q) / (rss / (n - k)))', 'q::DOUBLE', '(n - k)::DOUBLE'))} AS p_value, CAST(q AS BIGINT) AS df_num, (n - k)::DOUBLE AS df_den, n AS n_obs, {r('1 - rss / tss')} AS r_squared FROM ss"""
)


@query("A26_fixed_effects_test", BALANCED_SQL)
def a26(spark, sf_dir):
    """Joint F of the language effects; the SQL uses the closed form of a balanced table."""
    index = audit.index_by_cell(audits.metrics_of(spark, sf_dir))
    return tidy(regression.fixed_effects_test(index))


@query(
    "A27_scaling_test",
    f"""WITH {SCALING_SQL},
dm AS (SELECT y - avg(y) OVER (PARTITION BY f) AS y, x1 - avg(x1) OVER (PARTITION BY f) AS x1, x2 - avg(x2) OVER (PARTITION BY f) AS x2, y - avg(y) OVER () AS yc FROM sc),
s AS (SELECT sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy, sum(yc * yc) AS tss, count(*) AS n, (SELECT count(DISTINCT f) FROM sc) AS nf FROM dm),
fit AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 ** 2) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 ** 2) AS b2 FROM s),
e0 AS (SELECT *, syy - b1 * s1y - b2 * s2y AS rss, n - nf - 2 AS df FROM fit),
e AS (SELECT *, b1 / sqrt(rss / df * s22 / (s11 * s22 - s12 ** 2)) AS t FROM e0)
SELECT 'log_parameters' AS term, {r('b1')} AS estimate, {r('sqrt(rss / df * s22 / (s11 * s22 - s12 ** 2))')} AS std_error, {r('t', 4)} AS t_statistic,
  {r('2.0 * ' + t_cdf_sql('(-abs(t))', 'df::DOUBLE'))} AS p_two_sided, {r(t_cdf_sql('t', 'df::DOUBLE'))} AS p_one_sided, n AS n_obs, df::DOUBLE AS df_resid, {r('1 - rss / tss')} AS r_squared FROM e""",
)
def a27(spark, sf_dir):
    fit = regression.scaling_test(scaling_rows(spark, sf_dir))
    columns = ["term", "estimate", "std_error", "t_statistic", "p_two_sided", "p_one_sided", "n_obs", "df_resid", "r_squared"]
    return tidy(fit.select(*columns).withColumn("t_statistic", F.round("t_statistic", 4)))


MARKER_SQL = """mk AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'LatAm' WHEN 'R' THEN 'US' ELSE 'unmarked' END AS marker, l_linenumber AS occupation, l_linestatus AS model,
         l_discount + l_tax + l_quantity / 100.0 AS outcome FROM lineitem
)"""


def marker_rows(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "LatAm").when(F.col("l_returnflag") == "R", "US").otherwise("unmarked").alias("marker"),
        F.col("l_linenumber").cast("string").alias("occupation"),
        F.col("l_linestatus").alias("model"),
        F.col("l_discount").alias(fv.OUTCOME_LABELS[0]),
        F.col("l_tax").alias(fv.OUTCOME_LABELS[1]),
        (F.col("l_quantity") / 100.0).alias(fv.OUTCOME_LABELS[2]),
    )
    return regression.outcome_share(lines)


@query(
    "A28_marker_contrast",
    f"""WITH {MARKER_SQL},
g AS (SELECT marker, count(*)::DOUBLE AS n, avg(outcome) AS m, sum(outcome * outcome) - count(*) * avg(outcome) ** 2 AS sse FROM mk GROUP BY marker),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(sse) AS rss FROM g),
tss AS (SELECT sum((outcome - (SELECT avg(outcome) FROM mk)) ** 2) AS tss FROM mk)
SELECT {r('l.m - u.m', 8)} AS diff, {r('sqrt(t.n / (t.n - t.k) * (l.sse / l.n ** 2 + u.sse / u.n ** 2))', 8)} AS std_error,
  {r(normal_cdf_sql('(-(l.m - u.m) / sqrt(t.n / (t.n - t.k) * (l.sse / l.n ** 2 + u.sse / u.n ** 2)))'), 8)} AS p_one_sided, CAST(t.n AS BIGINT) AS n_obs, {r('1 - t.rss / tss.tss', 8)} AS r_squared
FROM g l, g u, t, tss WHERE l.marker = 'LatAm' AND u.marker = 'US'""",
)
def a28(spark, sf_dir):
    out = regression.marker_contrast(marker_rows(spark, sf_dir), factors=())
    return tidy(out, 8)


_NET = "{0} - sum(n * {0}) OVER (PARTITION BY {1}) / sum(n) OVER (PARTITION BY {1}) AS {0}"


def _net_of(factor: str) -> str:
    return ", ".join(_NET.format(column, factor) for column in ("y", "dl", "du"))


#: Outcome and marker indicators net of both factors, by turns; then the two-term regression and its HC1 error.
ALL_FACTORS_SQL = f"""WITH RECURSIVE {MARKER_SQL},
c AS (SELECT marker, occupation, model, count(*)::DOUBLE AS n, sum(outcome) AS sy, sum(outcome * outcome) AS syy FROM mk GROUP BY ALL),
net(i, marker, occupation, model, n, y, dl, du) AS (
  SELECT 0, marker, occupation, model, n, sy / n, CASE WHEN marker = 'LatAm' THEN 1.0::DOUBLE ELSE 0.0 END, CASE WHEN marker = 'US' THEN 1.0::DOUBLE ELSE 0.0 END FROM c
  UNION ALL SELECT i + 1, marker, occupation, model, n, {_net_of("model")}
  FROM (SELECT i, marker, occupation, model, n, {_net_of("occupation")} FROM net WHERE i < 80)
),
f AS (SELECT * FROM net WHERE i = 80),
g AS (SELECT sum(n * dl * dl) AS ll, sum(n * dl * du) AS lu, sum(n * du * du) AS uu, sum(n * dl * y) AS ly, sum(n * du * y) AS uy FROM f),
b AS (SELECT *, (uu * ly - lu * uy) / (ll * uu - lu * lu) AS bl, (ll * uy - lu * ly) / (ll * uu - lu * lu) AS bu, ll * uu - lu * lu AS det FROM g),
e AS (SELECT ((uu + lu) * dl - (lu + ll) * du) / det AS a, syy - sy * sy / c.n + c.n * (y - bl * dl - bu * du) ** 2 AS sse, c.n, c.sy, c.syy, bl - bu AS diff
  FROM f JOIN c ON c.marker = f.marker AND c.occupation = f.occupation AND c.model = f.model, b),
k AS (SELECT count(DISTINCT marker) + count(DISTINCT occupation) + count(DISTINCT model) - 2 AS k FROM mk),
t AS (SELECT any_value(diff) AS diff, sqrt(sum(n) / (sum(n) - any_value(k)) * sum(a * a * sse)) AS se, sum(n) AS n,
  1 - sum(sse) / (sum(syy) - sum(sy) ** 2 / sum(n)) AS r2 FROM e, k)
SELECT {r('diff', 8)} AS diff, {r('se', 8)} AS std_error, {r(normal_cdf_sql('(-diff / se)'), 8)} AS p_one_sided, CAST(n AS BIGINT) AS n_obs, {r('r2', 8)} AS r_squared FROM t"""


@query("A28_marker_contrast_all_factors", ALL_FACTORS_SQL)
def a28_full(spark, sf_dir):
    """Same contrast with occupation and model effects and the p-value."""
    return tidy(regression.marker_contrast(marker_rows(spark, sf_dir)), 8)


L5_SQL = (
    BALANCED_SQL[: BALANCED_SQL.rindex("SELECT 'language'")]
    + f""",
xy AS (SELECT weight AS x, delta AS y, grp FROM signed WHERE weight IS NOT NULL AND delta IS NOT NULL),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM xy), {_clustered_sql('c', 'grp')}
SELECT 'fixed_effects' AS model, {r('(ss_l / q) / (rss / (n - k))')} AS statistic,
  {r(f_sf_sql('((ss_l / q) / (rss / (n - k)))', 'q::DOUBLE', '(n - k)::DOUBLE'))} AS p_value, n AS n_obs, {r('1 - rss / tss')} AS r_squared FROM ss
UNION ALL SELECT 'pooled_gradient', {r('line.b / sqrt(v)')}, {r(normal_cdf_sql('(line.b / sqrt(v))'))}, line.n, {r('r2')} FROM line, c"""
)


@query("L5_estimation", L5_SQL)
def l5(spark, sf_dir):
    """Fixed-effect test and pooled gradient with p-values, as one tidy table."""
    rows = audits.metrics_of(spark, sf_dir)
    fits = estimation.estimate(audit.index_by_cell(rows), rows)
    fixed = fits["fixed_effects"].select(
        F.lit("fixed_effects").alias("model"), F.col("f_statistic").alias("statistic"),
        F.col("p_value").alias("p_value"), "n_obs", "r_squared",
    )
    pooled = fits["pooled_gradient"].select(
        F.lit("pooled_gradient").alias("model"), F.col("t_statistic").alias("statistic"),
        F.col("p_one_sided").alias("p_value"), "n_obs", "r_squared",
    )
    return tidy(fixed.unionByName(pooled))


# ---- tests over cells ---------------------------------------------------------------------


@query(
    "X1_shift_test",
    audits.INDEX_SQL
    + f" SELECT country, language, model, {r('avg(delta)')} AS mean_delta, {r('sqrt(var_samp(delta) / count(*))')} AS std_error, count(*) AS n_obs, count(*) AS n_clusters, {r('avg(delta) / sqrt(var_samp(delta) / count(*))')} AS t_statistic, {r(normal_cdf_sql('(avg(delta) / sqrt(var_samp(delta) / count(*)))'))} AS p_value FROM signed GROUP BY ALL",
)
def x1(spark, sf_dir):
    return tidy(regression.with_shift_p(regression.shift_test(audits.metrics_of(spark, sf_dir), b.CELL)))


@query(
    "X2_benjamini_hochberg",
    f"""WITH t AS (
  SELECT l_suppkey, l_returnflag, avg(l_quantity - 25.5) AS mean_delta, avg(l_quantity - 25.5) / sqrt(var_samp(l_quantity) / count(*)) AS t
  FROM lineitem GROUP BY ALL HAVING count(*) > 1
),
p AS (SELECT l_suppkey, l_returnflag, mean_delta, round({normal_cdf_sql('t')}, 9) AS p_value FROM t),
k AS (SELECT *, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS rk, count(*) OVER () AS m FROM p),
a AS (SELECT *, least(1.0, min(p_value * m / rk) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS p_adjusted FROM k)
SELECT l_suppkey, l_returnflag, {r('mean_delta')} AS mean_delta, {r('p_value')} AS p_value, {r('p_adjusted')} AS p_adjusted, p_adjusted < 0.05 AND mean_delta < -0.5 AS claimed FROM a""",
)
def x2(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    tests = lines.groupBy("l_suppkey", "l_returnflag").agg(
        F.avg(F.col("l_quantity") - 25.5).alias("mean_delta"),
        F.var_samp("l_quantity").alias("v"),
        F.count(F.lit(1)).alias("n"),
    )
    t = F.col("mean_delta") / F.sqrt(F.col("v") / F.col("n"))
    tests = tests.where("n > 1").withColumn("t_statistic", t).drop("v", "n")
    # Rounded, so that both engines see the same ties.
    tests = regression.with_shift_p(tests).withColumn("p_value", F.round("p_value", 9)).drop("t_statistic")
    return tidy(regression.benjamini_hochberg(tests, effect_col="mean_delta"))


# ---- agreement --------------------------------------------------------------------------------


def kappa_sql(source: str, a: str, c: str, keys: str, weighted: bool) -> str:
    """Kappa by the textbook definition over all label pairs."""
    w = "abs(x.pos - y.pos)" if weighted else "CASE WHEN x.pos = y.pos THEN 0 ELSE 1 END"
    return f"""(
WITH o AS (SELECT {keys}, {a} AS a, {c} AS b, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL),
lab AS (SELECT {keys}, label, row_number() OVER (PARTITION BY {keys} ORDER BY label) AS pos FROM (SELECT {keys}, a AS label FROM o UNION SELECT {keys}, b FROM o)),
ra AS (SELECT {keys}, a AS label, sum(n)::DOUBLE AS r FROM o GROUP BY ALL), cb AS (SELECT {keys}, b AS label, sum(n)::DOUBLE AS c FROM o GROUP BY ALL),
tot AS (SELECT {keys}, sum(n) AS n FROM o GROUP BY {keys}),
num AS (SELECT o.{keys}, sum({w} * o.n)::DOUBLE AS v FROM o JOIN lab x ON x.{keys} = o.{keys} AND x.label = o.a JOIN lab y ON y.{keys} = o.{keys} AND y.label = o.b GROUP BY o.{keys}),
den AS (
  SELECT ra.{keys}, sum({w} * r * c / tot.n) AS v FROM ra JOIN cb ON cb.{keys} = ra.{keys} JOIN tot ON tot.{keys} = ra.{keys}
  JOIN lab x ON x.{keys} = ra.{keys} AND x.label = ra.label JOIN lab y ON y.{keys} = cb.{keys} AND y.label = cb.label GROUP BY ra.{keys}
)
SELECT tot.{keys}, '{'cohens_kappa_linear' if weighted else 'cohens_kappa'}' AS statistic, {r('1 - num.v / den.v')} AS value, CAST(tot.n AS BIGINT) AS n, '' AS note
FROM tot JOIN num ON num.{keys} = tot.{keys} JOIN den ON den.{keys} = tot.{keys})"""


@query(
    "A29_cohens_kappa",
    f"WITH {b.RATERS_SQL} SELECT * FROM {kappa_sql('raters', 'r1', 'r2', 'l_returnflag', True)} UNION ALL SELECT * FROM {kappa_sql('raters', 'r1', 'r3', 'l_returnflag', False)}",
)
def a29(spark, sf_dir):
    rows = b.raters(spark, sf_dir)
    linear = agreement.cohens_kappa(rows, "r1", "r2", ["l_returnflag"])
    nominal = agreement.cohens_kappa(rows, "r1", "r3", ["l_returnflag"], weights=None)
    return tidy(linear.unionByName(nominal))


@query(
    "A30_raters_vs_reference",
    f"WITH {b.RATERS_SQL}, melted AS (SELECT 'r1' AS rater, r1 AS a, r2 AS ref FROM raters UNION ALL SELECT 'r3', r3, r2 FROM raters) SELECT * FROM {kappa_sql('melted', 'a', 'ref', 'rater', True)}",
)
def a30(spark, sf_dir):
    return tidy(agreement.raters_vs_reference(b.raters(spark, sf_dir), ["r1", "r3"], "r2"))


LABELS_SQL = META_SQL + """, sheet AS (
  SELECT image_id, CAST(floor(duration_s / 50) AS INTEGER) + 1 AS label_a, CASE WHEN row_ord % 9 <> 0 THEN CAST(floor(duration_s / 50) + row_ord % 3 AS INTEGER) END AS label_b,
         CASE WHEN row_ord % 5 <> 0 THEN CAST(floor(duration_s / 60) + row_ord % 2 AS INTEGER) + 1 END AS consensus_bin FROM metadata_unique
)"""


@query(
    "L9_labelling_analysis",
    LABELS_SQL
    + f""", pairs AS (SELECT 'label_a~label_b' AS rater, label_a AS a, label_b AS ref FROM sheet UNION ALL SELECT 'label_a', label_a, consensus_bin FROM sheet UNION ALL SELECT 'label_b', label_b, consensus_bin FROM sheet)
SELECT * FROM {kappa_sql('pairs', 'a', 'ref', 'rater', True)}""",
)
def l9(spark, sf_dir):
    unique = merge.latest_by_key(b.metadata(spark, sf_dir))
    base = F.floor(F.col("duration_s") / 50)
    k = F.col("row_ord")
    labels = unique.select(
        "image_id", (base + 1).cast("int").alias("label_a"), F.when(k % 9 != 0, (base + k % 3).cast("int")).alias("label_b")
    )
    consensus = unique.select(
        "image_id", F.when(k % 5 != 0, (F.floor(F.col("duration_s") / 60) + k % 2 + 1).cast("int")).alias("consensus_bin")
    )
    return tidy(plans.labelling_analysis(labels, consensus))
