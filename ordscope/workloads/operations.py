"""Merge, manifest, progress, request-log, sampling and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids
from ordscope.functions.ordinal import dominant_label
from ordscope.operators import distributions, grid, merge, progress, quality, requests, sampling
from ordscope.plans import operations as plans
from ordscope.session import materialise
from ordscope.workloads import audits
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import longs, query, r, tidy
from ordscope.workloads.relational import BACKEND_SQL, GRID_META_SQL, META_SQL, RUNNER_SQL, manifest

# ---- invariants, duplicates -------------------------------------------------


@query(
    "A15_sum_invariants",
    audits.OBS_SQL
    + f" SELECT country, grp, {r('sum(prob)')} AS total FROM obs GROUP BY country, grp HAVING abs(sum(prob) - 1) > 1e-3",
)
def a15(spark, sf_dir):
    """Several cells per (country, group), so their sums are off 1 and get reported."""
    hist = distributions.ordinal_histogram(b.panel(spark, sf_dir), audits.KEYS)
    return tidy(quality.sum_violations(distributions.to_long(hist, audits.KEYS), ["country", "grp"], "prob"))


@query(
    "A16_duplicate_summary",
    META_SQL
    + " SELECT count(*) AS n_rows, count(DISTINCT image_id) AS n_unique, count(*) - count(DISTINCT image_id) AS n_surplus, (SELECT count(*) FROM (SELECT image_id FROM metadata GROUP BY 1 HAVING count(*) > 1)) AS n_duplicated_keys FROM metadata",
)
def a16(spark, sf_dir):
    return merge.duplicate_summary(b.metadata(spark, sf_dir))


@query(
    "A17_ambiguous_ids",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS image_id, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_suppkey) > 1",
)
def a17(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"), "l_partkey", "l_suppkey"
    )
    return merge.ambiguous_keys(lines, columns=("l_partkey", "l_suppkey"))


@query(
    "A18_counts_by_key",
    META_SQL + " SELECT model, coalesce(backend, 'none') AS backend, count(*) AS n FROM metadata GROUP BY model, backend",
)
def a18(spark, sf_dir):
    counts = progress.count_by(b.metadata(spark, sf_dir), "model", "backend")
    return counts.withColumn("backend", F.coalesce("backend", F.lit("none")))


MODELS_WITH_EXTRA = [*fv.MAIN_MODELS, *fv.EXTRA_MODELS[:1]]


@query(
    "A19_count_matrix",
    META_SQL
    + f""", m(row_order, model) AS ({b.sql_values(list(enumerate(MODELS_WITH_EXTRA)))})
SELECT CAST(m.row_order AS BIGINT) AS row_order, m.model, """
    + ", ".join(
        f"""count(*) FILTER (WHERE u.language = '{lang}') AS "{lang}" """ for lang in fv.MAIN_LANGUAGES
    )
    + " FROM m LEFT JOIN metadata_unique u ON u.model = m.model GROUP BY m.row_order, m.model",
)
def a19(spark, sf_dir):
    unique = merge.latest_by_key(b.metadata(spark, sf_dir))
    return tidy(progress.count_matrix(unique, "model", "language", MODELS_WITH_EXTRA, fv.MAIN_LANGUAGES))


# ---- progress ----------------------------------------------------------------


def unique_log(spark, sf_dir):
    """Deduplicated log with the columns the reports read; several branches use it."""
    cols = ["image_id", "backend", "duration_s", "timestamp", "src_ord", "row_ord"]
    slim = b.metadata(spark, sf_dir).select(*cols)
    return materialise(merge.latest_by_key(slim, drop_source_order=True), "unique")


WINDOW_S = 400 * 86_400
THROUGHPUT_SQL = f"""recent AS (SELECT * FROM metadata_unique WHERE timestamp >= (SELECT max(timestamp) FROM metadata_unique) - {WINDOW_S}),
rates AS (
  SELECT backend, count(*) AS n_units, count(*) / greatest(max(timestamp) - min(timestamp), 1) * 60.0 AS per_minute,
         quantile_cont(duration_s, 0.5) AS p50_duration_s
  FROM recent GROUP BY backend
)"""


@query(
    "A20_recent_throughput",
    META_SQL
    + f", {THROUGHPUT_SQL} SELECT coalesce(backend, 'none') AS backend, n_units, {r('per_minute', 9)} AS per_minute, {r('p50_duration_s')} AS p50_duration_s FROM rates",
)
def a20(spark, sf_dir):
    unique = unique_log(spark, sf_dir)
    rates = progress.recent_throughput(unique, progress.latest_time(unique), window_s=WINDOW_S)
    out = rates.withColumn("per_minute", F.round("per_minute", 9)).withColumn("backend", F.coalesce("backend", F.lit("none")))
    return tidy(out, 9).withColumn("p50_duration_s", F.round("p50_duration_s", 6))


@query(
    "A21_completion_eta",
    GRID_META_SQL
    + f""", {THROUGHPUT_SQL},
prog AS (SELECT language, count(*) FILTER (WHERE image_id IN (SELECT image_id FROM metadata)) AS done, count(*) AS total FROM grid GROUP BY language),
rate AS (SELECT coalesce(sum(per_minute), 0) AS pm FROM rates)
SELECT language AS grid, done, total, {r('100.0 * done / total')} AS pct, {r('CASE WHEN pm > 0 AND done < total THEN (total - done) / pm * 60.0 END', 3)} AS eta_s FROM prog, rate""",
)
def a21(spark, sf_dir):
    unique = unique_log(spark, sf_dir)
    rates = progress.recent_throughput(unique, progress.latest_time(unique), window_s=WINDOW_S)
    by_language = b.customer_grid(spark, sf_dir, unique).withColumn("grid", F.col("language"))
    out = progress.with_eta(progress.grid_progress(by_language), rates)
    return tidy(out.select("grid", "done", "total", "pct", F.round("eta_s", 3).alias("eta_s")))


MANIFEST_SQL = f"""counts AS (
  SELECT cell_id, count(*) FILTER (WHERE image_id IN (SELECT image_id FROM metadata)) AS current_n FROM grid GROUP BY cell_id
),
missing AS (
  SELECT g.*, c.current_n, greatest(target_n - c.current_n, 0) AS missing_n, {BACKEND_SQL} AS backend, {RUNNER_SQL} AS recommended_runner,
         CAST(('0x' || substr(sha256(image_id), 1, 16))::UBIGINT % 4 AS BIGINT) AS shard_id
  FROM grid g JOIN counts c ON c.cell_id = g.cell_id WHERE image_id NOT IN (SELECT image_id FROM metadata)
)"""


@query(
    "A22_missing_manifest",
    GRID_META_SQL
    + f", {MANIFEST_SQL} SELECT cell_id, image_id, seed, CAST(target_n AS BIGINT) AS target_n, current_n, missing_n, shard_id, backend, recommended_runner FROM missing",
)
def a22(spark, sf_dir):
    cols = ["cell_id", "image_id", "seed", "target_n", "current_n", "missing_n", "shard_id", "backend", "recommended_runner"]
    return tidy(manifest(spark, sf_dir).select(*cols))


@query(
    "L8_manifest_report",
    GRID_META_SQL
    + f""", {MANIFEST_SQL}
SELECT 'summary:' || grid || ':' || recommended_runner || ':' || model AS name, count(*) AS n FROM missing GROUP BY grid, recommended_runner, model
UNION ALL SELECT 'duplicate_rows', count(*) - count(DISTINCT image_id) FROM missing
UNION ALL SELECT 'completed_rows', count(*) FILTER (WHERE missing_n <= 0 OR current_n >= target_n) FROM missing""",
)
def l8(spark, sf_dir):
    meta = b.metadata(spark, sf_dir)
    report = plans.manifest_report(b.customer_grid(spark, sf_dir, meta), meta)
    summary = report["summary"].select(
        F.concat_ws(":", F.lit("summary"), "grid", "recommended_runner", "model").alias("name"), "n"
    )
    problems = report["problems"].select(
        F.inline(
            F.array(
                F.struct(F.lit("duplicate_rows").alias("name"), F.col("duplicate_rows").alias("n")),
                F.struct(F.lit("completed_rows").alias("name"), F.col("completed_rows").alias("n")),
            )
        )
    )
    return summary.unionByName(problems)


@query(
    "W8_pending_top",
    GRID_META_SQL
    + " SELECT model, language, count(*) AS n_pending FROM grid WHERE image_id NOT IN (SELECT image_id FROM metadata) GROUP BY model, language, ord_language, ord_model ORDER BY n_pending DESC, min(ord_group), ord_language, ord_model LIMIT 10",
)
def w8(spark, sf_dir):
    pending = grid.pending_cells(b.customer_grid(spark, sf_dir, b.metadata(spark, sf_dir)))
    return progress.pending_top(pending, 10)


@query(
    "L7_progress_report",
    GRID_META_SQL
    + f""", {THROUGHPUT_SQL}
SELECT 'grid:done' AS name, {r("count(*) FILTER (WHERE image_id IN (SELECT image_id FROM metadata))")} AS value FROM grid
UNION ALL SELECT 'grid:total', count(*) FROM grid
UNION ALL SELECT 'rows:surplus', count(*) - count(DISTINCT image_id) FROM metadata
UNION ALL SELECT 'matrix:' || model, count(*) FROM metadata_unique u WHERE image_id IN (SELECT image_id FROM grid) GROUP BY model
UNION ALL SELECT 'rate:' || coalesce(backend, 'none'), n_units FROM (SELECT backend, count(*) AS n_units FROM metadata_unique WHERE timestamp >= (SELECT max(timestamp) FROM metadata_unique) - 86400 GROUP BY backend)""",
)
def l7(spark, sf_dir):
    meta = b.metadata(spark, sf_dir)
    tables = plans.progress_report(b.customer_grid(spark, sf_dir, meta), meta, "latest")

    def named(df, name, value):
        return df.select(name.alias("name"), value.cast("double").alias("value"))

    out = named(tables["grids"], F.lit("grid:done"), F.col("done"))
    out = out.unionByName(named(tables["grids"], F.lit("grid:total"), F.col("total")))
    out = out.unionByName(named(tables["duplicates"], F.lit("rows:surplus"), F.col("n_surplus")))
    row_sum = sum((F.col(f"`{c}`") for c in fv.MAIN_LANGUAGES), F.lit(0))
    out = out.unionByName(named(tables["matrix"], F.concat(F.lit("matrix:"), "model"), row_sum))
    rates = named(
        tables["throughput"], F.concat(F.lit("rate:"), F.coalesce("backend", F.lit("none"))), F.col("n_units")
    )
    return tidy(out.unionByName(rates))


# ---- merge ---------------------------------------------------------------------

UNIQUE_COLS = "image_id, model, occupation, seed, coalesce(backend, '-') AS backend, coalesce(timestamp, -1) AS timestamp, row_ord"


def _unique_projection(df):
    return df.select(
        "image_id", "model", "occupation", "seed",
        F.coalesce("backend", F.lit("-")).alias("backend"),
        F.coalesce("timestamp", F.lit(-1)).alias("timestamp"),
        "row_ord",
    )


@query("W3_latest_by_key", META_SQL + f" SELECT {UNIQUE_COLS} FROM metadata_unique")
def w3(spark, sf_dir):
    return _unique_projection(merge.latest_by_key(b.metadata(spark, sf_dir)))


@query(
    "W4_last_by_position",
    META_SQL
    + f" SELECT {UNIQUE_COLS} FROM metadata QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY src_ord DESC, row_ord DESC) = 1",
)
def w4(spark, sf_dir):
    return _unique_projection(merge.last_by_position(b.metadata(spark, sf_dir)))


@query(
    "L6_shard_merge",
    META_SQL
    + f" SELECT image_id, model, seed, coalesce(backend, '-') AS backend, coalesce(timestamp, -1) AS timestamp, {r('coalesce(duration_s, -1)')} AS duration_s FROM metadata_unique",
)
def l6(spark, sf_dir):
    merged = plans.merged_shards(b.metadata(spark, sf_dir))
    return tidy(
        merged.select(
            "image_id", "model", "seed",
            F.coalesce("backend", F.lit("-")).alias("backend"),
            F.coalesce("timestamp", F.lit(-1)).alias("timestamp"),
            F.coalesce("duration_s", F.lit(-1.0)).alias("duration_s"),
        )
    )


@query(
    "L11_import_summary",
    META_SQL
    + """ SELECT count(*) FILTER (WHERE src_ord = 0) AS rows_before, count(*) FILTER (WHERE src_ord > 0) AS shard_rows, count(DISTINCT image_id) AS rows_after,
  (SELECT count(*) FROM (SELECT image_id FROM metadata GROUP BY 1 HAVING min(src_ord) > 0)) AS rows_added FROM metadata""",
)
def l11(spark, sf_dir):
    meta = b.metadata(spark, sf_dir)
    return merge.import_summary(meta.where("src_ord = 0"), meta.where("src_ord > 0"))


# ---- request log -----------------------------------------------------------------

PHASE_SQL = f"""WITH {b.REQUESTS_SQL},
good AS (SELECT phase_n, list(wall_s ORDER BY wall_s) AS w, count(*) AS n FROM log WHERE ok GROUP BY phase_n),
p95 AS (
  SELECT phase_n, n, w, quantile_cont(x, 0.5) AS p50
  FROM (SELECT phase_n, n, w, unnest(w) AS x FROM good) GROUP BY phase_n, n, w
),
q AS (
  SELECT phase_n, n, p50, CASE WHEN n >= 20 THEN
      w[CAST(floor(0.95 * (n + 1)) AS BIGINT)] + (w[least(CAST(floor(0.95 * (n + 1)) AS BIGINT) + 1, n)] - w[CAST(floor(0.95 * (n + 1)) AS BIGINT)]) * (0.95 * (n + 1) - floor(0.95 * (n + 1)))
    ELSE w[n] END AS p95
  FROM p95
),
errs AS (
  SELECT phase_n, string_agg(error, ',' ORDER BY img_idx) AS first_errors FROM (
    SELECT * FROM log WHERE error <> '' QUALIFY row_number() OVER (PARTITION BY phase_n ORDER BY img_idx) <= 3) GROUP BY phase_n
),
base AS (
  SELECT phase_n, count(*) AS n_attempted, max(wall_s) AS wall_total_s, count(*) FILTER (WHERE ok) AS n_ok,
         count(*) FILTER (WHERE status = 429) AS n_429, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS n_5xx,
         count(*) FILTER (WHERE NOT ok AND (status IS NULL OR (status <> 429 AND status NOT BETWEEN 500 AND 599))) AS n_other_error
  FROM log GROUP BY phase_n
),
phases AS (
  SELECT b.*, q.p50 AS p50_wall_s, q.p95 AS p95_wall_s, n_ok / wall_total_s * 60.0 AS per_minute, n_ok / wall_total_s * 60.0 / b.phase_n AS per_minute_per_stream, first_errors
  FROM base b LEFT JOIN q ON q.phase_n = b.phase_n LEFT JOIN errs e ON e.phase_n = b.phase_n
)"""


@query(
    "A23_phase_metrics",
    PHASE_SQL
    + f" SELECT CAST(phase_n AS BIGINT) AS phase_n, n_attempted, {r('wall_total_s')} AS wall_total_s, n_ok, n_429, n_5xx, n_other_error, {r('p50_wall_s')} AS p50_wall_s, {r('p95_wall_s')} AS p95_wall_s, {r('per_minute')} AS per_minute, {r('per_minute_per_stream')} AS per_minute_per_stream, first_errors FROM phases",
)
def a23(spark, sf_dir):
    out = requests.phase_metrics(b.request_log(spark, sf_dir))
    return tidy(out.withColumn("first_errors", F.concat_ws(",", "error_examples")).drop("error_examples"))


# Rule 3 for four phases, written as the chain of comparisons it unrolls to.
@query(
    "W6_plateau_rule",
    PHASE_SQL
    + """, a AS (
  SELECT *, n_429::DOUBLE / n_attempted AS r429, n_other_error::DOUBLE / n_attempted AS rother, n_ok::DOUBLE / n_attempted AS rok,
         CASE WHEN lag(per_minute) OVER (ORDER BY phase_n) IS NULL THEN 1
              WHEN per_minute / lag(per_minute) OVER (ORDER BY phase_n) >= 1.15 AND n_429::DOUBLE / n_attempted <= 0.05 THEN 1 ELSE 0 END AS up
  FROM phases
),
w AS (SELECT *, min(up) OVER (ORDER BY phase_n) AS going FROM a),
flags AS (
  SELECT max(r429) > 0.2 AS hard, bool_or(phase_n = 1 AND rok >= 0.5) AND bool_or(phase_n > 1 AND rother > 0.2) AS parallel,
         max(CASE WHEN going = 1 THEN phase_n END) AS best FROM w
)
SELECT CAST(CASE WHEN hard OR parallel THEN 1 ELSE best END AS BIGINT) AS recommended_n,
       CASE WHEN hard THEN 'rate limited' WHEN parallel THEN 'parallel access limited' ELSE 'plateau' END AS rule FROM flags""",
)
def w6(spark, sf_dir):
    return tidy(requests.recommend_phase(requests.phase_metrics(b.request_log(spark, sf_dir))))


@query(
    "T6_failure_runs",
    f"""WITH {b.REQUESTS_SQL},
marked AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY img_idx) AS run FROM log),
runs AS (SELECT user_id, run, count(*) AS run_length, min(img_idx) AS run_start, max(img_idx) AS run_end FROM marked WHERE NOT ok GROUP BY user_id, run)
SELECT user_id, run_length, run_start, run_end FROM runs WHERE run_length >= 3""",
)
def t6(spark, sf_dir):
    log = b.request_log(spark, sf_dir)
    chunk = F.floor(F.col("img_idx") / 1000)
    runs = requests.failure_runs(log, ["user_id"], ["img_idx"], chunk, ~F.col("ok"), 3)
    return runs.drop("run")


# ---- order, top-k, sampling ---------------------------------------------------------


@query(
    "W7_stable_sort_head",
    f"WITH {b.GRID_SQL} SELECT occupation, seed, image_id FROM grid ORDER BY grid, occupation, seed LIMIT 500",
)
def w7(spark, sf_dir):
    cells = b.customer_grid(spark, sf_dir)
    return grid.top_rows(cells, ["grid", "occupation", "seed"], 500).select("occupation", "seed", "image_id")


@query(
    "W9_best_of_group",
    "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1",
)
def w9(spark, sf_dir):
    from ordscope.operators.classify import detections_best

    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    score = F.struct(F.col("l_extendedprice"), (-F.col("l_partkey")).alias("p"), (-F.col("l_suppkey")).alias("s"))
    return detections_best(lines, ["l_orderkey"], score).drop("l_extendedprice")


@query(
    "W10_stratified_sample",
    f"WITH {b.PANEL_SQL} SELECT DISTINCT grp, unit_id FROM (SELECT grp, unit_id FROM panel WHERE coalesce(has_signal, false) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('{fv.BASE_SEED}|' || unit_id), unit_id) <= 12)",
)
def w10(spark, sf_dir):
    sample = sampling.stratified_sample(b.panel(spark, sf_dir), "grp", "unit_id", carry=[])
    return sample.distinct()


@query(
    "W10_labelling_sheet",
    META_SQL
    + f"""SELECT image_id, occupation, language, model, country, path, CAST(-1 AS BIGINT) AS label_a, CAST(-1 AS BIGINT) AS label_b, CAST(-1 AS BIGINT) AS adjudication, '' AS notes
FROM (SELECT image_id || ':' || src_ord || ':' || row_ord AS image_id, occupation, language, model, country_proxy AS country, 'images/' || image_id || '.png' AS path FROM metadata WHERE seed % 5 <> 0)
WHERE occupation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occupation ORDER BY md5('{fv.BASE_SEED}|' || image_id), image_id) <= {fv.SAMPLE_PER_GROUP}""",
)
def w10_sheet(spark, sf_dir):
    """The labelling sheet whole: sampled rows, fixed columns, empty labels (shown as -1)."""
    panel = b.metadata(spark, sf_dir).withColumns(
        {
            "path": F.concat(F.lit("images/"), "image_id", F.lit(".png")),
            "image_id": F.concat_ws(":", "image_id", F.col("src_ord").cast("string"), F.col("row_ord").cast("string")),
            "country": F.col("country_proxy"),
            "has_face": F.col("seed") % 5 != 0,
        }
    )
    return longs(sampling.sample_for_validation(panel)).fillna(-1, ["label_a", "label_b", "adjudication"])


@query(
    "W9_dominant_label",
    """SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label
FROM (SELECT event_id, event_id * 7 % 5 AS a, event_id * 3 % 5 AS b, user_id % 5 AS c FROM events)""",
)
def w9_label(spark, sf_dir):
    """Label with the largest score of a map; the first of equal ones."""
    score = lambda e: F.expr(e).cast("double")
    scores = F.create_map(
        F.lit("a"), score("event_id * 7 % 5"), F.lit("b"), score("event_id * 3 % 5"), F.lit("c"), score("user_id % 5")
    )
    return b.table(spark, sf_dir, "events").select("event_id", dominant_label(scores).alias("label"))


# ---- quality -------------------------------------------------------------------------


@query(
    "A32_table_summary",
    META_SQL
    + " SELECT count(*) AS n_rows, count(DISTINCT model) AS n_model, count(DISTINCT language) AS n_language, count(DISTINCT backend) AS n_backend FROM metadata",
)
def a32(spark, sf_dir):
    return progress.table_summary(b.metadata(spark, sf_dir), ["model", "language", "backend"])


@query(
    "L10_quality_gate",
    audits.INDEX_SQL
    + f""", {b.METADATA_SQL},
base_sums AS (SELECT country, grp, sum(prob) AS s FROM base GROUP BY ALL),
weight_sums AS (SELECT country, sum(weight) AS s FROM weights GROUP BY ALL),
ids AS (SELECT image_id, count(*) AS n FROM metadata GROUP BY ALL)
SELECT 'baseline-sums' AS name, count(*) FILTER (WHERE abs(s - 1) > 1e-3) = 0 AS passed, 'blocking' AS severity, count(*) FILTER (WHERE abs(s - 1) > 1e-3) || ' of ' || count(*) || ' groups do not sum to 1' AS detail FROM base_sums
UNION ALL SELECT 'weight-sums', count(*) FILTER (WHERE abs(s - 1) > 1e-3) = 0, 'blocking', count(*) FILTER (WHERE abs(s - 1) > 1e-3) || ' of ' || count(*) || ' groups do not sum to 1' FROM weight_sums
UNION ALL SELECT 'unique-ids', count(*) FILTER (WHERE n > 1) = 0, 'warn', count(*) FILTER (WHERE n > 1) || ' of ' || count(*) || ' keys repeat' FROM ids
UNION ALL SELECT 'bins-in-range', count(*) FILTER (WHERE bin NOT BETWEEN 1 AND 10) = 0, 'warn', count(*) FILTER (WHERE bin NOT BETWEEN 1 AND 10) || ' of ' || count(*) || ' values out of range' FROM panel""",
)
def l10(spark, sf_dir):
    cells = audits.cell_counts(spark, sf_dir)
    base = audits.baseline_of(cells)
    long = distributions.to_long(base, ["country", "grp"], arrays=("base_probs",), names=("prob",))
    return quality.gate(
        quality.check_sums(long, "baseline-sums", ["country", "grp"], "prob"),
        quality.check_sums(base, "weight-sums", ["country"], "weight"),
        quality.check_unique(b.metadata(spark, sf_dir), "unique-ids", "image_id", "warn"),
        quality.check_range(b.panel(spark, sf_dir), "bins-in-range", "bin", 1, 10),
    )


@query(
    "L10_quality_report",
    audits.INDEX_SQL
    + f""",
base_sums AS (SELECT country, grp, sum(prob) AS s FROM base GROUP BY ALL),
weight_sums AS (SELECT country, sum(weight) AS s FROM weights GROUP BY ALL)
SELECT 'baseline-columns' AS name, true AS passed, 'blocking' AS severity, 'missing columns: []' AS detail
UNION ALL SELECT 'baseline-sums', count(*) FILTER (WHERE abs(s - 1) > 1e-3) = 0, 'blocking', count(*) FILTER (WHERE abs(s - 1) > 1e-3) || ' of ' || count(*) || ' groups do not sum to 1' FROM base_sums
UNION ALL SELECT 'weight-sums', count(*) FILTER (WHERE abs(s - 1) > 1e-3) = 0, 'blocking', count(*) FILTER (WHERE abs(s - 1) > 1e-3) || ' of ' || count(*) || ' groups do not sum to 1' FROM weight_sums
UNION ALL SELECT 'crosswalk', count(DISTINCT grp) = 25, 'blocking', count(DISTINCT grp) || ' rows (need 25)' FROM base
UNION ALL SELECT 'main-grid', count(*) = 12000, 'blocking', count(*) || ' rows (need 12000)' FROM signed""",
)
def l10_report(spark, sf_dir):
    """The report through the public plan, over counts taken once."""
    cells = audits.cell_counts(spark, sf_dir)
    base = audits.baseline_of(cells)
    long = distributions.to_long(base, ["country", "grp"], arrays=("base_probs",), names=("prob",))
    return plans.quality_report(long, base, base.select("grp").distinct(), cells)


@query(
    "F16_eta_text",
    META_SQL
    + """ SELECT CASE WHEN s IS NULL THEN '—' WHEN s >= 86400 THEN format('{:.1f} d', s / 86400.0) WHEN s >= 3600 THEN format('{:.1f} h', s / 3600.0) ELSE format('{:.0f} min', s / 60.0) END AS eta, count(*) AS n
FROM (SELECT floor(duration_s) * CASE WHEN row_ord % 3 = 0 THEN 900 WHEN row_ord % 3 = 1 THEN 60 ELSE 30 END AS s FROM metadata) GROUP BY 1""",
)
def f16(spark, sf_dir):
    k = F.col("row_ord") % 3
    scale = F.when(k == 0, 900).when(k == 1, 60).otherwise(30)  # whole and half minutes: rounding ties
    seconds = (F.floor("duration_s") * scale).cast("double")
    return b.metadata(spark, sf_dir).groupBy(ids.format_eta(seconds).alias("eta")).agg(F.count(F.lit(1)).alias("n"))
