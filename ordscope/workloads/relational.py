"""Projection, filter, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids
from ordscope.operators import baselines, classify, distributions, grid, merge, panel, sampling, weights
from ordscope.sources import dimensions
from ordscope.sources.readers import union_all
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import query, r, tidy

META_SQL = f"WITH {b.METADATA_SQL}"
GRID_META_SQL = f"WITH {b.METADATA_SQL}, {b.GRID_SQL}"

# ---- projections, filters, predicates --------------------------------------


@query(
    "P1_eligible_rows",
    f"WITH {b.PANEL_SQL} SELECT country, grp, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM panel WHERE coalesce(has_signal, false) AND bin IS NOT NULL GROUP BY ALL",
)
def p1(spark, sf_dir):
    rows = distributions.eligible_rows(b.panel(spark, sf_dir))
    return tidy(rows.groupBy("country", "grp", "bin").agg(F.count(F.lit(1)).alias("n")))


@query(
    "P2_country_filter",
    f"WITH {b.SURVEY_SQL}, names(code, country) AS ({b.sql_values([(v, k) for k, v in b.REGION_CODES.items() if k in ('ASIA', 'EUROPE')])}) SELECT respondent, country, CAST(colorr AS BIGINT) AS colorr FROM survey JOIN names ON code = pais",
)
def p2(spark, sf_dir):
    codes = {k: b.REGION_CODES[k] for k in ("ASIA", "EUROPE")}
    rows = baselines.country_rows(b.survey(spark, sf_dir), "pais", codes)
    return tidy(rows.select("respondent", "country", "colorr"))


@query(
    "P3_valid_range",
    f"WITH {b.SURVEY_SQL} SELECT respondent, CAST(colorr AS BIGINT) AS colorr, CAST(edre AS BIGINT) AS edre FROM survey WHERE colorr BETWEEN 1 AND 11 AND edre BETWEEN 0 AND 6",
)
def p3(spark, sf_dir):
    rows = baselines.valid_range(b.survey(spark, sf_dir), "colorr", 1, 11)
    rows = baselines.valid_range(rows, "edre", *fv.LEVEL_RANGE)
    return tidy(rows.select("respondent", "colorr", "edre"))


@query(
    "P4_sentinel_filter",
    f"WITH {b.SURVEY_SQL} SELECT respondent, {r('TRY_CAST(income AS DOUBLE)')} AS income FROM survey WHERE TRY_CAST(income AS DOUBLE) NOT IN (88, 98, 99, 888888, 999999, -1)",
)
def p4(spark, sf_dir):
    return tidy(weights.valid_incomes(b.survey(spark, sf_dir), "income").select("respondent", "income"))


@query(
    "P5_tier_membership",
    f"WITH {b.SURVEY_SQL}, t(tier, level) AS ({b.sql_values([(t, x) for t, xs in fv.TIER_LEVELS.items() for x in xs])}) SELECT tier, category, count(*) AS n FROM survey JOIN t ON level = edre GROUP BY ALL",
)
def p5(spark, sf_dir):
    rows = b.survey(spark, sf_dir).withColumn("tier", baselines.tier_of_level(F.col("edre")))
    return rows.where("tier is not null").groupBy("tier", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P6_drop_mislabelled",
    META_SQL
    + f" SELECT model, coalesce(backend, '-') AS backend, count(*) AS n FROM metadata WHERE (model = '{fv.MAIN_MODELS[1]}' AND backend = 'pollinations') IS NOT TRUE GROUP BY ALL",
)
def p6(spark, sf_dir):
    kept = merge.drop_mislabelled(b.metadata(spark, sf_dir), fv.MAIN_MODELS[1], "pollinations")
    return kept.groupBy("model", F.coalesce("backend", F.lit("-")).alias("backend")).agg(F.count(F.lit(1)).alias("n"))


def manifest(spark, sf_dir):
    return grid.missing_manifest(b.customer_grid(spark, sf_dir, b.metadata(spark, sf_dir)))


RUNNER_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN '{v}'" for m, v in fv.RUNNER_BY_MODEL.items()) + " ELSE 'manual' END"


@query(
    "P7_select_work",
    GRID_META_SQL
    + f""" SELECT image_id, occupation, seed FROM grid
WHERE model = '{fv.MAIN_MODELS[1]}' AND language = 'es-LatAm' AND {RUNNER_SQL} = 'kaggle'
  AND image_id NOT IN (SELECT image_id FROM metadata)
  AND ('0x' || substr(sha256(image_id), 1, 16))::UBIGINT % 3 = 1
ORDER BY occupation, seed, image_id LIMIT 200""",
)
def p7(spark, sf_dir):
    work = grid.select_work(
        manifest(spark, sf_dir), fv.MAIN_MODELS[1], "es-LatAm", b.metadata(spark, sf_dir),
        shard_id=1, n_shards=3, max_units=200, grid="main", runner="kaggle",
    )
    return work.select("image_id", "occupation", "seed")


@query(
    "P8_normalise_manifest",
    GRID_META_SQL
    + " SELECT split_part('main|' || model || '|' || language, '|', 1) AS grid, model, count(*) AS n FROM grid WHERE image_id NOT IN (SELECT image_id FROM metadata) GROUP BY ALL",
)
def p8(spark, sf_dir):
    raw = manifest(spark, sf_dir).drop("grid").withColumnRenamed("model", " model ")
    return grid.normalise_manifest(raw).groupBy("grid", "model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P9_extend_schema",
    META_SQL
    + " SELECT model, count(*) AS n_rows, count(*) FILTER (WHERE seed % 2 = 0) AS n_true, count(*) AS n_label, CAST(0 AS BIGINT) AS n_bin FROM metadata GROUP BY model",
)
def p9(spark, sf_dir):
    rows = b.metadata(spark, sf_dir).withColumn("has_face", F.col("seed") % 2 == 0)
    wide = classify.extend_schema(classify.extend_schema(rows))
    return wide.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("has_face").alias("n_true"),
        F.count_if(F.col("ita_label") == "not_classified").alias("n_label"),
        F.count("consensus_bin").alias("n_bin"),
    )


@query(
    "P10_canonical_projection",
    META_SQL
    + " SELECT image_id, occupation, language, model, country_proxy AS country, 'p/' || seed AS path, '' AS notes, CAST(0 AS BIGINT) AS n_labels FROM metadata_unique",
)
def p10(spark, sf_dir):
    rows = merge.latest_by_key(b.metadata(spark, sf_dir))
    rows = rows.withColumns({"country": F.col("country_proxy"), "path": F.concat(F.lit("p/"), F.col("seed").cast("string"))})
    sheet = sampling.labelling_sheet(rows)
    labels = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("label_a", "label_b", "adjudication")), F.lit(0))
    return tidy(sheet.withColumn("n_labels", labels).drop("label_a", "label_b", "adjudication"))


BACKEND_SQL = "CASE model WHEN 'pollinations/flux' THEN 'pollinations' ELSE 'local_diffusers' END"


@query(
    "P11_routing",
    META_SQL
    + f" SELECT model, language, {BACKEND_SQL} AS backend_for, {RUNNER_SQL} AS runner, {b.COUNTRY_SQL} AS country, count(*) AS n FROM metadata GROUP BY ALL",
)
def p11(spark, sf_dir):
    rows = b.metadata(spark, sf_dir)
    return rows.groupBy(
        "model",
        "language",
        ids.backend_for(F.col("model")).alias("backend_for"),
        ids.runner_for(F.col("model")).alias("runner"),
        ids.country_for_language(F.col("language")).alias("country"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P12_slice_predicate",
    f"WITH {b.GRID_SQL} SELECT model, language, count(*) AS n FROM grid WHERE model IN ('{fv.MAIN_MODELS[1]}', '{fv.MAIN_MODELS[2]}', '{fv.MAIN_MODELS[3]}') GROUP BY ALL",
)
def p12(spark, sf_dir):
    kept = b.customer_grid(spark, sf_dir).where(grid.slice_predicate())
    return kept.groupBy("model", "language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P13_stable_shard",
    META_SQL
    + " SELECT image_id, CAST(('0x' || substr(sha256(image_id), 1, 16))::UBIGINT % 7 AS BIGINT) AS shard_id FROM (SELECT DISTINCT image_id FROM metadata)",
)
def p13(spark, sf_dir):
    rows = b.metadata(spark, sf_dir).select("image_id").distinct()
    return tidy(rows.select("image_id", ids.stable_shard(F.col("image_id"), 7).alias("shard_id")))


@query(
    "P14_metadata_projection",
    META_SQL
    + f" SELECT country_proxy, model_source, count(*) AS n, {r('sum(duration_s)', 3)} AS duration_s, CAST(max(timestamp) AS BIGINT) AS timestamp FROM (SELECT *, CASE WHEN src_ord > 1 THEN 'mirror' ELSE model END AS model_source FROM metadata) GROUP BY ALL",
)
def p14(spark, sf_dir):
    rows = b.metadata(spark, sf_dir).withColumnRenamed("country_proxy", "country")
    rows = rows.withColumn("model_source", F.when(F.col("src_ord") > 1, "mirror"))
    out = grid.metadata_rows(rows)
    return tidy(
        out.groupBy("country_proxy", "model_source").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("duration_s").alias("duration_s"),
            F.max("timestamp").alias("timestamp"),
        ),
        3,
    )


# ---- joins -------------------------------------------------------------------

PHENO_SQL = """pheno AS (
  SELECT image_id, max(duration_s) AS score, count(*) AS n_seen FROM metadata WHERE backend = 'cache' GROUP BY image_id
)"""


def phenotype(spark, sf_dir):
    rows = b.metadata(spark, sf_dir).where(F.col("backend") == "cache")
    return rows.groupBy("image_id").agg(F.max("duration_s").alias("score"), F.count(F.lit(1)).alias("n_seen"))


@query(
    "J1_panel_join",
    META_SQL
    + f", {PHENO_SQL} SELECT m.model, m.language, count(*) AS n_rows, count(p.n_seen) AS n_matched, {r('sum(p.score)', 3)} AS score FROM metadata_unique m LEFT JOIN pheno p ON p.image_id = m.image_id GROUP BY ALL",
)
def j1(spark, sf_dir):
    unique = merge.latest_by_key(b.metadata(spark, sf_dir))
    joined = panel.build_panel(unique, phenotype(spark, sf_dir))
    return tidy(
        joined.groupBy("model", "language").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("n_seen").alias("n_matched"), F.sum("score").alias("score")
        ),
        3,
    )


@query(
    "J3_pending_anti_join",
    GRID_META_SQL
    + " SELECT image_id, seed FROM grid g WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.image_id = g.image_id) AND ('0x' || substr(sha256(image_id), 1, 16))::UBIGINT % 4 = 2",
)
def j3(spark, sf_dir):
    pending = grid.pending_cells(b.customer_grid(spark, sf_dir, b.metadata(spark, sf_dir)), None, 2, 4)
    return pending.select("image_id", "seed")


@query(
    "J4_target_semi_join",
    GRID_META_SQL
    + " SELECT model, count(*) AS n FROM grid WHERE image_id IN (SELECT image_id FROM metadata WHERE backend = 'cache') GROUP BY model",
)
def j4(spark, sf_dir):
    targets = b.metadata(spark, sf_dir).where(F.col("backend") == "cache")
    kept = b.customer_grid(spark, sf_dir, targets).where("done")
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J5_grid_membership",
    GRID_META_SQL
    + f" SELECT grid, count(*) FILTER (WHERE image_id IN (SELECT image_id FROM metadata)) AS done, count(*) AS total, {r('100.0 * count(*) FILTER (WHERE image_id IN (SELECT image_id FROM metadata)) / count(*)')} AS pct FROM grid GROUP BY grid",
)
def j5(spark, sf_dir):
    from ordscope.operators import progress

    return tidy(progress.grid_progress(b.customer_grid(spark, sf_dir, b.metadata(spark, sf_dir))))


@query(
    "J6_grid_enumeration",
    f"WITH {b.GRID_SQL} SELECT image_id, occupation, language, country, model, seed, CAST(replicate AS BIGINT) AS replicate FROM grid",
)
def j6(spark, sf_dir):
    cells = b.customer_grid(spark, sf_dir)
    return tidy(cells.select("image_id", "occupation", "language", "country", "model", "seed", "replicate"))


@query(
    "J7_group_tier_distribution",
    f"WITH {b.METADATA_SQL}, groups(grp, tier, minor) AS ({b.sql_values([(g[0], g[5], g[3]) for g in fv.GROUPS])}) SELECT tier, minor, count(*) AS n, count(DISTINCT occupation) AS n_groups FROM metadata JOIN groups ON grp = occupation GROUP BY ALL",
)
def j7(spark, sf_dir):
    rows = dimensions.lookup_groups(b.metadata(spark, sf_dir), "occupation")
    return rows.groupBy("tier", "minor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("occupation").alias("n_groups")
    )


@query(
    "J8_major_income_or_median",
    f"""WITH {b.SURVEY_SQL}, groups(grp, major) AS ({b.sql_values([(g[0], int(g[4])) for g in fv.GROUPS])}),
valid AS (SELECT CAST(pais AS VARCHAR) AS country, occup AS major, TRY_CAST(income AS DOUBLE) AS x FROM survey WHERE TRY_CAST(income AS DOUBLE) NOT IN (88, 98, 99, 888888, 999999, -1)),
means AS (SELECT country, major, avg(x) AS m FROM valid WHERE major IS NOT NULL AND major <> 4 GROUP BY ALL),
med AS (SELECT country, quantile_cont(x, 0.5) AS md FROM valid GROUP BY country)
SELECT med.country, g.grp, {r('coalesce(m, md)')} AS income FROM med CROSS JOIN groups g LEFT JOIN means ON means.country = med.country AND means.major = g.major""",
)
def j8(spark, sf_dir):
    rows = b.survey(spark, sf_dir)
    category = F.when(F.col("occup") != 4, F.col("occup"))  # one major without incomes
    rows = rows.select(F.col("pais").alias("country"), "income", category.alias("category"))
    return tidy(weights.survey_incomes(rows, weights.groups_with_major(spark)))


@query(
    "J9_label_consensus_join",
    f"""WITH {b.METADATA_SQL},
labels_t AS (SELECT image_id, CAST(seed % 11 + 1 AS BIGINT) AS label_a FROM metadata_unique WHERE backend IS NOT NULL),
cons AS (SELECT image_id, CAST(min(row_ord % 11 + 1) AS BIGINT) AS consensus_bin FROM metadata WHERE backend = 'cache' GROUP BY image_id)
SELECT l.label_a, coalesce(c.consensus_bin, 0) AS consensus_bin, count(*) AS n FROM labels_t l LEFT JOIN cons c ON c.image_id = l.image_id GROUP BY ALL""",
)
def j9(spark, sf_dir):
    unique = merge.latest_by_key(b.metadata(spark, sf_dir)).where(F.col("backend").isNotNull())
    labels = unique.select("image_id", (F.col("seed") % 11 + 1).alias("label_a"))
    cons = (
        b.metadata(spark, sf_dir)
        .where(F.col("backend") == "cache")
        .groupBy("image_id")
        .agg(F.min(F.col("row_ord") % 11 + 1).alias("consensus_bin"))
    )
    joined = labels.join(cons, "image_id", "left")
    return joined.groupBy("label_a", F.coalesce("consensus_bin", F.lit(0)).alias("consensus_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


PATH_SQL = f"""WITH {b.METADATA_SQL},
named AS (
  SELECT *, CASE WHEN row_ord % 3 = 0 THEN 'old/' || seed ELSE 'main/' || replace(occupation, ' ', '_') || '/seed_' || seed || '.png' END AS path,
         'main/' || replace(occupation, ' ', '_') || '/seed_' || seed || '.png' AS canonical
  FROM metadata_unique
),
files AS (SELECT DISTINCT 'main/' || replace(occupation, ' ', '_') || '/seed_' || seed || '.png' AS path FROM metadata WHERE backend IS DISTINCT FROM 'cache'),
repaired AS (
  SELECT model, backend, image_id, CASE WHEN path IN (SELECT path FROM files) THEN path WHEN canonical IN (SELECT path FROM files) THEN canonical ELSE path END AS path,
         CASE WHEN path IN (SELECT path FROM files) THEN 'ok' WHEN canonical IN (SELECT path FROM files) THEN 'fixed' ELSE 'orphan' END AS path_status
  FROM named
)"""


def repaired_paths(spark, sf_dir):
    meta = b.metadata(spark, sf_dir)
    root = "main"
    canonical = ids.canonical_path(F.col("occupation"), F.col("seed"), root)
    files = meta.where(~F.col("backend").eqNullSafe(F.lit("cache"))).select(canonical.alias("path"))
    named = merge.latest_by_key(meta).withColumn(
        "path",
        F.when(F.col("row_ord") % 3 == 0, F.concat(F.lit("old/"), F.col("seed").cast("string"))).otherwise(canonical),
    )
    return panel.repair_paths(named, files, root)


@query("J12_path_repair", PATH_SQL + " SELECT image_id, path, path_status FROM repaired")
def j12(spark, sf_dir):
    return repaired_paths(spark, sf_dir).select("image_id", "path", "path_status")


@query(
    "L12_path_report",
    PATH_SQL + " SELECT model, coalesce(backend, '-') AS backend, path_status, count(*) AS n FROM repaired GROUP BY ALL",
)
def l12(spark, sf_dir):
    rows = repaired_paths(spark, sf_dir)
    return rows.groupBy("model", F.coalesce("backend", F.lit("-")).alias("backend"), "path_status").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- set operations -----------------------------------------------------------


@query(
    "U1_union_all",
    f"""SELECT kind, count(*) AS n, count(seg) AS n_seg, {r('sum(bal)', 2)} AS balance FROM (
  SELECT 'customer' AS kind, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY kind""",
)
def u1(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")
    )
    s = b.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"))
    out = union_all([c, s]).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("seg").alias("n_seg"), F.sum("bal").alias("balance")
    )
    return tidy(out, 2)


@query(
    "U2_ordered_grid_union",
    f"""WITH {b.GRID_SQL}, supp AS (SELECT s_suppkey AS ord_group, {b.sql_list(fv.GROUP_NAMES)}[s_suppkey % 25 + 1] AS occupation FROM supplier)
SELECT 0::BIGINT AS prio, language, model, count(*) AS n, CAST(min(seed) AS BIGINT) AS lowest_seed FROM grid GROUP BY ALL
UNION ALL
SELECT 2::BIGINT, l.language, m.model, count(*), CAST(min({b._seed_sql('ord_group', 'l.i', 'm.i', '0')}) + {fv.SEED_OFFSETS['robustness']} AS BIGINT)
FROM supp, (SELECT unnest(range(0, 4)) AS i, unnest({b.sql_list(fv.MAIN_LANGUAGES)}) AS language) l, (SELECT unnest(range(0, 4)) AS i, unnest({b.sql_list(fv.EXTRA_MODELS)}) AS model) m, range(0, 3) r GROUP BY ALL""",
)
def u2(spark, sf_dir):
    """Two grids with priorities; the second one over suppliers and extra models."""
    suppliers = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("grp_index"), b.pick(fv.GROUP_NAMES, F.col("s_suppkey") % 25).alias("grp")
    )
    extra = grid.enumerate_grid(
        suppliers, fv.MAIN_LANGUAGES, fv.EXTRA_MODELS, 3, "robustness", fv.SEED_OFFSETS["robustness"], priority=2
    )
    both = b.customer_grid(spark, sf_dir).unionByName(extra)
    return tidy(
        both.groupBy("prio", "language", "model").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("lowest_seed"))
    )


@query(
    "U3_id_union",
    "SELECT id FROM (SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)",
)
def u3(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    s = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return o.union(c).union(s).distinct()


@query(
    "U4_intersection",
    GRID_META_SQL + " SELECT image_id FROM grid INTERSECT SELECT image_id FROM metadata",
)
def u4(spark, sf_dir):
    cells = b.customer_grid(spark, sf_dir).select("image_id")
    return cells.intersect(b.metadata(spark, sf_dir).select("image_id"))


@query(
    "U5_difference",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def u5(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = b.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return c.subtract(o)


@query(
    "U6_distinct_codes",
    f"WITH {b.METADATA_SQL}, groups(grp, tier, minor) AS ({b.sql_values([(g[0], g[5], g[3]) for g in fv.GROUPS])}) SELECT DISTINCT minor FROM metadata JOIN groups ON grp = occupation WHERE tier IN ('high', 'low') ORDER BY minor",
)
def u6(spark, sf_dir):
    rows = dimensions.lookup_groups(b.metadata(spark, sf_dir).select("occupation").distinct(), "occupation")
    return rows.where(F.col("tier").isin("high", "low")).select("minor").distinct().orderBy("minor")
