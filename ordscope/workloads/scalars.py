"""Scalar function and media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids, ordinal, prompts
from ordscope.operators import classify
from ordscope.operators.imputation import normalise_survey
from ordscope.operators.regression import outcome_share
from ordscope.sources.images import with_patch_statistics
from ordscope.sources.literals import literal_table
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import query, r, tidy

def row_count():
    return F.count(F.lit(1)).alias("n")


@query(
    "F1_consensus",
    f"""WITH {b.RATERS_SQL},
v AS (SELECT r1, r2, r3, list_sort(list_filter([r1, r2, r3], lambda x: x IS NOT NULL)) AS l FROM raters),
m AS (SELECT *, len(l) AS k, CAST(round_even((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0, 0) AS INTEGER) AS med FROM v),
c AS (SELECT *, len(list_filter(l, lambda x: abs(x - med) <= 1)) AS near FROM m)
SELECT CAST(med AS BIGINT) AS bin, CAST(k AS BIGINT) AS n_available, CAST(near AS BIGINT) AS n_concordant, near >= 2 AS concordant, count(*) AS n FROM c GROUP BY ALL""",
)
def f1(spark, sf_dir):
    rows = b.raters(spark, sf_dir)
    c = ordinal.consensus([F.col("r1"), F.col("r2"), F.col("r3")])
    return tidy(rows.select(c.alias("c")).select("c.*").groupBy("bin", "n_available", "n_concordant", "concordant").agg(row_count()))


ANGLE_SQL = "angles AS (SELECT l_linenumber, CASE WHEN l_tax < 0.08 THEN (l_extendedprice / 52500.0 - 1.0) * 120.0 END AS angle FROM lineitem)"


def angles(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.when(F.col("l_tax") < 0.08, (F.col("l_extendedprice") / 52500.0 - 1.0) * 120.0).alias("angle")
    )


@query(
    "F2_angle_to_bin",
    f"WITH {ANGLE_SQL} SELECT CAST(CASE WHEN angle IS NULL THEN 6 ELSE round_even(greatest(0.0, least(1.0, (55.0 - angle) / 105.0)) * 10, 0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM angles GROUP BY 1",
)
def f2(spark, sf_dir):
    return tidy(angles(spark, sf_dir).groupBy(ordinal.angle_to_bin(F.col("angle")).alias("bin")).agg(row_count()))


@query(
    "F3_angle_to_label",
    f"""WITH {ANGLE_SQL} SELECT CASE WHEN angle >= -90 AND angle < -30 THEN 'dark' WHEN angle >= -30 AND angle < 10 THEN 'brown' WHEN angle >= 10 AND angle < 28 THEN 'tan'
 WHEN angle >= 28 AND angle < 41 THEN 'intermediate' WHEN angle >= 41 AND angle < 55 THEN 'light' WHEN angle >= 55 AND angle < 90 THEN 'very_light' ELSE 'unknown' END AS label, count(*) AS n FROM angles GROUP BY 1""",
)
def f3(spark, sf_dir):
    return angles(spark, sf_dir).groupBy(ordinal.angle_to_label(F.col("angle")).alias("label")).agg(row_count())


@query(
    "F4_tone_to_bin",
    "WITH t AS (SELECT CAST(floor(l_quantity / 4) AS BIGINT) AS tone FROM lineitem) SELECT tone, CAST(CASE WHEN tone BETWEEN 1 AND 10 THEN round_even((tone - 1) / 9.0::DOUBLE * 10, 0) + 1 ELSE 6 END AS BIGINT) AS bin, count(*) AS n FROM t GROUP BY ALL",
)
def f4(spark, sf_dir):
    tone = F.floor(F.col("l_quantity") / 4)
    rows = b.table(spark, sf_dir, "lineitem").select(tone.alias("tone"), ordinal.tone_to_bin(tone).alias("bin"))
    return tidy(rows.groupBy("tone", "bin").agg(row_count()))


@query(
    "F5_angle_from_medians",
    f"WITH t AS (SELECT l_quantity * 2.0 AS l, (l_linenumber - 4) * 3.0 AS bb FROM lineitem) SELECT l, bb, {r('CASE WHEN abs(bb) < 1e-9 THEN CASE WHEN l >= 50 THEN 90.0 ELSE -90.0 END ELSE degrees(atan2(l - 50.0, bb)) END')} AS angle, count(*) AS n FROM t GROUP BY ALL",
)
def f5(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") * 2.0).alias("l"), ((F.col("l_linenumber") - 4) * 3.0).alias("bb")
    )
    angle = ordinal.angle_from_medians(F.col("l"), F.col("bb")).alias("angle")
    return tidy(rows.select("l", "bb", angle).groupBy("l", "bb", "angle").agg(row_count()))


COLOUR_SQL = "colours AS (SELECT l_quantity * 5.0 AS cr, floor(l_extendedprice / 420.0) AS cg, (l_discount + l_tax) * 1300.0 AS cb FROM lineitem)"


@query(
    "F6_nearest_anchor",
    f"""WITH {COLOUR_SQL}, anchors(tone, ar, ag, ab) AS ({b.sql_values([(i, *a) for i, a in enumerate(fv.COLOUR_ANCHORS, 1)])}),
d AS (SELECT cr, cg, cb, tone, (cr - ar) ** 2 + (cg - ag) ** 2 + (cb - ab) ** 2 AS dist FROM (SELECT DISTINCT cr, cg, cb FROM colours) CROSS JOIN anchors),
best AS (SELECT cr, cg, cb, tone FROM d QUALIFY row_number() OVER (PARTITION BY cr, cg, cb ORDER BY dist, tone) = 1)
SELECT CAST(tone AS BIGINT) AS tone, count(*) AS n FROM colours JOIN best USING (cr, cg, cb) GROUP BY 1""",
)
def f6(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem")
    tone = ordinal.nearest_anchor(
        F.col("l_quantity") * 5.0, F.floor(F.col("l_extendedprice") / 420.0).cast("double"), (F.col("l_discount") + F.col("l_tax")) * 1300.0
    )
    return tidy(rows.groupBy(tone.alias("tone")).agg(row_count()))


CODES = [*fv.PALETTE_DARK_TO_LIGHT, " #FBF2F3 ", "#513B2E", "#000000", "none"]


@query(
    "F7_palette_to_bin",
    f"""WITH p(pos, code) AS ({b.sql_values(list(enumerate(fv.PALETTE_DARK_TO_LIGHT)))}), c AS (SELECT {b.sql_list(CODES)}[l_partkey % {len(CODES)} + 1] AS code FROM lineitem)
SELECT c.code, CAST(coalesce(11 - p.pos, 0) AS BIGINT) AS bin, count(*) AS n FROM c LEFT JOIN p ON p.code = lower(trim(c.code)) GROUP BY ALL""",
)
def f7(spark, sf_dir):
    code = b.pick(CODES, F.col("l_partkey") % len(CODES))
    rows = b.table(spark, sf_dir, "lineitem").select(code.alias("code"))
    return tidy(rows.groupBy("code", F.coalesce(ordinal.palette_to_bin(F.col("code")), F.lit(0)).alias("bin")).agg(row_count()))


@query(
    "F8_unit_id",
    "SELECT p_partkey, replace(p_brand || '/' || p_type, '/', '_') || '__' || replace(p_name, ' ', '_') || '__' || p_size AS image_id FROM part",
)
def f8(spark, sf_dir):
    model = F.concat_ws("/", "p_brand", "p_type")
    return b.table(spark, sf_dir, "part").select("p_partkey", ids.unit_id(model, F.col("p_name"), F.col("p_size")).alias("image_id"))


@query(
    "F9_cell_seed",
    f"SELECT l_orderkey, l_linenumber, count(*) AS n, CAST({b._seed_sql('l_orderkey', 'l_linenumber % 4', 'l_suppkey % 8', 'l_partkey % 30')} + {fv.SEED_OFFSETS['h5']} AS BIGINT) AS seed, CAST({fv.BASE_SEED} AS BIGINT) * 1000 + l_linenumber * 100 + l_suppkey % 10 AS short_seed FROM lineitem GROUP BY ALL",
)
def f9(spark, sf_dir):
    c = F.col
    seed = ids.cell_seed(c("l_orderkey"), c("l_linenumber") % 4, c("l_suppkey") % 8, c("l_partkey") % 30, offset=fv.SEED_OFFSETS["h5"])
    short = ids.short_seed(c("l_linenumber"), c("l_suppkey") % 10)
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seed.alias("seed"), short.alias("short_seed"))
    return tidy(rows.groupBy(*rows.columns).agg(row_count()))


# ---- prompts --------------------------------------------------------------------------

LANGUAGES = [*fv.MAIN_LANGUAGES, *fv.INDIGENOUS_LANGUAGES, "xx"]
KEYS = [*fv.GROUP_NAMES, "astronaut", "marker:LatAm:architect", "marker:EU:doctor", "marker:unmarked:accountant"]
NOUNS = (
    [("en", g[0], g[0]) for g in fv.GROUPS]
    + [("es", g[0], g[1]) for g in fv.GROUPS]
    + [("pt-BR", g[0], g[2]) for g in fv.GROUPS]
    + [(lang, g, w) for lang, words in fv.INDIGENOUS_NOUNS.items() for g, w in words.items()]
)
ARTICLE_SQL = "CASE WHEN regexp_matches(lower({0}), '^[aeiou]') AND NOT regexp_matches(lower({0}), '^(eu|uni|use|ute|one)') THEN 'an ' ELSE 'a ' END"
PROMPT_SQL = f"""WITH nouns(lang, grp, noun) AS ({b.sql_values(NOUNS)}),
known(grp) AS ({b.sql_values([(g,) for g in fv.GROUP_NAMES])}),
k AS (SELECT {b.sql_list(KEYS)}[p_partkey % {len(KEYS)} + 1] AS key, {b.sql_list(LANGUAGES)}[p_size % {len(LANGUAGES)} + 1] AS language FROM part),
s AS (
  SELECT key, language, key LIKE 'marker:%' AS is_marker, CASE WHEN key LIKE 'marker:%' THEN split_part(key, ':', 2) END AS marker,
         CASE WHEN key LIKE 'marker:%' THEN split_part(key, ':', 3) ELSE key END AS grp FROM k
),
j AS (
  SELECT s.*, n.noun, known.grp IS NOT NULL AS is_known,
         CASE marker WHEN 'LatAm' THEN 'Colombian ' WHEN 'US' THEN 'American ' WHEN 'EU' THEN 'European ' ELSE '' END || n.noun AS spoken
  FROM s LEFT JOIN nouns n ON n.grp = s.grp AND n.lang = CASE WHEN language LIKE 'es%' THEN 'es' ELSE language END
  LEFT JOIN known ON known.grp = s.grp
)"""
PROMPT_CASE = f"""CASE WHEN is_marker AND language <> 'en' THEN NULL WHEN language = 'en' THEN 'a photo of ' || {ARTICLE_SQL.format('spoken')} || spoken
  WHEN language = 'es-ES' THEN 'una fotografía de un ' || spoken WHEN language = 'es-LatAm' THEN 'una foto de un ' || spoken
  WHEN language = 'pt-BR' THEN 'uma foto de um ' || spoken WHEN language IN ('qu', 'gn') THEN noun END"""


def prompt_keys(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        b.pick(KEYS, F.col("p_partkey") % len(KEYS)).alias("key"), b.pick(LANGUAGES, F.col("p_size") % len(LANGUAGES)).alias("language")
    )


@query("F10_prompt_text", PROMPT_SQL + f" SELECT key, language, coalesce({PROMPT_CASE}, '') AS prompt, count(*) AS n FROM j GROUP BY ALL")
def f10(spark, sf_dir):
    rows = prompt_keys(spark, sf_dir)
    text = F.coalesce(prompts.prompt_text(F.col("key"), F.col("language")), F.lit(""))
    return rows.groupBy("key", "language", text.alias("prompt")).agg(row_count())


@query(
    "F11_english_article",
    f"SELECT word, {ARTICLE_SQL.format('word')} AS article, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents) GROUP BY ALL",
)
def f11(spark, sf_dir):
    words = b.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    counted = words.groupBy("word").agg(row_count())
    return counted.withColumn("article", prompts.english_article(F.col("word")))


@query(
    "F12_marker_key",
    "SELECT 'marker:' || p_type || ':' || p_name AS key, p_type AS marker, p_name AS grp, count(*) AS n FROM part GROUP BY ALL",
)
def f12(spark, sf_dir):
    key = ids.marker_key(F.col("p_type"), F.col("p_name"))
    rows = b.table(spark, sf_dir, "part").select(key.alias("key")).withColumn("s", ids.split_marker(F.col("key")))
    return rows.groupBy("key", "s.marker", "s.grp").agg(row_count())


@query(
    "F13_prompt_status",
    PROMPT_SQL
    + """ SELECT CASE WHEN is_marker AND language <> 'en' THEN 'unavailable:NotImplementedError:marker prompts are English-only: ' || language
  WHEN language = 'xx' THEN 'unavailable:ValueError:unknown language ' || language WHEN NOT is_known THEN 'unavailable:KeyError:unknown group ' || grp
  WHEN noun IS NULL THEN 'unavailable:ValueError:no documented ' || language || ' noun for ' || grp ELSE 'ok' END AS prompt_status, count(*) AS n FROM j GROUP BY ALL""",
)
def f13(spark, sf_dir):
    status = prompts.prompt_status(F.col("key"), F.col("language"))
    return prompt_keys(spark, sf_dir).groupBy(status.alias("prompt_status")).agg(row_count())


@query(
    "F14_safe_path",
    """SELECT page_id, CASE WHEN c = '' THEN '_' ELSE c END AS safe FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?* ]', '_', 'g'), '[. ]+$', '') AS c FROM pages)""",
)
def f14(spark, sf_dir):
    pages = spark.read.schema("page_id bigint, url string").parquet(b.table_path(sf_dir, "pages"))
    return pages.select("page_id", ids.safe_path_component(F.col("url")).alias("safe"))


@query(
    "F15_composite_ids",
    f"WITH {b.GRID_SQL} SELECT cell_id, grid || '|' || model || '|' || language AS shard_group, count(*) AS n FROM grid GROUP BY ALL",
)
def f15(spark, sf_dir):
    c = F.col
    rows = b.customer_grid(spark, sf_dir)
    return rows.groupBy(
        ids.cell_id(c("model"), c("language"), c("country"), c("occupation")).alias("cell_id"),
        ids.shard_group(c("grid"), c("model"), c("language")).alias("shard_group"),
    ).agg(row_count())


@query("F17_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f17(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("sha256"))


@query("F18_fold_seed", f"WITH {b.GRID_SQL} SELECT seed, seed % 4294967296 AS provider_seed FROM grid")
def f18(spark, sf_dir):
    return b.customer_grid(spark, sf_dir).select("seed", ids.fold_seed(F.col("seed")).alias("provider_seed"))


@query(
    "F19_label_sum",
    f"SELECT l_returnflag, count(*) AS n, {r('sum(l_discount + l_tax + l_quantity / 100.0)', 4)} AS total FROM lineitem GROUP BY l_returnflag",
)
def f19(spark, sf_dir):
    labels = fv.OUTCOME_LABELS
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_discount").alias(labels[0]),
        F.col("l_tax").alias(labels[1]),
        (F.col("l_quantity") / 100.0).alias(labels[2]),
    )
    return tidy(outcome_share(rows).groupBy("l_returnflag").agg(row_count(), F.sum("outcome").alias("total")), 4)


@query(
    "F20_major_code",
    "SELECT coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size % 10 AS VARCHAR) END, ''), substr(CAST(p_partkey + 100 AS VARCHAR), 1, 1)) AS major, count(*) AS n FROM part GROUP BY 1",
)
def f20(spark, sf_dir):
    explicit = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise((F.col("p_size") % 10).cast("string"))
    code = ids.major_code(explicit, (F.col("p_partkey") + 100).cast("string"))
    return b.table(spark, sf_dir, "part").groupBy(code.alias("major")).agg(row_count())


@query(
    "X6_national_survey",
    f"""WITH cw(national_code, minor) AS ({b.sql_values([(s, m) for s, m in zip(('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'), ('112', '221', '251', '931'))])})
SELECT 'CO' AS country, CAST(c_custkey AS VARCHAR) AS respondent_id, coalesce(minor, '-') AS minor, 'observed' AS bin_source, {r('c_acctbal')} AS income_monthly FROM customer LEFT JOIN cw ON national_code = c_mktsegment""",
)
def x6(spark, sf_dir):
    codes = zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"), ("112", "221", "251", "931"))
    crosswalk = literal_table(spark, codes, "national_code string, minor string")
    columns = {"respondent_id": "c_custkey", "minor": "c_mktsegment", "income_monthly": "c_acctbal"}
    out = normalise_survey(b.table(spark, sf_dir, "customer"), "CO", columns, crosswalk)
    out = out.withColumn("minor", F.coalesce("minor", F.lit("-")))
    return tidy(out.select("country", "respondent_id", "minor", "bin_source", "income_monthly"))


# ---- media: pixels derived from embedding vectors ----------------------------------------


def patches(spark, sf_dir):
    """BGR bytes from the vector components, three per pixel."""
    level = F.transform(
        "embedding", lambda v: F.floor(F.least(F.greatest(v.cast("double") * 400.0 + 128.0, F.lit(0.0)), F.lit(255.0))).cast("int")
    )
    # Whole pixels: the last component fills the last one up, so that every component is read.
    level = F.concat(level, F.array_repeat(F.element_at(level, -1), F.pmod(-F.size("embedding"), F.lit(3))))
    hex_bytes = F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return b.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.unhex(hex_bytes).alias("data"))


PATCH_SQL = """lv AS (
  SELECT vec_id, label, i, CAST(floor(least(greatest(CAST(embedding[least(i, len(embedding))] AS DOUBLE) * 400.0 + 128.0, 0.0), 255.0)) AS INTEGER) AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(1, (len(embedding) + 2) // 3 * 3 + 1)) AS i FROM embeddings)
),
px AS (
  SELECT vec_id, label, (i - 1) // 3 AS p, max(CASE WHEN i % 3 = 1 THEN x END)::DOUBLE AS bl, max(CASE WHEN i % 3 = 2 THEN x END)::DOUBLE AS gr, max(CASE WHEN i % 3 = 0 THEN x END)::DOUBLE AS rd
  FROM lv GROUP BY ALL
),
lin AS (
  SELECT *, CASE WHEN rd / 255 > 0.04045 THEN ((rd / 255 + 0.055) / 1.055) ** 2.4 ELSE rd / 255 / 12.92 END AS lr,
         CASE WHEN gr / 255 > 0.04045 THEN ((gr / 255 + 0.055) / 1.055) ** 2.4 ELSE gr / 255 / 12.92 END AS lg,
         CASE WHEN bl / 255 > 0.04045 THEN ((bl / 255 + 0.055) / 1.055) ** 2.4 ELSE bl / 255 / 12.92 END AS lb FROM px
),
xyz AS (SELECT *, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM lin),
lab AS (
  SELECT *, round(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END, 9) AS l,
         round(200 * (CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0 / 116 END - CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0 / 116 END), 9) AS b
  FROM xyz
),
med AS (
  SELECT vec_id, label, median(l) FILTER (WHERE l > 20 AND l < 95) AS l_med, median(b) FILTER (WHERE l > 20 AND l < 95) AS b_med,
         median(rd) FILTER (WHERE l > 15 AND l < 97) AS r_med, median(gr) FILTER (WHERE l > 15 AND l < 97) AS g_med, median(bl) FILTER (WHERE l > 15 AND l < 97) AS b_med_rgb
  FROM lab GROUP BY ALL
)"""


@query("M1_patch_angle", f"WITH {PATCH_SQL} SELECT vec_id, {r('l_med')} AS l_med, {r('b_med')} AS b_med FROM med")
def m1(spark, sf_dir):
    return tidy(with_patch_statistics(patches(spark, sf_dir)).select("vec_id", "l_med", "b_med"))


TONE_SQL = f"""anchors(tone, ar, ag, ab) AS ({b.sql_values([(i, *a) for i, a in enumerate(fv.COLOUR_ANCHORS, 1)])}),
tones AS (SELECT vec_id, tone FROM med CROSS JOIN anchors QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (r_med - ar) ** 2 + (g_med - ag) ** 2 + (b_med_rgb - ab) ** 2, tone) = 1)"""


@query(
    "M2_patch_tone",
    f"WITH {PATCH_SQL}, {TONE_SQL} SELECT m.vec_id, {r('r_med')} AS r_med, {r('g_med')} AS g_med, {r('b_med_rgb')} AS b_med_rgb, CAST(tone AS BIGINT) AS tone FROM med m JOIN tones t ON t.vec_id = m.vec_id",
)
def m2(spark, sf_dir):
    stats = with_patch_statistics(patches(spark, sf_dir))
    tone = ordinal.nearest_anchor(F.col("r_med"), F.col("g_med"), F.col("b_med_rgb"))
    return tidy(stats.select("vec_id", "r_med", "g_med", "b_med_rgb", tone.alias("tone")))


@query(
    "M3_classify_table",
    f"""WITH {PATCH_SQL}, {TONE_SQL}, pal(pos, code) AS ({b.sql_values(list(enumerate(fv.PALETTE_DARK_TO_LIGHT)))}),
a AS (
  SELECT m.vec_id, m.label % 5 <> 0 AS face, CASE WHEN abs(b_med) < 1e-9 THEN CASE WHEN l_med >= 50 THEN 90.0 ELSE -90.0 END ELSE degrees(atan2(l_med - 50.0, b_med)) END AS angle, t.tone,
         11 - p.pos AS pb
  FROM med m JOIN tones t ON t.vec_id = m.vec_id LEFT JOIN pal p ON p.code = {b.sql_list(CODES)}[m.vec_id % {len(CODES)} + 1]
),
bins AS (
  SELECT *, CAST(round_even(greatest(0.0, least(1.0, (55.0 - angle) / 105.0)) * 10, 0) + 1 AS INTEGER) AS ab, CAST(round_even((tone - 1) / 9.0::DOUBLE * 10, 0) + 1 AS INTEGER) AS tb FROM a
),
l AS (SELECT *, list_sort(list_filter([ab, tb, pb], lambda x: x IS NOT NULL)) AS v FROM bins),
m3 AS (SELECT *, CAST(round_even((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2.0, 0) AS INTEGER) AS c FROM l)
SELECT vec_id, face AS has_face, CASE WHEN face THEN CASE WHEN angle >= -90 AND angle < -30 THEN 'dark' WHEN angle >= -30 AND angle < 10 THEN 'brown' WHEN angle >= 10 AND angle < 28 THEN 'tan'
 WHEN angle >= 28 AND angle < 41 THEN 'intermediate' WHEN angle >= 41 AND angle < 55 THEN 'light' WHEN angle >= 55 AND angle < 90 THEN 'very_light' ELSE 'unknown' END ELSE 'no_face' END AS ita_label,
 CAST(CASE WHEN face THEN c ELSE 0 END AS BIGINT) AS consensus_bin, CAST(CASE WHEN face THEN len(v) ELSE 0 END AS BIGINT) AS n_classifiers,
 CAST(CASE WHEN face THEN len(list_filter(v, lambda x: abs(x - c) <= 1)) ELSE 0 END AS BIGINT) AS n_concordant, face AND len(list_filter(v, lambda x: abs(x - c) <= 1)) >= 2 AS concordant_2of3,
 CAST(CASE WHEN face THEN 1 ELSE 0 END AS BIGINT) AS n_faces, {r('CASE WHEN face THEN angle END')} AS ita_value, CAST(coalesce(CASE WHEN face THEN ab END, 0) AS BIGINT) AS ita_bin,
 CAST(coalesce(CASE WHEN face THEN tone END, 0) AS BIGINT) AS mst_value, CAST(coalesce(CASE WHEN face THEN tb END, 0) AS BIGINT) AS mst_bin, CAST(coalesce(CASE WHEN face THEN pb END, 0) AS BIGINT) AS palette_bin FROM m3""",
)
def m3(spark, sf_dir):
    stats = with_patch_statistics(patches(spark, sf_dir)).withColumns(
        {
            "has_face": F.col("label") % 5 != 0,
            "palette_code": F.get(F.array(*[F.lit(c.strip()) if c.startswith("#") and c == c.lower() else F.lit(None) for c in CODES]), (F.col("vec_id") % len(CODES)).cast("int")),
        }
    )
    out = classify.classify(stats)
    return tidy(
        out.select(
            "vec_id", "has_face", "ita_label", F.coalesce("consensus_bin", F.lit(0)).alias("consensus_bin"),
            "n_classifiers", "n_concordant", "concordant_2of3", "n_faces", "ita_value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ita_bin", "mst_value", "mst_bin", "palette_bin")],
        )
    )
