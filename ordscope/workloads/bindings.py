"""How the driver's tables play the roles of an audit.

Each binding exists twice: as a DataFrame and as a SQL common table expression.
All of them are row-wise derivations of whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids
from ordscope.functions.literals import array_of, map_of
from ordscope.operators.grid import enumerate_grid
from ordscope.session import spread
from ordscope.workloads.registry import epoch_seconds

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan with a declared schema: no footer is read to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))


def pick(values, index: Column) -> Column:
    """Element of a literal list by 0-based index."""
    return F.get(array_of(values), index.cast("int"))


def sql_list(values) -> str:
    quoted = ["'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return "[" + ", ".join(quoted) + "]"


def sql_values(rows) -> str:
    """VALUES list of tuples."""
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


# ---- panel: one row per line item -----------------------------------------

CELL = ["country", "language", "model"]


def quantity_bin(q: Column) -> Column:
    return (F.floor((q - 1) / 4.5) + 1).cast("int")


def panel(
    spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame] = lambda scan: scan
) -> DataFrame:
    """Units with group, cell keys, bin, eligibility flag and an income.

    ``prepare`` may redistribute the line item scan. The joins are left-deep on
    base tables on purpose: each dimension is planned with its own file size, so
    it is broadcast only while it is small and shuffled by key beyond that.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"))
    lines = prepare(table(spark, sf_dir, "lineitem"))
    q = F.col("l_quantity")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.cast("long")
            ).alias("unit_id"),
            "grp",
            F.col("r_name").alias("country"),
            F.col("l_returnflag").alias("language"),
            F.col("l_linestatus").alias("model"),
            F.when(q != 50, quantity_bin(q)).alias("bin"),
            F.when(F.col("l_tax") < 0.08, F.col("l_discount") > 0.0).alias("has_signal"),
            F.col("l_extendedprice").alias("income"),
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_quantity",
            "l_suppkey",
        )
    )


PANEL_SQL = """
panel AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS unit_id,
         p_brand AS grp, r_name AS country, l_returnflag AS language, l_linestatus AS model,
         CASE WHEN l_quantity <> 50 THEN CAST(floor((l_quantity - 1) / 4.5) + 1 AS INTEGER) END AS bin,
         CASE WHEN l_tax < 0.08 THEN l_discount > 0.0 END AS has_signal,
         l_extendedprice AS income, l_extendedprice, l_discount, l_tax, l_quantity, l_suppkey
  FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
)"""

BINS_SQL = "bins AS (SELECT CAST(unnest(range(1, 12)) AS INTEGER) AS bin)"


def hist_sql(name: str, keys: str, where: str = "coalesce(has_signal, false)", source: str = "panel") -> str:
    """CTEs ``<name>`` (long, dense, with prob) built by dense join and windows."""
    on = " AND ".join(f"c.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    part = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_keys AS (SELECT {keys}, count(*) AS n_rows FROM {source} GROUP BY {keys}),
{name}_counts AS (
  SELECT {keys}, bin, count(*) AS n FROM {source} WHERE {where} AND bin IS NOT NULL GROUP BY {keys}, bin
),
{name}_dense AS (
  SELECT k.*, b.bin, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY {part}) AS BIGINT) AS n_support
  FROM {name}_keys k CROSS JOIN bins b LEFT JOIN {name}_counts c ON {on} AND c.bin = b.bin
),
{name} AS (
  SELECT *, CASE WHEN n_support = 0 THEN 1.0::DOUBLE / 11 ELSE n::DOUBLE / n_support END AS prob,
         n_support = 0 AS is_uniform_fallback FROM {name}_dense
)"""


# Weights: average-tie percentile rank of the mean income per (country, group).
WEIGHTS_SQL = """
incomes AS (SELECT country, grp, avg(income) AS income FROM panel GROUP BY country, grp),
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY country ORDER BY income)
             + (count(*) OVER (PARTITION BY country, income) - 1) / 2.0) / count(*) OVER (PARTITION BY country) AS pct_rank
  FROM incomes
),
weights AS (SELECT *, pct_rank / sum(pct_rank) OVER (PARTITION BY country) AS weight FROM ranked)"""

METRICS_SQL = (
    hist_sql("obs", "country, language, model, grp")
    + ","
    + hist_sql("base", "country, grp", "true")
    + f""",
{WEIGHTS_SQL.strip()},
diffs AS (
  SELECT o.country, o.language, o.model, o.grp, o.n_rows, o.bin, o.prob AS p, b.prob AS q,
         sum(o.prob - b.prob) OVER (PARTITION BY o.country, o.language, o.model, o.grp ORDER BY o.bin) AS cdf_diff
  FROM obs o JOIN base b ON b.country = o.country AND b.grp = o.grp AND b.bin = o.bin
),
metrics AS (
  SELECT d.country, d.language, d.model, d.grp, max(d.n_rows) AS n_rows,
         sum(CASE WHEN d.bin < 11 THEN abs(cdf_diff) ELSE 0 END) AS distance,
         sum(p * d.bin) - sum(q * d.bin) AS delta, max(w.weight) AS weight
  FROM diffs d LEFT JOIN weights w ON w.country = d.country AND w.grp = d.grp
  GROUP BY d.country, d.language, d.model, d.grp
),
signed AS (SELECT *, CASE WHEN abs(delta) < 1e-12 THEN 0 ELSE distance * sign(delta) END AS signed_distance FROM metrics)"""
)

# ---- generation metadata: one row per order --------------------------------

N_REPLICATES = 2
PRIORITY_LANGUAGE = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 0}


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation log: canonical (source 0) and three shards, with repeated ids.

    The columns the reports group by; ``row_ord`` is the position in the source.
    """
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lang_index = F.try_element_at(map_of(PRIORITY_LANGUAGE), F.col("o_orderpriority"))
    staged = o.select(
        "*",
        lang_index.alias("lang_index"),
        (key % 4).alias("model_index"),
        (F.floor(key / 4) % N_REPLICATES).alias("replicate"),
    )
    seed = ids.cell_seed(cust, F.col("lang_index"), F.col("model_index"), F.col("replicate"))
    language = pick(fv.MAIN_LANGUAGES, F.col("lang_index"))
    model = pick(fv.MAIN_MODELS, F.col("model_index"))
    occupation = pick(fv.GROUP_NAMES, cust % 25)
    return staged.select(
        ids.unit_id(model, occupation, seed).alias("image_id"),
        model.alias("model"),
        occupation.alias("occupation"),
        language.alias("language"),
        ids.country_for_language(language).alias("country_proxy"),
        seed.alias("seed"),
        F.when(key % 31 != 5, F.when(F.col("o_orderstatus") == "F", "pollinations").when(F.col("o_orderstatus") == "O", "local_diffusers").otherwise("cache")).alias("backend"),
        F.when(key % 40 != 3, F.col("o_totalprice") / 1000.0).alias("duration_s"),
        F.when(key % 50 != 7, epoch_seconds(F.col("o_orderdate"))).alias("timestamp"),
        (key % 4).cast("int").alias("src_ord"),
        key.alias("row_ord"),
    )


def customer_grid(spark: SparkSession, sf_dir: str, done: DataFrame | None = None) -> DataFrame:
    """Grid over customers x languages x models x replicates; with the column ``done``, given a log."""
    groups = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        F.col("c_custkey").alias("grp_index"), pick(fv.GROUP_NAMES, F.col("c_custkey") % 25).alias("grp")
    )
    return enumerate_grid(groups, fv.MAIN_LANGUAGES, fv.MAIN_MODELS, N_REPLICATES, done=done)


_M_BASE, _M_GROUP, _M_LANG, _M_MODEL = fv.SEED_MULTIPLIERS


def _seed_sql(cust: str, lang: str, model: str, rep: str) -> str:
    return (
        f"(CAST({fv.BASE_SEED} AS BIGINT) * {_M_BASE} + {cust} * {_M_GROUP} + {lang} * {_M_LANG}"
        f" + {model} * {_M_MODEL} + {rep})"
    )


COUNTRY_SQL = (
    "CASE language WHEN 'en' THEN 'MULTI' WHEN 'es-ES' THEN 'MX' WHEN 'pt-BR' THEN 'BR' ELSE 'CO' END"
)

METADATA_SQL = f"""
metadata_idx AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
              WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 0 END AS lang_index,
         o_orderkey % 4 AS model_index, (o_orderkey // 4) % {N_REPLICATES} AS replicate
  FROM orders
),
metadata_cols AS (
  SELECT {sql_list(fv.MAIN_MODELS)}[model_index + 1] AS model,
         {sql_list(fv.GROUP_NAMES)}[o_custkey % 25 + 1] AS occupation,
         {sql_list(fv.MAIN_LANGUAGES)}[lang_index + 1] AS language,
         {_seed_sql('o_custkey', 'lang_index', 'model_index', 'replicate')} AS seed,
         CASE WHEN o_orderkey % 31 <> 5 THEN CASE o_orderstatus WHEN 'F' THEN 'pollinations' WHEN 'O' THEN 'local_diffusers' ELSE 'cache' END END AS backend,
         CASE WHEN o_orderkey % 40 <> 3 THEN o_totalprice / 1000.0 END AS duration_s,
         CASE WHEN o_orderkey % 50 <> 7 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS timestamp,
         CAST(o_orderkey % 4 AS INTEGER) AS src_ord, o_orderkey AS row_ord
  FROM metadata_idx
),
metadata AS (
  SELECT replace(model, '/', '_') || '__' || replace(occupation, ' ', '_') || '__' || seed AS image_id,
         model, occupation, language, {COUNTRY_SQL} AS country_proxy, seed, backend, duration_s, timestamp, src_ord, row_ord
  FROM metadata_cols
),
metadata_unique AS (
  SELECT * FROM metadata
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY timestamp DESC NULLS LAST, src_ord, row_ord) = 1
)"""

GRID_SQL = f"""
grid_idx AS (
  SELECT c_custkey AS ord_group, {sql_list(fv.GROUP_NAMES)}[c_custkey % 25 + 1] AS occupation,
         l.i AS ord_language, l.language, m.i AS ord_model, m.model, r.replicate
  FROM customer,
       (SELECT unnest(range(0, {len(fv.MAIN_LANGUAGES)})) AS i, unnest({sql_list(fv.MAIN_LANGUAGES)}) AS language) l,
       (SELECT unnest(range(0, {len(fv.MAIN_MODELS)})) AS i, unnest({sql_list(fv.MAIN_MODELS)}) AS model) m,
       (SELECT unnest(range(0, {N_REPLICATES})) AS replicate) r
),
grid_seed AS (
  SELECT *, {_seed_sql('ord_group', 'ord_language', 'ord_model', 'replicate')} AS seed, {COUNTRY_SQL} AS country
  FROM grid_idx
),
grid AS (
  SELECT 'main' AS grid, *, {N_REPLICATES} AS target_n,
         replace(model, '/', '_') || '__' || replace(occupation, ' ', '_') || '__' || seed AS image_id,
         model || '|' || language || '|' || country || '|' || occupation AS cell_id
  FROM grid_seed
)"""

# ---- survey: one row per customer -------------------------------------------

REGION_CODES = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents with numeric codes and sentinels."""
    c = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("respondent"),
        F.col("n_regionkey").cast("string").alias("pais"),
        F.when(key % 20 == 0, F.lit(888888)).otherwise(F.floor((F.col("c_acctbal") + 1000) / 1000).cast("int") + 1).alias("colorr"),
        F.when(key % 8 == 7, F.lit(88)).otherwise((key % 8).cast("int")).alias("edre"),
        F.when(key % 11 == 0, F.lit("888888")).when(key % 13 == 0, F.lit("n/a")).otherwise((F.round((F.col("c_acctbal") + 1000) * 100).cast("long")).cast("string")).alias("income"),
        F.when(key % 17 != 0, (key % 9 + 1).cast("int")).alias("occup"),
        F.col("c_mktsegment").alias("category"),
        (F.lit(1.0) + (key % 3) / 2.0).alias("weight"),
    )


SURVEY_SQL = """
survey AS (
  SELECT c_custkey AS respondent, n_regionkey AS pais,
         CASE WHEN c_custkey % 20 = 0 THEN 888888 ELSE CAST(floor((c_acctbal + 1000) / 1000) AS INTEGER) + 1 END AS colorr,
         CASE WHEN c_custkey % 8 = 7 THEN 88 ELSE CAST(c_custkey % 8 AS INTEGER) END AS edre,
         CASE WHEN c_custkey % 11 = 0 THEN '888888' WHEN c_custkey % 13 = 0 THEN 'n/a'
              ELSE CAST(CAST(round((c_acctbal + 1000) * 100) AS BIGINT) AS VARCHAR) END AS income,
         CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 9 + 1 AS INTEGER) END AS occup,
         c_mktsegment AS category, 1.0 + (c_custkey % 3) / 2.0 AS weight
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""

# ---- raters: one row per line item ------------------------------------------


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_returnflag",
        quantity_bin(F.col("l_quantity")).alias("r1"),
        (F.floor(F.col("l_extendedprice") / 10000.0).cast("int") + 1).alias("r2"),
        F.when(F.col("l_tax") < 0.07, F.round(F.col("l_discount") * 100).cast("int") + 1).alias("r3"),
    )


RATERS_SQL = """
raters AS (
  SELECT l_orderkey, l_returnflag, CAST(floor((l_quantity - 1) / 4.5) + 1 AS INTEGER) AS r1,
         CAST(floor(l_extendedprice / 10000.0) AS INTEGER) + 1 AS r2,
         CASE WHEN l_tax < 0.07 THEN CAST(round(l_discount * 100) AS INTEGER) + 1 END AS r3
  FROM lineitem
)"""

# ---- request log: one row per event -------------------------------------------

PHASES = (1, 3, 5, 10)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, kind = F.col("event_id"), F.col("event_type")
    status = (
        F.when((kind == "error") & (eid % 9 == 0), F.lit(429))
        .when((kind == "error") & (eid % 3 == 1), F.lit(503))
        .when(kind == "error", F.lit(None).cast("int"))
        .when((kind == "purchase") & (eid % 10 == 0), F.lit(402))
        .otherwise(F.lit(200))
    )
    staged = e.withColumn("status", status).withColumn("ok", F.coalesce(F.col("status") == 200, F.lit(False)))
    return staged.select(
        pick(PHASES, F.col("user_id") % 4).alias("phase_n"),
        eid.alias("img_idx"),
        "user_id",
        "ts",
        F.col("value").alias("wall_s"),
        "status",
        "ok",
        F.when(F.col("ok"), F.lit("")).otherwise(F.concat(F.lit("E"), F.coalesce(F.col("status").cast("string"), F.lit("net")), F.lit(":"), eid.cast("string"))).alias("error"),
    )


REQUESTS_SQL = f"""
log_status AS (
  SELECT *, CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 429
                 WHEN event_type = 'error' AND event_id % 3 = 1 THEN 503
                 WHEN event_type = 'error' THEN NULL
                 WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 402 ELSE 200 END AS status
  FROM events
),
log AS (
  SELECT {sql_list(PHASES)}[user_id % 4 + 1] AS phase_n, event_id AS img_idx, user_id, ts, value AS wall_s, status,
         coalesce(status = 200, false) AS ok,
         CASE WHEN coalesce(status = 200, false) THEN '' ELSE 'E' || coalesce(CAST(status AS VARCHAR), 'net') || ':' || event_id END AS error
  FROM log_status
)"""
