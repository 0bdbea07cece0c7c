"""Source and sink queries: whole tables read, written to scratch, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.session import scratch_dir
from ordscope.sources import dimensions, readers, sinks, versions
from ordscope.streaming import shards
from ordscope.workloads import audits
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import query, r, tidy
from ordscope.workloads.relational import META_SQL


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "S1_parquet_scan",
    f"SELECT l_returnflag, l_linestatus, count(*) AS n, {r('sum(l_quantity)')} AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL",
)
def s1(spark, sf_dir):
    rows = readers.read_parquet(spark, b.table_path(sf_dir, "lineitem"), b.SCHEMAS["lineitem"])
    out = rows.where("l_discount > 0.05").groupBy("l_returnflag", "l_linestatus").agg(
        _n(), F.sum("l_quantity").alias("quantity")
    )
    return tidy(out)


@query("S2_done_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def s2(spark, sf_dir):
    paths = [b.table_path(sf_dir, "orders"), b.table_path(sf_dir, "no_such_shard")]
    return readers.done_ids(spark, paths, "o_custkey")


@query(
    "S3_multi_shard_scan",
    """SELECT source, CAST(src_ord AS BIGINT) AS src_ord, count(*) AS n, count(seg) AS n_seg, CAST(max(row_ord) AS BIGINT) AS last_row FROM (
  SELECT 'canonical' AS source, 0 AS src_ord, c_mktsegment AS seg, row_number() OVER () - 1 AS row_ord FROM customer
  UNION ALL SELECT 'nation.parquet', 1, NULL, row_number() OVER () - 1 FROM nation
  UNION ALL SELECT 'supplier.parquet', 2, NULL, row_number() OVER () - 1 FROM supplier) GROUP BY ALL""",
)
def s3(spark, sf_dir):
    """Tables of different schemas read as one canonical table and two shards."""
    rows = readers.read_shards(
        spark, b.table_path(sf_dir, "customer"), [b.table_path(sf_dir, "supplier"), b.table_path(sf_dir, "nation")]
    )
    out = rows.groupBy("source", "src_ord").agg(
        _n(), F.count("c_mktsegment").alias("n_seg"), F.max("row_ord").alias("last_row")
    )
    return tidy(out)


CUSTOMER_SQL = f"SELECT c_custkey, c_name, {r('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"


def _customer(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("S4_survey_csv_scan", CUSTOMER_SQL)
def s4(spark, sf_dir):
    path = scratch_dir(spark, "survey") + ".csv"
    # The file has another order and a column that is not declared.
    rows = b.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal", "c_name", "c_custkey")
    rows.write.csv(path, header=True)
    return tidy(readers.read_survey(spark, path, CUSTOMER_SCHEMA))


@query(
    "S5_best_effort_union",
    f"SELECT coalesce(c_mktsegment, '-') AS segment, count(*) AS n, {r('sum(bal)', 2)} AS balance FROM (SELECT c_mktsegment, c_acctbal AS bal FROM customer UNION ALL SELECT NULL, s_acctbal FROM supplier) GROUP BY 1",
)
def s5(spark, sf_dir):
    base = scratch_dir(spark, "surveys")
    _customer(spark, sf_dir).select("c_name", F.col("c_acctbal").alias("bal"), "c_mktsegment").write.csv(f"{base}/a.csv", header=True)
    b.table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal")).write.csv(f"{base}/b.csv", header=True)
    sources = [
        (f"{base}/a.csv", "c_mktsegment string, bal double"),
        (f"{base}/b.csv", "bal double"),
        (f"{base}/missing.csv", "bal double"),
        (f"{base}/a.sav", "bal double"),
    ]
    rows = readers.read_surveys(spark, sources)
    out = rows.groupBy(F.coalesce("c_mktsegment", F.lit("-")).alias("segment")).agg(_n(), F.sum("bal").alias("balance"))
    return tidy(out, 2)


@query(
    "S6_country_file_discovery",
    f"SELECT country, count(*) AS n, {r('sum(c_acctbal)', 2)} AS balance FROM (SELECT 'CO' AS country, c_acctbal FROM customer WHERE c_nationkey < 12 UNION ALL SELECT 'MX', c_acctbal FROM customer WHERE c_nationkey >= 12) GROUP BY country",
)
def s6(spark, sf_dir):
    base = scratch_dir(spark, "countries")
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    rows.where("c_nationkey < 12").write.csv(f"{base}/COL_2023_wave.csv", header=True)
    rows.where("c_nationkey >= 12").write.csv(f"{base}/MEX_2023_wave.csv", header=True)
    parts = []
    for country in ("CO", "MX"):
        found = readers.find_country_files(spark, base, country)
        part = readers.read_csv(spark, found, "c_nationkey int, c_acctbal double")
        parts.append(part.withColumn("country", F.lit(country)))
    out = readers.union_all(parts).groupBy("country").agg(_n(), F.sum("c_acctbal").alias("balance"))
    return tidy(out, 2)


@query("S7_manifest_csv_scan", META_SQL + " SELECT model, language, count(*) AS n, CAST(max(seed) AS BIGINT) AS last_seed FROM metadata GROUP BY ALL")
def s7(spark, sf_dir):
    path = scratch_dir(spark, "manifest")
    b.metadata(spark, sf_dir).select("seed", "backend", "language", "image_id", "model").write.csv(path, header=True)
    rows = readers.read_csv(spark, path, "image_id string, model string, language string, seed bigint")
    return rows.groupBy("model", "language").agg(_n(), F.max("seed").alias("last_seed"))


@query("S8_jsonl_scan", "SELECT doc_id, lang, text FROM documents")
def s8(spark, sf_dir):
    path = scratch_dir(spark, "translations")
    b.table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.json(path)
    return readers.read_jsonl(spark, path, "doc_id bigint, lang string, text string")


@query(
    "S9_inline_priors",
    f"""WITH {b.METADATA_SQL}, p(country, grp, income) AS ({b.sql_values([(c, g, float(v)) for c, vs in fv.PRIOR_INCOME.items() for g, v in vs.items()])})
SELECT p.country, occupation, count(*) AS n, {r('max(income)')} AS income FROM metadata JOIN p ON p.grp = occupation AND p.country = country_proxy GROUP BY ALL""",
)
def s9(spark, sf_dir):
    prior = dimensions.prior_income_dim(spark).withColumnsRenamed({"grp": "occupation"})
    rows = b.metadata(spark, sf_dir).withColumnRenamed("country_proxy", "country")
    out = rows.join(F.broadcast(prior), ["country", "occupation"]).groupBy("country", "occupation").agg(
        _n(), F.max("income").alias("income")
    )
    return tidy(out)


@query("S10_cached_stage", META_SQL + " SELECT model, language, count(*) AS n FROM metadata GROUP BY ALL")
def s10(spark, sf_dir):
    """The second build is never run: its output exists."""
    path = scratch_dir(spark, "stage")
    counts = b.metadata(spark, sf_dir).groupBy("model", "language").agg(_n())
    sinks.cached_stage(spark, path, lambda: counts)
    return sinks.cached_stage(spark, path, lambda: counts.where("n < 0"))


@query("S11_replace_table", META_SQL + " SELECT image_id, seed FROM metadata_unique WHERE model <> 'pollinations/flux'")
def s11(spark, sf_dir):
    """Read a table, filter it and put the result in its own place."""
    from ordscope.operators.merge import latest_by_key

    path = scratch_dir(spark, "canonical")
    first = versions.replace_table(latest_by_key(b.metadata(spark, sf_dir)).select("image_id", "seed", "model"), path)
    kept = versions.read_table(spark, path).where("model <> 'pollinations/flux'")
    versions.replace_table(kept, path, base=first.number)
    return versions.read_table(spark, path).select("image_id", "seed")


@query(
    "S12_result_csv",
    audits.INDEX_SQL
    + " SELECT country, language, model, printf('%.6f', CAST(sum(n_rows) AS DOUBLE)) AS n_units, printf('%.6f', max(n_rows)::DOUBLE) AS largest FROM signed GROUP BY ALL",
)
def s12(spark, sf_dir):
    path = scratch_dir(spark, "result")
    rows = audits.metrics_of(spark, sf_dir).groupBy(*b.CELL).agg(
        F.sum("n_rows").cast("double").alias("n_units"), F.max("n_rows").cast("double").alias("largest")
    )
    sinks.write_result_csv(rows, path)
    return readers.read_csv(spark, path, "country string, language string, model string, n_units string, largest string")


@query(
    "S13_append_ledger",
    META_SQL
    + f" SELECT src_ord::BIGINT AS run, count(*) AS n_units, {r('sum(duration_s)', 3)} AS elapsed_s FROM metadata GROUP BY src_ord",
)
def s13(spark, sf_dir):
    """One summary row per run, appended run by run."""
    path = scratch_dir(spark, "ledger")
    summary = b.metadata(spark, sf_dir).groupBy(F.col("src_ord").cast("long").alias("run")).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("duration_s").alias("elapsed_s")
    )
    for run in range(4):
        sinks.append_ledger(summary.where(F.col("run") == run), path)
    return tidy(spark.read.parquet(path), 3)


EVENT_SQL = "SELECT event_id, user_id, event_type FROM events"


def event_stream(spark, sf_dir):
    """The events table as a file stream."""
    return shards.shard_stream(spark, sf_dir, b.SCHEMAS["events"], "events.parquet")


@query("S14_shard_flush", EVENT_SQL)
def s14(spark, sf_dir):
    out, checkpoint = scratch_dir(spark, "shards"), scratch_dir(spark, "chk")
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    shards.drain(shards.shard_sink(stream, out, checkpoint))
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(out)


_SHARD_HOURS = 6  # between the times of two shards


@query(
    "S15_recent_files",
    f"""WITH s AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events))
SELECT 'metadata_' || event_type || '.parquet' AS source, (30 - {_SHARD_HOURS} * k)::DOUBLE AS hours_since FROM s WHERE 30 - {_SHARD_HOURS} * k <= 24""",
)
def s15(spark, sf_dir):
    """One shard per event type, six hours apart, listed 30 hours after the first; from file metadata only."""
    landed, folder = scratch_dir(spark, "landed"), scratch_dir(spark, "shards")
    events = b.table(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartition("event_type").write.partitionBy("event_type").parquet(landed)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(folder))
    first = 1_700_000_000
    files = sorted((s.getPath().getParent().getName().split("=", 1)[1], s.getPath()) for s in fs.globStatus(place(f"{landed}/event_type=*/*.parquet")))
    for i, (name, path) in enumerate(files):  # one file per event type
        shard = place(f"{folder}/metadata_{name}.parquet")
        fs.rename(path, shard)
        fs.setTimes(shard, 1000 * (first + i * _SHARD_HOURS * 3600), -1)
    return readers.recent_files(spark.read.parquet(folder), F.lit(first + 30 * 3600))
