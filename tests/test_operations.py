"""Merge, manifest, progress, request log, quality, panel, sources, streams."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators import grid, imputation, merge, panel, progress, quality, requests
from ordscope.plans import operations as plans
from ordscope.session import materialise, scratch_dir
from ordscope.sources import images, readers, sinks, versions
from ordscope.streaming import shards, throughput

META = (
    "image_id string, model string, occupation string, language string, country_proxy string, seed bigint, "
    "prompt string, path string, sha256 string, backend string, duration_s double, timestamp bigint"
)


def meta(spark, rows):
    """(id, timestamp[, model]) to a full metadata row."""
    return spark.createDataFrame(
        [
            (r[0], r[2] if len(r) > 2 else "m", "CEO", "en", "CO", 1, "p", f"p/{r[0]}", "h", "b", 1.0, r[1])
            for r in rows
        ],
        META,
    )


def write(df, path):
    df.coalesce(1).write.parquet(path)
    return path


# ---- merge ---------------------------------------------------------------------------


def test_latest_wins_ties_and_nulls(spark):
    rows = [
        ("a", 1, 0, 0, "old"), ("a", 5, 1, 0, "new"), ("a", 3, 2, 0, "mid"),
        ("tie", 7, 0, 1, "first"), ("tie", 7, 1, 0, "second"),
        ("null", None, 0, 2, "none"), ("null", 0, 1, 1, "zero"),
        ("only-null", None, 0, 3, "x"), ("only-null", None, 1, 2, "y"),
    ]
    df = spark.createDataFrame(rows, "image_id string, timestamp bigint, src_ord int, row_ord bigint, v string")
    got = {r.image_id: r.v for r in merge.latest_by_key(df).collect()}
    assert got == {"a": "new", "tie": "first", "null": "zero", "only-null": "x"}
    last = {r.image_id: r.v for r in merge.latest_by_key(df.drop("timestamp")).collect()}
    assert last == {"a": "mid", "tie": "second", "null": "zero", "only-null": "y"}
    again = merge.latest_by_key(merge.latest_by_key(df))
    assert {r.image_id: r.v for r in again.collect()} == got
    with pytest.raises(KeyError):
        merge.latest_by_key(df.drop("image_id"))


def test_hot_key_collapses_before_the_shuffle(spark):
    df = spark.range(40000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("image_id"),
        F.col("id").alias("timestamp"), F.lit(0).alias("src_ord"), F.col("id").alias("row_ord"),
    )
    out = merge.latest_by_key(df)
    assert out.where("image_id = 'hot'").first().timestamp == 39999
    assert "partial_min_by" in out._jdf.queryExecution().executedPlan().toString()
    assert merge.duplicate_summary(df).first().n_surplus == 40000 // 3


def test_run_merge(spark, tmp_path):
    base = str(tmp_path)
    canonical = write(meta(spark, [("a", 1), ("b", 9)]), f"{base}/metadata.parquet")
    s1 = write(meta(spark, [("a", 5)]), f"{base}/metadata_1.parquet")
    s2 = write(
        meta(spark, [("a", 3), ("c", 2)]).withColumn("model_source", F.lit("mirror")), f"{base}/metadata_2.parquet"
    )
    dry = plans.run_merge(spark, canonical, [s1, s2], dry_run=True).first()
    assert (dry.n_input, dry.n_merged, dry.n_dropped) == (5, 3, 2)
    assert spark.read.parquet(canonical).count() == 2
    plans.run_merge(spark, canonical, [s1, s2])
    rows = {r.image_id: r for r in versions.read_table(spark, canonical).collect()}
    assert rows["a"].timestamp == 5 and rows["c"].model_source == "mirror" and rows["b"].model_source is None
    assert not {"source", "src_ord", "row_ord"} & set(versions.read_table(spark, canonical).columns)
    plans.run_merge(spark, canonical, [s1, s2])
    assert {r.image_id: r for r in versions.read_table(spark, canonical).collect()} == rows
    assert sorted(os.listdir(base)) == ["metadata.parquet", "metadata_1.parquet", "metadata_2.parquet"]
    with pytest.raises(FileNotFoundError):
        plans.run_merge(spark, f"{base}/none.parquet", [])


def test_ambiguous_ids_fail_before_dedup(spark):
    df = meta(spark, [("a", 1, "m1"), ("a", 2, "m2")]).withColumns({"src_ord": F.lit(0), "row_ord": F.lit(0)})
    assert [r.image_id for r in merge.ambiguous_keys(df).collect()] == ["a"]
    with pytest.raises(PySparkException, match="ambiguous"):
        plans.merged_shards(df).collect()


def test_mislabelled_rows_keep_nulls(spark):
    df = spark.createDataFrame([("x", "y"), ("x", None), (None, "y"), ("x", "z")], "model string, backend string")
    assert merge.drop_mislabelled(df, "x", "y").count() == 3


def test_import_summary(spark):
    got = merge.import_summary(meta(spark, [("a", 1), ("b", 1)]), meta(spark, [("b", 2), ("c", 1), ("c", 2)])).first()
    assert tuple(got) == (2, 3, 3, 1)


# ---- panel and paths -------------------------------------------------------------------


def test_build_panel_left_and_validated(spark):
    m = meta(spark, [("a", 1), ("b", 1)])
    p = spark.createDataFrame([("a", True, 3)], "image_id string, has_face boolean, consensus_bin int")
    rows = {r.image_id: r.consensus_bin for r in panel.build_panel(m, p).collect()}
    assert rows == {"a": 3, "b": None}
    for bad in ((m.union(m), p), (m, p.union(p))):
        # Raised inside a broadcast thread, so the wrapper class depends on the plan.
        with pytest.raises(Exception, match="duplicate key"):
            panel.build_panel(*bad).collect()


def test_path_repair(spark):
    m = meta(spark, [("a", 1), ("b", 1), ("c", 1)]).withColumn("seed", F.ascii("image_id").cast("long"))
    files = spark.createDataFrame([("p/a",), ("main/CEO/seed_98.png",)], "path string")
    got = {r.image_id: (r.path, r.path_status) for r in panel.repair_paths(m, files, "main").collect()}
    assert got == {
        "a": ("p/a", "ok"), "b": ("main/CEO/seed_98.png", "fixed"), "c": ("p/c", "orphan"),
    }


# ---- grid, manifest, progress ------------------------------------------------------------


def test_pending_shards_partition_the_work(spark):
    cells = grid.main_grid(spark)
    done = cells.where("occupation = 'CEO' and language = 'en'").select("image_id")
    hot = done.limit(1).crossJoin(spark.range(200)).select("image_id")
    parts = [
        {r.image_id for r in grid.pending_cells(cells, done.union(hot), s, 3).select("image_id").collect()}
        for s in range(3)
    ]
    assert sum(map(len, parts)) == len(set.union(*parts)) == 12000 - 120
    assert max(map(len, parts)) < 1.1 * min(map(len, parts))


def small_grid(spark, done=None):
    groups = spark.createDataFrame([(0, "CEO"), (1, "a b__c"), (2, None), (3, ""), (None, "nurse"), (1, "nurse")], "grp_index long, grp string")
    return grid.enumerate_grid(groups, fv.MAIN_LANGUAGES, fv.MAIN_MODELS, 2, done=done)


def test_done_by_group_equals_done_by_id(spark):
    ids = [r.image_id for r in small_grid(spark).where("seed is not null").select("image_id").collect()]
    log = ids[::3] + ids[:1] * 50
    odd = [x.replace("__2026", "__02026") for x in ids[1::3]] + [x + "0" for x in ids[1::3]] + ["", "x", "7", "__7", None, "a__9223372036854775807", "a__-9223372036854775808"]
    other = [r.image_id for r in grid.all_grids(spark).where("occupation != 'CEO'").limit(50).collect()]
    done = spark.createDataFrame([(x,) for x in log + odd + other], "image_id string")
    want = {r.image_id: r.done for r in grid.flag_done(small_grid(spark), done).collect()}
    got = small_grid(spark, done)
    assert {r.image_id: r.done for r in got.collect()} == want and sum(want.values()) == len(set(ids[::3]))
    assert got.count() == small_grid(spark).count()


def test_cells_are_neither_shuffled_nor_broadcast(spark):
    now = 2_000_000
    rows = small_grid(spark).where("replicate = 1").select(
        "image_id", "model", "language", F.lit("b1").alias("backend"), F.lit(4.0).alias("duration_s"), F.lit(now).alias("timestamp"),
        F.lit(0).alias("src_ord"), F.lit(0).alias("row_ord"),
    )

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    cells = small_grid(spark, rows)
    assert "hashpartitioning(image_id" not in plan(grid.missing_manifest(cells))
    assert "hashpartitioning(image_id" not in plan(progress.grid_progress(cells))
    for given in (cells, small_grid(spark)):
        matrix = plan(plans.progress_report(given, rows, now)["matrix"])
        assert not [x for x in matrix.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x]


def test_manifest_and_progress(spark):
    cells = grid.all_grids(spark)
    now = 2_000_000
    done = cells.where("grid = 'main' and occupation in ('CEO', 'nurse') and replicate < 20").select(
        "image_id", "model", "language",
        F.lit("b1").alias("backend"), F.lit(4.0).alias("duration_s"),
        (F.lit(now) - F.col("replicate") * 60).alias("timestamp"),
    )
    rows = done.unionByName(done).withColumns({"src_ord": F.lit(0), "row_ord": F.monotonically_increasing_id()})
    report = plans.manifest_report(cells, rows)
    assert report["manifest"].count() == 14720 - 640
    assert tuple(report["problems"].first()) == (0, 0)
    partial = report["manifest"].where("cell_id = 'pollinations/flux|en|MULTI|CEO' and grid = 'main'").collect()
    assert len(partial) == 10 and all((r.current_n, r.missing_n) == (20, 10) for r in partial)
    tables = plans.progress_report(cells, rows, now)
    grids = {r.grid: r for r in tables["grids"].collect()}
    assert (grids["main"].done, grids["main"].total, grids["h5"].done) == (640, 12000, 0)
    assert grids["main"].pct == pytest.approx(100 * 640 / 12000)
    rate = tables["throughput"].first()
    assert (rate.n_units, rate.p50_duration_s) == (640, 4.0)
    assert rate.per_minute == pytest.approx(640 / (19 * 60) * 60)
    assert grids["main"].eta_s == pytest.approx((12000 - 640) / rate.per_minute * 60)
    matrix = tables["matrix"].orderBy("row_order").collect()
    assert [r.model for r in matrix] == list(fv.MAIN_MODELS) and matrix[0]["es-LatAm"] == 40
    top = tables["pending_top"].collect()
    assert len(top) == 10 and (top[0].model, top[0].language) == (fv.MAIN_MODELS[0], "en")
    assert tables["duplicates"].first().n_surplus == 640


def test_throughput_edges(spark):
    rows = [("a", 100, 1.0), ("a", 100, None), (None, 90, None), ("old", 10, 1.0)]
    df = spark.createDataFrame(rows, "backend string, timestamp bigint, duration_s double")
    got = {r.backend: r for r in progress.recent_throughput(df, 120, window_s=60).collect()}
    assert set(got) == {"a", None}
    assert got["a"].per_minute == 120.0 and got["a"].p50_duration_s == 1.0
    assert got[None].p50_duration_s is None
    assert progress.count_by(df, "backend").count() == 3


def test_normalise_and_select(spark):
    rows = [("m", "en", "main|m|en", "local", "ok", "i1", "CEO", 2), ("m", "en", "main|m|en", "local", "bad", "i2", "CEO", 1)]
    raw = spark.createDataFrame(
        rows,
        "`model ` string, language string, ` shard_group` string, recommended_runner string, prompt_status string, "
        "image_id string, occupation string, seed bigint",
    )
    done = spark.createDataFrame([("zzz",)], "image_id string")
    work = grid.select_work(raw, "m", "en", done, grid="main", max_units=5).collect()
    assert [(r.image_id, r.grid) for r in work] == [("i1", "main")]
    with pytest.raises(KeyError):
        grid.normalise_manifest(raw.drop("seed"))


def test_metadata_rows(spark):
    df = spark.createDataFrame([("a", "m", "CO", None, "3")], "image_id string, model string, country string, model_source string, seed string")
    r = grid.metadata_rows(df).first()
    assert (r.country_proxy, r.model_source, r.seed) == ("CO", "m", 3)


# ---- request log --------------------------------------------------------------------------


def test_phase_metrics(spark):
    rows = [(1, i, float(i), 200, True, "") for i in range(1, 26)]
    rows += [(3, 1, 2.0, 200, True, ""), (3, 2, 9.0, 429, False, "e2"), (3, 3, 9.0, 503, False, "e3"),
             (3, 4, 9.0, None, False, "e4"), (3, 5, 9.0, 402, False, "e5"), (5, 1, 1.0, None, None, "net")]
    log = spark.createDataFrame(rows, "phase_n int, img_idx int, wall_s double, status int, ok boolean, error string")
    got = {r.phase_n: r for r in requests.phase_metrics(log, F.lit(60.0)).collect()}
    one, three, five = got[1], got[3], got[5]
    assert (one.n_ok, one.p50_wall_s) == (25, 13.0)
    assert one.p95_wall_s == pytest.approx(24.7)
    assert (one.per_minute, three.per_minute_per_stream) == (25.0, pytest.approx(1 / 3))
    assert (three.n_429, three.n_5xx, three.n_other_error) == (1, 1, 2)
    assert three.p95_wall_s == 2.0 and three.error_examples == ["e2", "e3", "e4"]
    assert five.n_ok == 0 and five.p50_wall_s is None and five.n_other_error == 1


@pytest.mark.parametrize(
    "phases,want",
    [
        ([(1, 20, 20, 0, 0, 1.0), (3, 20, 20, 0, 0, 2.0), (5, 20, 20, 0, 0, 2.1)], (3, "plateau")),
        ([(1, 20, 20, 0, 0, 1.0), (3, 20, 14, 6, 0, 2.0)], (1, "rate limited")),
        ([(1, 20, 20, 0, 0, 0.7), (3, 20, 1, 0, 19, 0.67), (5, 20, 1, 0, 19, 0.66)], (1, "parallel access limited")),
        ([(1, 20, 20, 0, 0, 1.0), (3, 20, 18, 2, 0, 3.0), (5, 20, 20, 0, 0, 9.0)], (1, "plateau")),
        ([(1, 20, 20, 0, 0, 0.0), (3, 20, 20, 0, 0, 5.0)], (1, "plateau")),
        ([], (1, "no phases")),
    ],
)
def test_plateau_rule(spark, phases, want):
    schema = "phase_n int, n_attempted bigint, n_ok bigint, n_429 bigint, n_other_error bigint, per_minute double"
    assert tuple(requests.recommend_phase(spark.createDataFrame(phases, schema)).first()) == want


def brute_runs(events, limit):
    out, runs = [], {}
    for key, at, failed in sorted(events):
        start, n = runs.get(key, (None, 0))
        if failed:
            runs[key] = (at if n == 0 else start, n + 1)
        else:
            out += [(key, n, start)] if n >= limit else []
            runs[key] = (None, 0)
    return sorted(out + [(k, n, s) for k, (s, n) in runs.items() if n >= limit])


def random_events(n=3000):
    rng = np.random.default_rng(6)
    keys = np.where(rng.uniform(size=n) < 0.4, 0, rng.integers(1, 30, n))
    return [(int(k), i, bool(rng.uniform() < 0.6)) for i, k in enumerate(keys)]


def test_failure_runs_across_chunks(spark):
    events = random_events()
    df = spark.createDataFrame(events, "k int, at bigint, failed boolean")
    got = requests.failure_runs(df, ["k"], ["at"], F.floor(F.col("at") / 50), F.col("failed"), 4).collect()
    assert sorted((r.k, r.run_length, r.run_start) for r in got) == brute_runs(events, 4)


def test_failure_alerts_carry_over_batches(spark, tmp_path):
    events = random_events()
    state, alerts = f"{tmp_path}/state", f"{tmp_path}/alerts"
    schema = "k int, at bigint, failed boolean"
    for epoch, lo in enumerate(range(0, 3000, 1000)):
        batch = spark.createDataFrame(events[lo : lo + 1000], schema)
        for _ in range(2 if epoch == 1 else 1):  # a replay must not change anything
            throughput.failure_alerts(
                batch, state, alerts, epoch, ["k"], ["at"], F.floor(F.col("at") / 100), F.col("failed"), 4
            )
    got = throughput.current_alerts(spark, alerts, ["k"]).collect()
    assert sorted((r.k, r.run_length, r.run_start) for r in got) == brute_runs(events, 4)


# ---- quality and imputation ------------------------------------------------------------------


def test_quality_gate(spark):
    good = spark.createDataFrame([("CO", "a", 1, 0.5), ("CO", "a", 2, 0.5)], "country string, grp string, bin int, prob double")
    checks = quality.gate(
        quality.check_columns(good, "cols", ["grp", "nope"], "warn"),
        quality.check_sums(good, "sums", ["country", "grp"], "prob"),
        quality.check_sums(good.withColumn("prob", F.lit(0.4)), "bad-sums", ["grp"], "prob"),
        quality.check_row_count(good, "rows", 2),
        quality.check_unique(good, "unique", "grp"),
        quality.check_range(good, "range", "bin", 1, 11),
    )
    got = {r.name: r.passed for r in checks.collect()}
    assert got == {"cols": False, "sums": True, "bad-sums": False, "rows": True, "unique": False, "range": True}
    with pytest.raises(PySparkException, match="check failed"):
        quality.enforce(checks).collect()
    assert quality.enforce(checks.where("name in ('cols', 'sums')")).count() == 2


def test_category_imputation(spark):
    ref = spark.createDataFrame([("x", 1)] * 3 + [("x", 2)] + [("y", 11)] * 2, "category string, bin int")
    tgt = spark.createDataFrame([("CO", "g", "x")] * 2 + [("CO", "g", "y")] * 2 + [("CO", "g", "z")], "country string, grp string, category string")
    row = imputation.category_imputation(ref, tgt).first()
    assert row.covered_share == pytest.approx(0.8)
    assert row.base_probs == pytest.approx([0.375, 0.125] + [0.0] * 8 + [0.5])


# ---- sources, sinks -----------------------------------------------------------------------------


def test_survey_files(spark, tmp_path):
    base = str(tmp_path)
    pd.DataFrame({"pais": [8, 8], "colorr": [3, 99], "edre": [5, 1]}).to_stata(f"{base}/COL_2023_x.dta", write_index=False)
    pd.DataFrame({"pais": [1], "colorr": [4], "edre": [2]}).to_csv(f"{base}/MEX_2023_x.csv", index=False)
    schema = "pais int, colorr int, edre int"
    dta = readers.read_survey(spark, f"{base}/COL_2023_x.dta", schema)
    assert sorted(map(tuple, dta.collect())) == [(8, 3, 5), (8, 99, 1)]
    assert readers.find_country_files(spark, base, "MX").endswith("MEX_*.csv")
    assert readers.find_country_files(spark, base, "CO", "dta").endswith("COL_*.dta")
    assert readers.find_country_files(spark, base, "BR").endswith("/*.csv")
    assert readers.find_country_files(spark, f"{base}/none", "BR") is None
    both = readers.read_surveys(
        spark, [(f"{base}/COL_2023_x.dta", schema), (f"{base}/MEX_2023_x.csv", schema), (f"{base}/gone.csv", schema), (f"{base}/a.sav", schema)]
    )
    assert both.count() == 3
    with pytest.raises(NotImplementedError):
        readers.read_survey(spark, f"{base}/a.sav", schema)
    with pytest.raises(ValueError):
        readers.read_survey(spark, f"{base}/a.xyz", schema)


def test_shard_directory_and_recent_files(spark, tmp_path):
    base = str(tmp_path)
    for name, rows in (("metadata_a", [("a", 1)]), ("metadata_b", [("b", 2), ("c", 3)]), ("other", [("x", 1)])):
        pd.DataFrame(rows, columns=["image_id", "timestamp"]).to_parquet(f"{base}/{name}.parquet")
    old = time.time() - 3 * 86400
    os.utime(f"{base}/metadata_a.parquet", (old, old))
    df = readers.read_shard_dir(spark, base, "image_id string, timestamp bigint")
    assert sorted((r.image_id, r.source, r.row_ord) for r in df.collect()) == [
        ("a", "metadata_a.parquet", 0), ("b", "metadata_b.parquet", 0), ("c", "metadata_b.parquet", 1),
    ]
    raw = spark.read.schema("image_id string").option("pathGlobFilter", "metadata_*").parquet(base)
    recent = readers.recent_files(raw, F.lit(int(time.time()))).collect()
    assert [r.source for r in recent] == ["metadata_b.parquet"] and recent[0].hours_since < 1
    ids = readers.done_ids(spark, [f"{base}/metadata_a.parquet", f"{base}/metadata_b.parquet", f"{base}/gone.parquet"])
    assert sorted(r.image_id for r in ids.collect()) == ["a", "b", "c"]
    assert readers.done_ids(spark, [f"{base}/gone"]).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456789, 3)], "k string, x double, n int")
    sinks.write_result_csv(df, f"{tmp_path}/r")
    assert tuple(readers.read_csv(spark, f"{tmp_path}/r", "k string, x string, n string").first()) == ("a", "1.234568", "3")
    calls = []
    for _ in range(2):
        out = sinks.cached_stage(spark, f"{tmp_path}/stage", lambda: calls.append(1) or df)
    assert len(calls) == 1 and out.count() == 1
    versions.replace_table(df.withColumn("n", F.lit(7)), f"{tmp_path}/stage")
    assert versions.read_table(spark, f"{tmp_path}/stage").first().n == 7
    for _ in range(2):
        sinks.append_ledger(df, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, rgb, size=8):
        raw = b"".join(b"\0" + bytes(rgb) * size for _ in range(size))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(
            b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        )

    png(tmp_path / "a.png", (243, 231, 219))
    (tmp_path / "broken.png").write_bytes(b"nope")
    patches = images.read_patches(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: (r.r_med, r.g_med, r.b_med_rgb) for r in images.with_patch_statistics(patches).collect()}
    assert got == {"a.png": (243, 231, 219), "broken.png": (None, None, None)}
    assert images.content_hashes(spark, str(tmp_path)).count() == 2
    assert {r.length for r in images.file_listing(spark, str(tmp_path)).collect()} > {4}


def test_scratch_uses_the_configured_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base)
    df = materialise(spark.range(10).withColumn("b", F.lit(None).cast("boolean")), "t")
    assert df.count() == 10 and df.schema["b"].dataType.simpleString() == "boolean"


# ---- streams --------------------------------------------------------------------------------------


def test_stream_upsert_and_deltas(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "image_id string, timestamp bigint, v string"
    os.makedirs(src)

    def land(name, rows):
        pd.DataFrame(rows, columns=["image_id", "timestamp", "v"]).to_parquet(f"{src}/metadata_{name}.parquet")

    land("1", [("a", 1, "a1"), ("b", 9, "b9")])
    canonical, deltas = f"{tmp_path}/canonical", f"{tmp_path}/deltas"

    def run():
        shards.drain(shards.upsert_stream(shards.shard_stream(spark, src, schema), canonical, f"{tmp_path}/c1"))
        shards.drain(shards.delta_stream(shards.shard_stream(spark, src, schema, max_files=1), deltas, f"{tmp_path}/c2"))

    run()
    land("2", [("a", 5, "a5"), ("b", 3, "b3"), ("c", 2, "c2")])
    run()
    want = {"a": "a5", "b": "b9", "c": "c2"}
    assert {r.image_id: r.v for r in versions.read_table(spark, canonical).collect()} == want
    assert {r.image_id: r.v for r in shards.current_rows(spark, None, deltas).collect()} == want
    compacted = f"{tmp_path}/compacted"
    for _ in range(2):
        shards.compact(spark, compacted, deltas)
    assert {r.image_id: r.v for r in versions.read_table(spark, compacted).collect()} == want


def test_batch_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "ts string, backend string, duration_s double").withColumn("ts", F.to_timestamp("ts"))
    tumbling = throughput.windowed_throughput(df, window="1 hour", slide=None).collect()
    assert len(tumbling) == 2 and tumbling[0].per_minute == pytest.approx(1 / 60)
    assert throughput.windowed_throughput(df, window="2 hours", slide="1 hour").where("n_units = 2").count() == 1


def test_ties_across_shards_keep_the_earliest_source(spark):
    """Position 3 of the first shard comes before position 0 of the second."""
    rows = [("x", 5, "metadata_b", 0, "late"), ("x", 5, "metadata_a", 3, "early"), ("x", 4, "metadata_a", 0, "old"), ("x", None, "metadata_a", 0, "unknown")]
    df = spark.createDataFrame(rows, "image_id string, timestamp bigint, source string, row_ord bigint, v string")
    assert merge.latest_by_key(df).first().v == "early"
    stamped = df.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    assert merge.latest_by_key(stamped).first().v == "early"


def test_alerts_do_not_depend_on_batch_cuts(spark, tmp_path):
    from ordscope.streaming import throughput

    events = [(1, i, i not in (0, 6, 9)) for i in range(12)] + [(2, 5, True), (2, 7, True), (2, 11, True)]
    df = spark.createDataFrame(events, "user bigint, pos bigint, bad boolean")
    want = {(1, 5, 1, 5), (2, 3, 5, 11)}
    for name, cuts in {"whole": [12], "cut": [3, 4, 5, 8, 12], "fine": list(range(1, 13))}.items():
        state, alerts, at = str(tmp_path / f"s{name}"), str(tmp_path / f"a{name}"), 0
        for epoch, end in enumerate(cuts):
            batch = df.where(F.col("pos").between(at, end - 1))
            throughput.failure_alerts(batch, state, alerts, epoch, ["user"], ["pos"], F.floor(F.col("pos") / 4), F.col("bad"), 3)
            at = end
        got = throughput.current_alerts(spark, alerts, ["user"]).collect()
        assert {(r.user, r.run_length, r.run_start, r.run_end) for r in got} == want, name


def test_csv_is_read_by_name(spark, tmp_path):
    from ordscope.sources import readers

    (tmp_path / "s.csv").write_text("idnum,edre,pais,colorr\n7,3,8,5\n")
    row = readers.read_csv(spark, str(tmp_path / "s.csv"), "pais int, colorr int, edre int").first()
    assert (row.pais, row.colorr, row.edre) == (8, 5, 3)
    with pytest.raises(ValueError, match="income"):
        readers.read_csv(spark, str(tmp_path / "s.csv"), "pais int, income double")


def test_panel_keeps_rows_without_a_key_and_checks_the_others(spark):
    from ordscope.operators.panel import build_panel

    meta = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "image_id string, m int")
    face = spark.createDataFrame([("a", 9), (None, 8)], "image_id string, bin int")
    got = {(r.image_id, r.m, r.bin) for r in build_panel(meta, face).collect()}
    assert got == {("a", 1, 9), (None, 2, None), (None, 3, None)}
    with pytest.raises(Exception, match="duplicate key"):
        build_panel(meta, face.unionAll(face)).collect()


def test_nan_bins_count_as_unknown(spark):
    from ordscope.operators import distributions

    df = spark.createDataFrame([("g", float("nan"), True), ("g", 3.0, True)], "grp string, bin double, has_signal boolean")
    assert distributions.eligible_rows(df).count() == 1
    row = distributions.count_bins(df, ["grp"]).first()
    assert (row.n_rows, sum(row.counts)) == (2, 1)


def test_unknown_groups_fail_whichever_column_is_read(spark):
    from ordscope.sources.dimensions import lookup_groups

    df = spark.createDataFrame([("CEO",), ("nobody",)], "grp string")
    with pytest.raises(Exception, match="nobody"):
        lookup_groups(df).select("tier").collect()


def test_text_rounds_half_to_even(spark):
    from ordscope.functions import ids

    seconds = [30.0, 150.0, 270.0, 90.0, 1.15 * 3600, 4500.0, 6300.0, 86_400 * 1.25, None]
    df = spark.createDataFrame([(s,) for s in seconds], "s double")
    want = ["—" if s is None else f"{s / 86400:.1f} d" if s >= 86400 else f"{s / 3600:.1f} h" if s >= 3600 else f"{s / 60:.0f} min" for s in seconds]
    assert [r.t for r in df.select(ids.format_eta(F.col("s")).alias("t")).collect()] == want


def test_result_csv_leaves_nulls_empty(spark, tmp_path):
    from ordscope.sources import sinks

    df = spark.createDataFrame([("a", None), ("b", 0.5)], "k string, v double").coalesce(1)
    sinks.write_result_csv(df, str(tmp_path / "out"), decimals=0)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert sorted(text.split()) == ["a,", "b,0", "k,v"]


def test_a_table_is_never_absent(spark, tmp_path):
    """A reader in a loop through replacements, a crash before the commit, and rows read from the table itself."""
    import threading

    path, seen, errors, done = str(tmp_path / "t"), [], [], threading.Event()
    versions.replace_table(spark.range(3), path)

    def read():
        while not done.is_set():
            try:
                seen.append(versions.read_table(spark, path).count())
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(4):
        table = versions.read_table(spark, path)
        versions.replace_table(table.unionAll(table), path)
    spark.range(9).write.parquet(f"{path}/data-crashed")
    done.set()
    reader.join()
    assert not errors and set(seen) <= {3, 6, 12, 24, 48}
    assert versions.read_table(spark, path).count() == 48
    assert versions.vacuum(spark, path, keep=1, older_than_s=3600) == 0
    assert versions.vacuum(spark, path, keep=1, older_than_s=-10) > 0
    assert not os.path.exists(f"{path}/data-crashed") and versions.read_table(spark, path).count() == 48


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    base = versions.replace_table(spark.range(3), path)
    versions.replace_table(spark.range(4), path, base=base.number)
    with pytest.raises(versions.CommitConflict):
        versions.replace_table(spark.range(5), path, base=base.number)
    assert versions.read_table(spark, path).count() == 4
    plain = str(tmp_path / "plain")
    spark.range(2).write.parquet(plain)
    assert versions.current(spark, plain).number == 0
    versions.replace_table(versions.read_table(spark, plain).where("id = 1"), plain, base=0)
    assert [r.id for r in versions.read_table(spark, plain).collect()] == [1]


def test_upsert_rewrites_the_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "image_id string, timestamp bigint, v string"
    rows = [(f"i{i}", 1, "old") for i in range(200)] + [(None, 1, "no id")]
    shards.upsert_batch(spark.createDataFrame(rows, schema), path, n_buckets=16, writer="w", epoch=0)
    first = versions.current(spark, path)
    batch = spark.createDataFrame([("i7", 2, "new"), ("i7", 0, "late"), ("x", 1, "added")], schema)
    shards.upsert_batch(batch, path, writer="w", epoch=1)
    second = versions.current(spark, path)
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets.get(b)}
    assert second.n_buckets == 16 and 1 <= len(changed) <= 2
    got = {r.image_id: r.v for r in versions.read_table(spark, path).collect()}
    assert got == {**{f"i{i}": "old" for i in range(200)}, None: "no id", "i7": "new", "x": "added"}
    shards.upsert_batch(batch.withColumn("v", F.lit("replayed")), path, writer="w", epoch=1)
    assert versions.current(spark, path) == second
    shards.upsert_batch(spark.createDataFrame([], schema), path, writer="w", epoch=2)
    assert versions.read_table(spark, path).count() == 202


def test_alerts_of_rows_without_a_key(spark, tmp_path):
    rows = [(None, 1, True), (7, 2, True), (None, 3, True), (7, 4, True), (None, 5, True), (8, 6, False)]
    df = spark.createDataFrame(rows, "user bigint, pos bigint, bad boolean")
    runs = requests.failure_runs(df, ["user"], ["pos"], F.floor(F.col("pos") / 4), F.col("bad"), 2)
    assert {(r.user, r.run_length, r.run_start, r.run_end) for r in runs.collect()} == {(None, 3, 1, 5), (7, 2, 2, 4)}
    for epoch, (low, high) in enumerate([(1, 2), (3, 6)]):
        batch = df.where(F.col("pos").between(low, high))
        throughput.failure_alerts(batch, f"{tmp_path}/s", f"{tmp_path}/a", epoch, ["user"], ["pos"], F.floor(F.col("pos") / 4), F.col("bad"), 2)
    got = throughput.current_alerts(spark, f"{tmp_path}/a", ["user"]).collect()
    assert {(r.user, r.run_length, r.run_start, r.run_end) for r in got} == {(None, 3, 1, 5), (7, 2, 2, 4)}
