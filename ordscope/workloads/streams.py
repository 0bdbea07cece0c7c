"""Streaming queries: the events table arrives as a file stream and is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordscope.session import scratch_dir
from ordscope.sources import versions
from ordscope.streaming import shards, throughput
from ordscope.workloads import bindings as b
from ordscope.workloads.registry import epoch_seconds, query, r, tidy
from ordscope.workloads.scans import EVENT_SQL, event_stream


@query("T1_shard_stream", EVENT_SQL)
def t1(spark, sf_dir):
    out, checkpoint = scratch_dir(spark, "t1"), scratch_dir(spark, "chk")

    def land(batch, epoch):
        """A folder per batch, so that a replayed batch replaces itself."""
        batch.select("event_id", "user_id", "event_type").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    shards.run_batches(event_stream(spark, sf_dir), checkpoint, land, "append")
    return spark.read.parquet(out).drop("epoch")


UPSERT_SQL = """WITH e AS (SELECT user_id || ':' || event_type AS image_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id, value, row_number() OVER () AS pos FROM events)
SELECT image_id, timestamp, event_id, (round(value, 6) + 0.0) AS value FROM e QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY timestamp DESC, event_id) = 1"""


def unit_stream(spark, sf_dir):
    return event_stream(spark, sf_dir).select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("image_id"),
        epoch_seconds(F.col("ts")).alias("timestamp"),
        "event_id",
        "value",
        "source",
        F.col("event_id").alias("row_ord"),
    )


@query("T2_stream_upsert", UPSERT_SQL)
def t2(spark, sf_dir):
    """Last write wins per id; the stream is drained twice to show it is idempotent."""
    canonical = scratch_dir(spark, "t2")
    for _ in range(2):
        query_ = shards.upsert_stream(unit_stream(spark, sf_dir), canonical, scratch_dir(spark, "chk"))
        shards.drain(query_)
    return tidy(versions.read_table(spark, canonical).select("image_id", "timestamp", "event_id", "value"))


@query("T3_checkpointed_shards", "SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_id FROM events GROUP BY event_type")
def t3(spark, sf_dir):
    """Restarting from the checkpoint adds nothing: every input file is committed once."""
    out, checkpoint = scratch_dir(spark, "t3"), scratch_dir(spark, "chk")
    for _ in range(2):
        stream = shards.shard_stream(spark, sf_dir, b.SCHEMAS["events"], "events.parquet", max_files=1)
        shards.drain(shards.shard_sink(stream.select("event_id", "event_type"), out, checkpoint))
    rows = spark.read.parquet(out)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def _timed(stream):
    return stream.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("backend"),
        F.col("value").alias("duration_s"),
        "event_id",
    )


def _drain_windows(spark, frame, name):
    """Every batch lands its updated windows by itself; a window's newest form is read back."""
    target, checkpoint = scratch_dir(spark, name), scratch_dir(spark, "chk")

    def land(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    shards.run_batches(frame, checkpoint, land)
    landed = spark.read.parquet(target)
    values = F.struct(*[c for c in landed.columns if c not in ("window_start", "backend", "epoch")])
    newest = landed.groupBy("window_start", "backend").agg(F.max_by(values, "epoch").alias("v"))
    return newest.select("window_start", "backend", "v.*")


def _window_sql(hours: int, slide: int) -> str:
    return f"""WITH e AS (SELECT event_type AS backend, value, CAST(floor(epoch(ts) / {slide * 3600}) AS BIGINT) * {slide * 3600} AS slot FROM events),
w AS (SELECT backend, value, slot - k * {slide * 3600} AS window_start FROM e CROSS JOIN (SELECT unnest(range(0, {hours // slide})) AS k))
SELECT window_start, backend, count(*) AS n_units, {r(f'count(*) / {hours * 60}.0')} AS per_minute, {r('avg(value)', 9)} AS mean_duration_s FROM w GROUP BY ALL"""


def _window_result(df):
    start = F.col("window_start").cast("timestamp_ntz")
    return tidy(
        df.select(
            epoch_seconds(start).alias("window_start"), "backend", "n_units",
            F.round("per_minute", 6).alias("per_minute"), "mean_duration_s",
        ),
        9,
    )


@query("T4_sliding_throughput", _window_sql(24, 1))
def t4(spark, sf_dir):
    stream = throughput.windowed_throughput(_timed(event_stream(spark, sf_dir)), delay="60 days")
    return _window_result(_drain_windows(spark, stream, "t4"))


@query("T4_tumbling_throughput", _window_sql(6, 6))
def t4_tumbling(spark, sf_dir):
    stream = throughput.windowed_throughput(
        _timed(event_stream(spark, sf_dir)), window="6 hours", slide=None, delay="60 days"
    )
    return _window_result(_drain_windows(spark, stream, "t4t"))


@query("T5_drop_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def t5(spark, sf_dir):
    """First row per id wins; which row that is depends on arrival, the ids do not."""
    out, checkpoint = scratch_dir(spark, "t5"), scratch_dir(spark, "chk")
    stream = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    unique = shards.drop_repeats(stream, ["user_id", "event_type"], "ts", "60 days")
    shards.drain(shards.shard_sink(unique, out, checkpoint))
    return spark.read.parquet(out).select("user_id", "event_type")


def _cuts(low: int, high: int, n: int) -> list[tuple[int, int]]:
    edges = [low + (high + 1 - low) * i // n for i in range(n + 1)]
    return [(a, z - 1) for a, z in zip(edges, edges[1:])]


@query(
    "T6_stream_failure_alerts",
    """WITH m AS (SELECT *, event_type <> 'error' AS ok, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, count(*) AS run_length, min(event_id) AS run_start, max(event_id) AS run_end FROM m WHERE NOT ok GROUP BY user_id, run HAVING count(*) >= 3""",
)
def t6_stream(spark, sf_dir):
    state, alerts, checkpoint = (scratch_dir(spark, tag) for tag in ("state", "alerts", "chk"))
    failed, chunk = F.col("event_type") == "error", F.floor(F.col("event_id") / 1000)

    def fold(batch, epoch):
        throughput.failure_alerts(batch, state, alerts, epoch, ["user_id"], ["event_id"], chunk, failed, 3)

    # The events arrive in four parts; after each the stream starts again from its checkpoint. Runs are cut anywhere.
    folder = scratch_dir(spark, "cut")
    events = b.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    for start, end in _cuts(low, high, 4):
        events.where(F.col("event_id").between(start, end)).write.mode("append").parquet(folder)
        shards.run_batches(spark.readStream.schema(events.schema).parquet(folder), checkpoint, fold, "append")
    return throughput.current_alerts(spark, alerts, ["user_id"])


@query("T2_stream_deltas", UPSERT_SQL)
def t2_deltas(spark, sf_dir):
    """Upsert by deltas, folded into the canonical table and resolved once more."""
    canonical, deltas = scratch_dir(spark, "t2c"), scratch_dir(spark, "t2d")
    shards.drain(shards.delta_stream(unit_stream(spark, sf_dir), deltas, scratch_dir(spark, "chk")))
    shards.compact(spark, canonical, deltas)
    rows = shards.current_rows(spark, canonical, deltas)
    return tidy(rows.select("image_id", "timestamp", "event_id", "value"))
