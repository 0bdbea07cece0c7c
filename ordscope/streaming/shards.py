"""Shard directory as a stream, idempotent upsert, checkpointed shard output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ordscope.operators.merge import latest_by_key
from ordscope.sources import versions
from ordscope.sources.readers import path_exists, union_all


def shard_stream(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    pattern: str = "metadata_*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New shards of a directory, with their source and row position."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory).select(
        "*",
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.row_index").alias("row_ord"),
    )


def upsert_batch(
    batch: DataFrame,
    canonical: str,
    key: str = "image_id",
    order_col: str = "timestamp",
    writer: str = "",
    epoch: int | None = None,
    n_buckets: int = 64,
) -> None:
    """Fold one micro-batch into the canonical table (see ``sources.versions``).

    Only the buckets of the batch's ids are read and written. A batch that the table
    already holds is left out; last write wins is idempotent besides.
    """

    def merge(old: DataFrame | None, incoming: DataFrame) -> DataFrame:
        parts = [incoming.withColumn("src_ord", F.lit(1))]
        if old is not None:
            parts.insert(0, old.withColumns({"src_ord": F.lit(0), "source": F.lit(""), "row_ord": F.lit(0).cast("long")}))
        return latest_by_key(union_all(parts), key, order_col, drop_source_order=True)

    versions.upsert(batch, canonical, key, merge, n_buckets, writer, epoch)


def upsert_stream(
    stream: DataFrame,
    canonical: str,
    checkpoint: str,
    key: str = "image_id",
    order_col: str = "timestamp",
    trigger_seconds: int | None = None,
    n_buckets: int = 64,
) -> StreamingQuery:
    """Start the upsert; without an interval it drains what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: upsert_batch(batch, canonical, key, order_col, checkpoint, epoch, n_buckets)
    )
    return _trigger(writer, trigger_seconds).start()


def append_delta(
    batch: DataFrame, epoch: int, folder: str, key: str = "image_id", order_col: str = "timestamp"
) -> None:
    """Write one micro-batch, deduplicated, as its own delta folder.

    The cost follows the batch, not the table. A replayed batch overwrites its own
    folder, so it is not counted twice.
    """
    newest = latest_by_key(batch, key, order_col)
    newest.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def delta_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    key: str = "image_id",
    order_col: str = "timestamp",
    trigger_seconds: int | None = None,
) -> StreamingQuery:
    """Upsert by appending deltas; readers resolve them, ``compact`` folds them in."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: append_delta(batch, epoch, folder, key, order_col)
    )
    return _trigger(writer, trigger_seconds).start()


def current_rows(
    spark: SparkSession,
    canonical: str | None,
    deltas: str,
    key: str = "image_id",
    order_col: str = "timestamp",
) -> DataFrame:
    """Latest row per id over the canonical table (first) and all deltas (by epoch)."""
    parts = []
    version = versions.current(spark, canonical) if canonical else None
    if version:
        old = versions.read_version(spark, canonical, version)
        first = {"src_ord": F.lit(-1).cast("long"), "source": F.lit(""), "row_ord": F.lit(0).cast("long")}
        parts.append(old.withColumns(first))
    if path_exists(spark, f"{deltas}/epoch=*"):
        parts.append(
            spark.read.parquet(deltas).withColumn("src_ord", F.col("epoch").cast("long")).drop("epoch")
        )
    if not parts:
        raise FileNotFoundError(f"neither {canonical} nor {deltas} holds rows")
    return latest_by_key(union_all(parts), key, order_col, drop_source_order=True)


def compact(
    spark: SparkSession, canonical: str, deltas: str, key: str = "image_id", order_col: str = "timestamp"
) -> None:
    """Fold all deltas into the canonical table. Folding twice changes nothing."""
    versions.replace_table(current_rows(spark, canonical, deltas, key, order_col), canonical)


def shard_sink(
    stream: DataFrame,
    directory: str,
    checkpoint: str,
    trigger_seconds: int | None = None,
) -> StreamingQuery:
    """Append-only shard files with exactly-once commits.

    The count limit is the source's ``maxFilesPerTrigger``, the time limit the
    processing-time trigger.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", directory)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return _trigger(writer, trigger_seconds).start()


def _trigger(writer, seconds: int | None):
    if seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def drop_repeats(
    stream: DataFrame, keys: Sequence[str], time_col: str, delay: str = "24 hours"
) -> DataFrame:
    """First row per id within the watermark (first wins; use the upsert for last wins)."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def drain(query: StreamingQuery) -> None:
    """Wait for a draining query and surface its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_batches(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "update"
) -> None:
    """Drain a stream through ``handle(batch, id)``."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    drain(query)
