"""Blocks of consecutive documents, and compact binary columns for what they exchange."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from ordscope.session import scratch_base, scratch_dir


def pack(values: np.ndarray) -> bytes:
    """A numeric array as compressed bytes; the bytes of equal significance lie together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros((1, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_bytes(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed value: lengths, then contents."""
    sizes = np.fromiter(map(len, items), "<u4", len(items)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(items).to_bytes(4, "little") + sizes + b"".join(items))


def unpack_bytes(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def least_dtype(most: int):
    """The smallest unsigned type that holds ``most``."""
    return next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)


def blocks(rows: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Consecutive (id, text) rows until a block holds ``chars`` characters; a longer text is a block."""
    block, size = [], 0
    for row in rows:
        if block and size + len(row[1]) > chars:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield block


def block_number(part: int, sequence: int) -> int:
    return (part << 32) | sequence


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that joins on it need not move it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{key}s_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", scratch_dir(spark, name)).saveAsTable(name)
    return spark.table(name)


def forget(*tables: DataFrame) -> None:
    """Delete spent intermediate tables: all files under the shared folder that they were read from.

    Only for tables whose successors are written; a table in the catalogue leaves it too.
    """
    for df in tables:
        spark = df.sparkSession
        base = f"{scratch_base(spark)}/{spark.sparkContext.applicationId}/".replace("file:", "")
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in paths:
            if base not in path:  # never anything but this application's own scratch tables
                continue
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            name = path.rsplit("/", 1)[1].rsplit("-", 1)[0]
            if re.fullmatch(r"[a-z]+s_[0-9a-f]{32}", name):  # the form of ``bucketed``
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + size), one slice after the other."""
    total = int(sizes.sum())
    shift = starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else starts
    return np.repeat(shift, sizes) + np.arange(total)
