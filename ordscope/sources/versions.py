"""Tables whose every state is complete: immutable data folders and a numbered log.

A version is one small JSON file in ``_log`` that names the data folders it consists of.
Writers add data folders and then commit the next number; a number is created
exclusively, so of two writers one wins and the other sees that it lost. Readers resolve
the highest number. Nothing a reader resolved is renamed or rewritten: the table is never
absent, and a job that died before its commit leaves folders nobody names, which
:func:`vacuum` deletes.

The exclusive create is a hard link on a local file system and a rename that refuses to
replace elsewhere (atomic on HDFS; an object store without such a rename needs another
commit). A bucketed table names one folder per bucket of its key, so that an upsert reads
and writes the buckets it touches and names the others again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordscope.session import materialise
from ordscope.sources.readers import path_exists

BUCKET = "__bucket"


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: str = ""
    folders: tuple[str, ...] = ()
    key: str = ""  # of a bucketed table
    n_buckets: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)  # last batch of each stream that writes the table

    def paths(self) -> list[str]:
        return [*self.folders, *self.buckets.values()]


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, log = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, path: str, number: int) -> Version:
    text = spark.read.text(f"{path}/_log/{number:020d}.json", wholetext=True).first()[0]
    entry = json.loads(text)
    return Version(**{**entry, "folders": tuple(entry["folders"])})


def current(spark: SparkSession, path: str) -> Version | None:
    """The latest version; None for a table that has none. Plain Parquet files in the folder are version 0."""
    numbers = _numbers(spark, path)
    if numbers:
        return _load(spark, path, numbers[-1])
    plain = f"{path}/*.parquet"
    return Version(0, spark.read.parquet(plain).schema.json(), ("*.parquet",)) if path_exists(spark, plain) else None


def before_epoch(spark: SparkSession, path: str, writer: str, epoch: int) -> Version | None:
    """The latest version without batch ``epoch`` of ``writer``: what a replay of it starts from."""
    for number in reversed(_numbers(spark, path)):
        version = _load(spark, path, number)
        if version.epochs.get(writer, -1) < epoch:
            return version
    return None


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    fs, log = _fs(spark, f"{path}/_log")
    fs.mkdirs(log)
    target = f"{path}/_log/{version.number:020d}.json"
    _, staged = _fs(spark, f"{path}/_log/.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(asdict(version)), "utf-8"))
    out.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI(fs.makeQualified(p).toUri().toString()))
            jvm.java.nio.file.Files.createLink(local(jvm.org.apache.hadoop.fs.Path(target)), local(staged))
        elif fs.exists(jvm.org.apache.hadoop.fs.Path(target)) or not fs.rename(staged, jvm.org.apache.hadoop.fs.Path(target)):
            raise CommitConflict(f"{path}: version {version.number} exists")
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise CommitConflict(f"{path}: version {version.number} exists") from error
        raise
    finally:
        fs.delete(staged, False)
    return version


def read_version(spark: SparkSession, path: str, version: Version) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(version.schema))
    folders = [f"{path}/{p}" for p in version.paths()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, version: Version, buckets: list[int]) -> DataFrame:
    """The rows of some buckets of a bucketed table."""
    schema = T.StructType.fromJson(json.loads(version.schema))
    there = [f"{path}/{version.buckets[str(b)]}" for b in buckets if str(b) in version.buckets]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a table."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return read_version(spark, path, version)


def replace_table(df: DataFrame, path: str, base: int | None = None) -> Version:
    """Commit ``df`` as the whole table. The job may read the table itself.

    ``base`` is the version the rows were derived from: if another version was committed
    since, :class:`CommitConflict` is raised and nothing changes. Without it the last
    writer wins.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    while True:
        old = current(spark, path)
        number = (old.number if old else 0) if base is None else base
        try:
            epochs = old.epochs if old else {}
            return _commit(spark, path, Version(number + 1, df.schema.json(), (folder,), epochs=epochs))
        except CommitConflict:
            if base is not None:
                raise


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def upsert(
    batch: DataFrame,
    path: str,
    key: str,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    n_buckets: int = 64,
    writer: str = "",
    epoch: int | None = None,
    attempts: int = 10,
) -> Version:
    """Fold ``batch`` into a table bucketed by ``key``: only the buckets it touches are read and written.

    ``merge(old, batch)`` gives the new rows of these buckets (``old`` is None where the
    table is new). The number of buckets is fixed by the first commit. A batch of
    ``writer`` that a version already holds is left out. A writer that loses the race
    starts again from the version that won.
    """
    spark = batch.sparkSession
    for _ in range(attempts):
        old = current(spark, path)
        if old and epoch is not None and old.epochs.get(writer, -1) >= epoch:
            return old
        n = old.n_buckets if old and old.n_buckets else n_buckets
        keyed = materialise(batch.withColumn(BUCKET, bucket_of(F.col(key), n)), "batch")
        touched = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())  # at most n_buckets rows
        rows = None
        if old:
            if old.n_buckets:
                rows = read_buckets(spark, path, old, touched)
            else:  # a table without buckets is bucketed by its first upsert
                rows, touched = read_version(spark, path, old), list(range(n))
        merged = merge(rows, keyed.drop(BUCKET))
        folder = f"data-{uuid.uuid4().hex}"
        placed = merged.withColumn(BUCKET, bucket_of(F.col(key), n))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
        buckets = dict(old.buckets) if old else {}
        for b in touched:
            buckets.pop(str(b), None)
            if path_exists(spark, f"{path}/{folder}/{BUCKET}={b}"):
                buckets[str(b)] = f"{folder}/{BUCKET}={b}"
        epochs = dict(old.epochs) if old else {}
        if epoch is not None:
            epochs[writer] = epoch
        version = Version((old.number if old else 0) + 1, merged.schema.json(), (), key, n, buckets, epochs)
        try:
            return _commit(spark, path, version)
        except CommitConflict:
            continue
    raise CommitConflict(f"{path}: lost {attempts} commits in a row")


def vacuum(spark: SparkSession, path: str, keep: int = 10, older_than_s: int = 24 * 3600) -> int:
    """Delete versions beyond the last ``keep``, and folders that no version names any more.

    Only what is older than ``older_than_s`` goes: readers and writers at work keep theirs.
    """
    fs, root = _fs(spark, path)
    numbers, limit = _numbers(spark, path), 1000 * (time.time() - older_than_s)
    gone = 0
    for number in numbers[:-keep]:
        _, entry = _fs(spark, f"{path}/_log/{number:020d}.json")
        if fs.getFileStatus(entry).getModificationTime() <= limit:
            gone += bool(fs.delete(entry, False))
    named = {p.split("/", 1)[0] for number in _numbers(spark, path) for p in _load(spark, path, number).paths()}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("data-") and name not in named and status.getModificationTime() <= limit:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
