"""Readers. Every schema is declared; nothing is inferred from data."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordscope import fixed_values as fv

log = logging.getLogger(__name__)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does at least one file match (works for every Hadoop file system and globs)?"""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan; with a schema no footer is read at planning time."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The declared columns of a CSV file, found by their header names.

    Spark applies a schema by position. So the header is read first, the declared
    types are put in file order, and the declared columns are selected. A declared
    column that the file lacks is an error, and so is a file of the same path whose
    header differs from the first one's.
    """
    wanted = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    header = spark.read.option("header", True).csv(path).columns
    missing = [n for n in wanted.fieldNames() if n not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f.dataType for f in wanted.fields}
    in_file_order = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
    rows = spark.read.schema(in_file_order).option("enforceSchema", False).csv(path, header=True)
    return rows.select(*[F.col(f"`{n}`") for n in wanted.fieldNames()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_stata(spark: SparkSession, path: str, schema: str, chunk_rows: int = 100_000) -> DataFrame:
    """Stata files, one task per file, streamed in chunks; labels stay numeric codes."""
    struct = spark.createDataFrame([], schema).schema
    names = struct.fieldNames()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for content in batch["content"]:
                with pd.read_stata(io.BytesIO(content), convert_categoricals=False, chunksize=chunk_rows) as reader:
                    for chunk in reader:
                        yield chunk.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, struct)


def read_survey(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Dispatch on the suffix: CSV and Stata are read, SPSS is refused."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix == "dta":
        return read_stata(spark, path, schema)
    if suffix == "sav":
        raise NotImplementedError(f"convert {path} to .csv or .dta first")
    raise ValueError(f"unknown survey format: {path!r}")


def read_surveys(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame | None:
    """Best-effort union of ``(path, schema)``: unreadable sources are skipped with a warning."""
    parts = []
    for path, schema in sources:
        try:
            if not path_exists(spark, path):
                raise FileNotFoundError(path)
            parts.append(read_survey(spark, path, schema))
        except (AnalysisException, NotImplementedError, ValueError, OSError) as exc:
            log.warning("skipped %s: %s", path, exc)
    return union_all(parts) if parts else None


def find_country_files(spark: SparkSession, base: str, country: str, suffix: str = "csv") -> str | None:
    """Glob of a country's files by ISO prefix, else any survey file, else None."""
    patterns = []
    if country in fv.SURVEY_FILE_PREFIX:
        patterns.append(f"{base}/{fv.SURVEY_FILE_PREFIX[country]}_*.{suffix}")
    patterns.append(f"{base}/*.{suffix}")
    return next((p for p in patterns if path_exists(spark, p)), None)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns absent from a part become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def done_ids(spark: SparkSession, paths: Sequence[str], id_col: str = "image_id") -> DataFrame:
    """Distinct ids over many files; missing paths are ignored, only one column is read."""
    there = [p for p in paths if path_exists(spark, p)]
    texts = [p for p in there if p.endswith(".csv")]
    tables = [p for p in there if not p.endswith(".csv")]
    parts = [spark.read.csv(p, header=True) for p in texts]  # headers may differ
    if tables:
        parts.append(spark.read.parquet(*tables))  # one scan for any number of shards
    parts = [p.select(F.col(id_col).cast("string").alias(id_col)) for p in parts]
    if not parts:
        return spark.createDataFrame([], f"{id_col} string")
    return union_all(parts).distinct()


def tag_source(df: DataFrame, source: str | Column, src_ord: int) -> DataFrame:
    """Source name and explicit insertion order (file position) of every row."""
    name = F.lit(source) if isinstance(source, str) else source
    return df.select(
        "*",
        name.alias("source"),
        F.lit(src_ord).alias("src_ord"),
        F.col("_metadata.row_index").alias("row_ord"),
    )


def read_shards(
    spark: SparkSession,
    canonical: str | None,
    shards: Sequence[str],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Canonical table first, then shards in name order, columns united.

    A handful of explicit paths become one union; for a directory with very many
    shards use ``read_shard_dir``.
    """
    parts = []
    if canonical and path_exists(spark, canonical):
        parts.append(tag_source(read_parquet(spark, canonical, schema), "canonical", 0))
    for i, path in enumerate(sorted(shards), start=1):
        if path_exists(spark, path):
            parts.append(tag_source(read_parquet(spark, path, schema), path.rsplit("/", 1)[-1], i))
    if not parts:
        raise FileNotFoundError("no canonical table and no shards")
    return union_all(parts)


def read_shard_dir(
    spark: SparkSession, directory: str, schema: T.StructType | str, pattern: str = "metadata_*.parquet"
) -> DataFrame:
    """All shards of a directory in one scan, ordered by file name.

    The rank of the file name needs no shuffle: the name itself orders the
    shards, so it is carried as the order column.
    """
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .parquet(directory)
        .select(
            "*",
            F.col("_metadata.file_name").alias("source"),
            F.col("_metadata.row_index").alias("row_ord"),
        )
    )


def recent_files(df: DataFrame, now: Column, window_s: int = fv.SECONDS_PER_DAY) -> DataFrame:
    """Files behind a scan that changed within the window, with hours since.

    Only file metadata is selected, so no data column is decoded.
    """
    files = df.select(
        F.col("_metadata.file_name").alias("source"),
        F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("mtime"),
    ).distinct()
    age = now - F.col("mtime")
    return files.where(age <= window_s).select("source", (age / 3600.0).alias("hours_since"))
