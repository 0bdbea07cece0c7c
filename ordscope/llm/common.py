"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``str.translate`` table that lowers A-Z and nothing else.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names (``new=old``).

    Operators begin with this, so extra columns, whatever their names, never meet
    the working columns.
    """
    return df.select(*[F.col("`" + old.replace("`", "``") + "`").alias(new) for new, old in columns.items()])


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has: for working columns beside those that are kept."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only. ``lower`` does that by itself where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lowered(text: str) -> bytes:
    """The text's UTF-8 with A-Z lower-cased and nothing else: that is what ``bytes.lower`` does."""
    return text.encode("utf-8", "surrogatepass").lower()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what an Arrow batch holds: few rows, and where Spark knows the setting, few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of a stream of Arrow batches as Python tuples."""
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
