"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes all rows its predecessor kept and returns the columns of
``documents``, the last one tokens:

1. the quality classifier rejects documents (operator 4);
2. of equal texts the row with the largest id stays (operator 10);
3. of each near-duplicate component the row with the smallest id stays (operator 7);
4. the sources are mixed: one row per taken piece of a document, its words in
   ``text``, whole passes over a source giving its texts again (operator 3);
5. the pieces are encoded and decoded (operator 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordscope.llm import bpe, exact_dedup, mixing, quality, simhash
from ordscope.session import materialise


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` per piece; ids are little-endian unsigned 32-bit integers."""
    out = bpe.decode(bpe.encode(docs))
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("bpe", tokens),
]
#: No SQL: the classifier and the fingerprints have none. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
