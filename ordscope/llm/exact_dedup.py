"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined in three steps, and each step groups by the whole content
beside its digest, so two texts are never merged because a hash agrees:

1. locally: the map side of the first aggregate combines the copies of a task;
2. per salt: (digest, salt, content), where the salt comes from the row's id, so a
   group that holds a third of all rows is spread over ``salts`` reducers;
3. globally: the at most ``salts`` winners of a content meet and give the row that
   stays and the size.

The decision returns to the rows by (digest, salt, second hash, length), so a hot
group's rows are spread in that join as well, and the decision table has one row
per key there. That return compares no content: two texts would have to share a SHA-256
digest, a second 64-bit hash and their length for one to get the other's verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordscope.llm.common import ascii_lower, own_prefix, pick, text_of


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", ascii_lower(text_of()).alias("content"))
    return rows.select(
        "doc_id",
        "content",
        F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
        F.xxhash64("content").alias("second"),
        F.octet_length("content").alias("bytes"),
        F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(salts)).alias("salt"),
    )


KEYS = ["digest", "salt", "second", "bytes"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row
    with the largest id stays. Null text counts as empty. A null id never wins
    against an id; in a group without any id ``keep_id`` is null and all its rows
    stay. Rows that repeat an id with equal text share one verdict. An empty table
    gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col, salts)
    salted = rows.groupBy(*KEYS, "content").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("digest", "content")
    winners = salted.select(
        *KEYS,
        F.max("best").over(same).alias("keep_id"),
        F.sum("n").over(same).alias("group_size"),
    )
    return (
        rows.drop("content")
        .join(winners, KEYS)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat an id with equal text one stays, the one whose own text has the
    smallest hash; so it is with equal texts of which none has an id. The rows are moved
    once, by (digest, id); repeats are limited to one row before that.
    """
    own = own_prefix(docs)
    digest, known, key = f"{own}digest", f"{own}known", f"{own}id"
    kept = exact_dedup(docs, id_col, text_col, salts).where("kept").select(
        F.col("digest").alias(digest), F.col("doc_id").isNotNull().alias(known), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key)
    )
    named, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.withColumns({
        digest: F.sha2(ascii_lower(text_of(f"`{text_col}`")).cast("binary"), 256),
        known: named.isNotNull(),
        key: F.coalesce(named.cast("string"), F.lit("")),
    })
    order = Window.partitionBy(digest, known, key).orderBy(F.xxhash64(text))
    first = rows.withColumn(f"{own}rank", F.row_number().over(order)).where(F.col(f"{own}rank") == 1)
    return first.join(kept, [digest, known, key], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
