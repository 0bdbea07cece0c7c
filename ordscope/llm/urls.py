"""URL filters: host and path rules, then a listed-URL check behind a blocked Bloom filter.

The listed canonical URLs set bits in a Bloom filter whose every key touches one
512-bit block. The filter has a fixed number of bytes whatever the list's length, so
it may be sent to all tasks; a long list only raises the share of false hits. URLs
which the filter passes are possible hits: an exact join with the list removes the
false ones. The other URLs, most of them as a rule, take no part in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import ascii_lower, pick, small_batches
from ordscope.session import materialise


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

BLOCK_WORDS = 8  # 64-bit words of a block
PROBES = 8
_ODD = (np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for a URL without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(rest: Column) -> Column:
    """Host without ``www.`` and default port, path without its last slash, query without tracking and in order."""
    host = F.regexp_replace(F.regexp_replace(host_of(rest), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(rest), r"/$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, the earlier of equally long ones; else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Later ones override: short before long, and of equally long ones the last listed first.
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


# --- blocked Bloom filter -----------------------------------------------------------


def _probes(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, word within it and bit of every probe of every hash."""
    block = (hashes >> np.uint64(32)) % np.uint64(blocks)
    spread = (hashes[:, None] * _ODD[None, :]) >> np.uint64(55)  # nine bits: a place in 512
    return block.astype(np.int64), (spread >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spread & np.uint64(63))


_WORDS = [f"w{i}" for i in range(BLOCK_WORDS)]


def build_filter(keys: DataFrame, filter_bytes: int = 4 << 20) -> np.ndarray:
    """The filter of ``keys(h)`` as an array blocks x 8 of 64-bit words.

    Tasks set bits, blocks are combined by bitwise or, and at most ``filter_bytes``
    (plus block numbers) come to the driver.
    """
    count = max(1, filter_bytes // (8 * BLOCK_WORDS))
    schema = pa.schema([("block", pa.int32()), *[(w, pa.int64()) for w in _WORDS]])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((count, BLOCK_WORDS), np.uint64)
        for batch in batches:
            block, word, bit = _probes(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), count)
            np.bitwise_or.at(bits, (np.repeat(block, PROBES), word.ravel()), bit.ravel())
        used = np.flatnonzero(bits.any(axis=1))
        for at in range(0, len(used), 8192):
            some = used[at : at + 8192]
            arrays = [pa.array(some.astype(np.int32)), *[pa.array(bits[some, i].view(np.int64)) for i in range(BLOCK_WORDS)]]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    parts = keys.select("h").mapInArrow(set_bits, "block int, " + ", ".join(f"{w} bigint" for w in _WORDS))
    rows = parts.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in _WORDS]).toPandas()
    bits = np.zeros((count, BLOCK_WORDS), np.uint64)
    if len(rows):
        bits[rows["block"].to_numpy()] = rows[_WORDS].to_numpy(np.int64).view(np.uint64)
    return bits


def maybe_listed(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """``rows(page_id, url, key, h)`` with ``maybe``: whether the filter passes ``h``."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            block, word, bit = _probes(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), len(table))
            hit = (table[block[:, None], word] & bit != 0).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "maybe"])

    types = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(test, f"{types}, maybe boolean")


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    rules: Sequence[Rule] = RULES,
    filter_bytes: int = 4 << 20,
) -> DataFrame:
    """``page_id, host, path, rule, listed, verdict``: one row per page.

    The longest fitting rule decides; without one a page is blocked if its canonical
    URL is on the list. Null URLs and such without ``://`` have empty host and path,
    fit no rule and are never listed. A null id is kept, repeated rows stay repeated,
    list entries may repeat, and either table may be empty.
    """
    small_batches(pages.sparkSession, 10_000)
    entry = canonical(rest_of(F.col("url")))
    keys = pick(listed, url=listed_col).select(entry.alias("key")).where("key != ''").distinct()
    keys = materialise(keys.select("key", F.xxhash64("key").alias("h")), "listed")
    bits = build_filter(keys, filter_bytes)
    rows = pick(pages, page_id=id_col, url=url_col).select("page_id", "url", entry.alias("key"))
    tested = maybe_listed(rows.withColumn("h", F.xxhash64("key")), bits)
    # AQE splits the rows of a URL that very many pages share; a key is on the list side once.
    sure = keys.select(F.col("key").alias("on_list"))
    hits = tested.where("maybe").join(sure, F.col("key") == F.col("on_list"), "left")
    both = hits.select("page_id", "url", F.col("on_list").isNotNull().alias("listed")).unionAll(
        tested.where(~F.col("maybe")).select("page_id", "url", F.lit(False).alias("listed"))
    )
    judged = both.withColumn("rest", rest_of(F.col("url"))).select(
        "page_id", "listed", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path")
    )
    judged = judged.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), "listed",
        F.coalesce("found.verdict", method).alias("verdict"),
    )


def repeated_urls(pages: DataFrame, url_col: str = "url", least: int = 2) -> DataFrame:
    """``url``: one spelling of each canonical URL that at least ``least`` pages have, mirrors and link variants."""
    rows = pick(pages, url=url_col).withColumn("key", canonical(rest_of(F.col("url")))).where("key != ''")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where(F.col("n") >= least).select("url")
