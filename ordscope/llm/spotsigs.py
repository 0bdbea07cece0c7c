"""SpotSigs fingerprints: chains of content words after common-word anchors.

A signature is an anchor with the next content words (words that are no anchors)
after it. A document's fingerprint is the sorted set of its signatures' hashes. Two
documents can only reach a Jaccard likeness of ``t`` if the smaller set has at least
``t`` times the size of the larger, so the pair search partitions by set length, and
within a partition compares the shortest posting lists of each set only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, pick, rows_of, small_batches, text_of
from ordscope.session import materialise

#: Common words that serve as anchors, by language.
ANCHORS = {
    "en": "the a an of and to in is was are be by for from it on or that this with as at has have will",
    "de": "der die das den dem des ein eine einer und von zu im in mit auf für ist sich nicht als auch",
    "fr": "le la les un une des de du et à en est que qui dans pour par sur au aux il ce pas",
    "es": "el la los las un una de del y a en es que por para con se lo su al como no",
}
_ANCHORS = frozenset(w for line in ANCHORS.values() for w in line.split())
_WORD = re.compile(r"[^\W_]+")
WIDTH = 8  # hexadecimal digits of a signature's hash


def signatures(text: str, chain: int = 2, gap: int = 8) -> np.ndarray:
    """Sorted distinct hashes of the anchors' chains.

    The start of the text is an anchor, and in a stretch of more than ``gap`` words
    without one each further word is its own anchor, so texts without common words
    have signatures as well and an edit changes only those near it. A chain that the
    text's end cuts short counts. Only a text without words has no signature.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, "<u4")
    common = np.fromiter(map(_ANCHORS.__contains__, words), bool, len(words))
    at = np.arange(len(words))
    latest = np.maximum.accumulate(np.where(common, at, -1))
    anchors = np.flatnonzero(common | (at - latest > gap))
    content = np.flatnonzero(~common)
    following = np.searchsorted(content, anchors, "right").tolist()
    chains = [words[i] for i in content.tolist()]
    heads = [words[i] for i in anchors.tolist()]
    hashed = xxhash.xxh32_intdigest
    found = {
        hashed(" ".join([head, *chains[k : k + chain]]).encode("utf-8", "surrogatepass"))
        for head, k in zip(["^", *heads], [0, *following])
    }
    return np.array(sorted(found), "<u4")


def as_text(signature_set: np.ndarray) -> str:
    return signature_set.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sorted sets; 1 for two empty ones. 0 without a look if the sizes rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


_SETS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2) -> DataFrame:
    """``doc_id, fingerprint``: the signature set of each whole text, as text; null and empty texts: ''."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(_SETS, [(d, as_text(signatures(t, chain))) for d, t in rows_of([batch], "doc_id", "text")])

    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


# --- pairs ---------------------------------------------------------------------------


def length_classes(longest: int, least: float) -> list[int]:
    """Lower edges of the set-length partitions: likeness ``least`` only spans neighbours."""
    edges = [1]
    while edges[-1] <= longest:
        edges.append(max(edges[-1] + 1, int(edges[-1] / least) + 1))
    return edges


def similar(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, likeness`` of distinct fingerprints ``sets(fingerprint)`` with likeness of ``least`` or more, a < b.

    Equal fingerprints are one class: pass distinct values and join members by value.
    A set is listed in its own length partition and asks that and the next longer one.
    It is listed under its first ``n - ceil(least * n) + 1`` signatures in order of
    rarity: two sets that are alike share one of these. Postings of a signature that
    many sets list are pruned by the length bound before sets are compared.
    """
    spark = sets.sparkSession
    size = (F.length("fingerprint") / WIDTH).cast("int")
    rows = sets.where(F.length("fingerprint") > 0).select("fingerprint", size.alias("n")).distinct()
    rows = rows.withColumn("key", F.xxhash64("fingerprint"))
    longest = rows.agg(F.max("n")).first()[0] or 0
    edges = length_classes(longest, least)
    step = F.lit(0)
    for edge in edges[1:]:
        step = step + F.when(F.col("n") >= edge, 1).otherwise(0)
    rows = materialise(rows.withColumn("class", step), "sets")
    items = rows.select("key", "n", "class", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("fingerprint", i * WIDTH + 1, F.lit(WIDTH)))
    ).alias("item"))
    rarity = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(rarity, "item").groupBy("key", "n", "class").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    prefix = F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    listed = materialise(ranked.select("key", "n", "class", F.explode(prefix).alias("p")).select("key", "n", "class", "p.item"), "listed")
    asks = listed.select(F.col("key").alias("b"), F.col("n").alias("m"), "item", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"))
    pairs = listed.select(F.col("key").alias("a"), "n", "class", "item").join(asks, ["class", "item"])
    within = (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n"))
    ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.where(within & (F.col("a") != F.col("b"))).select(ordered.alias("p")).select("p.*").distinct()
    left = rows.select(F.col("key").alias("a"), F.col("fingerprint").alias("x"))
    right = rows.select(F.col("key").alias("b"), F.col("fingerprint").alias("y"))
    found = pairs.join(left, "a").join(right, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("likeness", pa.float64())])
        for batch in batches:
            out = []
            for x, y in rows_of([batch], "x", "y"):
                score = jaccard(np.frombuffer(bytes.fromhex(x), ">u4"), np.frombuffer(bytes.fromhex(y), ">u4"), least)
                if score >= least - 1e-12:
                    out.append((min(x, y), max(x, y), score))
            yield batch_of(schema, out)

    small_batches(spark)
    return found.select("x", "y").mapInArrow(compare, "a string, b string, likeness double")


# --- documents against their edited texts and their successors -------------------------

_JUDGED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_JUDGED_TYPE = (
    "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _judge(chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, id); a bucket's last row is the next bucket's first, for reading only."""
        last, out, held = None, [], 0
        for bucket, guest, doc, text in rows_of(batches, "bucket", "guest", "doc_id", "text"):
            mine = signatures(text, chain)
            if last is not None and last[0] == bucket:
                _, owner, before, its = last
                edited = _edited(before, text)
                changed = signatures(edited, chain)
                out.append((owner, len(before), edited, as_text(its), as_text(changed), jaccard(its, changed), jaccard(its, mine)))
                held += len(before)
            # Only the first guest is read; those after it are its repeats.
            last = None if guest else (bucket, doc, text, mine)
            if len(out) >= 500 or held > 8 << 20:
                yield batch_of(_JUDGED, out)
                out, held = [], 0
        yield batch_of(_JUDGED, out)

    return run


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, guest, doc_id, text``: ranges of ids, each closed by the next range's first document.

    The edges are ids of the table, as many as shuffle partitions. One shuffle moves
    the texts. Null ids come last, rows that repeat an id in order of their text; the
    last document's successor is the first.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    top = F.lit((1 << 63) - 1)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), top).alias("at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(parts)]
    edges = rows.agg(F.percentile_approx("at", at, 10 * parts), F.min("at")).first()
    firsts = sorted({*(edges[0] or []), *([edges[1]] if edges[1] is not None else [])})
    n = len(firsts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("guest", pa.bool_()), ("at", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
        edge = np.array(firsts, np.int64)
        for batch in batches:
            out = []
            for doc, text, key in rows_of([batch], "doc_id", "text", "at"):
                b = int(np.searchsorted(edge, key, "right")) - 1
                out.append((b, False, key, doc, text))
                if key == firsts[b]:
                    out.append(((b - 1) % n, True, key, doc, text))
            yield batch_of(schema, out)

    small_batches(spark)
    dealt = rows.mapInArrow(place, "bucket int, guest boolean, at bigint, doc_id bigint, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "at", "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2) -> DataFrame:
    """Each document against its edited text and the next document.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edit replaces the last quarter of the code points by the first as
    many of the next document. Null text is empty; two texts without words are alike
    (1), one without is unlike any other (0). A table of one row is its own
    successor; an empty table gives an empty result.
    """
    return with_successors(docs, id_col, text_col).mapInArrow(_judge(chain), _JUDGED_TYPE)
