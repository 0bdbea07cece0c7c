"""Ranked lexical search with per-term geometric blocking.

Documents form shards of consecutive rows, one table row each, with the term
frequencies of the terms that queries ask for. Four passes, without a shuffle of
documents or postings:

1. shards: whole texts are split into terms once; statistics are sums over all rows;
2. seeds: each shard scores a few documents rich in a query's heaviest terms; the
   ``top``-th best of these over all shards is a score that the result reaches;
3. index: within a shard the posting list of a term is clustered by the similarity of
   its documents and cut into blocks; a block stores its documents and, for every
   other term asked together with the term, the largest weight in the block;
4. search: a block is skipped only if the query's weights times its summary stay below
   the score reached so far. Documents of the other blocks are scored exactly.

A query needs lists only for its essential terms: the rest, whose largest
contributions together stay below the seed, cannot lift a document into the result.
All arithmetic is on 64-bit integers, so bounds are exact and results whole.

Queries are worked on in groups with a bounded number of terms; a group's terms and
weights are the only data that every task has. A task holds one shard.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, pick, rows_of, small_batches, text_of
from ordscope.llm.packing import block_number, least_dtype, pack, unpack
from ordscope.session import materialise, spread

#: Maximal runs of ASCII letters, digits and everything beyond ASCII, on lower-cased UTF-8.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SKETCH = 32  # dimensions of the projection that similarity is measured in


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, A-Z lower-cased (``bytes.lower`` changes nothing else)."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Queries:
    """A group of queries: ids, the terms of each as positions in ``terms``, then weights and seeds."""

    ids: list
    terms: dict[bytes, int]
    asked: list[np.ndarray]
    docs: int = 0
    length: int = 0
    weights: np.ndarray | None = None
    seeds: np.ndarray | None = None
    lists: dict[int, np.ndarray] | None = None  # essential term: the terms its summaries cover
    essential: list[np.ndarray] | None = None


def query_groups(queries: DataFrame, id_col: str, text_col: str, terms_at_once: int) -> Iterator[Queries]:
    """Distinct (id, text) queries in groups of at most ``terms_at_once`` terms; a query with more is a group."""
    rows = pick(queries, item=id_col, text=text_col).select("item", text_of().alias("text")).distinct()
    ids, vocabulary, asked, size = [], {}, [], 0
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        found = sorted(set(terms_of(text)))
        if ids and size + len(found) > terms_at_once:
            yield Queries(ids, vocabulary, asked)
            ids, vocabulary, asked, size = [], {}, [], 0
        ids.append(item)
        asked.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found], np.int64))
        size += len(found)
    if ids:
        yield Queries(ids, vocabulary, asked)


# --- shards ----------------------------------------------------------------------------

_SHARD = pa.schema([
    ("shard", pa.int64()), ("docs", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()),
    ("sizes", pa.binary()), ("spread", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()),
])
_SHARD_TYPE = (
    "shard bigint, docs bigint, length bigint, ids binary, known binary, sizes binary, spread binary, terms binary, counts binary"
)


def _to_shards(vocabulary: dict[bytes, int], shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        docs = length = 0
        held: list[tuple] = []
        get = vocabulary.get

        def row() -> tuple:
            def joined(i: int, kind: str) -> bytes:
                return pack(np.concatenate([h[i] for h in held]).astype(kind)) if held else pack(np.zeros(0, kind))

            ids = np.array([h[0] or 0 for h in held], "<i8")
            known = np.array([h[0] is not None for h in held], "<u1")
            sizes = np.array([h[1] for h in held], "<u8")
            spread_ = np.array([len(h[2]) for h in held], "<u4")
            at = block_number(task, number)
            return (at, docs, length, pack(ids), pack(known), pack(sizes), pack(spread_), joined(2, "<u4"), joined(3, "<u4"))

        for doc, text in rows_of(batches, "doc_id", "text"):
            terms = terms_of(text)
            if not terms:
                continue
            docs, length = docs + 1, length + len(terms)
            found = Counter(map(get, terms))
            found.pop(None, None)
            if not found:
                continue
            codes = np.fromiter(found.keys(), np.int64, len(found))
            counts = np.fromiter(found.values(), np.int64, len(found))
            held.append((doc, len(terms), codes, counts))
            if len(held) == shard_docs:
                yield batch_of(_SHARD, [row()])
                held, docs, length, number = [], 0, 0, number + 1
        if docs:
            yield batch_of(_SHARD, [row()])

    return run


class Shard:
    """The documents of one row: ids and a dense matrix of term weights, documents x terms."""

    def __init__(self, row: dict, queries: Queries):
        self.ids, self.known = unpack(row["ids"], "<i8"), unpack(row["known"], "<u1") > 0
        sizes, spread_ = unpack(row["sizes"], "<u8").astype(np.int64), unpack(row["spread"], "<u4").astype(np.int64)
        self.terms, tf = unpack(row["terms"], "<u4").astype(np.int64), unpack(row["counts"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), spread_)
        m = 50 + (50 * sizes * queries.docs) // max(queries.length, 1)
        self.value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])  # at most a million
        self.matrix = np.zeros((len(self.ids), len(queries.terms)), np.int32)
        self.matrix[self.doc, self.terms] = self.value

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.matrix[docs[:, None], terms[None, :]].astype(np.int64) @ weights

    def postings(self) -> Iterator[tuple[int, np.ndarray]]:
        """Term and its documents, ascending."""
        order = np.lexsort((self.doc, self.terms))
        terms, docs = self.terms[order], self.doc[order]
        edges = np.flatnonzero(np.diff(terms, prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(terms)]):
            yield int(terms[a]), docs[a:z]

    def sketches(self, weights: np.ndarray) -> np.ndarray:
        """Unit vectors whose products approximate the likeness of the documents' weighted terms."""
        signs = np.random.default_rng(42).integers(0, 2, (len(weights), _SKETCH)).astype(np.float32) * 2 - 1
        flat = (self.matrix * (weights / max(weights.max(initial=0), 1)).astype(np.float32)[None, :]) @ signs
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)


# --- statistics and seeds -----------------------------------------------------------------

_DF = pa.schema([("term", pa.int64()), ("df", pa.int64())])


def _frequencies(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for (terms,) in rows_of(batches, "terms"):
            total += np.bincount(unpack(terms, "<u4").astype(np.int64), minlength=n_terms)
        some = np.flatnonzero(total)
        yield batch_of(_DF, list(zip(some.tolist(), total[some].tolist())))

    return run


def weigh(queries: Queries, shards: DataFrame) -> None:
    """Statistics over all documents: their number and length, and each asked term's document frequency."""
    row = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    queries.docs, queries.length = int(row[0]), int(row[1])
    partial = shards.select("terms").mapInArrow(_frequencies(len(queries.terms)), "term bigint, df bigint")
    df = {r["term"]: r["df"] for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row per asked term
    n = queries.docs
    queries.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(queries.terms))], np.int64)


_FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_FOUND_TYPE = "query int, doc_id bigint, score bigint"


class _Best:
    """The ``top`` best (score, then smaller id) of each query that a task has met."""

    def __init__(self, n: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(n)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[query]
        if len(scores) > self.top:  # no more than the best of these can stay
            some = np.lexsort((ids, -scores))[: self.top]
            scores, ids = scores[some], ids[some]
        for entry in zip(scores.tolist(), (-ids).tolist()):
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def floor(self, query: int) -> int:
        """A score that the query's result reaches for certain; 1 where there are too few."""
        heap = self.heaps[query]
        return heap[0][0] if len(heap) == self.top else 1

    def rows(self) -> pa.RecordBatch:
        return batch_of(_FOUND, [(q, -i, s) for q, heap in enumerate(self.heaps) for s, i in heap])


def _seed(queries: Queries, top: int, heaviest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.ids), top)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, queries)
                lists = dict(shard.postings())
                for q, asked in enumerate(queries.asked):
                    heavy = asked[np.argsort(-queries.weights[asked], kind="stable")]
                    heavy = [lists[t] for t in heavy.tolist() if t in lists][:heaviest]
                    if heavy:
                        docs = np.unique(np.concatenate([d[: 2 * top] for d in heavy]))
                        docs = docs[shard.known[docs]]
                        scores = shard.scores(docs, asked, queries.weights[asked])
                        best.add(q, scores[scores > 0], shard.ids[docs[scores > 0]])
        yield best.rows()

    return run


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def seed(queries: Queries, shards: DataFrame, top: int, heaviest: int = 4) -> None:
    """A score that each query's result reaches, and with it the essential terms."""
    found = shards.mapInArrow(_seed(queries, top, heaviest), _FOUND_TYPE)
    last = _top(found, top).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()  # one row per query
    queries.seeds = np.ones(len(queries.ids), np.int64)
    for r in last:
        if r["n"] == top:
            queries.seeds[r["query"]] = r["least"]
    queries.essential, lists = [], {}
    for q, asked in enumerate(queries.asked):
        asked = asked[queries.weights[asked] > 0]
        most = queries.weights[asked] * 1_000_000
        order = np.argsort(most, kind="stable")
        needed = asked[order][np.cumsum(most[order]) >= queries.seeds[q]]
        queries.essential.append(needed)
        for t in needed.tolist():
            lists.setdefault(t, set()).update(asked.tolist())
    queries.lists = {t: np.array(sorted(c), np.int64) for t, c in lists.items()}


# --- index -------------------------------------------------------------------------------


def geometric_blocks(vectors: np.ndarray, block_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``vectors`` and the starts of blocks of at most ``block_docs`` alike ones.

    Evenly spaced rows are the centres; every row joins the centre it is most like.
    """
    n = len(vectors)
    centres = vectors[(np.arange(math.ceil(n / block_docs)) * block_docs) % n]
    likeness = vectors @ centres.T
    nearest = likeness.argmax(axis=1)
    order = np.lexsort((-likeness[np.arange(n), nearest], nearest))
    edges = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    starts = [s for a, z in zip(edges.tolist(), [*edges[1:].tolist(), n]) for s in range(a, z, block_docs)]
    return order, np.array(starts, np.int64)


_LIST_TYPE = "struct<term:int, docs:binary, starts:binary, summary:binary>"


def _index(queries: Queries, block_docs: int):
    lists = pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("summary", pa.binary())]))
    schema = pa.schema([*_SHARD, ("lists", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = Shard(row, queries), []
                vectors = shard.sketches(queries.weights) if len(shard.ids) else None
                for term, docs in shard.postings():
                    covered = queries.lists.get(term)
                    if covered is None:
                        continue
                    order, starts = geometric_blocks(vectors[docs], block_docs)
                    docs = docs[order]
                    summary = np.maximum.reduceat(shard.matrix[docs[:, None], covered[None, :]], starts, axis=0)
                    kinds = least_dtype(len(shard.ids))
                    out.append({
                        "term": term, "docs": kinds.encode() + pack(docs.astype(kinds)), "starts": pack(starts.astype("<u4")),
                        "summary": pack(summary.reshape(-1).astype("<u4")),
                    })
                yield pa.RecordBatch.from_pylist([{**row, "lists": out}], schema=schema)

    return run


# --- search ------------------------------------------------------------------------------


def _search(queries: Queries, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.ids), top)
        for batch in batches:
            for row in batch.to_pylist():
                shard, blocks = Shard(row, queries), {}
                for entry in row["lists"]:
                    covered = queries.lists[entry["term"]]
                    docs = unpack(entry["docs"][3:], entry["docs"][:3].decode()).astype(np.int64)
                    summary = unpack(entry["summary"], "<u4").astype(np.int64).reshape(-1, len(covered))
                    blocks[entry["term"]] = (docs, unpack(entry["starts"], "<u4").astype(np.int64), summary, covered)
                for q, asked in enumerate(queries.asked):
                    asked = asked[queries.weights[asked] > 0]
                    weights = queries.weights[asked]
                    least = max(int(queries.seeds[q]), best.floor(q))
                    open_docs = []
                    for term in queries.essential[q].tolist():
                        if term not in blocks:
                            continue
                        docs, starts, summary, covered = blocks[term]
                        bound = summary[:, np.searchsorted(covered, asked)] @ weights
                        sizes = np.diff(starts, append=len(docs))
                        open_docs.append(docs[np.repeat(bound >= least, sizes)])
                    docs = np.unique(np.concatenate(open_docs)) if open_docs else np.zeros(0, np.int64)
                    docs = docs[shard.known[docs]]
                    if len(docs):
                        scores = shard.scores(docs, asked, weights)
                        stay = scores >= least
                        best.add(q, scores[stay], shard.ids[docs[stay]])
        yield best.rows()

    return run


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    top: int = 50,
    shard_docs: int = 2048,
    block_docs: int = 32,
    terms_at_once: int = 8192,
) -> DataFrame:
    """The ``top`` best documents of each query with a score above 0: ``query_id, rank, doc_id, score``.

    Equal scores rank by ascending id. Null texts have no terms; a query without terms
    has no rows. A document without an id counts in the statistics and is not returned;
    rows that repeat an id are ranked one by one. Queries that repeat id and text are one.
    Without documents or queries the result is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = spread(rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    kind = queries.schema[query_id].dataType
    found = None
    for number, group in enumerate(query_groups(queries, query_id, query_text, terms_at_once)):
        shards = materialise(rows.mapInArrow(_to_shards(group.terms, shard_docs), _SHARD_TYPE), "shards")
        weigh(group, shards)
        seed(group, shards, top)
        index = materialise(shards.mapInArrow(_index(group, block_docs), f"{_SHARD_TYPE}, lists array<{_LIST_TYPE}>"), "index")
        hits = _top(index.mapInArrow(_search(group, top), _FOUND_TYPE), top)
        names = spark.createDataFrame(list(enumerate(group.ids)), f"query int, item {kind.simpleString()}")
        hits = hits.join(F.broadcast(names), "query").select(F.col("item").alias(query_id), "rank", "doc_id", "score")
        found = hits if found is None else found.unionAll(materialise(hits, f"hits{number}"))
    if found is None:
        return spark.createDataFrame([], f"`{query_id}` {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return found
