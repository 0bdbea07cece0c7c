"""SimHash near-duplicates through BK-trees over shards of the fingerprints.

Copies collapse first: the search runs over distinct fingerprints. Two of them within
``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` slices of the 64
bits, so every pair of slices (for 6 slices and radius 4) gives a shard key, and all
links lie within shards. In a shard the members form a BK-tree, whose children hang
on the integer distance to their parent; a search follows only edges within the
radius. A shard larger than ``shard_rows`` becomes several trees of bounded size, and
each tree is sent to the query chunks of its shard, so no task holds more than two
chunks.

A shard task returns a spanning forest of its links, not the pairs: the links a
component needs, at most one per member. Components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import ASCII_LOWER, batch_of, own_prefix, pick, rows_of, small_batches, text_of
from ordscope.llm.components import components
from ordscope.session import materialise

SEED = 42
_SPLIT = " \t\n\v\f\r"
_CHUNK = 50_000
_SIGN, _ALL = 1 << 63, (1 << 64) - 1


def _words(text: str) -> list[str]:
    # The white space of the contract and no other: str.split() alone would also cut at U+001C or U+00A0.
    for space in _SPLIT[1:]:
        if space in text:
            text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def simhash(text: str, width: int = 4) -> int:
    """64 bits; a bit is set where over half of the shingle hashes have it. No word: zero."""
    words = [w.encode("utf-8", "surrogatepass") for w in _words(text.translate(ASCII_LOWER))]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):  # a long text is hashed piece by piece
        pairs = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= _SIGN else value


def _hash_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, _signed(simhash(text, width))) for doc, text in rows_of([batch], "doc_id", "text")]
            yield batch_of(_FINGERPRINTS, rows)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp``: the SimHash of each whole text as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_hash_rows(width), "doc_id bigint, fp bigint")


class BKTree:
    """Values under Hamming distance; a child hangs on its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert, unless the value is there."""
        at = 0
        while at < len(self.values):
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                return
            child = self.children[at].setdefault(distance, len(self.values))
            if child == len(self.values):
                break
            at = child
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        open_nodes = [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield self.values[at]
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)


def shard_forest(tree_values: list[int], query_values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links among tree and query members that lie within the radius of each other."""
    tree = BKTree()
    for v in tree_values:
        tree.add(v)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    links = []
    for v in query_values:
        for w in tree.within(v, radius):
            a, b = root(v), root(w)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((v, w))
    return links


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of shard keys: the choice of ``blocks - radius`` slices, and their bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    return F.array(*keys)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forests(radius: int):
    """Stream over rows sorted by shard: only the current shard is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, asks, out = None, [], [], []

        def links() -> list[tuple[int, int]]:
            if not tree or len(tree) + len(asks) < 2:
                return []
            return [(_signed(a), _signed(b)) for a, b in shard_forest(tree, asks or tree, radius)]

        for choice, bits, t, q, fp, role in rows_of(batches, "choice", "bits", "t", "q", "fp", "role"):
            if (choice, bits, t, q) != key:
                out += links()
                key, tree, asks = (choice, bits, t, q), [], []
                if len(out) >= 10_000:
                    yield batch_of(_LINKS, out)
                    out = []
            (tree if role == 0 else asks).append(fp & _ALL)  # bits are counted on unsigned values
        out += links()
        yield batch_of(_LINKS, out)

    return run


def near_links(fps: DataFrame, radius: int = 4, blocks: int = 6, shard_rows: int = 4096) -> DataFrame:
    """Spanning links ``a, b`` between distinct values of ``fps(fp)`` within ``radius`` bits."""
    shards = fps.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.*")
    sizes = shards.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = shards.join(sizes, ["choice", "bits"])  # a fingerprint alone in its shard links to nothing there
    chunks = F.ceil(F.col("n") / shard_rows).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # Tree t meets query chunk q for t <= q; within one chunk the tree asks about its own members.
    as_tree = F.transform(
        F.sequence(F.col("own"), F.col("chunks") - 1),
        lambda q: F.struct(F.col("own").alias("t"), q.cast("int").alias("q"), F.lit(0).alias("role")),
    )
    as_query = F.transform(
        F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>")),
        lambda t: F.struct(t.cast("int").alias("t"), F.col("own").alias("q"), F.lit(1).alias("role")),
    )
    parts = members.select("choice", "bits", "fp", F.explode(F.concat(as_tree, as_query)).alias("p")).select(
        "choice", "bits", "fp", "p.*"
    )
    dealt = parts.repartition("choice", "bits", "t", "q").sortWithinPartitions("choice", "bits", "t", "q", "fp")
    return dealt.mapInArrow(_forests(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    width: int = 4,
    blocks: int = 6,
    shard_rows: int = 4096,
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id that can be reached, the document itself included. Null and empty
    texts have fingerprint zero and link like any other. A null id is never a
    component's name unless all its members lack an id. Repeated rows stay repeated.
    An empty table gives an empty result. ``blocks`` must exceed ``radius``.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    fps = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(near_links(distinct.select("fp"), radius, blocks, shard_rows))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with all their columns.

    Of rows that repeat an id all stay or all go; rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    own = own_prefix(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(f"{own}gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"{own}gone"), "left_anti")
