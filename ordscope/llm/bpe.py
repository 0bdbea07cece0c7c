"""Byte-level BPE over a shuffle of distinct words, and decoding.

1. Explode: a task splits its documents into pre-tokens. A block of documents is
   written once, bucketed by its number: its distinct words, and per position the
   number of the word there.
2. Encode: the blocks' word lists are dealt by the words' hashes. A bucket meets every
   block's list of its words, encodes each distinct word once and answers each list. A
   word that makes up a third of all text is one entry per block there, so no key is
   hot.
3. Reassemble: a block meets its answers and puts the ids in order of the positions,
   document by document. The bucketing saves moving the blocks for that.

Only word lists and answers are shuffled: texts stay where they are read. Decoding
looks ids up in the token-byte table, which has as many rows as the vocabulary (50 256
here) and is the only data that every task has.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, pick, rows_of, small_batches, text_of
from ordscope.llm.packing import block_number, blocks, bucketed, gather, least_dtype, pack, pack_bytes, unpack, unpack_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_LONG_PIECE = 200


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; read where the task runs, once per worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@cache
def _splitter():
    return regex.compile(public_tokenizers.PATTERN)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of the lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > _LONG_PIECE:
        return _merge_long(word, ranks)
    none = len(ranks) + 1
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over a linked list, for pieces of any length."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i is word[i:end[i]], or gone (end 0)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# --- explode -----------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("spread", pa.binary()), ("codes", pa.binary())])
_BLOCK_TYPE = "block bigint, docs binary, words binary, spread binary, codes binary"
_LIST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])
_LIST_TYPE = "bucket int, block bigint, words binary"
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
_ANSWER_TYPE = "block bigint, bucket int, sizes binary, ids binary"


def _explode(buckets: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = _splitter(), TaskContext.get().partitionId()
        for number, block in enumerate(blocks(rows_of(batches, "doc_id", "text"), chars)):
            code: dict[str, int] = {}
            streams, sizes = [], []
            for _, text in block:
                found = split.findall(text)
                for word in found:
                    if word not in code:
                        code[word] = len(code)
                streams.append(np.fromiter(map(code.__getitem__, found), "<u4", len(found)))
                sizes.append(len(found))
            words = [w.encode("utf-8", "surrogatepass") for w in code]
            dealt = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(dealt, kind="stable")  # codes in order of the buckets
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            width = least_dtype(len(words))
            codes = rank[np.concatenate(streams)].astype(width) if words else np.zeros(0, width)
            docs = pack_bytes([
                np.array([i is not None for i, _ in block], "<u1").tobytes(), np.array([i or 0 for i, _ in block], "<i8").tobytes(),
                np.array(sizes, "<u4").tobytes(),
            ])
            spread = pack(np.bincount(dealt, minlength=buckets).astype("<u4"))
            listed = pack_bytes([words[i] for i in order.tolist()])
            yield batch_of(_BLOCK, [(block_number(part, number), docs, listed, spread, width.encode() + pack(codes))])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, words, spread in rows_of(batches, "block", "words", "spread"):
        listed, upto = unpack_bytes(words), np.concatenate(([0], np.cumsum(unpack(spread, "<u4"), dtype=np.int64))).tolist()
        rows = [(b, block, pack_bytes(listed[a:z])) for b, (a, z) in enumerate(zip(upto, upto[1:])) if z > a]
        yield batch_of(_LIST, rows)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists sorted by bucket; the ids of the current bucket's words are kept."""
        ranks, bucket, known = load_ranks(path), None, {}
        width = least_dtype(max(ranks.values(), default=0))
        for b, block, words in rows_of(batches, *_LIST.names):
            if b != bucket:
                bucket, known = b, {}
            ids, sizes = [], []
            for word in unpack_bytes(words):
                found = known.get(word)
                if found is None:
                    found = known[word] = merge(word, ranks)
                ids += found
                sizes.append(len(found))
            yield batch_of(_ANSWER, [(block, b, pack(np.array(sizes, "<u4")), pack(np.array(ids, width)))])

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _reassemble(width: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = sorted(right.to_pylist(), key=lambda a: a["bucket"])
        sizes = [unpack(a["sizes"], "<u4").astype(np.int64) for a in answers]
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ids = np.concatenate([unpack(a["ids"], width) for a in answers]) if answers else np.zeros(0, width)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        rows = []
        for block in left.to_pylist():
            known, keys, n_words = unpack_bytes(block["docs"])
            known, keys = np.frombuffer(known, "<u1"), np.frombuffer(keys, "<i8")
            upto = np.concatenate(([0], np.cumsum(np.frombuffer(n_words, "<u4"), dtype=np.int64)))
            codes = unpack(block["codes"][3:], block["codes"][:3].decode())
            for d in range(len(keys)):
                words = codes[upto[d] : upto[d + 1]]
                out = ids[gather(starts[words], sizes[words])].astype("<u4").tobytes()
                rows.append((int(keys[d]) if known[d] else None, out))
        return pa.Table.from_batches([batch_of(_ENCODED, rows)])

    return run


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    block_chars: int = 8_000_000,
    buckets: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, ids``, the token ids as little-endian unsigned 32-bit integers.

    Each match of the public pattern is encoded by itself, without special tokens;
    their strings are ordinary text. Null and empty texts have no ids; a null id is
    kept; rows that repeat give repeated rows; an empty table gives an empty result.
    ``buckets`` (twice the shuffle partitions unless given) bounds the share of the
    distinct words a task encodes; ``block_chars`` bounds what a task holds besides
    its longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    made = bucketed(rows.mapInArrow(_explode(buckets, block_chars), _BLOCK_TYPE), "block")
    lists = made.select("block", "words", "spread").mapInArrow(_lists, _LIST_TYPE)
    lists = lists.repartition("bucket").sortWithinPartitions("bucket")
    answers = lists.mapInArrow(_encode(path), _ANSWER_TYPE)
    width = least_dtype(max(load_ranks(path).values(), default=0))
    stored = made.select("block", "docs", "codes").groupBy("block")
    return stored.cogroup(answers.groupBy("block")).applyInArrow(_reassemble(width), "doc_id bigint, ids binary")


_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.binary())])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: the bytes of ``encoded(doc_id, ids)``, by the token-byte table.

    An id outside the vocabulary is an error. Null ids count as none.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        token = {i: b for b, i in ranks.items()}
        for batch in batches:
            rows = []
            for doc, ids in rows_of([batch], "doc_id", "ids"):
                known = np.frombuffer(ids or b"", "<u4").tolist()
                rows.append((doc, ids or b"", b"".join(map(token.__getitem__, known))))
            yield batch_of(_DECODED, rows)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text binary")
