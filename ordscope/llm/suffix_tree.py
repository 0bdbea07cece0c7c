"""Language-model scores from a probabilistic suffix tree over words.

The states of the tree are contexts of up to ``depth`` words. A context that occurs
``least`` times or more is a candidate; it is retained if its next-word distribution
diverges from its parent's (the context without its first word) by more than
``threshold`` in total: the sum over its occurrences of the log ratio of the two
probabilities, each occurrence left out of its own estimate. A state's distribution
is smoothed with its parent's, (c(s, x) + T(s) P(x | parent)) / (c(s) + T(s)) with T(s)
the number of distinct next words, down to the word counts. A word is scored in the
longest suffix that is a state. With ``longer``, contexts of more than ``depth`` words
are candidates as well if their parent is retained: rounds go on, one per length, until
a round retains none.

How it is spread: documents form blocks. A block is written once, as word hashes and
codes, bucketed by its number. In each round (context length 0, 1, 2) a block lists
its distinct (context, word) entries with their training counts, so a frequent entry
is one per block; the lists are dealt by the context's hash. A bucket sums the counts,
tests its contexts and answers every block's list. The bucketing saves moving the
blocks: only lists and answers are shuffled. Contexts that make up over 1 / 1024 of all
words (so at most 1 024 of one length) are dealt by the next word's hash instead; for
these a bucket returns its part of T(s), and once that is summed, its part of the test.

After ``depth`` rounds a block is written anew with the positions whose context was
retained, and the documents and words they need; each further round reads and rewrites
what the round before it left, so its cost follows the surviving contexts. A position
that drops out adds its log probability to its document's sum. Spent tables are deleted.

A parent's probability reaches the test as a 32-bit float. The next words of a context
that is not hot are told apart by 40 bits of their hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, lowered, pick, rows_of, small_batches, text_of
from ordscope.llm.packing import block_number, blocks, bucketed, forget, least_dtype, pack, pack_bytes, unpack, unpack_bytes
from ordscope.session import materialise

HOT_SHARE = 1024
_END = xxhash.xxh64_intdigest(b"\x20end")  # words hold no blank
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: int | None, parts: int, part: int) -> bool:
    """A null id is a training row."""
    return doc_id is not None and crc32(str(doc_id).encode()) % parts == part


# --- blocks --------------------------------------------------------------------------

_BLOCK = pa.schema([
    ("block", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("trained", pa.binary()), ("codes", pa.binary()),
    ("n_trained", pa.int64()),
])
_BLOCK_TYPE = "block bigint, docs binary, words binary, trained binary, codes binary, n_trained bigint"


def _to_blocks(chars: int, parts: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(rows_of(batches, "doc_id", "text"), chars)):
            code: defaultdict[bytes, int] = defaultdict(None, {b"": 0})  # the end; no word is empty
            code.default_factory = code.__len__  # a new word gets the next code
            streams, sizes = [], []
            for _, text in block:
                found = lowered(text).split()  # on UTF-8, at the six white space characters
                found.append(b"")
                streams.append(np.fromiter(map(code.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
            codes = np.concatenate(streams)
            del streams
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in code), np.uint64, len(code))
            hashes[0] = _END
            order = np.argsort(hashes, kind="stable")  # codes in the order of the hashes
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            codes, hashes = rank[codes], hashes[order]
            held = np.array([is_held_out(i, parts, part) for i, _ in block])
            trained = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(hashes)).astype("<u4")
            docs = pack_bytes([
                np.array([i is not None for i, _ in block], "<u1").tobytes(), np.array([i or 0 for i, _ in block], "<i8").tobytes(),
                np.array(sizes, "<u4").tobytes(), held.astype("<u1").tobytes(),
            ])
            width = least_dtype(len(hashes))
            row = (block_number(task, number), docs, pack(hashes), pack(trained), width.encode() + pack(codes.astype(width)), int(trained.sum()))
            yield batch_of(_BLOCK, [row])

    return run


@dataclass
class Model:
    """What every task must know: the totals, the limits, and of the hot contexts of each length T(s) and the verdict."""

    buckets: int
    depth: int
    least: int
    threshold: float
    hot_share: int
    tokens: int = 0
    distinct: int = 0
    hot_types: list[dict[int, int]] = field(default_factory=list)
    hot_kept: list[set[int]] = field(default_factory=list)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash space, so that hash order is bucket order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_LIST = pa.schema([
    ("length", pa.int32()), ("hot", pa.bool_()), ("bucket", pa.int32()), ("block", pa.int64()), ("contexts", pa.binary()),
    ("sizes", pa.binary()), ("words", pa.binary()), ("trained", pa.binary()), ("parent", pa.binary()),
])
_LIST_TYPE = (
    "length int, hot boolean, bucket int, block bigint, contexts binary, sizes binary, words binary, trained binary, parent binary"
)
_ANSWER = pa.schema([
    ("block", pa.int64()), ("length", pa.int32()), ("hot", pa.bool_()), ("bucket", pa.int32()), ("counts", pa.binary()),
    ("types", pa.binary()), ("kept", pa.binary()), ("distinct", pa.int64()), ("contexts", pa.binary()), ("totals", pa.binary()),
])
_ANSWER_TYPE = (
    "block bigint, length int, hot boolean, bucket int, counts binary, types binary, kept binary, distinct bigint, contexts binary, totals binary"
)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of 0 and more, the first index of each, and each key's place among them.

    Where a key and its index fit one number together these are sorted as plain numbers,
    which is several times faster than sorting indices by key.
    """
    shift = int(len(keys)).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - shift):
        return np.unique(keys, return_index=True, return_inverse=True)
    packed = keys << shift
    packed |= np.arange(len(keys))
    packed.sort()
    small = np.int32 if shift < 32 else np.int64
    order = (packed & ((1 << shift) - 1)).astype(small)
    packed >>= shift
    new = _begins(packed)
    inverse = np.empty(len(keys), small)
    inverse[order] = np.cumsum(new, dtype=small) - 1
    return packed[new], order[new], inverse


def _begins(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _before(values: np.ndarray, first: int) -> np.ndarray:
    """The value of the place before each one."""
    moved = np.empty_like(values)
    moved[0], moved[1:] = first, values[:-1]
    return moved


def _hash_order(hashes: np.ndarray) -> np.ndarray:
    """Indices in the order of the hashes' leading bits, 32 at least, then of the indices: buckets lie together."""
    shift = int(len(hashes)).bit_length()
    if shift > 32:
        return np.argsort(hashes, kind="stable")
    low = np.uint64((1 << shift) - 1)
    packed = hashes & ~low
    packed |= np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    packed &= low
    return packed.view(np.int64)


def _slices(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


def _first_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, trained in rows_of(batches, "block", "words", "trained"):
            hashes, counts = unpack(words, "<u8"), unpack(trained, "<u4")
            rows = [
                (0, False, b, block, b"", b"", pack(hashes[a:z]), pack(counts[a:z]), b"")
                for b, a, z in _slices(bucket_of(hashes, buckets), buckets)
            ]
            yield batch_of(_LIST, rows)

    return run


class _Reader:
    """A block's words, and round by round the probabilities of the answers so far.

    A worker's memory is a few arrays of the block's length: codes and places are 32-bit
    numbers (a text has fewer bytes), and what the positions of an entry have in common
    is worked out per entry.
    """

    def __init__(self, row: dict, answers: list[dict], model: Model):
        self.block, self.model = row["block"], model
        known, ids, sizes, held = unpack_bytes(row["docs"])
        self.known, self.ids = np.frombuffer(known, "<u1"), np.frombuffer(ids, "<i8")
        self.sizes, self.held = np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(held, "<u1").astype(bool)
        width = row["codes"][:3].decode()
        self.codes = unpack(row["codes"][3:], width).astype(np.int32)
        self.hashes = unpack(row["words"], "<u8")
        self.trained = np.repeat(~self.held, self.sizes)
        self.answers = sorted(answers, key=lambda a: (a["length"], a["hot"], a["bucket"]))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.within = np.arange(len(self.codes), dtype=np.int32)  # place in the document
        self.within -= np.repeat(self.starts.astype(np.int32), self.sizes)
        counts = self._answer(0, False, "counts")[self.codes]
        self.n_known = counts > 0
        self.p = counts + 0.5
        self.p /= model.tokens + 0.5 * (model.distinct + 1)
        # Candidates of length 1: the word before; -1 where there is none.
        self.context, self.context_count = _before(self.codes, -1), _before(counts, 0)
        self.context[self.starts], self.context_count[self.starts] = -1, 0
        self.context_hashes = self.hashes

    def _answer(self, length: int, hot: bool, what: str) -> np.ndarray:
        kind = {"counts": "<u4", "types": "<u4", "kept": "<u1", "totals": "<u4"}[what]
        found = [unpack(a[what], kind) for a in self.answers if a["length"] == length and a["hot"] == hot]
        return np.concatenate(found) if found else np.zeros(0, kind)

    def word_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Per document the known words and the base score; before the first ``advance``."""
        return np.add.reduceat(self.n_known.astype(np.int64), self.starts), np.add.reduceat(np.log10(self.p), self.starts)

    def entries(self) -> None:
        """Distinct (context, word) entries of the present length, those of hot contexts apart."""
        able = self.context_count >= self.model.least
        hot = able & (self.context_count > self.model.tokens // self.model.hot_share)
        self.at = [np.flatnonzero(x).astype(np.int32) for x in (able & ~hot, hot)]
        self.unique, self.pairs = [], []
        # Entries lie in the order of what they are dealt by: the context, or the word of a hot one.
        for is_hot, high, low, many in ((False, self.context, self.codes, self.hashes), (True, self.codes, self.context, self.context_hashes)):
            shift = max(1, int(len(many)).bit_length())
            keys = high[self.at[is_hot]].astype(np.int64)
            keys <<= shift
            keys |= low[self.at[is_hot]]
            keys, first, inverse = _distinct(keys)
            pair = (keys >> shift).astype(np.int32), (keys & ((1 << shift) - 1)).astype(np.int32)
            self.unique.append((first, inverse))
            self.pairs.append(pair[::-1] if is_hot else pair)

    def lists(self, length: int) -> list[tuple]:
        self.entries()
        rows, n = [], self.model.buckets
        for hot in (False, True):
            (context, word), (first, inverse), at = self.pairs[hot], self.unique[hot], self.at[hot]
            if not len(context):
                continue
            trained = np.bincount(inverse[self.trained[at]], minlength=len(context)).astype("<u4")
            parent = self.p[at[first]].astype("<f4")
            dealt = self.hashes[word] if hot else self.context_hashes[context]
            for b, a, z in _slices(bucket_of(dealt, n), n):
                if hot:
                    contexts, sizes = self.context_hashes[context[a:z]], b""
                else:
                    begins = np.flatnonzero(_begins(context[a:z]))
                    contexts = self.context_hashes[context[a:z][begins]]
                    sizes = pack(np.diff(begins, append=z - a).astype("<u4"))
                packed = pack(self.hashes[word[a:z]]) if hot else _packed_words(self.hashes[word[a:z]])
                rows.append((length, hot, b, self.block, pack(contexts), sizes, packed, pack(trained[a:z]), pack(parent[a:z])))
        return rows

    def advance(self, length: int) -> None:
        """Take the answers for ``length``: move probabilities on, and set up the next candidates."""
        self.entries()
        last = length == self.model.depth
        self.retained = np.zeros(len(self.codes), bool)
        counts, pair_of = np.zeros(len(self.codes), np.uint32), np.full(len(self.codes), -1, np.int32)
        hashes_of, upto = [], 0
        for hot in (False, True):
            (context, word), (first, inverse), at = self.pairs[hot], self.unique[hot], self.at[hot]
            if not len(context):
                continue
            per_entry = self._answer(length, hot, "counts")
            if hot:
                known, stay = self.model.hot_types[length], self.model.hot_kept[length]
                types_of, kept_of = np.zeros(len(self.context_hashes), np.int64), np.zeros(len(self.context_hashes), bool)
                for c in np.flatnonzero(np.bincount(context)).tolist():  # at most ``hot_share`` contexts
                    name = int(self.context_hashes[c])
                    types_of[c], kept_of[c] = known.get(name, 0), name in stay
                types, kept = types_of[context], kept_of[context]
            else:
                nth = np.cumsum(_begins(context), dtype=np.int32) - 1
                types, kept = self._answer(length, False, "types")[nth], self._answer(length, False, "kept")[nth] > 0
                del nth
            # The positions of an entry share its parent's probability and its context's count.
            p, total = self.p[at[first]], self.context_count[at[first]].astype(np.int64)
            total += types
            better = per_entry + types * p
            better /= np.maximum(total, 1, out=total)
            np.copyto(p, better, where=kept)
            del better, total
            self.p[at] = p[inverse]
            self.retained[at] = kept[inverse]
            if last:
                continue
            counts[at] = per_entry[inverse]
            pair_of[at] = inverse + np.int32(upto)
            mixed, words = self.context_hashes[context], self.hashes[word]
            mixed *= _M1
            words *= _M2
            words += np.uint64(length)
            mixed ^= words
            hashes_of.append(mixed)
            upto += len(context)
        self.at = self.unique = self.pairs = None
        if last or not upto:
            self.context, self.context_count = pair_of, counts  # no candidates
            self.context.fill(-1)
            self.context_count.fill(0)
            return
        mixed = np.concatenate(hashes_of)
        del hashes_of
        mixed ^= mixed >> np.uint64(29)
        mixed *= _M1
        order = _hash_order(mixed)
        rank = np.empty(upto, np.int32)
        rank[order] = np.arange(upto)
        # The entry that ends at the word before is the next context.
        before = _before(pair_of, -1)
        able = self.within > length
        able &= before >= 0
        self.context = np.where(able, rank[before], np.int32(-1))
        self.context_count = np.where(able, _before(counts, 0), np.uint32(0))
        self.context_hashes = mixed[order]


def _packed_words(hashes: np.ndarray) -> bytes:
    """40 bits of each word's hash: enough to tell the next words of one context apart."""
    low = pack((hashes >> np.uint64(8)).astype("<u4"))
    return len(low).to_bytes(4, "little") + low + pack((hashes & np.uint64(255)).astype("<u1"))


def _steps(model: Model, length: int):
    """Lists of contexts of ``length`` from a block and the answers to the shorter ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            reader = _Reader(row, right.to_pylist(), model)
            for done in range(1, length):
                reader.advance(done)
            rows += reader.lists(length)
        return pa.Table.from_batches([batch_of(_LIST, rows)])

    return run


# --- what survives a round ---------------------------------------------------------------

_STATE = pa.schema([
    ("block", pa.int64()), ("n_active", pa.int64()), ("info", pa.binary()), ("done", pa.binary()), ("docs", pa.binary()),
    ("words", pa.binary()), ("codes", pa.binary()), ("active", pa.binary()),
])
_STATE_TYPE = "block bigint, n_active bigint, info binary, done binary, docs binary, words binary, codes binary, active binary"


def _state_row(block: int, info: bytes, names, sizes, held, codes, hashes, at, p, onward, length: int) -> tuple:
    """A block with the positions ``at[onward]`` and their documents; the others' log probabilities are summed.

    ``names`` are the documents' numbers in the whole block, ``at`` the positions of this
    round and ``p`` their probabilities.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.searchsorted(ends, at, "right").astype(np.int32)
    onward = onward & (at - starts[doc] >= length)
    sums = np.bincount(doc[~onward], weights=np.log10(p[~onward]), minlength=len(sizes))
    some = np.flatnonzero(np.bincount(doc[~onward], minlength=len(sizes)))
    done = pack_bytes([names[some].astype("<u4").tobytes(), sums[some].astype("<f8").tobytes()])
    at, p, doc = at[onward], p[onward], doc[onward]
    kept = np.unique(doc)
    moved = np.zeros(len(sizes), np.int64)
    moved[kept] = np.cumsum(sizes[kept]) - sizes[kept]
    at = at - starts[doc] + moved[doc]
    codes = codes[np.repeat(np.bincount(kept, minlength=len(sizes)) > 0, sizes)]
    there = np.bincount(codes, minlength=len(hashes)) > 0
    used, codes = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[codes]
    docs = pack_bytes([names[kept].astype("<u4").tobytes(), sizes[kept].astype("<u4").tobytes(), held[kept].astype("<u1").tobytes()])
    width = least_dtype(max(len(used), 1))
    active = pack_bytes([pack(np.diff(at, prepend=0).astype("<u4")), pack(p.astype("<f4"))])
    return (block, len(at), info, done, docs, pack(hashes[used]), width.encode() + pack(codes.astype(width)), active)


def _survivors(model: Model, onward: bool):
    """From a block and the answers up to ``depth`` to its first state."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            reader = _Reader(row, right.to_pylist(), model)
            sums = reader.word_sums()
            for length in range(1, model.depth + 1):
                reader.advance(length)
            info = pack_bytes([
                reader.known.tobytes(), reader.ids.tobytes(), reader.sizes.astype("<u4").tobytes(), reader.held.astype("<u1").tobytes(),
                sums[0].astype("<u4").tobytes(), sums[1].astype("<f8").tobytes(),
            ])
            stay = reader.retained if onward else np.zeros(len(reader.codes), bool)
            rows.append(_state_row(
                reader.block, info, np.arange(len(reader.sizes)), reader.sizes, reader.held, reader.codes, reader.hashes,
                np.arange(len(reader.codes), dtype=np.int32), reader.p, stay, model.depth + 1,
            ))
        return pa.Table.from_batches([batch_of(_STATE, rows)])

    return run


class _Active:
    """The surviving positions of a block, their contexts of ``length`` words and their distinct entries."""

    def __init__(self, row: dict, length: int):
        self.block, self.length = row["block"], length
        names, sizes, held = unpack_bytes(row["docs"])
        self.names, self.sizes = np.frombuffer(names, "<u4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)
        self.held = np.frombuffer(held, "<u1").astype(bool)
        self.codes, self.hashes = unpack(row["codes"][3:], row["codes"][:3].decode()).astype(np.int64), unpack(row["words"], "<u8")
        at, p = unpack_bytes(row["active"])
        self.at, self.p = np.cumsum(unpack(at, "<u4").astype(np.int64)), unpack(p, "<f4").astype(np.float64)
        mixed = np.full(len(self.at), length, np.uint64)
        for back in range(1, length + 1):
            mixed = (mixed ^ self.hashes[self.codes[self.at - back]]) * _M1
            mixed ^= mixed >> np.uint64(29)
        self.context_hashes, rank = np.unique(mixed * _M2, return_inverse=True)
        self.shift = max(1, int(len(self.hashes)).bit_length())
        key = (rank.astype(np.int64) << self.shift) | self.codes[self.at]
        self.key, self.first, self.inverse = _distinct(key)

    def lists(self, buckets: int) -> list[tuple]:
        context, word = self.key >> self.shift, self.key & ((1 << self.shift) - 1)
        trained = np.repeat(~self.held, self.sizes)[self.at]
        trained = np.bincount(self.inverse, weights=trained, minlength=len(self.key)).astype("<u4")
        parent, rows = self.p[self.first].astype("<f4"), []
        for b, a, z in _slices(bucket_of(self.context_hashes[context], buckets), buckets):
            begins = np.flatnonzero(np.diff(context[a:z], prepend=-1))
            contexts = self.context_hashes[context[a:z][begins]]
            sizes = pack(np.diff(begins, append=z - a).astype("<u4"))
            rows.append((self.length, False, b, self.block, pack(contexts), sizes, _packed_words(self.hashes[word[a:z]]), pack(trained[a:z]), pack(parent[a:z])))
        return rows

    def advanced(self, answers: list[dict]) -> tuple:
        """The state after the answers: retained contexts go on with one word more."""
        answers = sorted(answers, key=lambda a: a["bucket"])

        def answer(what: str, kind: str) -> np.ndarray:
            return np.concatenate([unpack(a[what], kind) for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)

        nth = self.key >> self.shift  # every context was asked about, in the order of its hash
        counts, types, totals = answer("counts", "<u4"), answer("types", "<u4")[nth], answer("totals", "<u4")[nth]
        kept = answer("kept", "<u1")[nth][self.inverse] > 0
        better = (counts[self.inverse] + types[self.inverse] * self.p) / np.maximum((totals + types)[self.inverse], 1)
        p = np.where(kept, better, self.p)
        return _state_row(
            self.block, None, self.names, self.sizes, self.held, self.codes, self.hashes, self.at, p, kept, self.length + 1
        )


def _active_lists(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["n_active"]:
                    yield batch_of(_LIST, _Active(row, length).lists(buckets))

    return run


def _next_state(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [_Active(row, length).advanced(right.to_pylist()) for row in left.to_pylist()]
        return pa.Table.from_batches([batch_of(_STATE, rows)])

    return run


_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])
_SCORES_TYPE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(table: pa.Table) -> pa.Table:
    """A block's documents: what is known of them, and the sums of all rounds."""
    rows = table.to_pylist()
    info = next(r["info"] for r in rows if r["info"])
    kinds = ("<u1", "<i8", "<u4", "<u1", "<u4", "<f8")
    known, ids, sizes, held, n_known, base = (np.frombuffer(x, k).tolist() for x, k in zip(unpack_bytes(info), kinds))
    score = np.zeros(len(ids))
    for r in sorted(rows, key=lambda r: r["round"]):
        names, sums = unpack_bytes(r["done"])
        score[np.frombuffer(names, "<u4")] += np.frombuffer(sums, "<f8")
    ids = [i if k else None for i, k in zip(ids, known)]
    out = list(zip(ids, map(bool, held), sizes, n_known, base, score.tolist()))
    return pa.Table.from_batches([batch_of(_SCORES, out)])


# --- buckets ---------------------------------------------------------------------------


def _answer_words(rows: list[tuple]) -> list[tuple]:
    words = [unpack(r[6], "<u8") for r in rows]
    _, inverse = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unpack(r[7], "<u4") for r in rows])).astype(np.int64)
    out, at = [], 0
    for i, (row, own) in enumerate(zip(rows, words)):
        answer = counts[inverse[at : at + len(own)]].astype("<u4")
        at += len(own)
        out.append((row[3], 0, False, row[2], pack(answer), b"", b"", int((counts > 0).sum()) if i == 0 else 0, None, b""))
    return out


def _answer_hot(rows: list[tuple]) -> list[tuple]:
    length, bucket = rows[0][0], rows[0][2]
    contexts = np.concatenate([unpack(r[4], "<u8") for r in rows])
    words = np.concatenate([unpack(r[6], "<u8") for r in rows])
    sizes = [len(unpack(r[4], "<u8")) for r in rows]
    names, context = np.unique(contexts, return_inverse=True)
    order = np.lexsort((context, words))
    new = np.concatenate(([True], (np.diff(words[order]) != 0) | (np.diff(context[order]) != 0)))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    counts = np.bincount(entry, weights=np.concatenate([unpack(r[7], "<u4") for r in rows])).astype("<u8")
    parent = np.concatenate([unpack(r[8], "<f4") for r in rows])[order][new]
    out, at = [], 0
    for row, n in zip(rows, sizes):
        out.append((row[3], length, True, bucket, pack(counts[entry[at : at + n]].astype("<u4")), b"", b"", 0, None, b""))
        at += n
    # This bucket's entries of the hot contexts, for their T(s) and their test; no block asked for this row.
    seen = counts > 0
    return [*out, (
        None, length, True, bucket, pack(counts[seen]), pack(context[order][new][seen].astype("<u4")), pack(parent[seen]), 0, pack(names), b"",
    )]


def _gain(c, parent, types, total) -> np.ndarray:
    """An entry's part of the divergence: each occurrence left out of its own estimate.

    That is of its count, the context's count and, if it was the only one, of T(s).
    """
    others = types - (c == 1)
    below = total - 1 + others
    estimate = np.where(below > 0, (c - 1 + others * parent) / np.maximum(below, 1), parent)
    return c * (np.log(np.maximum(estimate, 1e-300)) - np.log(parent))


_HOT = pa.schema([("context", pa.int64()), ("types", pa.int64()), ("total", pa.int64()), ("gain", pa.float64())])
_HOT_TYPE = "context bigint, types bigint, total bigint, gain double"


def _hot_sums(known: dict[int, tuple[int, int]] | None):
    """Parts of T(s) and the counts of hot contexts; once these are ``known``, parts of their divergence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, counts, contexts, parents in rows_of(batches, "contexts", "counts", "types", "kept"):
            names = unpack(names, "<u8").view(np.int64)
            c, of = unpack(counts, "<u8").astype(np.int64), unpack(contexts, "<u4").astype(np.int64)
            types, total = np.bincount(of, minlength=len(names)), np.bincount(of, weights=c, minlength=len(names)).astype(np.int64)
            gain = np.zeros(len(names))
            if known:
                all_types, all_total = (np.array([known[n][i] for n in names.tolist()], np.int64) for i in (0, 1))
                parent = unpack(parents, "<f4").astype(np.float64)
                gain = np.bincount(of, weights=_gain(c, parent, all_types[of], all_total[of]), minlength=len(names))
            yield batch_of(_HOT, list(zip(names.tolist(), types.tolist(), total.tolist(), gain.tolist())))

    return run


def _judge_hot(model: Model, answers: DataFrame) -> None:
    """T(s) and the test of the hot contexts of one length: two sums of at most ``hot_share`` rows."""
    parts = answers.where("block IS NULL").select("contexts", "counts", "types", "kept")
    summed = [F.sum(c).alias(c) for c in ("types", "total", "gain")]
    rows = parts.mapInArrow(_hot_sums(None), _HOT_TYPE).groupBy("context").agg(*summed).collect()
    known = {r["context"]: (r["types"], r["total"]) for r in rows}
    model.hot_types.append({c & ((1 << 64) - 1): types for c, (types, _) in known.items()})
    rows = parts.mapInArrow(_hot_sums(known), _HOT_TYPE).groupBy("context").agg(*summed).collect() if known else []
    kept = {r["context"] & ((1 << 64) - 1) for r in rows if r["gain"] > model.threshold and r["total"] >= model.least}
    model.hot_kept.append(kept)


def _answer_contexts(rows: list[tuple], model: Model) -> list[tuple]:
    length, bucket = rows[0][0], rows[0][2]
    named = [unpack(r[4], "<u8") for r in rows]
    sizes = [unpack(r[5], "<u4").astype(np.int64) for r in rows]
    names, nth = np.unique(np.concatenate(named), return_inverse=True)
    words = []
    for r in rows:
        cut = 4 + int.from_bytes(r[6][:4], "little")
        words.append((unpack(r[6][4:cut], "<u4").astype(np.int64) << 8) | unpack(r[6][cut:], "<u1").astype(np.int64))
    context = np.repeat(nth, np.concatenate(sizes))
    keys, first, entry = np.unique((context << 40) | np.concatenate(words), return_index=True, return_inverse=True)
    counts = np.bincount(entry, weights=np.concatenate([unpack(r[7], "<u4") for r in rows])).astype(np.int64)
    parent = np.concatenate([unpack(r[8], "<f4") for r in rows])[first].astype(np.float64)
    owner = keys >> 40
    total = np.bincount(owner, weights=counts, minlength=len(names))
    types = np.bincount(owner, weights=counts > 0, minlength=len(names))
    seen = counts > 0
    c, s = counts[seen], owner[seen]
    gain = np.bincount(s, weights=_gain(c, parent[seen], types[s], total[s]), minlength=len(names))
    kept = ((gain > model.threshold) & (total >= model.least)).astype("<u1")
    if length >= model.depth:  # what is not retained takes no further part
        counts, types, total = counts * kept[owner], types * kept, total * kept
    out, at, group = [], 0, 0
    for row, own in zip(rows, sizes):
        n = int(own.sum())
        mine = nth[group : group + len(own)]
        answer = pack(counts[entry[at : at + n]].astype("<u4"))
        totals = pack(total[mine].astype("<u4")) if length > model.depth else b""
        retained = int(kept.sum()) if group == 0 else 0
        out.append((row[3], length, False, bucket, answer, pack(types[mine].astype("<u4")), pack(kept[mine]), retained, None, totals))
        at, group = at + n, group + len(own)
    return out


def _answers(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists sorted by (hot, bucket); one bucket is in memory."""
        current, rows = None, []

        def answered() -> pa.RecordBatch:
            if rows[0][0] == 0:
                return batch_of(_ANSWER, _answer_words(rows))
            return batch_of(_ANSWER, _answer_hot(rows) if rows[0][1] else _answer_contexts(rows, model))

        for row in rows_of(batches, *_LIST.names):
            if (row[1], row[2]) != current:
                if rows:
                    yield answered()
                current, rows = (row[1], row[2]), []
            rows.append(row)
        if rows:
            yield answered()

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 5,
    part: int = 1,
    depth: int = 2,
    least: int = 2,
    threshold: float = 2.0,
    block_chars: int = 8_000_000,
    hot_share: int = HOT_SHARE,
    longer: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose crc32 of the id, modulo ``parts``, is not ``part``.
    Scores are log10 probabilities of the whole text with its end; the end counts as a
    token. Null and empty texts are their end alone. Rows with a null id are training
    rows; rows that repeat count as often as they occur. Without training rows every
    token has the probability of an unseen one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(4 * n, depth, least, threshold, hot_share, hot_types=[{}], hot_kept=[set()])
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kept = bucketed(rows.mapInArrow(_to_blocks(block_chars, parts, part), _BLOCK_TYPE), "block")
    model.tokens = kept.agg(F.coalesce(F.sum("n_trained"), F.lit(0))).first()[0]

    def answered(lists: DataFrame, length: int) -> DataFrame:
        dealt = lists.repartition("hot", "bucket").sortWithinPartitions("hot", "bucket")
        return materialise(dealt.mapInArrow(_answers(model), _ANSWER_TYPE), f"answers{length}")

    spent = [kept]
    answers = None
    for length in range(depth + 1):
        if length == 0:
            new = answered(kept.select("block", "words", "trained").mapInArrow(_first_lists(model.buckets), _LIST_TYPE), length)
        else:
            new = answered(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_steps(model, length), _LIST_TYPE), length)
        if length == 0:
            model.distinct = new.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
        else:
            _judge_hot(model, new)
        spent.append(new)
        new = new.where("block IS NOT NULL")
        answers = new if answers is None else answers.unionAll(new)
    state = bucketed(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_survivors(model, longer), _STATE_TYPE), "block")
    sums = None
    for length in count(depth + 1):
        done = materialise(state.select("block", F.lit(length).alias("round"), "info", "done"), "sums")
        sums = done if sums is None else sums.unionAll(done)
        forget(*spent)
        if not state.agg(F.sum("n_active")).first()[0]:
            break
        new = answered(state.mapInArrow(_active_lists(model.buckets, length), _LIST_TYPE), length)
        spent = [state, new]
        going = state.where("n_active > 0").select(*[c for c in _STATE.names if c not in ("info", "done")])
        state = bucketed(going.groupBy("block").cogroup(new.groupBy("block")).applyInArrow(_next_state(length), _STATE_TYPE), "block")
    forget(state)
    scored = sums.groupBy("block").applyInArrow(_score, _SCORES_TYPE)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
