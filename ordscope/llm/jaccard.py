"""Jaccard join of documents on word n-grams by rare-first prefix filtering.

Every text becomes the set of its n-gram hashes. Under one order of all n-grams, rare
ones first, two sets of likeness ``t`` share an n-gram within their prefixes, the first
``n - ceil(t * n) + 1`` of each. What two prefixes share bounds what the sets share:
beyond the end of the prefix that ends first, that set has ``n - prefix`` n-grams left.
So two sets that share ``c`` n-grams in their prefixes have at most ``c`` and the larger
of both rests in common. Pairs that may be alike by that are verified on the whole sets.

How the work is spread:

* The order needs document frequencies. They are counted over all documents in a table
  of ``COUNTERS`` counters by hash, the only data every task has; n-grams of one counter
  are ordered by hash. A coarse count changes the number of candidates, not the result.
* Equal sets are one from the start: of those with one 128-bit digest the first stands
  for all, under a number made of its block and its place there.
* Blocks of documents send their prefixes, packed, to buckets of the hash space. A
  bucket keeps the n-grams that two sets share. N-grams shared by the very same sets
  are one list with a multiplicity: a pair of near copies meets a few times, not once
  per n-gram. A set's lists with their multiplicities are its profile; two profiles
  give ``c``, so a pair is judged where it meets and only what passes is a row.
* Pairs come in rounds. In the first, the members of a list propose to its hubs, the
  members that share most, and to their neighbours by size; verified links merge
  components. Lists over ``_PIECE`` members are cut into pieces, dealt anew in further
  rounds. Then all pairs of different components that pass are verified. So a group of
  thousands of near copies is joined by some links per set, and no pair of sets that
  are not yet connected is left out. In the last round pieces meet two by two, except
  for pieces that lie within one component.
* Sets stay in their blocks; only those of a pair to verify move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, pick, rows_of, small_batches, text_of
from ordscope.llm.components import components
from ordscope.llm.packing import block_number, blocks, bucketed, forget, gather, pack, unpack
from ordscope.session import materialise, spread

COUNTERS = 1 << 22
RANGES = 32
_SLICES = 64
_PIECE = 2048  # members of a list that meet at once
_HUBS = 3  # of a meeting, to which all members propose
_NEIGHBOURS = 3  # in the order of sizes, to which a member proposes
_PROFILE = 512  # lists in a profile at most; beyond, a set's total bounds what it shares
_HOT = 1 << 19  # members of an n-gram that wait in a bucket at most


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word n-grams; of fewer words the whole sequence."""
    # On UTF-8, lower() changes A-Z only, and split() knows the six white space characters only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width])) for i in range(n)), "<u8", n))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def range_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each of ``RANGES`` ranges, at most 65 535: suffix summaries."""
    shift = np.uint64(64 - RANGES.bit_length() + 1)
    return np.minimum(np.bincount((hashes >> shift).astype(np.int64), minlength=RANGES), 65535).astype("<u2")


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- sets and frequencies -----------------------------------------------------------------

_SETS = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary())])
_SETS_TYPE = "block bigint, id bigint, doc_id bigint, digest binary, n bigint, hashes binary"
_PLACES = 23  # bits for a set's place in its block: a set takes a character at least
_BLOCKS = 17  # bits for a block's place in its task


def set_number(block: int, place: int) -> int:
    return ((block >> 32) << (_PLACES + _BLOCKS)) | ((block & 0xFFFFFFFF) << _PLACES) | place


def block_of(number):
    """The block in a column of set numbers."""
    part = F.shiftleft(F.shiftright(number, _PLACES + _BLOCKS), 32)
    return part.bitwiseOR(F.shiftright(number, _PLACES).bitwiseAND(F.lit((1 << _BLOCKS) - 1)))


def _to_sets(width: int, chars: int):
    if chars >= 1 << _PLACES:
        raise ValueError(f"blocks of {chars} characters may hold more sets than {1 << _PLACES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(rows_of(batches, "doc_id", "text"), chars)):
            if number >> _BLOCKS:
                raise ValueError(f"more than {1 << _BLOCKS} blocks in one task")
            rows, place = [], 0
            for doc, text in block:
                found = shingles(text, width)
                own = block_number(task, number)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                rows.append((own, set_number(own, place) if len(found) else None, doc, digest, len(found), pack(found)))
                place += len(found) > 0
            yield batch_of(_SETS, rows)

    return run


_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.uint32)
    for (hashes,) in rows_of(batches, "hashes"):
        np.add.at(counts, counter_of(unpack(hashes, "<u8")), 1)
    yield batch_of(_COUNTS, [(i, pack(c)) for i, c in enumerate(np.split(counts, _SLICES))])


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(unpack(c, "<u4").astype(np.uint64) for c in table.column("counts").to_pylist())
    return pa.Table.from_batches([batch_of(_COUNTS, [(table.column("part")[0].as_py(), pack(_levels(total)))])])


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact to 64, then 16 steps an octave."""
    steps = 64 + np.floor(16 * np.log2(np.maximum(counts, 64) / 64))
    return np.where(counts <= 64, counts, np.minimum(steps, 255)).astype("<u1")


def frequency_table(sets: DataFrame) -> np.ndarray:
    """One byte per counter, ``COUNTERS`` in all whatever the input."""
    parts = sets.select("hashes").mapInArrow(_count, "part int, counts binary").groupBy("part")
    rows = parts.applyInArrow(_add_counts, "part int, counts binary").collect()
    return np.concatenate([unpack(r["counts"], "<u1") for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(COUNTERS, "<u1")


# --- prefixes -----------------------------------------------------------------------------

_LISTS = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("tokens", pa.binary()), ("of", pa.binary()), ("n", pa.binary())])
_LISTS_TYPE = "bucket int, base bigint, tokens binary, of binary, n binary"
_SHARED = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("times", pa.int64()), ("size", pa.int64())])
_SHARED_TYPE = "list bigint, id bigint, n bigint, times bigint, size bigint"


def _prefixes(buckets: int, percent: int, frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequencies.value
        block, found = None, []

        def lists() -> pa.RecordBatch:
            tokens, of, n = (np.concatenate(x) for x in zip(*found))
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((tokens, bucket))
            tokens, of, n, bucket = tokens[order], of[order], n[order], bucket[order]
            edges, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
            for b in np.unique(bucket).tolist():
                a, z = int(edges[b]), int(edges[b + 1])
                rows.append((b, set_number(block, 0), pack(tokens[a:z]), pack(of[a:z].astype("<u4")), pack(n[a:z].astype("<u4"))))
            return batch_of(_LISTS, rows)

        for number, own, n, hashes in rows_of(batches, "block", "id", "n", "hashes"):
            if number != block and found:
                yield lists()
                found = []
            block = number
            values = unpack(hashes, "<u8")
            size = prefix_size(n, percent)
            rare = np.lexsort((values, levels[counter_of(values)]))[:size]
            found.append((values[rare], np.full(size, own & ((1 << _PLACES) - 1)), np.full(size, n)))
        if found:
            yield lists()

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64-bit mixes of numbers, to be added up to a key of a set of numbers."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists_of(tokens: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The lists of a bucket's n-grams that two or more sets share; those of the same sets are one.

    A list's key is the sum of its members' mixes. Should two lists have one key they
    are one longer list: its members still meet.
    """
    order = np.lexsort((ids, tokens))
    tokens, ids, n = tokens[order], ids[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(tokens)))
    keys = np.add.reduceat(_mixed(ids), starts) if len(starts) else np.zeros(0, np.uint64)
    starts, sizes, keys = starts[sizes > 1], sizes[sizes > 1], keys[sizes > 1]
    both, first, times = np.unique(np.stack([keys, sizes.astype(np.uint64)]), axis=1, return_index=True, return_counts=True)
    starts, sizes = starts[first], sizes[first]
    at = gather(starts, sizes)
    columns = (np.repeat(both[0].view(np.int64), sizes), ids[at], n[at], np.repeat(times, sizes), np.repeat(sizes, sizes))
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=_SHARED)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``list, id, n, times, size`` of the lists of prefixes sorted by bucket.

    A bucket's n-grams wait for its end; one of ``_HOT`` members or more is a list by
    itself, whose members do not wait.
    """
    bucket, found, waiting, due = None, [], 0, 2 * _HOT
    hot = np.zeros(0, np.uint64)

    def passed(tokens, ids, n):
        """Rows of hot n-grams, and what is left."""
        is_hot = np.isin(tokens, hot)
        k = int(is_hot.sum())
        columns = (_mixed(tokens[is_hot]).view(np.int64), ids[is_hot], n[is_hot], np.ones(k, np.int64), np.zeros(k, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=_SHARED), (tokens[~is_hot], ids[~is_hot], n[~is_hot])

    for b, base, tokens, of, n in rows_of(batches, *_LISTS.names):
        if b != bucket:
            if found:
                yield _lists_of(*map(np.concatenate, zip(*found)))
            bucket, found, waiting, due, hot = b, [], 0, 2 * _HOT, np.zeros(0, np.uint64)
        part = unpack(tokens, "<u8"), base + unpack(of, "<u4").astype(np.int64), unpack(n, "<u4").astype(np.int64)
        if len(hot):
            rows, part = passed(*part)
            yield rows
        found.append(part)
        waiting += len(part[0])
        if waiting >= due:
            part = tuple(map(np.concatenate, zip(*found)))
            values, counts = np.unique(part[0], return_counts=True)
            hot = np.concatenate((hot, values[counts >= _HOT]))
            rows, part = passed(*part)
            yield rows
            found, waiting = [part], len(part[0])
            due = 2 * max(waiting, _HOT)
    if found:
        yield _lists_of(*map(np.concatenate, zip(*found)))


# --- candidates ---------------------------------------------------------------------------

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIRS_TYPE = "a bigint, b bigint"


def _passing(n, at, ranges, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Upper bound of likeness where the pairs (i, j) pass the length, position and suffix filters, else -1."""
    x, y = n[i], n[j]
    need = -(-percent * (x + y) // (100 + percent))  # overlap that the likeness asks for
    room = 1 + np.minimum(at[i], at[j]) + np.minimum(x - at[i], y - at[j]) - 1  # before, at and after the shared n-gram
    likely = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (room >= need)
    out = np.full(len(i), -1.0)
    some = np.flatnonzero(likely)
    for s in range(0, len(some), 1 << 15):
        part = some[s : s + (1 << 15)]
        overlap = np.minimum(ranges[i[part]], ranges[j[part]]).sum(axis=1, dtype=np.int64)
        # A full counter bounds nothing.
        overlap = np.where((ranges[i[part]].max(axis=1) == 65535) | (ranges[j[part]].max(axis=1) == 65535), np.minimum(x[part], y[part]), overlap)
        fits = overlap >= need[part]
        out[part[fits]] = (overlap / np.maximum(x[part] + y[part] - overlap, 1))[fits]
    return out


def _may_link(n: np.ndarray, component: np.ndarray, total: np.ndarray, profiles: list, percent: int) -> np.ndarray:
    """Which pairs of a meeting lie in different components and may be alike by length and prefixes.

    ``profiles`` has arrays (lists, times), or None for a set of too many lists. Lists
    are told apart by 32 bits here: equal ones only raise the bound.
    """
    known = np.array([p is not None for p in profiles])
    lists = [p[0] if p is not None else np.zeros(0, np.int32) for p in profiles]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    names, column = np.unique(np.concatenate(lists), return_inverse=True)
    times = np.concatenate([p[1] if p is not None else np.zeros(0, np.int32) for p in profiles])
    row = np.repeat(np.arange(len(n)), sizes)
    common = np.zeros((len(n), len(n)), np.float32)
    for a in range(0, len(names), 1024):
        own = (column >= a) & (column < a + 1024)
        shares = np.zeros((len(n), min(1024, len(names) - a)), np.float32)
        np.add.at(shares, (row[own], column[own] - a), times[own])
        common += shares @ (shares > 0).astype(np.float32).T
    if not known.all():
        either = ~(known[:, None] & known[None, :])
        common[either] = np.minimum(total[:, None], total[None, :])[either]
    rest = n - (n - -(-percent * n // 100) + 1)
    x, y = n[:, None], n[None, :]
    able = (component[:, None] != component[None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    need = -(-percent * (x + y) // (100 + percent))  # overlap that the likeness asks for
    return able & (common + np.maximum(rest[:, None], rest[None, :]) >= need)


def _propose(percent: int, every: bool):
    """Stream over meetings; ``every`` pair that may link, or each member's with hubs and neighbours."""

    def pairs_of(rows: list[tuple]) -> np.ndarray:
        ids, component, n, total, weight, side = (np.array([r[c] for r in rows]) for c in range(6))
        able = _may_link(n, component, total, [None if r[6] is None else (np.array(r[6], np.int32), np.array(r[7], np.int64)) for r in rows], percent)
        if side.any():  # two pieces meet: pairs within one of them belong to another meeting
            able &= side[:, None] != side[None, :]
        if not every and len(rows) > _HUBS + _NEIGHBOURS:
            order = np.lexsort((ids, n))
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            is_hub = np.zeros(len(rows), bool)
            is_hub[np.lexsort((ids, -weight))[:_HUBS]] = True
            near = np.abs(place[:, None] - place[None, :]) <= _NEIGHBOURS
            able &= is_hub[:, None] | is_hub[None, :] | near
        i, j = np.nonzero(np.triu(able, 1))
        return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, size = None, [], [], 0

        def found() -> pa.RecordBatch:
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_PAIRS)

        for one, t, q, *row in rows_of(batches, "list", "t", "q", "id", "component", "n", "total", "weight", "side", "lists", "times"):
            if (one, t, q) != key:
                if len(rows) > 1:
                    out.append(pairs_of(rows))
                    size += out[-1].shape[1]
                key, rows = (one, t, q), []
                if size >= 100_000:
                    yield found()
                    out, size = [], 0
            rows.append(row)
        if len(rows) > 1:
            out.append(pairs_of(rows))
        yield found()

    return run


def _one_meeting(members: DataFrame, seed: int) -> DataFrame:
    """Lists in pieces of some ``_PIECE`` members; the seed deals them anew."""
    per = members.groupBy("list").agg(F.count(F.lit(1)).alias("all"), (F.min("component") != F.max("component")).alias("open"))
    rows = members.join(per.where("open").select("list", "all"), "list")
    own = F.pmod(F.xxhash64(F.lit(seed), "id"), F.ceil(F.col("all") / _PIECE)).cast("int")
    return rows.select("list", own.alias("t"), own.alias("q"), F.lit(0).alias("side"), "id", "component")


def _all_meetings(members: DataFrame) -> DataFrame:
    """Lists in pieces that meet two by two.

    The largest component of a list is cut apart from the rest, so its pieces never meet
    each other; lists of one component alone are left out.
    """
    per = members.groupBy("list", "component").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("list").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("most")
    )
    per = per.where("parts > 1").select("list", "all", F.col("most.k").alias("first"), F.col("most.component").alias("main"))
    rows = members.join(per, "list")
    whole, main = F.col("all") <= _PIECE, F.col("component") == F.col("main")
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("first") / _PIECE)).cast("int")
    others = F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("first")) / _PIECE)).cast("int")
    own = F.when(whole, 0).when(main, F.pmod(F.xxhash64("id"), mains)).otherwise(mains + F.pmod(F.xxhash64("id"), others)).cast("int")
    rows = rows.select("list", "id", "component", own.alias("own"), mains.alias("mains"), (mains + others).alias("pieces"))

    def meet(t, q, side):
        return F.struct(t.cast("int").alias("t"), q.cast("int").alias("q"), F.lit(side).alias("side"))

    is_main = F.col("own") < F.col("mains")
    lower = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.col("own")), F.col("pieces") - 1)
    as_first = F.transform(lower, lambda q: meet(F.col("own"), q, 0))
    before = F.when(~is_main & (F.col("own") > 0), F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    as_second = F.transform(before, lambda t: meet(t, F.col("own"), 1))
    dealt = rows.select("list", "id", "component", F.explode(F.concat(as_first, as_second)).alias("m"))
    return dealt.select("list", "m.*", "id", "component")


def _candidates(members: DataFrame, profiles: DataFrame, percent: int, every: bool, seed: int) -> DataFrame:
    """Distinct pairs ``a, b`` (a < b) of different components that may link: all, or those proposed."""
    dealt = (_all_meetings(members) if every else _one_meeting(members, seed)).join(profiles, "id")
    dealt = dealt.repartition("list", "t", "q").sortWithinPartitions("list", "t", "q")
    return dealt.mapInArrow(_propose(percent, every), _PAIRS_TYPE).distinct()


# --- verification -------------------------------------------------------------------------

_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in rows_of([batch], "a", "b", "x", "y"):
                x, y = unpack(x, "<u8"), unpack(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append((a, b, 100 * common >= percent * (len(x) + len(y) - common)))
            yield batch_of(_VERIFIED, out)

    return run


def _chosen(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets with these numbers. Blocks are told which of their sets these are: no set moves for it."""
    per = ids.groupBy(block_of(F.col("id")).alias("block")).agg(F.collect_set("id").alias("chosen"))
    return sets.join(per, "block").where(F.array_contains("chosen", F.col("id"))).drop("chosen")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of the written pairs."""
    needed = materialise(_chosen(sets, pairs.select(F.explode(F.array("a", "b")).alias("id"))).select("id", "hashes"), "needed")
    left = needed.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = needed.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    checked = materialise(both.mapInArrow(_verify(percent), "a bigint, b bigint, linked boolean"), "verified")
    forget(needed)
    return checked


def linked_sets(sets: DataFrame, firsts: DataFrame, percent: int = 80, rounds: int = 8) -> DataFrame:
    """``node, component`` of the sets that link to another; ``sets(block, id, n, hashes)`` is bucketed by block.

    ``firsts(id)`` are the sets that stand for their equals. After the first round
    further ones come, ``rounds`` in all at most, only where lists were cut in pieces and
    while a round links a hundredth of the sets; then all open pairs are taken.
    """
    spark = sets.sparkSession
    frequencies = spark.sparkContext.broadcast(frequency_table(sets))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = _chosen(sets, firsts).select("block", "id", "n", "hashes").mapInArrow(_prefixes(buckets, percent, frequencies), _LISTS_TYPE)
    lists = lists.repartition("bucket").sortWithinPartitions("bucket")
    shared = lists.mapInArrow(_shared, _SHARED_TYPE).groupBy("list", "id")
    shared = materialise(shared.agg(F.max("n").alias("n"), F.sum("times").alias("times"), F.max("size").alias("size")), "shared")
    entry = F.struct(F.shiftright("list", 32).cast("int").alias("list"), F.col("times").cast("int").alias("times"))
    share = F.sum(F.col("times") * F.col("size")) / F.max("n")
    profiles = shared.groupBy("id").agg(
        F.max("n").alias("n"), F.sum("times").alias("total"), share.alias("weight"), F.count(F.lit(1)).alias("k"), F.collect_list(entry).alias("e")
    )
    kept = F.col("k") <= _PROFILE
    profiles = profiles.select(
        "id", "n", "total", "weight", F.when(kept, F.col("e.list")).alias("lists"), F.when(kept, F.col("e.times")).alias("times")
    )
    profiles = materialise(profiles, "profiles")
    members = shared.select("list", "id")
    enough = profiles.count() // 100
    cut = members.groupBy("list").count().where(F.col("count") > _PIECE).limit(1).count() > 0
    rows = members.withColumn("component", F.col("id"))
    links = tried = component = None
    every, number = False, 0
    while True:
        pairs = _candidates(rows, profiles, percent, every, number)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        checked = _verified(materialise(pairs, "pairs"), sets, percent)
        new = checked.where("linked").select("a", "b")
        links = new if links is None else links.unionAll(new)
        count = new.count()
        if every and not count and component is not None:
            return component
        component = components(links)
        if every:
            return component
        tried = checked.select("a", "b") if tried is None else tried.unionAll(checked.select("a", "b"))
        number += 1
        every = number == rounds or not cut or count <= enough
        named = members.join(component.withColumnRenamed("node", "id"), "id", "left")
        rows = named.select("list", "id", F.coalesce("component", "id").alias("component"))


def near_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    block_chars: int = 8_000_000,
    salts: int = 16,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of
    distinct ``width``-word n-grams, A-Z lower-cased; ``component_id`` is the smallest id
    that links reach, the document's own included. A text of fewer words is one n-gram;
    null, empty and blank texts are empty sets, linked with nothing. A row without an id
    links like any other and names no component unless all members lack an id.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = spread(rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    sets = bucketed(rows.mapInArrow(_to_sets(width, block_chars), _SETS_TYPE), "block")
    keyed = materialise(sets.select("doc_id", F.col("n").alias("n_shingles"), "digest", "id"), "keyed")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    # Copies of one set are spread by salt; a component is named by its sets' smallest ids.
    salted = keyed.where("digest IS NOT NULL").groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.min("id").alias("id"))
    salted = materialise(salted, "salted")
    firsts = materialise(salted.groupBy("digest").agg(F.min("id").alias("id")), "firsts")
    found = linked_sets(sets, firsts.select("id"), percent)
    forget(sets)
    named = firsts.join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    named = materialise(salted.drop("id").join(named, "digest"), "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    verdict = named.join(smallest, "component").select("digest", "salt", "component_id")
    out = keyed.join(verdict, ["digest", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
