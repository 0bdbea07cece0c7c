"""Mixing sources to target weights, in DataFrame operations only.

1. Pack: the words of a source form one stream (documents in the order of a hash of
   their id), cut into blocks of ``block_words``; running totals are taken in two
   levels, so a source that holds a third of all rows is spread over many tasks.
2. Draw: every output slot of a source is thrown into one of the output shards, so a
   shard's counts per source are a multinomial draw, given the sources' totals.
3. Map: the slots of (shard, source) are consecutive numbers of the source's sequence
   of passes; a keyed swap-or-not permutation of each pass turns a number into a
   block index.
4. Join: slots meet the blocks by (source, index).

Draws and permutations are hashes of fixed keys, so reruns and retried tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordscope.llm.common import SPACES, WORD_PATTERN, own_prefix, pick, text_of
from ordscope.session import materialise

WEIGHTS = (3, 1, 2)
ROUNDS = 24
_MANY = 8192


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target``: shares by weight, held at ``most`` times a source's size.

    ``sizes(source, source_size)`` has one row per source. The level at which the
    targets stop growing is found on the sources in order of the ratio at which each
    is full: one small row per source, in one window.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    full_at = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = full_at.rowsBetween(Window.unboundedPreceding, -1)
    onward = full_at.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    rows = rows.select(
        "*",
        (share * F.sum("source_size").over(everyone)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.sum("weight").over(onward).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # Sources before the first one that is not full at its level are full; the level of that one holds for the rest.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level")))
    rows = rows.withColumn("final", level.over(everyone)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def swap_or_not(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. size-1, for any size: each round swaps an index with its partner or not."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(key, r, F.lit("shift")), size) - x
        partner = F.when(partner < 0, partner + size).otherwise(partner)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


@dataclass
class Mix:
    """What a mix consists of; every table is written and can be read again.

    documents: doc, source, size, source_size, target (``doc`` numbers the input rows' keys)
    segments: shard, slot, source, doc_id, tie, pass, first_word, n_words
    """

    documents: DataFrame
    segments: DataFrame


def _positions(docs: DataFrame, per_chunk: int) -> DataFrame:
    """First word of every document in its source's stream, by two-level running totals."""
    rows = docs.withColumn("order", F.xxhash64(F.lit("order"), "doc_id", "digest"))
    # The hash's leading bits are a chunk number in order of the hash; their count follows the number of rows.
    n = docs.count()
    bits = max(0, (max(1, n // per_chunk) - 1).bit_length())
    chunk = F.shiftright("order", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("chunk", chunk)
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "chunk", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("order", "doc_id", "digest", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tie", F.row_number().over(Window.partitionBy("source", "chunk", "order", "doc_id", "digest").orderBy("size")))
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    totals = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))
    return rows.join(totals, same).withColumn("start", F.col("base") + F.col("offset")).drop("s", "c", "base", "offset", "order", "chunk")


def _slots(plan: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``source, shard, slot, pass, index, words``: every slot of the output and the block it takes."""
    n = plan.withColumn("total_slots", F.sum("slots").over(Window.partitionBy()))
    n = n.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("total_slots") / shard_slots)).cast("long"))
    chunks = n.where("slots > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / _MANY))))
    chunks = chunks.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "c")
    throws = chunks.withColumn(
        "k", F.explode(F.sequence(F.col("c") * _MANY, F.least((F.col("c") + 1) * _MANY, F.col("slots")) - 1))
    )
    key = F.coalesce("source", F.lit("\x00null"))
    throws = throws.select("source", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), key, "k"), "shards").alias("shard"))
    counts = throws.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    counts = counts.join(
        plan.select(F.col("source").alias("s"), "source_size", "blocks", "take"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    # Few bytes that become very many slots: a fixed number of partitions, which is not merged by size.
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartition(parts, "source", "shard")
    slots = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slots = slots.withColumn("k", F.col("first") + F.col("i"))
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn("j", F.col("k") % F.col("blocks"))
    # A stream's last block may be short: it comes last in every pass, the others are permuted.
    permuted = swap_or_not(F.col("j"), F.col("blocks") - 1, F.xxhash64(F.lit(seed), key, "pass"))
    index = F.when(F.col("j") == F.col("blocks") - 1, F.col("j")).otherwise(permuted)
    taken_before = F.col("pass") * F.col("source_size") + F.least(F.col("j") * block_words, F.col("source_size"))
    words = F.least(F.lit(block_words), F.col("source_size") - index * block_words, F.col("take") - taken_before)
    return slots.select("source", "shard", F.col("i").alias("slot"), "pass", index.alias("index"), words.alias("words"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 512,
    shard_slots: int = 8192,
    seed: int = 7,
    per_chunk: int = 4096,
) -> Mix:
    """Plan a mix of all documents: which words of which document go to which slot.

    A source's taken words are its target, rounded to whole words; no document is
    taken more often than ``most`` (at most 2) times. Null text has no words, a null
    source is a source (ordered last), a null id is an id of its own, rows that
    repeat are documents of their own. Empty tables, and tables without a word, give
    a mix without segments.
    """
    if most > 2:
        raise ValueError("a block is taken in at most two passes")
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64(text_of()).alias("digest")
    )
    rows = materialise(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, share, most)
    take = F.least(F.round("target").cast("long"), (F.floor(F.lit(most)) * F.col("source_size")).cast("long"))
    plan = wanted.withColumn("take", take).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    rest = F.col("take") - F.col("source_size") * F.floor(F.col("take") / F.col("source_size"))
    slots = F.floor(F.col("take") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block_words)
    plan = materialise(plan.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long")), "plan")

    placed = materialise(_positions(rows, per_chunk), "placed")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    pieces = pieces.select(
        "source", "index", "doc_id", "digest", "tie",
        F.greatest(F.col("start"), F.col("index") * block_words).alias("from"),
        F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block_words).alias("to"),
        "start",
    )
    slot_rows = _slots(plan, block_words, shard_slots, seed).select(
        F.col("source").alias("s"), F.col("index").alias("x"), "shard", "slot", "pass", "words"
    )
    # Both sides have grown since their sizes were known (few rows that became many): neither may be broadcast.
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("index") == F.col("x"))
    joined = pieces.hint("merge").join(slot_rows, same)
    # The last slot of a source ends at its target: it takes the first words of its block.
    end = F.least(F.col("to"), F.col("index") * block_words + F.col("words"))
    segments = joined.withColumn("n_words", end - F.col("from")).where("n_words > 0").select(
        "shard", "slot", "source", "doc_id", "digest", "tie", "pass", (F.col("from") - F.col("start")).alias("first_word"), "n_words"
    )
    of_source = plan.select(F.col("source").alias("s"), "source_size", "target")
    documents = placed.join(of_source, F.col("source").eqNullSafe(F.col("s"))).drop("s", "start")
    return Mix(documents, segments)


def taken_words(mixed: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per document."""
    taken = mixed.segments.groupBy("doc_id", "digest", "tie", "source").agg(F.sum("n_words").alias("taken"))
    t = taken.select(*[F.col(c).alias(f"t_{c}") for c in taken.columns])
    same = (
        F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        & (F.col("digest") == F.col("t_digest"))
        & (F.col("tie") == F.col("t_tie"))
        & F.col("source").eqNullSafe(F.col("t_source"))
    )
    return mixed.documents.join(t, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("t_taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs``: one row per segment, its text cut to the segment's words.

    Words keep the white space around them, so the segments of a pass put together
    give the text again. Documents without words are not part of a mix.
    """
    p, name = own_prefix(docs), lambda c: f"`{c}`"
    whole = text_of(name(text_col))
    keys = [name(id_col), f"{p}digest", name(source_col)]
    own = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(name(c)) for c in docs.columns]))
    carriers = docs.withColumn(f"{p}digest", F.xxhash64(whole)).withColumn(f"{p}tie", F.row_number().over(own))
    # A document's segments together: its text is joined and cut into words once, however long it is.
    ids = ["doc_id", "digest", "tie", "source"]
    parts = mixed.segments.groupBy(*ids).agg(F.collect_list(F.struct("first_word", "n_words")).alias("parts"))
    parts = parts.select(*[F.col(c).alias(f"{p}{c}_") for c in parts.columns])
    joined = carriers.join(
        parts,
        F.col(name(id_col)).eqNullSafe(F.col(f"{p}doc_id_"))
        & (F.col(f"{p}digest") == F.col(f"{p}digest_"))
        & (F.col(f"{p}tie") == F.col(f"{p}tie_"))
        & F.col(name(source_col)).eqNullSafe(F.col(f"{p}source_")),
    )
    pieces = F.regexp_extract_all(whole, F.lit(rf"(?s)^[{SPACES}]*[^{SPACES}]+[{SPACES}]*|[^{SPACES}]+[{SPACES}]*"), F.lit(0))
    # By way of a generator, across which the words are not computed anew for every segment.
    joined = joined.select("*", F.explode(F.array(pieces)).alias(f"{p}pieces"))
    cuts = F.transform(
        f"{p}parts_",
        lambda s: F.array_join(F.slice(f"{p}pieces", (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")), ""),
    )
    joined = joined.select(*[name(c) for c in docs.columns], F.explode(cuts).alias(f"{p}cut"))
    columns = []
    for c, kind in docs.dtypes:
        value = {text_col: F.col(f"{p}cut"), "n_chars": F.length(f"{p}cut").cast(kind)}.get(c, F.col(name(c)))
        columns.append(value.alias(c))
    return joined.select(*columns)
