"""Spelling variants: a relational trie frontier over the distinct words.

The words, and their mirror images, form two radix tries kept as one edge table
(node, label, child). A state is (word, position, node, edits). States without an edit
are the words on their own paths; joined with the edges of their nodes they replace one
character of a label or drop one of the word. Level by level the states with one edit
are joined with the one edge of their node that goes on as their word does. A state that
ends at a word gives a pair of neighbours. An inserted character is the other word's
dropped one, so each pair of unequal lengths is found from its longer word; one of equal
lengths from its smaller word.

In every pair one half of the word is untouched. So a forward state may only take its
edit beyond the first half of the word, a mirrored state beyond the first half of the
mirror image, and prefixes shorter than that are in no table. That keeps the frontier
in the narrow parts of the tries: near the root any letter would do.

Nodes are named by a 64-bit hash of their prefix. Prefixes that share a hash would
share a node, which adds paths and loses none; every pair is compared once at the end.
A node below which many words lie is split: its edges are repeated per salt, and a
state carries the salt of its node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, lowered, pick, rows_of, small_batches, text_of
from ordscope.session import materialise, spread

#: Letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
_HELD = 400_000  # distinct words a task combines before it passes them on
_PER_SALT = 4096  # words below a node for each copy of its edges

# --- words ----------------------------------------------------------------------------

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count_words(least: int, every: int):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # a longer run is matched whole, a shorter one nowhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for doc, text in rows_of(batches, "doc_id", "text"):
            start = crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in Counter(runs.findall(lowered(text).decode("utf-8", "surrogatepass"))).items():
                h = crc32(word.encode(), start)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                counts[word] = counts.get(word, 0) + n
            if len(counts) >= _HELD:
                yield batch_of(_COUNTS, list(counts.items()))
                counts = {}
        yield batch_of(_COUNTS, list(counts.items()))

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: the runs of letters with ``least`` or more code points that occur ``occurrences`` times or more.

    A-Z are lower-cased. Where ``every`` divides the crc32 of ``<id>:<run>``, the run
    loses one code point, at that number modulo its length. A null id writes as
    nothing; null texts have no runs.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    counted = spread(rows).mapInArrow(_count_words(least, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# --- the tries ------------------------------------------------------------------------

_PREFIXES = pa.schema([
    ("text", pa.string()), ("start", pa.int32()), ("least", pa.int32()), ("nodes", pa.list_(pa.int64())), ("follows", pa.list_(pa.string())),
])
_PREFIXES_TYPE = "text string, start int, least int, nodes array<bigint>, follows array<string>"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word and its mirror image with their prefixes from ``least`` on, and what follows each ('': the end)."""
    for batch in batches:
        out = []
        for (word,) in rows_of([batch], "word"):
            start, least = len(word) // 2, (len(word) - 1) // 2
            for sign, text in (("+", word), ("-", word[::-1])):  # no letter is a sign
                state = xxhash.xxh3_64((sign + text[:least]).encode())
                nodes, follows = [], [*text[least:], ""]
                for letter in follows:
                    nodes.append(_signed(state.intdigest()))
                    state.update(letter.encode())
                out.append((sign + text, start, least, nodes, follows))
        yield batch_of(_PREFIXES, out)


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edge table and the first frontier of ``words(word)``.

    Edges: ``node, salt, first, label, child, salts, onward, ends``; ``first`` is the label's
    first character, ``child`` the node it leads to and ``onward`` what the child's edges
    begin with ('.': an end); ``ends`` is the directed word that an edge completes. States:
    ``text, position, node, salt``. A directed word is the word after ``+`` or its mirror
    image after ``-``.
    """
    small_batches(words.sparkSession)
    rows = materialise(words.select("word").mapInArrow(_prefixes, _PREFIXES_TYPE), "prefixes")
    steps = F.posexplode(F.arrays_zip("nodes", "follows")).alias("i", "p")
    steps = rows.select("text", "start", "least", steps).select(
        "text", (F.col("i") + F.col("least")).alias("depth"), (F.col("i") + F.col("least") == F.col("start")).alias("starts"), "p.nodes", "p.follows"
    )
    # A node is a prefix with two ways on, or one where a word starts. Map-side combined.
    nodes = steps.groupBy(F.col("nodes").alias("node")).agg(
        F.count(F.lit(1)).alias("below"), (F.max("starts") | (F.min("follows") != F.max("follows"))).alias("forks")
    )
    nodes = nodes.where("forks").select("node", F.ceil(F.col("below") / _PER_SALT).cast("int").alias("salts"))
    met = steps.select("text", "depth", F.col("nodes").alias("node")).join(nodes, "node")
    path = met.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "salts"))).alias("path"))
    path = materialise(path, "paths")
    pairs = path.select("text", "path", F.posexplode("path").alias("i", "here"))
    pairs = pairs.select("text", "here.*", F.get("path", F.col("i") + 1).alias("there"))
    # Characters of a directed word begin at 2, after its sign.
    label = F.expr("substring(text, depth + 2, coalesce(there.depth, length(text)) - depth)")
    ends = F.when(F.col("there").isNull(), F.col("text"))
    edges = pairs.select("node", "salts", label.alias("label"), F.col("there.node").alias("child"), F.col("there.salts").alias("child_salts"), ends.alias("ends"))
    edges = edges.distinct().withColumn("first", F.expr("substring(label, 1, 1)"))
    edges = materialise(edges, "labels")
    letter = F.when(F.col("first") == "", ".").otherwise(F.col("first"))
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.sort_array(F.collect_set(letter)), "").alias("onward"))
    ending = edges.where("child IS NULL").withColumn("onward", F.lit(None).cast("string"))  # no key to join on
    edges = edges.where("child IS NOT NULL").join(onward, "child", "left").unionByName(ending).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    edges = edges.select("node", "salt", "first", "label", "child", F.col("child_salts").alias("salts"), "onward", "ends")
    states = pairs.where(F.col("depth") >= F.floor((F.length("text") - 1) / 2)).select(
        "text", F.col("depth").alias("position"), "node", F.pmod(F.xxhash64("text"), "salts").cast("int").alias("salt")
    )
    return materialise(edges, "edges"), states


def _after(length) -> Column:
    """The ``length`` characters of a state's word from its position on, after the sign."""
    return F.col("text").substr(F.col("position") + 2, length)


def _moved(met: DataFrame, ways: list[tuple[Column, Column, Column]]) -> DataFrame:
    """States after the ``ways`` (lengths fit, length, characters fit) over an edge.

    Children that cannot go on are left out. All conditions are one filter right after the
    join, the cheap ones first, so Spark tests them as the join's own condition and only
    states that go on become rows.
    """
    taken, ends_at = [], []
    for fits, length, equal in ways:
        position = F.col("position") + length
        whole = position == F.length("text") - 1
        next_letter = F.when(whole, ".").otherwise(F.col("text").substr(position + 2, F.lit(1)))
        onward = F.when(F.col("ends").isNotNull(), whole).otherwise(F.col("onward").contains(next_letter))
        taken.append(F.coalesce(fits & onward & equal, F.lit(False)))
        ends_at.append(position)
    kept = ["text", "child", "salts", "ends"]
    if len(ways) == 1:
        return met.where(taken[0]).select(*kept, ends_at[0].alias("position"))
    (first, second), (a, b) = taken, ends_at
    met = met.where(first | second).select(*kept, first.alias("first"), second.alias("second"), a.alias("a"), b.alias("b"))
    both = F.when(F.col("first") & F.col("second"), F.array("a", "b")).when(F.col("first"), F.array("a")).otherwise(F.array("b"))
    return met.select(*kept, F.explode(both).alias("position"))


def _edited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge of a state's node taken with one edit: a replaced character of the label or a dropped one of the word."""
    met = states.join(edges, ["node", "salt"])
    # An edge that completes a word can only do so for a text of that length or one more.
    met = met.where(F.col("ends").isNull() | (F.length("text") - F.length("ends")).isin(0, 1))
    size, left = F.length("label"), F.length("text") - 1 - F.col("position")
    begins = _after(F.lit(1)) == F.col("first")
    tail = F.col("text").substr(F.col("position") + 3, size)  # after the next character
    # Under another first character the edit is there, and the rest must be equal.
    replaced = F.when(begins, F.levenshtein(_after(size), "label", 1) == 1).otherwise(
        F.col("text").substr(F.col("position") + 3, size - 1) == F.col("label").substr(F.lit(2), size)
    )
    # Of two words of one length only the smaller finds the other: so the label is the greater one.
    replaced = (F.col("label") > _after(size)) & replaced
    # At the end of a label that is followed exactly, the drop is left to the next node, if there is one.
    last = F.col("ends").isNotNull() | (_after(size) != F.col("label"))
    dropped = F.when(begins, last & (F.levenshtein(_after(size + 1), "label", 1) == 1)).otherwise(tail == F.col("label"))
    return _moved(met, [(left >= size, size, replaced), (left > size, size + 1, dropped)])


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge whose label goes on as the word does."""
    met = states.withColumn("first", _after(F.lit(1))).join(edges, ["node", "salt", "first"])
    size = F.length("label")
    return _moved(met, [(F.lit(True), size, _after(size) == F.col("label"))])


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: all ordered pairs of distinct ``words(word)`` that differ by one inserted, deleted or replaced code point."""
    edges, states = tries(words)
    found, level = None, 0
    while level == 0 or not states.isEmpty():
        moved = _followed(states, edges) if level else _edited(states, edges)
        level += 1
        moved = materialise(moved, f"frontier{level}")
        done = moved.where(F.col("ends").isNotNull()).select("text", "ends")
        found = done if found is None else found.unionAll(done)
        states = moved.where(F.col("ends").isNull()).select(
            "text", "position", F.col("child").alias("node"), F.pmod(F.xxhash64("text"), F.col("salts")).cast("int").alias("salt")
        )

    def plain(column: str):
        body = F.expr(f"substring({column}, 2)")
        return F.when(F.col(column).startswith("-"), F.reverse(body)).otherwise(body)

    pairs = found.select(plain("text").alias("word"), plain("ends").alias("near"))
    # A pair is found from one of its words only, by several ways: so it is told apart before it is turned.
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()
    turned = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.select(F.explode(turned).alias("p")).select("p.*")


# --- forms ----------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the last of the chain of forms. Chains have no cycles.

    Pointers are doubled, so a chain of k forms takes about log2 k joins.
    """
    links = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(
            links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 7,
    occurrences: int = 2,
    ratio: int = 10,
    every: int = 31,
) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``.

    A word's form is its near word of largest n (of these the first in code-point
    order) if that n is ``ratio`` times its own or more, else null; ``root`` follows
    forms to the last one and is the word itself without a form. ``n_near`` counts near
    words. Null, empty and blank texts give no words; repeated rows count again; a table
    without words gives an empty result.
    """
    words = materialise(vocabulary(docs, id_col, text_col, least, occurrences, every), "words")
    pairs = neighbours(words)
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    known = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    known = materialise(known, "forms")
    last = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
