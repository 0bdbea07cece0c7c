"""Operators on documents against brute force, with null, empty, tied and repeated rows."""

import base64
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ordscope.llm import bpe, exact_dedup, mixing, pii, quality, simhash, spotsigs, suffix_tree
from ordscope.llm.common import ASCII_LOWER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# Columns with the names the operators use themselves.
EXTRA = ["content", "digest", "salt", "key", "size", "bucket", "block", "fp", "n", "label", "score", "at", "x y", "__digest"]


def frame(spark, rows, schema="doc_id bigint, text string, source string"):
    df = spark.createDataFrame(rows, schema)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    return df


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "und", "Haus", "être", "x" * 30, "123", "a.b", "%%%", "naïve", "\x1cz", " q"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(n - 12)]
    texts += [texts[0], texts[0].upper(), texts[1] + "\t", None, "", "  \n ", None, "word", "WORD", "a" * 5000, "ß", texts[2]]
    return [(i, t, rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]


ROWS = [*corpus(), (None, "lonely text without id", "s1"), (None, None, None), (3, "again three", "s2"), (3, "again three", "s2")]


def words_of(text):
    return WORDS.findall((text or "").translate(ASCII_LOWER))


# --- exact dedup ----------------------------------------------------------------------


def test_exact_dedup_matches_brute_force(spark):
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[(t or "").translate(ASCII_LOWER)].append(d)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(frame(spark, ROWS), salts=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want


def test_drop_copies_keeps_columns_and_one_row_per_text(spark):
    docs = frame(spark, [r for r in ROWS if r[0] != 3])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(ASCII_LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(ASCII_LOWER) for d, t, _ in ROWS if d != 3})


def test_exact_dedup_of_a_hot_group_and_of_nothing(spark):
    docs = frame(spark, [(i, "Copy" if i % 2 else "copy", "s") for i in range(500)])
    got = exact_dedup.exact_dedup(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(499, 500)} and sum(r.kept for r in got) == 1
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# --- personal data -----------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def valid(kind, match):
        digits = re.sub(r"\D", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in BASE.items()}


def test_detectors_equal_the_plain_patterns():
    rng = random.Random(0)
    for _ in range(8000):
        text = "".join(rng.choice("ab1.@+- (0290%_4") for _ in range(rng.randint(0, 45)))
        assert pii.detect(text) == plain_spans(text), text


def test_detectors_are_linear_on_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "@" * 100_000, "+1" * 100_000, "a." * 100_000 + "@"):
        assert set(pii.detect(text)) == set(pii.KINDS)


@pytest.mark.parametrize(
    ("text", "kind", "hidden", "value"),
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com", "john.doe@example.com"),
        ("x john.doe [at] exаmple [dot] com y", "email", "john.doe [at] exаmple [dot] com", "john.doe@example.com"),
        ("j​ohn(at)example.com", "email", "j​ohn(at)example.com", "john@example.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("x user_at_example_dot_com y", "email", "user_at_example_dot_com", "user@example.com"),
        ("x user&#64;example&#46;com y", "email", "user&#64;example&#46;com", "user@example.com"),
        ("ring plus one four one four five five five seven one three four end", "phone",
         "plus one four one four five five five seven one three four", "+14145557134"),
        ("vier sieben vier neun sechs zwei sieben acht fünf vier neun neun null null sechs vier", "card",
         "vier sieben vier neun sechs zwei sieben acht fünf vier neun neun null null sechs vier", "4749627854990064"),
        ("at one nine two dot one six eight dot one dot two.", "ip", "one nine two dot one six eight dot one dot two", "192.168.1.2"),
    ],
)
def test_disguises_map_back_to_source_characters(text, kind, hidden, value):
    found = [(k, text[s:e], v) for k, s, e, plain, v in pii.all_spans(text) if not plain]
    assert found == [(kind, hidden, value)]


@pytest.mark.parametrize(
    ("hidden", "kind", "value"),
    [
        ("192[.]168[.]1[.]1", "ip", "192.168.1.1"),
        ("192(.)168(.)1(.)1", "ip", "192.168.1.1"),
        ("192&period;168&period;1&period;1", "ip", "192.168.1.1"),
        ("192.168.1O1.5", "ip", "192.168.101.5"),
        ("192.168.one.two", "ip", "192.168.1.2"),
        ("192.168.1.two", "ip", "192.168.1.2"),
        ("user [arroba] ejemplo.es", "email", "user@ejemplo.es"),
        ("user (arobase) exemple.fr", "email", "user@exemple.fr"),
        ("user [ät] beispiel.de", "email", "user@beispiel.de"),
        ("user at example[.]com", "email", "user@example.com"),
        ("plus 1 (415) 555-2671", "phone", "+1 (415) 555-2671"),
        ("+1 415 555 267one", None, None),
        ("+1 415 555 26 seven one", "phone", "+1 415 555 26 71"),
        ("4749 6278 5499 oh oh six four", "card", "4749 6278 5499 0064"),
    ],
)
def test_a_disguise_alone_in_a_short_text(hidden, kind, value):
    """Nothing else in the text hints at a disguise."""
    found = [(k, s, e, v) for k, s, e, plain, v in pii.all_spans(hidden) if not plain]
    assert (kind is None and not found) or (kind, 0, len(hidden), value) in found


def test_prose_has_no_spans():
    for text in ("meet me at example.com at dot com", "un deux trois le plus un", "look at the dot on that point", "é" * 50, ""):
        assert pii.all_spans(text) == []


def test_rewriting_back_is_the_identity_without_edits_inside():
    text = "ab one two cd three ef"
    step = pii.Rewriting(text, pii.spelled_digits(text))
    assert step.text == "ab 12 cd 3 ef"
    for word in ("ab", "cd", "ef"):
        at = step.text.index(word)
        assert text[slice(*step.back(at, at + 2))] == word
    assert text[slice(*step.back(3, 5))] == "one two"


def test_find_pii_rows(spark):
    rows = [(1, "a@b.de 4749627854990064", None), (None, None, None), (2, "", "s"), (1, "a@b.de 4749627854990064", None)]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert pii.find_pii(frame(spark, [])).count() == 0


# --- BPE ----------------------------------------------------------------------------------


def encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_merge_equals_the_public_library():
    library, ranks = encoding()
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdeteréßñ  \n\t!'s1２ \x1c\x85 " + chr(rng.randint(1, 0x2FFF))) for _ in range(rng.randint(0, 300)))
        own = [i for w in bpe._splitter().findall(text) for i in bpe.merge(w.encode("utf-8"), ranks)]
        assert own == library.encode_ordinary(text)
    for piece in (b"a" * 3000, b"the" * 1000, bytes(rng.choice(b"etaoin!") for _ in range(2000))):
        assert bpe._merge_long(piece, ranks) == library._encode_single_piece(piece) == bpe.merge(piece, ranks)


def test_encode_and_decode_rows(spark):
    library, _ = encoding()
    want = Counter()
    for d, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want[(d, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode())] += 1
    # Tiny blocks, so that documents of one task meet answers of many lists.
    got = bpe.decode(bpe.encode(frame(spark, ROWS), block_chars=300, buckets=5)).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.text)) for r in got) == want
    assert bpe.encode(frame(spark, [])).count() == 0
    assert bytes(bpe.encode(frame(spark, [(1, None, None)])).first().ids) == b""


# --- mixing ---------------------------------------------------------------------------------


def water_fill(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while open_ := [s for s in order if s not in full]:
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not more:
            break
        full |= more
    return {s: most * sizes[s] if s in full else level * weight[s] for s in order}


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 20_000]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 50)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = water_fill(sizes)
        assert {r.source for r in got} == set(sizes)
        assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in got)


def test_swap_or_not_is_a_permutation(spark):
    for n in (1, 2, 7, 1000):
        out = spark.range(n).select(mixing.swap_or_not(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in out) == list(range(n))
    assert [r.x for r in out] != list(range(n))


def test_mix_meets_its_targets_and_bounds(spark):
    docs = frame(spark, [*ROWS, (99, "w " * 900, "s2")])
    mixed = mixing.mix(docs, block_words=16, shard_slots=5, per_chunk=8)
    got = mixing.taken_words(mixed).collect()
    sizes = defaultdict(int)
    for _, t, s in [*ROWS, (99, "w " * 900, "s2")]:
        sizes[s] += len(WORDS.findall(t or ""))
    want = water_fill(dict(sizes))
    by_source = defaultdict(int)
    assert len(got) == len(ROWS) + 1
    source_of = {round(want[s], 6): s for s in want}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_source[source_of[round(r.target, 6)]] += r.taken
    assert all(abs(by_source[s] - want[s]) <= 0.5 for s in want)
    again = mixing.taken_words(mixing.mix(docs.repartition(7), block_words=16, shard_slots=5, per_chunk=8)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_texts_are_the_taken_words(spark):
    docs = frame(spark, [*ROWS, (99, "  one two\n three " * 50, "s2")])
    mixed = mixing.mix(docs, block_words=16, shard_slots=5, per_chunk=8)
    out = mixing.mixed_documents(docs, mixed)
    assert out.columns == docs.columns
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += len(WORDS.findall(r.text))
    want = Counter()
    for r in mixing.taken_words(mixed).collect():
        want[r.doc_id] += r.taken
    assert taken == +want
    # A document that both passes take whole gives its text twice.
    whole = mixed.segments.where("doc_id = 99").orderBy("pass", "first_word").collect()
    assert sum(s.n_words for s in whole) == want[99]


def test_mix_of_nothing(spark):
    for rows in ([], [(1, None, "s"), (2, "  ", None)]):
        docs = frame(spark, rows)
        mixed = mixing.mix(docs)
        assert mixed.segments.count() == 0
        assert mixing.taken_words(mixed).count() == len(rows)
        assert mixing.mixed_documents(docs, mixed).count() == 0


# --- quality ----------------------------------------------------------------------------------


def quality_rows(n=300):
    rng = random.Random(4)
    good = ["the", "house", "stands", "on", "a", "hill", "near", "water", "and", "trees"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(good) + (rng.choice(["%%%", "$$$"]) if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_classifier_generalises_to_held_out_rows(spark):
    rows, labels = quality_rows()
    extra = [(1000, None, None), (1001, "", None), (None, "the house", None), (None, None, None)]
    marks = spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id bigint, quality int").withColumn("text", F.lit("x"))
    got = quality.classify(frame(spark, [*rows, *extra]), marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_classifier_ignores_held_out_labels(spark):
    rows, labels = quality_rows(120)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q) for d, q in labels]
    a, b = (
        {r.doc_id: r.score for r in quality.classify(frame(spark, rows), spark.createDataFrame(x, "doc_id bigint, quality int")).collect()}
        for x in (labels, turned)
    )
    assert a == pytest.approx(b)


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.classify(frame(spark, [(1, "a b", None)]), none).collect()] == [0.5]
    assert quality.classify(frame(spark, []), none).count() == 0


def test_training_rows_stay_out_of_the_driver(spark):
    """The sample and the counts are fitted in a task; the driver's Python gets the model."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'%' * (i % 2)}{rng.getrandbits(40):x}" for _ in range(1500)), "s") for i in range(500)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id bigint, quality int")
    quality.train(docs.limit(9), labels, bits=16)  # what is imported and kept from now on does not count
    tracemalloc.start()
    model = quality.train(docs, labels, bits=16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and peak < 3e6, peak  # 500 vectors of over 2 000 slots: 4 MB and more


def test_drop_rejected_keeps_columns(spark):
    rows, labels = quality_rows(120)
    docs = frame(spark, rows)
    kept = quality.drop_rejected(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, q in labels if q}


# --- SimHash -----------------------------------------------------------------------------------


def simhash_of(text):
    w = words_of(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """Smallest member per connected component, by brute force."""
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_near_duplicates_match_brute_force(spark):
    prints = [(d, simhash_of(t)) for d, t, _ in ROWS]
    component = classes({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for d, f in prints:
        if d is not None:
            smallest[component[f]] = min(d, smallest.get(component[f], d))
    want = Counter((d, f, smallest.get(component[f])) for d, f in prints)
    got = simhash.near_duplicates(frame(spark, ROWS)).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_crowded_shards(spark):
    """Chains within the radius, with shards larger than a tree may be."""
    rng = random.Random(5)
    values, v = set(), rng.getrandbits(64)
    for _ in range(300):
        values.add(v)
        for bit in rng.sample(range(64), rng.choice([1, 4, 5])):
            v ^= 1 << bit
        if rng.random() < 0.1:
            v = rng.getrandbits(64)
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp bigint")
    for rows in (3, 4096):
        links = simhash.near_links(df, shard_rows=rows)
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        found = {(min(p), max(p)) for p in pairs}
        assert classes(values, lambda a, b, f=found: (a, b) in f) == want
        grouped = {r.node & (1 << 64) - 1: r.component for r in simhash.components(links).collect()}
        assert len(set(grouped.values())) == len({want[x] for x in grouped})


def test_tree_search_equals_a_scan():
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.within(v, 4)) == sorted({w for w in values if (v ^ w).bit_count() <= 4})


def test_drop_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = frame(spark, [(5, base, "s"), (6, base + " tail", "s"), (7, "something else " * 20, "s"), (None, base, "s")])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {5, 7, None}


# --- SpotSigs -------------------------------------------------------------------------------------


def as_set(text):
    return set(spotsigs.signatures(text).tolist())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_likeness_matches_brute_force(spark):
    rows = [r for r in ROWS if r[0] is not None]
    ordered = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0], r[1]))
    want = Counter()
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        want[(d, len(t), edited, likeness(as_set(t), as_set(edited)), likeness(as_set(t), as_set(n)))] += 1
    got = spotsigs.edited_likeness(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited, r.near_edited, r.near_next) for r in got) == want
    prints = defaultdict(set)
    for r, (_, t) in zip(sorted(got, key=lambda r: (r.doc_id, r.n_chars)), ordered):
        prints[t].add(r.fingerprint)
    assert spotsigs.edited_likeness(frame(spark, [])).count() == 0
    alone = spotsigs.edited_likeness(frame(spark, [(1, "the old house", "s")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(1, 1.0)]


def test_null_ids_come_last(spark):
    rows = [(None, "omega the last word", None), (2, "beta has the second", None), (1, "alpha is the first", None)]
    got = {r.doc_id: r.edited for r in spotsigs.edited_likeness(frame(spark, rows)).collect()}
    assert got[2].endswith("omega the last word"[: len("beta has the second") // 4])
    assert got[None].endswith("alpha is the first"[: len("omega the last word") // 4])


def test_only_texts_without_words_lack_signatures():
    for text in ("x", "the", "Erberte " * 30, "%%% a"):
        assert len(spotsigs.signatures(text))
    assert not len(spotsigs.signatures(" \n %%%"))


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(7)
    sets = []
    for _ in range(60):
        items = {rng.randint(0, 400) for _ in range(rng.randint(1, 30))}
        sets += [items, items | {rng.randint(0, 400)}, {*list(items)[1:], 999}]
    texts = sorted({"".join(f"{i:08x}" for i in sorted(s)) for s in sets})
    as_sets = [{t[i : i + 8] for i in range(0, len(t), 8)} for t in texts]
    want = {
        (texts[i], texts[j])
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j]) - 1e-12
    }
    got = spotsigs.similar(spark.createDataFrame([(t,) for t in [*texts, "", *texts[:3]]], "fingerprint string"), 0.8).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert spotsigs.similar(spark.createDataFrame([], "fingerprint string")).count() == 0


# --- suffix tree -------------------------------------------------------------------------------------


def tree_scores(rows, depth=2, least=2, threshold=2.0):
    texts = [(d, [*words_of(t), None]) for d, t, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in texts]
    counts, follow = Counter(), [None] + [defaultdict(Counter) for _ in range(depth)]
    for (_, w), h in zip(texts, held):
        if not h:
            counts.update(w)
            for k in range(1, depth + 1):
                for i in range(k, len(w)):
                    follow[k][tuple(w[i - k : i])][w[i]] += 1
    total, distinct = sum(counts.values()), len(counts)
    states = [None] + [{} for _ in range(depth)]

    def p(word, before, longest):
        out = (counts[word] + 0.5) / (total + 0.5 * (distinct + 1))
        for k in range(1, min(longest, len(before)) + 1):
            s = tuple(before[len(before) - k :])
            if states[k].get(s):
                c = follow[k][s]
                out = (c[word] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    for k in range(1, depth + 1):
        for s, c in follow[k].items():
            n = sum(c.values())
            gain = 0.0
            for word, m in c.items():
                up, others = p(word, s, k - 1), len(c) - (m == 1)
                below = n - 1 + others
                gain += m * (math.log((m - 1 + others * up) / below if below else up) - math.log(up))
            states[k][s] = n >= least and gain > threshold
    out = []
    for (d, w), h in zip(texts, held):
        base = sum(math.log10(p(x, [], 0)) for x in w)
        score = sum(math.log10(p(x, w[:i], depth)) for i, x in enumerate(w))
        out.append((d, h, len(w), sum(counts[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("share", [1024, 1, 8])
def test_suffix_tree_matches_brute_force(spark, share):
    """With most contexts, some contexts and few contexts dealt as hot ones."""
    got = suffix_tree.score_documents(frame(spark, ROWS), block_chars=400, hot_share=share).collect()
    want = tree_scores(ROWS)
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(rows, key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert a[6] == pytest.approx(b[6], rel=1e-6)


def test_sorting_keys_with_their_places():
    """As NumPy's unique, also for keys that leave no room for a place; hashes of a bucket lie together."""
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 50, 400), rng.integers(0, 1 << 62, 300).repeat(2), np.zeros(0, np.int64), np.array([3])):
        for got, want in zip(suffix_tree._distinct(keys), np.unique(keys, return_index=True, return_inverse=True)):
            assert np.array_equal(got, want)
    hashes = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    order = suffix_tree._hash_order(hashes)
    assert np.array_equal(np.sort(order), np.arange(5000))
    assert (np.diff(suffix_tree.bucket_of(hashes[order], 1000)) >= 0).all()


def test_suffix_tree_block_in_little_memory(monkeypatch):
    """A block of many words takes a bounded number of bytes a word in its worker, in every step up to its first state."""
    monkeypatch.setattr(suffix_tree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    drawn = np.random.default_rng(5).zipf(1.2, 200_000) % 20_000
    rows = [(i, " ".join(f"w{x}" for x in part)) for i, part in enumerate(np.split(drawn, 500))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "text"])
    (block,) = suffix_tree._to_blocks(8_000_000, 5, 1)(iter([batch]))
    model = suffix_tree.Model(8, 2, 2, 2.0, 1, hot_types=[{}] * 3, hot_kept=[set()] * 3)
    model.tokens = block.column("n_trained")[0].as_py()
    left, lists = pa.Table.from_batches([block]), list(suffix_tree._first_lists(8)(iter([block])))
    answers, peaks = [], []
    for length in (1, 2, None):
        for lists_batch in lists:
            ordered = lists_batch.sort_by([("hot", "ascending"), ("bucket", "ascending")])
            answers += [b.filter(b.column("block").is_valid()) for b in suffix_tree._answers(model)(iter([ordered]))]
        right = pa.Table.from_batches(answers)
        tracemalloc.start()
        done = suffix_tree._steps(model, length)(left, right) if length else suffix_tree._survivors(model, True)(left, right)
        peaks.append(tracemalloc.get_traced_memory()[1] / (len(drawn) + len(rows)))
        tracemalloc.stop()
        lists = done.to_batches()
    assert max(peaks) < 90, peaks


def test_suffix_tree_of_little(spark):
    assert suffix_tree.score_documents(frame(spark, [])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = suffix_tree.score_documents(frame(spark, [(held, "a b", None)])).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def longer_scores(rows, depth=2, least=2, threshold=2.0):
    """All contexts of up to ``depth`` words and those of any length whose parent is retained; also the longest length retained."""
    texts = [(d, [*words_of(t), None]) for d, t, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in texts]
    trained = [w for (_, w), h in zip(texts, held) if not h]
    counts = Counter(x for w in trained for x in w)
    total, states = sum(counts.values()), {}

    def p(word, before):
        out, k = (counts[word] + 0.5) / (total + 0.5 * (len(counts) + 1)), 0
        for k in range(1, len(before) + 1):
            s = tuple(before[len(before) - k :])
            if s in states:
                c = states[s]
                out = (c[word] + len(c) * out) / (sum(c.values()) + len(c))
            elif k > depth:
                break
        return out

    k, deepest = 1, 0
    while k <= depth or deepest == k - 1:
        follow = defaultdict(Counter)
        for w in trained:
            for i in range(k, len(w)):
                if k <= depth or tuple(w[i - k + 1 : i]) in states:
                    follow[tuple(w[i - k : i])][w[i]] += 1
        new = {}
        for s, c in follow.items():
            n, gain = sum(c.values()), 0.0
            for word, m in c.items():
                up, others = p(word, s), len(c) - (m == 1)
                below = n - 1 + others
                gain += m * (math.log((m - 1 + others * up) / below if below else up) - math.log(up))
            if n >= least and gain > threshold:
                new[s] = c
        states |= new
        deepest = k if new else deepest
        k += 1
    return [(d, sum(math.log10(p(x, w[:i])) for i, x in enumerate(w))) for d, w in texts], deepest


@pytest.mark.parametrize("share", [1024, 1])
def test_suffix_tree_of_longer_contexts(spark, share):
    """Each of the four words before a word halves what it can be; two words of context leave four choices."""
    rng, rows = random.Random(8), []
    for i in range(100):
        bits = [[rng.randrange(2) for _ in range(4)] for _ in range(10)]
        rows.append((i, " ".join(" ".join([*(f"{'pqrt'[j]}{x}" for j, x in enumerate(b)), f"n{b}".replace(" ", "")]) for b in bits), None))
    want, deepest = longer_scores(rows)
    assert deepest >= 4
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(frame(spark, rows), block_chars=700, hot_share=share, longer=True).collect()}
    short = {r.doc_id: r.score for r in suffix_tree.score_documents(frame(spark, rows), block_chars=700, hot_share=share).collect()}
    for d, score in want:
        assert got[d] == pytest.approx(score, rel=1e-6)
        assert got[d] > short[d] + 1


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (2, "b", None), (3, "A", "s"), (3, "a", "t"), (4, "long " * 40_000, "s"), (4, "long " * 40_000, "s")]
    rows += [(None, "x", "s"), (None, "X", "s"), (None, "b", "s"), (5, None, None), (5, "", "s")]
    got = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert Counter((r.doc_id, (r.text or "")[:4].lower()) for r in got) == Counter([(2, "b"), (3, "a"), (4, "long"), (None, "x"), (5, "")])
    assert all(r.content == "clash" for r in got) and exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_hinge_fit_minimises_the_dual():
    """Against projected gradient steps on the dense dual, with rows that stand for several."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(30)]
    labels, times, ratios = rng.integers(0, 2, 30), rng.integers(1, 4, 30).astype(float), rng.normal(size=12)
    x = np.zeros((30, 13))
    for i, s in enumerate(rows):
        x[i, s] = ratios[s] / np.sqrt(len(s))
    x[:, 12] = 1.0
    signed = x * np.where(labels > 0, 1.0, -1.0)[:, None]
    up = times[labels > 0].sum() / times.sum()
    bound = times * 0.5 / np.where(labels > 0, up, 1 - up)
    gram, alpha = signed @ signed.T, np.zeros(30)
    for _ in range(200_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, bound)
    want = 0.5 * alpha @ gram @ alpha - alpha.sum()
    weights, bias = quality.fit_hinge(rows, ratios, labels, times, passes=3000)
    full = np.append(weights, bias)
    primal = 0.5 * full @ full + (bound * np.maximum(0, 1 - signed @ full)).sum()
    assert primal == pytest.approx(-want, rel=1e-2)
    doubled = [i for i in range(30) for _ in range(int(times[i]))]
    again, other = quality.fit_hinge([rows[i] for i in doubled], ratios, labels[doubled], passes=3000)
    assert np.allclose(again, weights, atol=2e-2) and other == pytest.approx(bias, abs=2e-2)


def test_quality_sample_with_one_row_repeated(spark):
    """A third of the labelled rows are one row; it is one row of the sample."""
    rows = [(i, f"good words number {i} here" if i % 2 else f"@@ ## {i} !!", None) for i in range(60)] + [(1, "good words number 1 here", None)] * 40
    labels = [(i, i % 2) for i in range(60)]
    model = quality.train(frame(spark, rows), frame(spark, labels, "doc_id bigint, quality int"), fit_rows=30)
    assert model.score(quality.features("good words number 99 here")) > 0.5 > model.score(quality.features("@@ ## 99 !!"))
    small = quality.train(frame(spark, rows), frame(spark, labels, "doc_id bigint, quality int"), fit_bytes=1)
    assert small.slope == 1.0 and not small.weights.any()
