"""Lexical search, spelling variants and the n-gram join against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordscope.llm import jaccard, lexical, packing, spelling
from ordscope.llm.common import batch_of
from ordscope.llm.common import ASCII_LOWER

EXTRA = ["word", "near", "node", "block", "digest", "n", "score", "query", "rank", "component", "token", "x y", "__text"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id bigint, text string"):
    df = spark.createDataFrame(rows, schema)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- lexical search ---------------------------------------------------------------------------


def ranked(docs, items, top=50):
    """All scores in Python integers."""
    split = lambda t: TERM.findall((t or "").translate(ASCII_LOWER))
    bags = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for (d, bag), size in zip(bags, sizes):
            if d is None:
                continue
            score = 0
            for t in set(split(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * size * n) // length
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÄPFEL", "naïve", "a1b2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("shape", [{"shard_docs": 7, "block_docs": 2, "terms_at_once": 12}, {"shard_docs": 64, "block_docs": 8}])
def test_search_matches_brute_force(spark, shape):
    rows = list(enumerate(texts(150, 1)))
    rows += [(200, None), (201, ""), (202, "?!, -"), (None, rows[3][1]), (203, rows[5][1]), (204, rows[5][1].upper()), (7, "w1 w2"), (7, "w1 w2")]
    rows += [(205, "w3 " * 60_000), (206, "ÄPFEL äpfel")]
    items = [(i, t) for i, t in enumerate(texts(6, 2))] + [(50, None), (51, "nothing matches this"), (52, "w0"), (0, texts(6, 2)[0]), (53, "ÄPFEL w40")]
    for top in (50, 5):
        got = lexical.search(frame(spark, rows), frame(spark, items, "item_id bigint, text string"), top=top, **shape).collect()
        assert Counter(map(tuple, got)) == ranked(rows, items, top)


def test_search_of_little(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    # Of one document with all terms the weights are those of a term that every document has.
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == ranked([(1, "a")], [(1, "a b")])


def test_blocks_hold_alike_documents_and_all_of_them():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 32))
    vectors = centres[rng.integers(0, 4, 100)] + rng.normal(size=(100, 32)) / 20
    order, starts = lexical.geometric_blocks(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 8)
    assert sorted(order.tolist()) == list(range(100)) and starts[0] == 0
    assert np.diff(starts, append=100).max() <= 8 and np.diff(starts, append=100).min() >= 1


def test_seeds_skip_blocks_and_nothing_that_counts(spark):
    """The seed is a score that the result reaches: so the last one ranked is no lower."""
    rows = list(enumerate(texts(400, 3)))
    docs, items = frame(spark, rows), spark.createDataFrame([(1, "w5 w20 w41"), (2, "w0 w1")], "item_id bigint, text string")
    (group,) = lexical.query_groups(items, "item_id", "text", 100)
    slim = docs.select("doc_id", "text")
    shards = slim.mapInArrow(lexical._to_shards(group.terms, 50), lexical._SHARD_TYPE).cache()
    lexical.weigh(group, shards)
    lexical.seed(group, shards, 10)
    want = ranked(rows, [(1, "w5 w20 w41"), (2, "w0 w1")], 10)
    for q, item in enumerate(group.ids):
        last = min(s for i, _, _, s in want if i == item)
        assert 1 < group.seeds[q] <= last


# --- spelling variants -------------------------------------------------------------------------


def variants(rows, least=7):
    runs = re.compile("[A-Za-zÀ-ÿ]+")
    n = Counter()
    for d, t in rows:
        for run in runs.findall(t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, counts = {}, Counter()
    for w in n:
        close = [v for v in n if near(w, v)]
        counts[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            forms[w] = best
    out = set()
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, n[w], counts[w], forms.get(w), n[forms[w]] if w in forms else None, root))
    return out


def test_variants_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abñé") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "baaaaaaa", "abababab", "bababab", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]

    def edited(w):
        i, k = rng.randrange(len(w)), rng.random()
        return w[:i] + (rng.choice("abñéz") if k < 0.7 else "") + w[i + (k < 0.4) :]

    words = [w for w in base for _ in range(rng.choice([2, 2, 30, 400]) if len(w) < 100 else 2)]
    words += [edited(w) for w in base for _ in range(6) if len(w) < 100] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, "aaaaaaa " * 3), (900, None), (901, ""), (902, "1234567 ___ ŸŸŸŸŸŸŸŸ"), (3, rows[3][1]), (3, rows[3][1]), (903, "AAAAAAA,ÀÀÀÀÀÀÀ;ÀÀÀÀÀÀÀ àààààààà ààààààà ààààààà")]
    got = spelling.group_variants(frame(spark, rows)).collect()
    assert len(got) == len({r.word for r in got})
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == variants(rows)
    assert any(r.form for r in got) and any(r.root != r.form for r in got if r.form)


def test_variants_of_little(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id bigint, text string")).count() == 0


# --- n-gram join -------------------------------------------------------------------------------


def joined(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    named = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return Counter((d, len(sets[i]), d if not sets[i] else named[find(i)]) for i, (d, _) in enumerate(rows))


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    passage = [word() for _ in range(12)]
    docs = []
    for size in (1, 3, 4, 5, 6, 8, 20, 40, 60, 90, 120):
        first = [word() for _ in range(size)]
        docs.append(first)
        for _ in range(6):
            copy = list(rng.choice(docs[-6:]) if rng.random() < 0.5 else first)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy + [word() for _ in range(rng.randint(0, 2))])
        docs.append(first[: size // 2] + passage + first[size // 2 :])
    texts = [" ".join(d) for d in docs]
    texts += [texts[0], texts[9].upper(), texts[20] + "\n\t", "", " \r\n ", None, None, "one", "ONE", "\x1cone"]
    return [(i * 3 % 101 + 5, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "alone without an id"), (5, texts[30]), (5, texts[30])]


@pytest.mark.parametrize("seed, piece", [(1, 2048), (2, 3)])
def test_join_matches_brute_force(spark, seed, piece, monkeypatch):
    """Also with posting lists cut into pieces of three."""
    monkeypatch.setattr(jaccard, "_PIECE", piece)
    rows = near_rows(seed)
    got = jaccard.near_documents(frame(spark, rows), block_chars=3000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == joined(rows)


def test_join_at_the_threshold(spark):
    """Of 104 shingles in all 83 or 84 shared: 79.8 and 80.8 per cent."""
    base = [f"t{i}" for i in range(92)]
    rows = [(1, " ".join(base))]
    for d, k in ((2, 8), (3, 12), (4, 20), (5, 21), (6, 22), (7, 23)):
        rows.append((d, " ".join(base[:-k] + [f"n{d}{i}" for i in range(k)])))
    got = jaccard.near_documents(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == joined(rows)


def test_join_of_a_long_text_and_a_large_group(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    changed = list(long)
    for i in range(0, 60_000, 300):
        changed[i] = "x"
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, " ".join(long[:30_000]))]
    base = [f"v{i}" for i in range(100)]
    rows += [(10 + i, " ".join([*base[:50], f"own{i}", *base[50:]])) for i in range(300)]
    got = {r.doc_id: r.component_id for r in jaccard.near_documents(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, **{10 + i: 10 for i in range(300)}}


def test_join_of_little(spark):
    assert jaccard.near_documents(frame(spark, [])).count() == 0
    rows = [(1, None), (2, " "), (3, "a b")]
    got = jaccard.near_documents(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 1, 3)}


def test_prefixes_and_filters_lose_no_pair():
    """Sets that are alike share a prefix n-gram under any order, and pass every filter there."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        alike = 100 * common >= 80 * (len(a) + len(b) - common)
        firsts = [dict(zip(s.tolist(), range(jaccard.prefix_size(len(s), 80)))) for s in (a, b)]
        shared = set(firsts[0]) & set(firsts[1])
        assert shared or not alike
        sizes, ranges = np.array([len(a), len(b)]), np.array([jaccard.range_counts(a), jaccard.range_counts(b)])
        for token in shared if alike else ():
            at = np.array([firsts[0][token], firsts[1][token]])
            assert jaccard._passing(sizes, at, ranges, np.array([0]), np.array([1]), 80)[0] >= 0.8


def test_sets_that_share_too_little_of_their_prefixes_are_not_verified(spark, monkeypatch):
    """Lines of a plane of 16 points as texts: two share one passage of four at most, and all passages are equally rare."""
    rng = random.Random(11)
    points = [" ".join(f"p{rng.randrange(10**9)}" for _ in range(375)) for _ in range(16)]
    times = [[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]]  # in the field of four elements
    lines = [[4 * x + (times[m][x] ^ c) for x in range(4)] for m in range(4) for c in range(4)] + [[4 * x + y for y in range(4)] for x in range(4)]
    rows = [(i, " ".join(points[p] for p in line)) for i, line in enumerate(lines)]
    tried = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (tried.append(pairs.count()), verified(pairs, *rest))[1])
    got = jaccard.near_documents(frame(spark, [*rows, (20, rows[0][1] + " more")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(20)}, 20: 0}
    assert 1 <= sum(tried) <= 5


def test_what_prefixes_share_loses_no_pair():
    """The bound is at least the true overlap, also where a set has too many lists for a profile."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.choice(10**6, int(rng.integers(5, 80)), replace=False)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 10**6, rng.integers(0, 6))])) for _ in range(8)]
        prefixes = [s[: jaccard.prefix_size(len(s), 80)] for s in sets]
        n, total = np.array([len(s) for s in sets]), np.array([len(x) for x in prefixes])
        profiles = [None if rng.random() < 0.2 else (x.astype(np.int32), np.ones(len(x), np.int64)) for x in prefixes]
        able = jaccard._may_link(n, np.arange(8), total, profiles, 80)
        for i in range(8):
            for j in range(8):
                common = len(np.intersect1d(sets[i], sets[j]))
                assert i == j or able[i, j] or 100 * common < 80 * (n[i] + n[j] - common)


@pytest.mark.parametrize("hot", [1 << 19, 4])
def test_lists_of_a_bucket(monkeypatch, hot):
    """N-grams of the same sets are one list; a hot one is a list by itself; each keeps its members."""
    monkeypatch.setattr(jaccard, "_HOT", hot)
    held = {7: [1, 2], 8: [1, 2], 9: [2, 3], 10: [3], 11: list(range(1, 9))}
    rows = []
    for base in range(1, 9):
        tokens = [t for t, ids in held.items() if base in ids]
        rows.append((0, base, packing.pack(np.array(tokens, "<u8")), packing.pack(np.zeros(len(tokens), "<u4")), packing.pack(np.full(len(tokens), 50, "<u4"))))
    found = defaultdict(dict)
    for batch in jaccard._shared(iter([batch_of(jaccard._LISTS, rows)])):
        for r in batch.to_pylist():
            found[r["list"]][r["id"]] = r["times"]
    assert sorted(map(sorted, (x.items() for x in found.values()))) == sorted(
        [[(1, 2), (2, 2)], [(2, 1), (3, 1)], [(i, 1) for i in range(1, 9)]]
    )


def test_spent_tables_are_deleted_and_no_others(spark, tmp_path):
    import os

    mine = packing.bucketed(spark.range(5).withColumnRenamed("id", "block"), "block")
    folder = mine.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "").replace("file:", "")
    other = str(tmp_path / "other")
    spark.range(5).write.parquet(other)
    packing.forget(mine, spark.read.parquet(other))
    assert not os.path.exists(folder) and os.path.exists(other)


def test_spelling_edges_are_tested_in_the_join(spark):
    """Ways over an edge are the join's own condition, compiled; and each ordered pair comes once."""
    drawn = random.Random(6)
    words = sorted({"".join(drawn.choices("aab", k=drawn.randint(7, 9))) for _ in range(80)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    edges, states = spelling.tries(frame)
    plan = spelling._edited(states, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "levenshtein" in line for line in plan.splitlines())
    assert "lambda" not in plan
    near = lambda a, b: a != b and any(a[:i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) for i in range(len(a)))
    want = sorted((a, b) for a in words for b in words if near(a, b) or near(b, a))
    assert sorted(map(tuple, spelling.neighbours(frame).collect())) == want
