"""Spelling variants, collision-counting search and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duesflow.llm import collide, spelling, trie
from duesflow.llm import queries as llm

# --- spelling variants


def corpus():
    rng = random.Random(3)
    stems = ["garden", "kitchen", "straße", "niñería", "aaaaaaaa", "abababab", "Übermut", "window"]
    texts = []
    for doc in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(stems) + rng.choice(["", "er", "ing", "s", "aa", "ab"])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abexé") + w[at:], w[:at] + rng.choice("abexé") + w[at + 1:]])
            words.append(w)
        texts.append((doc, " ".join(words)))
    return [*texts, (None, "gardening Gardening"), (1, texts[1][1]), (70, None), (71, ""), (72, "x" * 5000 + " " + "x" * 4999 + "y"),
            (73, "x" * 5000 + "-" + "x" * 4999 + "y 12 ÷÷÷÷÷÷÷")]


def words_by_hand(rows, least_count=2):
    met = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                met[run] += 1
    return {w: n for w, n in met.items() if n >= least_count}


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants_by_hand(words):
    near = defaultdict(list)
    for a, b in itertools.permutations(words, 2):
        if distance_is_one(a, b):
            near[a].append(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("group", [spelling.GROUP, 4])
def test_variants_equal_brute_force(spark, group):
    """Also where nearly all groups are crowded and dealt anew."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    words = spelling.count_words(docs)
    want = words_by_hand(rows)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 150
    got = spelling.variant_groups(words, group=group)
    assert rows_of(got, *VARIANT) == variants_by_hand(want) and got.count() == len(want)


def test_forms_are_followed_to_the_root(spark):
    words = {"abcdefgh": 1000, "abcdefgx": 100, "abcdefyx": 10, "abcdezyx": 1, "qqqqqqqq": 10, "qqqqqqqw": 100, "qqqqqqqe": 100}
    got = rows_of(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")), *VARIANT)
    assert got == variants_by_hand(words)
    assert ("abcdezyx", "abcdefyx", "abcdefgh", 1, 1, 10) in got and ("qqqqqqqq", "qqqqqqqe", "qqqqqqqe", 10, 2, 100) in got


def test_variants_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.count_words(none).isEmpty() and spelling.variant_groups(spelling.count_words(none)).isEmpty()
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3")], "doc_id long, text string")
    assert spelling.variant_groups(spelling.count_words(blank)).isEmpty()


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        cost = [rng.randrange(1, 9) for _ in places]
        pairs = [(a + b, [p, q]) for (p, a), (q, b) in itertools.combinations(zip(places, cost, strict=True), 2) if q - p >= 2]
        got = spelling.choose_pivots(places, cost)
        price = dict(zip(places, cost, strict=True))
        assert got[1] - got[0] >= 2 and price[got[0]] + price[got[1]] == min(pairs)[0]


# --- collision-counting search


def recall(got, data, every, k):
    """Share of the true k best of every query that came out; checks order, scores and that own rows are missing."""
    by_query, hit, total = defaultdict(list), 0, 0
    for r in got:
        by_query[r.query_id].append(r)
    asked = sorted({i for i, _ in data if i % every == 0})
    for q in asked:
        query = min(list(v) for i, v in data if i == q)
        scored = sorted(((-float(np.cumsum(np.array(v) * np.array(query))[-1]), i) for i, v in data if i != q))
        rows = sorted(by_query[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, min(k, len(scored)) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        known = Counter((s, i) for s, i in scored)
        assert not Counter((-r.score, r.vec_id) for r in rows) - known
        hit += sum((Counter(scored[:k]) & Counter((-r.score, r.vec_id) for r in rows)).values())
        total += len(scored[:k])
    return hit / max(1, total)


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, size=(3000, 1))
    x[100:900] = x[100]  # copies: a third of the rows
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(7)
    got = collide.nearest_by_collisions(df).collect()
    data = [(i, np.asarray(v, np.float64)) for i, v in enumerate(x)]
    assert len(got) == 150 * 20 and recall(got, data, 20, 20) >= 0.97
    again = collide.nearest_by_collisions(df).collect()
    assert sorted(again) == sorted(got)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []),
            (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (40, [2.0]), (9, [3.0]), (60, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collide.nearest_by_collisions(df)
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 8, 1.0), (0, 4, 7, -1.0), (40, 1, 9, 6.0)]
    assert collide.nearest_by_collisions(df.where("false")).columns == got.columns and collide.nearest_by_collisions(df.where("false")).isEmpty()


def test_query_reaches_the_recall(spark):
    got = llm.op12_collision_search(spark, "/root/testdata/sf0.001").collect()
    data = [(r.vec_id, np.asarray(r.embedding, np.float64)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert recall(got, data, 20, 20) >= 0.9


# --- conversation trie


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        held = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += held
            leaves[p[:d]] += not kids[p]
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()}


def talk():
    rng = random.Random(11)
    rows = []
    for conv in range(160):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b  c", "", None, "x"])))
    rows += [(200, t, "user", f"long {t}") for t in range(900)]
    rows += [(c, t, "user", f"long {t}") for c in range(201, 209) for t in range(300 + c)]
    return [*rows, (None, 1, "user", "lost"), (300, None, "b", "2"), (300, None, "a", "1"), (300, 0, "c", "3"), (300, 0, "c", "3"),
            (301, 5, "user", "only"), (302, -4, "user", "only")]


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("small", [trie.SMALL, 40, 3])
def test_trie_equals_brute_force(spark, small):
    """Whole components in one task, and split by joins down to a few nodes; chains are deep."""
    rows = talk()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(6)
    placed, lengths = llm.rebuilt_conversations(df)
    got = trie.prefix_trie(placed, lengths, small=small)
    assert got.count() == got.select("conv_id", "depth").distinct().count()
    assert rows_of(got, *TRIE) == trie_by_hand(rows)


def test_trie_of_few_rows(spark):
    shape = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], shape)
    assert trie.prefix_trie(*llm.rebuilt_conversations(empty)).isEmpty()
    rows = [(c, None, None, None) for c in (1, 2, 3, 45, 46)]  # some are rebuilt without a turn
    got = trie.prefix_trie(*llm.rebuilt_conversations(spark.createDataFrame(rows, shape)))
    assert rows_of(got, *TRIE) == trie_by_hand(rows)


def test_split_components_in_arrays():
    rng = np.random.default_rng(4)
    for shape in ("chain", "star", "random"):
        n = 200
        parent = np.array([max(0, i - 1) if shape == "chain" else 0 if shape == "star" else rng.integers(0, max(1, i)) for i in range(n)])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        value, own = rng.integers(0, 9, size=(n, 2)), rng.integers(1, 5, size=n)
        weight, sums = own.copy(), value.copy()
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            sums[parent[i]] += sums[i]
        shuffled = rng.permutation(n)
        got = trie.split_components(*(a[shuffled] for a in (np.arange(n), depth, parent, np.zeros(n, np.int64), np.zeros(n, np.int64), weight)),
                                    np.zeros((n, 2), np.int64), value[shuffled])
        assert (got == sums[shuffled]).all()


def test_queries_are_registered(spark):
    root = "/root/testdata/sf0.001"
    words = llm.op11_spelling_variants(spark, root)
    assert words.columns == list(VARIANT) and words.where(F.col("form_n") < 10 * F.col("n")).isEmpty()
    assert llm.op13_prefix_trie(spark, root).columns == list(TRIE)
