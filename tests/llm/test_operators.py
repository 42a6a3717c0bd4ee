"""The ten operators on small tables with every odd case, against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duesflow.llm import exact, knn, licences, lm, matrices, mixing, neardup, packing, toxicity, warc
from duesflow.llm.queries import tokenizer_path
from duesflow.llm.tokens import WordCoder
from duesflow.llm.util import stored_table
from duesflow.llm.words import WordHasher

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, `size` int"
RNG = random.Random(7)
WORDS = ["alpha", "Beta", "gamma", "été", "delta,", "the", "of", "x&&&", "niño", "Ünder"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(9000, 1)
ROWS = [
    (1, "a  b\tc", "s1"), (2, "a b c", "s1"), (3, None, None), (4, "", "s2"), (5, " ", "s2"), (6, " \n ", "s2"), (7, LONG, "s1"),
    (8, LONG, "s1"), (9, "a b c", None), (None, "a b c", "s3"), (2, "a b c", "s1"), (10, prose(60, 2), "s3"), (11, prose(61, 2), "s3"),
    (12, prose(60, 3), "s3"), (None, None, None), (13, "\x0b", "é")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "d", "k", 1) for i, t, s in ROWS]
    return stored_table(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- exact duplicates


def brute_groups():
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(squeeze(t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [exact.content_hash, lambda text: F.substring(exact.content_hash(text), 1, 0)])
def test_exact_groups_also_when_hashes_collide(docs, digest):
    rows = exact.exact_groups(docs, digest).collect()
    groups = brute_groups()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == Counter((i, *groups[squeeze(t)]) for i, t, _ in ROWS)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256: 1 for r in rows})


def test_exact_copies_dropped(docs, empty):
    kept = exact.drop_copies(docs)
    assert kept.schema == docs.schema
    assert Counter(squeeze(r.text) for r in kept.collect()) == Counter({t: 1 for t in brute_groups()})
    assert exact.drop_copies(empty).count() == 0 and exact.exact_groups(empty).count() == 0


# --- mixing


def test_mix_meets_targets(docs, empty):
    rows, sources, pieces = mixing.mix_sources(docs, block=16)
    totals = Counter()
    for _, t, s in ROWS:
        totals[s] += len(words_of(t))
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (1.5 * sum(totals.values()) - sum(2 * totals[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        full = {s for s in free if 2 * totals[s] < level * weight[s]}
        if not full:
            break
        free -= full
    target = {s: level * weight[s] if s in free else 2 * totals[s] for s in order}
    for r in sources.collect():
        assert r.source_size == totals[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
    taken = Counter()
    by_uid = {r.uid: r for r in rows.collect()}
    assert Counter((r.doc_id, r.source, r["size"]) for r in by_uid.values()) == Counter((i, s, len(words_of(t))) for i, t, s in ROWS)
    places = []
    for p in pieces.collect():
        taken[by_uid[p.uid].source] += p.length
        places.append((p.uid, p.walk, p.first, p.length))
        assert 0 <= p.first and p.first + p.length <= by_uid[p.uid]["size"] and p.walk in (0, 1)
    for uid, walk in {p[:2] for p in places}:
        spans = sorted(p[2:] for p in places if p[:2] == (uid, walk))
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans))
    assert all(taken[s] == round(target[s]) for s in order)
    assert mixing.mix_sources(empty)[2].count() == 0


def test_mixed_documents_hold_the_words_taken(docs):
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    _, _, pieces = mixing.mix_sources(docs, block=16)
    assert sum(len(words_of(r.text)) for r in out.collect()) == pieces.agg(F.sum("length")).first()[0]


def test_slots_follow_the_weights(spark):
    sources = spark.createDataFrame([(1, 5000), (2, 3000), (3, 2000)], "place long, quota long")
    slots = [r.place for r in mixing.schedule(sources, 10).orderBy("slot").collect()]
    assert Counter(slots) == {1: 500, 2: 300, 3: 200}
    for n in (50, 200, 700):
        first = Counter(slots[:n])
        assert all(abs(first[p] - n * w) <= 6 for p, w in ((1, 0.5), (2, 0.3), (3, 0.2)))


# --- packing


def coded(text):
    return [*np.frombuffer(WordCoder(tokenizer_path()).encode([text or ""])[0], "<u4").tolist(), 2]


def test_packing_is_lossless(docs, empty):
    rows = packing.pack_documents(docs, tokenizer_path(), length=256, open_windows=4, slack=8, merge=2).collect()
    windows = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans))
        fills.append(sum(spans[-1]))
    assert max(fills) <= 256 and sum(256 - f for f in fills) <= 256 + 8 * len(fills)
    texts = [coded(t) for _, t, _ in ROWS]
    starts = sorted(r.doc_tokens for r in rows if r.start == 0)
    assert starts == sorted(len(t) for t in texts)
    assert Counter(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()) == Counter(i for t in texts for i in t)
    seven = sorted((r.start, r.ids) for r in rows if r.doc_id == 7)
    assert np.frombuffer(b"".join(i for _, i in seven), "<u4").tolist() == coded(LONG)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_word_coder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, _ in ROWS] + ["a<|endoftext|>b <|ENDOFTEXT|>", "don't DON'T 'S", "é! €! 3! \x1c\x85 ﬁ İ", "é. ́"]
    plain, ours = Tokenizer.from_file(tokenizer_path()), WordCoder(tokenizer_path(), cache=50)
    for _ in range(2):
        for text, ids in zip(texts, ours.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# --- matrices


def test_best_fit_decreasing():
    sizes = [RNG.randrange(1, 300) for _ in range(400)] + [1000, 256, 512]
    rows = matrices.best_fit_decreasing(sizes, 256)
    assert all(sum(n for *_, n in row) <= 256 for row in rows)
    got = sorted(p for row in rows for p in row)
    for item, size in enumerate(sizes):
        spans = [(s, n) for i, s, n in got if i == item]
        assert spans[0][0] == 0 and sum(n for _, n in spans) == size and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans))
    assert len(rows) <= 1.03 * math.ceil(sum(sizes) / 256) + 1


def test_room_tree_gives_least_sufficient_room():
    tree, held = matrices.RoomTree(64), []
    for step in range(3000):
        if RNG.random() < 0.5:
            room = RNG.randrange(1, 65)
            tree.put(room, step)
            held.append(room)
        else:
            need = RNG.randrange(1, 65)
            want = min((r for r in held if r >= need), default=None)
            got = tree.take(need)
            assert (got[0] if got else None) == want
            if want is not None:
                held.remove(want)


def test_matrices_round_trip(docs, empty, tmp_path):
    shards = stored_table(matrices.write_matrices(docs, tokenizer_path(), f"file://{tmp_path}", length=128, shard_docs=4))
    rows = matrices.read_matrices(shards).collect()
    pieces = []
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 128 and r.resets == [c for c in r.cu_seqlens if c < 128]
        for doc, start, (a, b) in zip(r.doc_ids, r.starts, itertools.pairwise(r.cu_seqlens), strict=True):
            pieces.append((doc, start, ids[a:b]))
    assert Counter(i for *_, p in pieces for i in p) == Counter(i for _, t, _ in ROWS for i in [*coded(t)[:-1], 49407])
    seven = [i for _, _, p in sorted(p for p in pieces if p[0] == 7) for i in p]
    assert seven == [*coded(LONG)[:-1], 49407]
    assert matrices.read_matrices(matrices.write_matrices(empty, tokenizer_path(), f"file://{tmp_path}/e")).count() == 0


# --- archives


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 200 + "</p>"
    rows = [(4, "http://a/é b\r\n", big, 1), (2, "http://a", big, 1), (9, None, big, 1), (3, "u", None, 1), (5, "u", "", 1), (6, "u", "short", 1),
            (7, "u", "short", 1), (2, "http://a", big, 1), (None, "u", big, 1), (8, "u", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = warc.archive_pages(pages, f"file://{tmp_path}", archive_bytes=4000).collect()
    want = Counter((p, len((h or "").encode()), "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else None) for p, _, h, _ in rows)
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == want
    assert {r.url for r in out} == {u for _, u, *_ in rows}
    assert all(bytes(r.payload) == next((h or "").encode() for p, _, h, _ in rows if p == r.page_id) for r in out if r.record_type == "response")
    assert list(tmp_path.glob("records/*.idx")) and warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_normaliser_reads_one_or_many_members():
    records = [warc.format_record(i, "u", b"p" * i, "0", "response", None) for i in (0, 5, 70_000)]
    for stream in (zlib_gzip(b"".join(records)), b"".join(map(zlib_gzip, records))):
        import io

        assert list(warc.split_stream(warc.inflated(io.BytesIO(stream)))) == records
    with pytest.raises(ValueError):
        list(warc.split_stream([records[0][:-1]]))


def zlib_gzip(data):
    deflate = zlib.compressobj(wbits=31)
    return deflate.compress(data) + deflate.flush()


# --- top-k


def test_top_inner_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(250)] + [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [math.inf] + [0.0] * 5), (None, rows[1][1]),
             (2300, [math.nan] * 6), (200, rows[5][1]), (5000, [1.0, 2.0]), (5001, [3.0, 4.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(3)
    valid = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    # Query 200 repeats with two vectors; which one counts is not checked, only that one does.
    for q, x in [(i, v) for i, v in valid if i % 100 == 0 and i != 200]:
        best = sorted(((-int(np.dot(x, v)), i) for i, v in valid if i != q and len(v) == len(x)))[:10]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_inner_products(table, pivots=8).collect()}
    assert {g for g in got if g[0] != 200} == want and len([g for g in got if g[0] == 200]) == 10
    assert knn.top_inner_products(table.limit(0)).count() == 0


def test_scores_stay_exact_for_large_components():
    big = np.array([[2.0**40, 3.0]])
    assert knn._scores(big, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]


def _moved(plan) -> tuple[int, int]:
    """Bytes broadcast and rows shuffled by an executed plan."""
    kind, nodes = plan.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        nodes = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        nodes = [plan.plan()]
    else:
        nodes = [plan.children().apply(i) for i in range(plan.children().size())]
    below = [_moved(n) for n in nodes]
    metric = lambda on, name: int(plan.metrics().apply(name).value()) if kind == on else 0
    return (sum(b for b, _ in below) + metric("BroadcastExchangeExec", "dataSize"),
            sum(r for _, r in below) + metric("ShuffleExchangeExec", "shuffleRecordsWritten"))


def test_top_inner_products_send_each_vector_once(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(2000)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        top = knn.top_inner_products(table, every=10)
        assert len(top.collect()) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    broadcast, rows = _moved(top._jdf.queryExecution().executedPlan())
    # Two small tables take 1 MB each, 200 queries copied 48 times 5 MB. Queries go to 24 parts, each of which finds ten answers a query.
    assert broadcast < 3 * 2**20 and 0 < rows <= 2000 + 200 * 24 + 200 * 24 * 10


@pytest.mark.parametrize(("held", "wide"), [(2**27, 1.0), (20_000, 1.0), (20_000, 2.0**33), (2**27, 2.0**50)])
def test_top_inner_products_of_clusters(spark, monkeypatch, held, wide):
    """Far apart groups, ties, repeated ids and lengths of two to eight bytes a component, by one pass over the vectors and by several."""
    monkeypatch.setattr(knn, "HELD", held)
    monkeypatch.setattr(knn, "AT_ONCE", 64)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 5)) * 60
    rows = [(i, (middles[i % 12] + rng.integers(-2, 3, 5)).tolist()) for i in range(1500)]
    rows += [(i, rows[i % 7][1]) for i in range(1500, 1800)] + [(i, rows[i][1]) for i in range(3, 90)] + [(4001, (middles[0] * wide).tolist()), (-40, rows[4][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = [(i, [int(max(-2.0**53, min(2.0**53, math.floor(1024 * c)))) for c in v]) for i, v in rows]
    want = []
    for q, x in {i: v for i, v in whole if i % 20 == 0}.items():
        score = lambda v, x=x: max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, v, strict=True))))
        best = sorted((-score(v), i) for i, v in whole if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, knn.top_inner_products(table, every=20, pivots=10, queries_per_block=16).collect())) == sorted(want)


# --- near duplicates


def test_shingles_and_similarity():
    texts = ["", "a", "a b c d e f g a b c d e", "x\ty", "a b c d e F g a b c d e"]
    hashes, counts, starts = neardup.Shingler()(texts)
    bags = [(hashes[a:b], counts[a:b]) for a, b in zip(starts, [*starts[1:], len(hashes)], strict=True)]
    assert [int(c.sum()) for _, c in bags] == [0, 1, 8, 1, 8] and sorted(bags[2][1].tolist()) == [1] * 6 + [2]
    assert (bags[2][0] == bags[4][0]).all()
    assert neardup.weighted_jaccard(*bags[2], *bags[4]) == 1.0 and neardup.weighted_jaccard(*bags[1], *bags[3]) == 0.0


def test_samples_agree_as_often_as_bags_do():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    left, right = rng.random(400) * 3 + 0.2, rng.random(400) * 3 + 0.2
    want = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    sampler = neardup.Sampler(3000)
    samples = sampler(np.concatenate([hashes, hashes]), np.concatenate([left, right]), np.array([0, 400]))
    assert abs((samples[0] == samples[1]).mean() - want) < 0.04


def test_near_groups_against_all_pairs(spark, empty):
    base = [prose(120, 100 + i) for i in range(6)]
    common = prose(60, 999)
    rows = []
    for b, text in enumerate(base):
        for v in range(8):
            words = text.split()
            for _ in range(v // 2):
                words[random.Random(b * 10 + v).randrange(120)] = f"new{v}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, common + " " + prose(90, 5000 + i)) for i in range(30)]
    rows += [(2000, None), (2001, ""), (None, rows[0][1]), (0, rows[0][1]), (2002, rows[3][1].upper().replace(" ", "  ")), (2003, prose(4000, 77)), (2004, "one two")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(4)
    got = neardup.near_groups(table).collect()
    assert len(got) == len(rows)
    hashes, counts, starts = neardup.Shingler()([t or "" for _, t in rows])
    ends = [*starts[1:], len(hashes)]
    unique, df = np.unique(hashes, return_counts=True)
    weigh = neardup.Frequent(unique, neardup.idf(df, len(rows)))
    bags = [(hashes[a:b], weigh(hashes[a:b]) * counts[a:b]) for a, b in zip(starts, ends, strict=True)]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if neardup.weighted_jaccard(*bags[i], *bags[j]) >= 0.8:
            root[find(j)] = find(i)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    want = Counter((d, min(x for x in ids if x is not None), len(ids)) for ids in classes.values() for d in ids)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)
    kept = neardup.drop_near_copies(table)
    assert kept.schema == table.schema and kept.count() == len(classes)
    assert neardup.near_groups(empty).count() == 0


def test_near_pairs_inside_a_crowd_of_unlike_documents(spark):
    passage, rows = prose(254, 31), []
    for i in range(2500):
        own = prose(28, 20_000 + i).split()
        rows.append((2 * i, passage + " " + " ".join(own)))
        if i % 50 == 7:
            rows.append((2 * i + 1, passage + " " + " ".join(own[:20] + prose(8, 60_000 + i).split())))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_groups(table).collect()}
    pairs = {d - 1 for d, _ in rows if d % 2}
    assert got == {d: (d - d % 2, 2 if d - d % 2 in pairs else 1) for d, _ in rows}


@pytest.mark.parametrize("unlike", [1, 40])
def test_near_pair_that_meets_in_the_last_band_only(spark, monkeypatch, unlike):
    def sign(texts, _):
        alone = [F.col("uid") * 10 + band for band in range(neardup.BANDS - 1)]
        return texts.select("uid", F.array(*alone, F.lit(-1).cast("long")).alias("buckets"),
                            F.array_repeat(F.lit(1), neardup.BANDS * neardup.DEPTH).alias("marks"))

    monkeypatch.setattr(neardup, "_signatures", sign)
    pair = prose(100, 8)
    rows = [(i, prose(100, 9000 + i)) for i in range(unlike)] + [(unlike, pair), (unlike + 1, pair + " end")]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("class_size > 1").collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == [(unlike, unlike, 2), (unlike + 1, unlike, 2)]


def test_blocks_equal_all_pairs():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    hashes, counts, starts = neardup.Shingler()(texts)
    ends = np.append(starts[1:], len(hashes))
    weigh = neardup.Frequent(hashes[:5], np.array([1.0, 1.2, 1.4, 1.6, 1.8]))
    bags = [(hashes[a:b], weigh(hashes[a:b]) * counts[a:b]) for a, b in zip(starts, ends, strict=True)]
    left, right = np.arange(20), np.arange(20, 60)
    i, j = neardup._alike(hashes, counts, weigh(hashes), starts, left, right, 0.3001, width=7)
    want = {(a, b) for a in range(20) for b in range(40) if neardup.weighted_jaccard(*bags[a], *bags[20 + b]) >= 0.3001}
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want


# --- licences


def test_licence_scan(spark, empty):
    rows = [(1, "X Released under the MIT License. mit-license", 1), (2, None, 1), (3, "", 1), (None, "cc by nc CC BY-NC 4.0", 1), (5, LONG, 1),
            (6, "this program is free software: you may redistribute it and or modify it under the terms of the gnu general public license as "
                "published by the free software foundation either version 3 of the license or at your option any later version", 1),
            (7, "the of license under the version 2", 1), (1, "X", 1)]
    out = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    for (doc, text, _), r in zip(rows, out, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert (r.doc_id, r.n_words, r.n_base) == (doc, len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "gpl-3" in out[5].labels and out[5].n_base == 0 and out[6].labels == "" and out[4].labels == ""
    assert licences.scan_licences(empty).count() == 0


def test_phrase_of_the_mit_licence_begins_with_under():
    scan = licences.LicenceScanner(licences.TEMPLATES, licences.PHRASES, 4, 0.7, 4).scan
    assert scan("The MIT License; a mit license. by the mit license")[:6] == (10, 0, None, None, "", "")
    assert scan("MIT license, used under the MIT\nLicense")[:6] == (7, 1, 3, 3, "mit", "mit")


def test_licences_are_told_apart():
    scan = licences.LicenceScanner(licences.TEMPLATES, licences.PHRASES, 4, 0.7, 4).scan
    bsd, third = " 1. x y z ".join(licences.TEMPLATES["bsd-2"]), licences.TEMPLATES["bsd-3"][0]
    assert scan(bsd)[5] == "bsd-2" and scan(bsd + ". 3. " + third)[5] == "bsd-3" and scan(f"{bsd} 3 {third} or {bsd}")[5] == "bsd-2,bsd-3"
    for label, texts in licences.TEMPLATES.items():
        for text in texts:
            assert label in scan(text)[5].split(",") and (label[:3] in ("mit", "apa", "cc-") or scan(text)[5] == label)
    assert scan(licences.TEMPLATES["mit"][-1].upper())[5] == "mit"


def test_automaton_gives_longest_runs():
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    machine = licences.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]): k for k, s in enumerate(sequences) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(4) for _ in range(300)]
    for at, (state, length) in enumerate(machine.statistics(text)):
        want = max((n for n in range(at + 2) if n == 0 or tuple(text[at + 1 - n:at + 1]) in runs), default=0)
        assert length == want
        if length:
            assert all(sequences[k][e - length + 1:e + 1] == text[at + 1 - length:at + 1] for k, e in machine.ends[state].items())


# --- toxicity


def test_toxicity_finds_documents_and_sentences(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        text = ". ".join(prose(8, 10_000 + 7 * i + k) for k in range(6))
        bad = i % 5 == 0
        if bad:
            text = text.replace(". ", f". you {rng.choice(['badword', 'vilezing', 'vileton', 'Vilement'])} there. ", 1)
        rows.append((i, text, "x", "y"))
        labels.append((i, int(bad), None))
    rows += [(1000, None, "x", "y"), (1001, "", "x", "y"), (None, rows[0][1], "x", "y"), (1, rows[1][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, uid string").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs.select("doc_id", "text"), known, lambda c: F.crc32(c.cast("string")) % 3 != 1)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        bad = r.doc_id is None or (r.doc_id < 600 and r.doc_id % 5 == 0)
        assert (r.score >= 0.7) == bad and 0 <= r.score <= 1
        if bad:
            assert re.search("(?i)badword|vile", r.sentence_text)
    clean = toxicity.drop_toxic(docs, model)
    assert clean.schema == docs.schema and clean.count() == len(rows) - 121
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(empty, known, lambda c: c >= 0)
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


# --- language model


def test_language_model(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        chain = ["start"]
        for _ in range(60):
            chain.append({"start": "one", "one": "Two", "Two": rng.choice(["three", "one"]), "three": "start"}[chain[-1]])
        rows.append((i, " ".join([*chain, f"rare{i}", f"often{i % 7}"]), "z"))
    rows += [(500, None, "z"), (501, "", "z"), (None, "unknown words", "z"), (502, prose(20_000, 8), "z"), (1, rows[1][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in split(t))
    total = sum(counts.values())
    from duesflow.llm.util import crc_part

    out = lm.score_texts(docs, crc_part("doc_id", 7, 2)).collect()
    want = Counter()
    for i, t, _ in rows:
        tokens = split(t)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        want[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    chains = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in chains) > 0.8 * sum(r.base_score for r in chains)
    assert lm.score_texts(empty, crc_part("doc_id", 7, 2)).count() == 0


def test_head_is_filled_by_tokens_of_equal_counts(spark):
    few = [(b"often%d" % i, 100 + i) for i in range(5)]
    many = [(b"t%d" % i, 1) for i in range(2000)] + [(b"x" * 65, 1)]
    counts = spark.createDataFrame([(bytearray(t), n) for t, n in few + many], "token binary, n bigint")
    for head in (0, 3, 5, 10, 1000, 2005, 5000):
        vocabulary, least = lm.learn_vocabulary(counts, head)
        assert vocabulary.total == sum(n for _, n in few + many) and vocabulary.distinct == len(few + many)
        got, known = set(vocabulary.facts()[0]), dict(few + many[:-1])
        assert len(got) <= head and got <= set(known)
        assert {t for t, n in known.items() if n >= least} <= got
        assert len(got) >= min(len(known), 0.98 * head - 8)
    equal = spark.createDataFrame([(bytearray(b"w%d" % i), 1) for i in range(20)], "token binary, n bigint")
    assert 0 < len(lm.learn_vocabulary(equal, 10)[0].counts) <= 10


def test_language_model_sums_to_one():
    tokens = [f"w{i}".encode() for i in range(3000)] + [lm.END]
    counts = np.arange(len(tokens), 0, -1)
    tail = tokens[lm.CLASSES * lm.MEMBERS:]
    tail_n, tail_v = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for t, c in zip(tail, counts[lm.CLASSES * lm.MEMBERS:], strict=True):
        tail_n[lm.tail_class(t)] += c
        tail_v[lm.tail_class(t)] += 1
    words = lm.Vocabulary(tokens, counts, counts.sum(), len(tokens), tail_n, tail_v)
    net = lm.Network(words.biases())
    rng = np.random.default_rng(0)
    net.top[:] = rng.normal(size=net.top.shape) / 4
    net.inside[:] = rng.normal(size=net.inside.shape) / 4
    # After one context, over all model words and all classes of the others with their counts and the unknown one.
    last = np.arange(lm.CLASSES * (lm.MEMBERS + 1))
    codes = np.stack([np.full(len(last), 7), last], 1).ravel()
    lp = net.log10(codes, np.arange(0, len(codes), 2))[1::2]
    assert abs((10.0 ** lp).sum() - 1) < 1e-3
    in_tail = [(10.0 ** np.log10(counts[len(tokens) - len(tail):] + 1))[[lm.tail_class(t) == c for t in tail]].sum() + 1 for c in range(lm.CLASSES)]
    assert np.allclose(in_tail, 10 ** words.log_tail())


def test_word_hasher_finds_words():
    texts = [b"a  bb\tc", b"", b" x", "é\x0b\x0c z".encode()]
    hashes, first, past, sizes = WordHasher()(texts)
    joined = WordHasher.join(texts)
    assert [joined[a:b] for a, b in zip(first, past, strict=True)] == [w for t in texts for w in t.split()] and sizes.tolist() == [3, 0, 1, 2]
    assert len(set(hashes.tolist())) == 6
