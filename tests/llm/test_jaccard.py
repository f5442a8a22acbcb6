import random

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import jaccard


def brute(rows, n=5, t=80):
    """Components by comparing all pairs."""
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, text in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "1 as n", "2 as key", "3 as d1")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}


def test_against_all_pairs(spark):
    """Near copies around the threshold, chains, short texts, shared passages."""
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d e"), (7, "A b c d\te"), (8, "É"), (9, "é")]
    passage = r.choices(vocab, k=40)
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([3, 6, 9, 15, 30, 80, 300]))
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2)
            rows.append((len(rows), " ".join(w)))
    assert result(spark, rows, extra=True) == brute(rows)


def test_large_group(spark):
    """A large group of near copies that do not all link with each other."""
    r = random.Random(7)
    base = ["v%d" % i for i in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(30)
        rows.append((1000 + i, " ".join(w)))
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert result(spark, []) == {}
    got = jaccard.components(spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == [4, 4, 4]


@pytest.mark.parametrize("t", [70, 80, 90])
def test_bands_hold_all_partners(t):
    bands = jaccard.Bands(t)
    for a in range(1, 3000):
        b = bands.largest_partner(a)
        assert bands.band(b) - bands.band(a) in (0, 1)
        k = bands.band(a)
        assert bands.allocated(k) >= bands.need(a, k)


def test_candidates_joined_by_shuffle(spark, monkeypatch):
    """More candidates than are broadcast."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    r = random.Random(8)
    rows = [(0, None)]
    for _ in range(6):
        base = ["x%d" % r.randrange(300) for _ in range(40)]
        for k in range(4):
            w = list(base)
            w[r.randrange(40)] = f"new{k}"
            rows.append((len(rows), " ".join(w[:k] + w)))
    assert result(spark, rows) == brute(rows)


def test_one_very_long_text(spark):
    r = random.Random(9)
    words = ["w%d" % r.randrange(50_000) for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000] + ["other"] + words[1000:])), (3, " ".join(words[:150_000])), (4, "short text of no great length")]
    assert {i: x[1] for i, x in result(spark, rows).items()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_keys_are_dealt_among_turns_and_none_is_lost():
    """A turn makes only its part of the keys, all turns make each key once with the same rows, and rows with a center pass the shuffle as they are."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 5000, 400).astype(np.uint64)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1, 61), pa.int64()), pa.array([jaccard.packed(s) for s in sets], pa.binary())], ["d1", "keys"])

    def rows(*turn):
        return [tuple(r.values()) for b in jaccard.pre_aggregated(iter([batch]), *turn) for r in b.to_pylist()]

    whole, parts = rows(), [rows(i, jaccard.PASSES) for i in range(jaccard.PASSES)]
    assert sorted(map(str, whole)) == sorted(map(str, sum(parts, [])))
    assert all(len(p) < len(whole) / 2 for p in parts)
    got = {tuple(r.values()) for p in range(jaccard.PASSES) for b in jaccard.shared_keys(jaccard.pre_aggregated(iter([batch]), p, jaccard.PASSES)) for r in b.to_pylist()}
    want = {}
    for d, s in enumerate(sets, 1):
        for key in s.tolist():
            want.setdefault(key, []).append(d)
    assert got == {(k, d, ds[0]) for k, ds in want.items() if len(ds) > 1 for d in ds}


def test_wide_parities_bound_the_difference():
    """Places that differ are at most the elements that do, for sets of other sizes too; halves fold into parities in half as many places."""
    rng = np.random.default_rng(4)
    for n, m in [(513, 600), (1000, 1100), (1024, 1025), (3000, 5000), (2000, 2000)]:
        pool = np.unique(rng.integers(0, 1 << 62, n + m).astype(np.uint64))
        a, b = np.sort(rng.permutation(pool)[:n]), np.sort(rng.permutation(pool)[:m])
        x, y = (np.frombuffer(jaccard.wide_parities(s), np.uint8) for s in (a, b))
        assert 8 * len(x) >= n and 8 * len(y) >= m
        apart, least = jaccard.places_apart(x, y), 8 * min(len(x), len(y))
        assert apart == jaccard.places_apart(y, x) == np.bitwise_count(jaccard.parities(a, least) ^ jaccard.parities(b, least)).sum() <= len(np.setxor1d(a, b))
    assert jaccard.wide_parities(pool[:512]) is None


def long_texts(r, count=24, words=3000):
    """Long texts with a third in common, one with a near copy, and a short text that shares a doc_id with a long one."""
    passage = ["p%d" % r.randrange(10**6) for _ in range(words)]
    own = [["w%d" % r.randrange(10**6) for _ in range(words // 2)] for _ in range(count)]
    rows = [(i, " ".join(passage + w)) for i, w in enumerate(own, 1)]
    return [*rows, (90, " ".join(passage + own[4] + ["end"])), (91, "a short text of some words"), (7, "a short text of some words")]


def test_long_texts_that_only_share_a_passage_are_not_verified(spark, monkeypatch):
    """The parities in 512 places let all pairs of long sets through, which grew as the square of the long texts that share a key."""
    seen, old = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (seen.append(pairs.count()), old(pairs, *a))[1])
    got = result(spark, long_texts(random.Random(8)))
    assert {i: x[1] for i, x in got.items() if x[1] != i} == {90: 5, 91: 7}
    assert sum(seen) < 24


def test_pairs_are_verified_in_parts_and_compared_in_turns(spark, monkeypatch):
    """No part takes more than its share of the pairs, and no link is lost between the parts, or between chunks of a key in different turns."""
    r = random.Random(9)
    rows = []
    passage = ["p%d" % r.randrange(1000) for _ in range(60)]
    for _ in range(12):
        base = passage + ["w%d" % r.randrange(200) for _ in range(r.choice([5, 10, 15, 20]))]
        for _ in range(6):
            w = list(base)
            w[r.randrange(len(w))] = "x%d" % r.randrange(50)
            rows.append((len(rows), " ".join(w)))
    parts, turns, part, crossing = [], [], jaccard.verified_part, jaccard.crossing
    for name, value in [("BROADCAST_IDS", 40), ("PARTNERS", 2), ("CHUNK_ROWS", 4)]:
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "crossing_turns", lambda *a: 3)
    monkeypatch.setattr(jaccard, "verified", lambda pairs, docs, n, t, most, old=jaccard.verified: old(pairs, docs, n, t, 2000))
    monkeypatch.setattr(jaccard, "verified_part", lambda pairs, *a: (parts.append(pairs.count()), part(pairs, *a))[1])
    monkeypatch.setattr(jaccard, "crossing", lambda *a: (turns.append(a[3:]), crossing(*a))[1])
    assert result(spark, rows) == brute(rows)
    assert turns == [(0, 3), (1, 3), (2, 3)]
    assert len(parts) > 4 and max(parts) <= 40
