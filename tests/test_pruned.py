"""Pruned best matches against all products."""

import numpy as np
import pytest

from trailmark.operators import matching, pruned


def vectors(kind, n, rng, d=16):
    if kind == "random":
        return rng.normal(size=(n, d))
    centers = rng.normal(size=(40, d)) * 4
    x = centers[rng.integers(0, 40, n)] + rng.normal(size=(n, d)) * 0.15
    return x / np.linalg.norm(x, axis=1)[:, None] if kind == "unit" else x


@pytest.mark.parametrize("kind", ["clustered", "unit", "random", "ties"])
def test_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(pruned, "EACH", 20)
    monkeypatch.setattr(pruned, "BLOCK", 37)
    monkeypatch.setattr(pruned, "QUERIES", 11)
    rng = np.random.default_rng(3)
    g = vectors(kind, 1500, rng) if kind != "ties" else np.repeat(rng.normal(size=(30, 4)), 10, axis=0)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(g)), g, strict=True)]
    gallery = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = gallery.where("id % 15 = 0")
    found = pruned.best_match(queries, gallery, but_itself=True)
    got = {r.query_id: (r.gallery_id, r.similarity) for r in found.best.collect()}
    order = sorted(rows)
    m = np.array([x for _, x in order])
    want = {}
    for i in range(0, len(m), 15):
        s = np.round(m @ m[i], 9)
        s[i] = -np.inf
        want[i] = (int(s.argmax()), float(s.max()))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert found.share <= 1 and (kind not in ("clustered", "unit") or found.share < 0.3), found.share


def test_empty(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], none.schema)
    assert pruned.best_match(none, one).best.count() == pruned.best_match(one, none).best.count() == 0
    assert pruned.best_match(one, one, but_itself=True).best.count() == 0
    assert [r.similarity for r in pruned.best_match(one, one).best.collect()] == [5.0]


def test_a_vector_leaves_the_task_once(spark, monkeypatch):
    """The cells that a query still visits are a list beside its vector, not a row each with the vector in it."""
    seen = []
    keep = type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, f, schema, *x, **y: (seen.append(schema), keep(self, f, schema, *x, **y))[1])
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))], "id long, embedding array<double>")
    assert pruned.best_match(rows.where("id < 20"), rows, but_itself=True).best.count() == 20
    assert any("cells array" in s for s in seen)


@pytest.mark.parametrize("size", [7, 1000])
def test_near_pairs_by_blocks(spark, monkeypatch, size):
    """Against all pairs summed in order, with products on the bound itself, equal vectors and rows without a key."""
    monkeypatch.setattr(matching, "PAIRS", size)
    monkeypatch.setattr(matching, "PRODUCTS", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:20] = x[0]
    x[20:40] = np.array([1.0, 0, 0, 0, 0])
    x[40:50] = np.array([0.4, 0.0, 0, 0, 0])  # 1 - 0.4 is the bound
    rows = [(i, None if i % 30 == 29 else i % 2, v.tolist()) for i, v in enumerate(x)]
    got = sorted(tuple(r) for r in matching.near_pairs(spark.createDataFrame(rows, "id long, k long, embedding array<double>"), "k", 0.6).collect())
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and 1 - sum(p * q for p, q in zip(a[2], b[2], strict=True)) <= 0.6]
