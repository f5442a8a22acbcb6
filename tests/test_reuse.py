"""Reuse distances against a cache that is run."""

import random
from collections import OrderedDict

import pytest

from trailmark.operators.reuse import lru, reuse_distances


def cache(keys, cap):
    held, out, ever = OrderedDict(), [], set()
    for k in keys:
        if k in held:
            held.move_to_end(k)
            out.append(("hit", False))
            continue
        held[k] = None
        evicts = len(held) > cap
        if evicts:
            held.popitem(last=False)
        out.append(("evicted" if k in ever else "cold", evicts))
        ever.add(k)
    return out


@pytest.mark.parametrize(("kind", "cap", "base", "fan"), [("even", 40, 16, 2), ("hot", 5, 64, 4), ("hot", 30, 1024, 16), ("one", 1, 8, 3), ("even", 1, 4096, 16)])
def test_against_a_cache(spark, kind, cap, base, fan):
    rng = random.Random(3)
    draw = {"even": lambda: rng.randrange(80), "hot": lambda: 7 if rng.random() < 0.4 else rng.choice([None, *range(60)]), "one": lambda: 1}[kind]
    rows = [(10 * i + 3, draw()) for i in range(700 if kind != "one" else 50)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    table = spark.createDataFrame(shuffled, "at long, k long")
    got = {r["at"]: (r.outcome, r.evicts) for r in lru(table, "k", "at", cap, base, fan).collect()}
    assert [got[i] for i, _ in rows] == cache([k for _, k in rows], cap) and len(got) == len(rows)


def test_distances(spark):
    table = spark.createDataFrame([(i, k) for i, k in enumerate("abcbbacd")], "at long, k string")
    assert [r.distance for r in sorted(reuse_distances(table, "k", "at", 2, 2).collect())] == [None, None, None, 1, 0, 2, 2, None]
    assert reuse_distances(table.limit(0), "k", "at").count() == 0
