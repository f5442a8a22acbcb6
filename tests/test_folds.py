"""Folds over blocks against the machines run on whole keys, and the machines against plain loops."""

import random

import pytest

from trailmark.operators.folds import CountOrTime, Fifo, Leases, fold, settled_fold


def table(spark, rows):
    rows = rows[:]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "id long, k long, us long, worker string, action string, member long")


def rows_of(n=400, seed=1):
    rng, us, out = random.Random(seed), 0, []
    for i in range(n):
        us += rng.choice([0, 1, 1, 2, 3, 5, 40])
        k = 1 if rng.random() < 0.8 else rng.choice([2, 3, None])
        out.append((i, k, us, rng.choice("abc"), rng.choices(["claim", "renew", "release"], [3, 6, 1])[0], rng.choice([None, *range(25)])))
    return out


def by_key(rows):
    return {k: [r for r in rows if r[1] == k] for k in {r[1] for r in rows} - {None}}


@pytest.mark.parametrize("block", [3, 32, 1000])
def test_leases(spark, block):
    rows, ttl = rows_of(), 12
    got = {r.id: (r.outcome, r.lease) for r in fold(table(spark, rows), "k", ["us", "id"], Leases(ttl), block).collect()}
    want = {}
    for mine in by_key(rows).values():
        holder = ends = None
        number = 0
        for i, _, us, worker, action, _ in mine:
            if holder is not None and us >= ends:
                holder = None
            if action == "claim" and holder is None:
                holder, ends, number = worker, us + ttl, number + 1
                want[i] = ("claimed", number)
            elif action != "claim" and holder == worker:
                want[i] = ("renewed" if action == "renew" else "released", number)
                holder, ends = (worker, us + ttl) if action == "renew" else (None, None)
            else:
                want[i] = ("refused", None)
    assert got == want


@pytest.mark.parametrize(("block", "count", "wait"), [(3, 8, 10), (32, 8, 10), (32, 5, 1000), (7, 1, 5), (64, 50, 3), (1000, 8, 10)])
def test_batches(spark, block, count, wait):
    rows = rows_of()
    got = {r.id: (r.batch, r.place) for r in fold(table(spark, rows), "k", ["us", "id"], CountOrTime(count, wait), block).collect()}
    want = {}
    for mine in by_key(rows).values():
        begin, place, batch = None, 0, 0
        for i, _, us, *_ in mine:
            if begin is None or place == count or us >= begin + wait:
                begin, place, batch = us, 0, batch + 1
            place += 1
            want[i] = (batch, place)
    assert got == want


@pytest.mark.parametrize(("block", "cap"), [(8, 3), (40, 6), (40, 24), (40, 100), (1000, 6), (16, 1)])
def test_fifo(spark, block, cap):
    rows = rows_of(300, 4)
    got = {r.id: r.passes for r in settled_fold(table(spark, rows), "k", ["us", "id"], Fifo(cap, "member"), block).collect()}
    want = {}
    for mine in by_key(rows).values():
        held: list = []
        for i, *_, member in mine:
            want[i] = member is None or member not in held
            if member is not None and member not in held:
                held = [*held, member][-cap:]
    assert got == want


def test_empty(spark):
    none = table(spark, [])
    assert fold(none, "k", ["us", "id"], Leases(5)).count() == settled_fold(none, "k", ["us", "id"], Fifo(3, "member")).count() == 0
