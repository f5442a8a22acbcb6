"""Operators on the cases that their semantics turn on."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import columns as K
from trailmark.operators import geometry, graph, matching, sequences, throttle
from trailmark.session import written
from trailmark.sources import messages, tables


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_transition_guard_follows_ids_not_times(spark):
    rows = [(1, 7, 50, "out"), (2, 7, 40, "IN"), (3, 7, 60, "in"), (4, 7, 10, "out"), (5, 8, 5, "in")]
    df = spark.createDataFrame(rows, "id long, user_id long, ts long, status string")
    assert values(sequences.transition_guard(df), "id") == [(1,), (2,), (4,), (5,)]


def test_greedy_throttle_counts_from_what_was_emitted(spark):
    rows = [(1, 0), (1, 150), (1, 250), (1, 440), (1, 450), (1, 2000), (1, 2000), (2, 5)]
    df = spark.createDataFrame(rows, "k long, us long")
    assert values(throttle.greedy_throttle(df, "k", "us", 200), "k", "us") == [(1, 0), (1, 250), (1, 450), (1, 2000), (2, 5)]


@pytest.mark.parametrize(
    ("crops", "best"),
    [([(0.99, 0.35), (0.61, 0.41)], 1), ([(0.7, 0.5), (0.9, 0.8), (0.65, 0.45)], 1), ([(0.5, 0.3), (0.55, 0.2)], 0), ([(None, None), (0.7, 0.5)], 1), ([(0.8, 0.5), (0.5, 0.8), (0.8, 0.5)], 0)],
)
def test_best_frame(spark, crops, best):
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(crops)], "track_id long, frame_num long, frontality double, pitch double")
    assert values(sequences.best_frame(df), "frame_num") == [(best,)]


def test_send_once_and_null_tracks(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "b"), (4, 6, "a"), (5, None, "a"), (6, None, "a")], "id long, track long, name string")
    assert values(sequences.send_once(df, ["track", "name"], "id", "track"), "id") == [(1,), (3,), (4,), (5,), (6,)]


def test_connected_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert values(graph.connected_components(df), "node", "root") == [(i, 0) for i in range(31)] + [(100, 100), (101, 100)]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_greedy_throttle_over_blocks(spark, block):
    """Dense, sparse and empty blocks, ties, negative times, null keys, against a plain fold."""
    r = np.random.default_rng(3)
    rows = [(int(k), int(t)) for k, n, top in ((1, 3000, 9000), (2, 60, 100_000), (3, 1, 5)) for t in r.integers(-top, top, n) for k in [k]] + [(1, 7), (1, 7), (None, 3), (4, None)]
    want = []
    for k in (1, 2, 3):
        last = None
        for t in sorted(t for key, t in rows if key == k):
            if last is None or t - last >= 100:
                want.append((k, t))
                last = t
    df = spark.createDataFrame(rows, "k long, us long")
    assert values(throttle.greedy_throttle(df, "k", "us", 100, block), "k", "us") == sorted(want)
    assert throttle.greedy_throttle(df.where("k > 9"), "k", "us", 100).count() == 0


def test_greedy_throttle_of_one_dense_key(spark):
    rows = spark.range(1_000_000).select(F.lit("a").alias("k"), (F.col("id") * 10).alias("us"))
    got = throttle.greedy_throttle(rows, "k", "us", 1000)
    assert got.agg(F.count("*"), F.min("us"), F.max("us")).first()[:] == (10_000, 0, 9_999_000)


def test_stored_table(spark, tmp_path):
    table = tables.StoredTable(spark, f"file://{tmp_path}/t", "k long, v string, at long")
    rows = lambda *x: spark.createDataFrame(list(x), table.schema)
    assert table.read().count() == 0 and table.delete(rows((1, "a", 1)).select("k")) == 0
    table.append(rows((1, "a", 1), (2, "b", 1)))
    table.append(rows((3, "c", 1)))
    table.upsert(rows((1, "z", 2), (2, "old", 0), (4, "d", 1)), ["k"], "at")
    assert values(table.read(), "k", "v") == [(1, "z"), (2, "b"), (3, "c"), (4, "d")]
    table.insert_ignore(rows((1, "no", 9), (5, "f", 2), (5, "e", 1)), ["k"], "at")
    assert values(table.read(), "k", "v") == [(1, "z"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    assert table.delete(rows((1, "", 0), (3, "", 0), (9, "", 0)).select("k")) == 2
    assert values(table.read(), "k") == [(2,), (4,), (5,)]


def test_only_changed_buckets_are_written(spark, tmp_path):
    table = tables.StoredTable(spark, f"file://{tmp_path}/t", "k long, v string, at long", ["k"], 8)
    rows = lambda *x: spark.createDataFrame(list(x), table.schema)
    table.append(rows(*[(i, "a", 1) for i in range(200)], (None, "n", 1)))
    before = table.files()
    assert len({b for b, _ in before}) == 8
    table.upsert(rows((7, "new", 2), (7, "newer", 3)), ["k"], "at")
    after = table.files()
    kept = [x for x in before if x in after]
    assert len({b for b, _ in before} - {b for b, _ in kept}) == 1 and len(after) == len(kept) + 1
    assert values(table.read().where("k = 7"), "v") == [("newer",)] and table.read().count() == 201
    table.insert_ignore(rows((7, "no", 9), (1000, "yes", 9)), ["k"], "at")
    assert set(after) < set(table.files()) and len(table.files()) == len(after) + 1
    now = table.files()
    assert table.delete(rows((8, "", 0), (9999, "", 0)).select("k")) == 1
    assert len({b for b, f in set(now) - set(table.files())}) == 1
    # By other columns than the keys: any bucket may hold the rows, but only those that do are written.
    now = table.files()
    assert table.delete(rows((0, "yes", 0)).select("v")) == 1 and len({b for b, f in set(now) - set(table.files())}) == 1
    assert table.read().count() == 200
    with pytest.raises(ValueError, match="other buckets"):
        tables.StoredTable(spark, f"file://{tmp_path}/t", table.schema, ["k"], 4).read()


def test_cameras_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    assert sorted(map(str, sequences.required_unique(rows, ["id"], "camera").collect())) == sorted(map(str, rows.collect()))
    twice = rows.union(rows.where("id = 2"))
    with pytest.raises(Exception, match=r"camera is there more than once: \{.*id.*2"):
        sequences.required_unique(twice, ["id"], "camera").count()
    assert sequences.required_unique(twice, ["id", "name"], "camera").where("false").count() == 0


def test_contracted_components(spark):
    chain = spark.range(1, 900).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(5000, 5001), (5001, 5002)], "a long, b long"))
    want = {i: 1 for i in range(1, 901)} | {5000: 5000, 5001: 5000, 5002: 5000}
    for contract in (False, True):
        assert {r["node"]: r.root for r in graph.connected_components(chain, contract=contract).collect()} == want


def test_commands(spark):
    raw = [('{"id": 1, "user_id": 2, "event_type": "a", "stream": "s"}',), ('{"id": 1, "user_id": 2, "event',), ('{"id": 3, "stream": "t"}',), ('{"id": 4}',), ("[]",), ("x" * 6000,), (None,)]
    got = messages.commands(spark.createDataFrame(raw, "value string"), ["s"]).collect()
    assert [x.error_type for x in got] == [None, "PARSE_ERROR", "UNKNOWN_STREAM", "UNKNOWN_STREAM", "PARSE_ERROR", "PARSE_ERROR", "PARSE_ERROR"]
    assert got[0].user_id == 2 and len(got[5].raw) == 5000


def test_refused_cameras():
    k = [[800.0, 0, 320], [0, 800, 240], [0, 0, 1]]
    for bad_k, bad_d in ((k, [0.1, float("nan"), 0, 0]), ([[float("inf"), 0, 1], *k[1:]], [0.0] * 4), (k[:2], [0.0] * 4), (k, [0.0] * 3)):
        with pytest.raises(ValueError):
            geometry.check_coefficients(bad_k, bad_d, False)


def test_best_match_in_parts_without_itself(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(40, 5))
    g = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    s = np.round(v @ v.T, 9) - np.diag([1e9] * 40)
    for most in (3, 100):
        got = matching.best_match(g, g, 7, most, but_itself=True)
        assert values(got, "query_id", "gallery_id") == [(i, int(s[i].argmax())) for i in range(40)]


def test_best_match_ties_and_blocks(spark):
    g = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [0.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.1, 0.9])], "id long, embedding array<double>")
    for block in (1, 2, 100):
        assert values(matching.best_match(q, g, block), "query_id", "gallery_id", "similarity") == [(10, 1, 1.0), (11, 2, 0.9)]


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    for name, slug in {"Vision_1": "vision1", "Meeting room": "meetingroom", "Café 3": "caf3", "A.B_C-D": "abcd"}.items():
        assert get(K.slug(F.lit(name))) == slug and get(K.slug(F.lit(slug))) == slug
    assert get(K.url_norm(F.lit("https://h/a/image.jpg;v=1?token=x#y"))) == "https://h/a/image.jpg"
    assert get(K.storage_uri(F.lit("https://storage.googleapis.com/b/Ali%20V_1.jpg?sig=2"))) == "gs://b/Ali V_1.jpg"
    identity = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    x, y = K.project(identity, *K.foot_point(F.lit(10.0), F.lit(110.0), F.lit(220.0)))
    assert (get(x), get(y)) == (60.0, 220.0)
    assert get(K.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    verdicts = {"http://100.64.1.1/": "blocked range", "http://11.0.0.1/": "ok", "https://x.storage.googleapis.com/": "ok", "https://xstorage.googleapis.com/": "domain not allowed", "file:///etc": "blocked scheme", None: "empty"}
    for url, verdict in verdicts.items():
        assert get(K.url_verdict(F.lit(url).cast("string"))) == verdict


def test_homography():
    src = np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)
    want = np.array([[2, 0.1, 10], [0.2, 3, -5], [0.001, 0.0005, 1]])
    to = lambda p: (lambda q: q[:, :2] / q[:, 2:])(np.c_[p, np.ones(len(p))] @ want.T)
    assert np.allclose(geometry.solve_homography(src, to(src))[0], want, atol=1e-6)
    more = np.vstack([src, [[50, 20], [30, 70]]])
    dst = to(more)
    dst[5] += 80
    h, inside = geometry.solve_homography(more, dst)
    assert inside.tolist() == [True] * 5 + [False] and np.allclose(h, want, atol=1e-4)
    for bad in (src[:3], np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float)):
        with pytest.raises(ValueError):
            geometry.solve_homography(bad, bad)


@pytest.mark.parametrize(("d", "fisheye"), [([-0.2, 0.05, 0.001, -0.0005, 0.01], False), ([0.05, -0.01, 0.002, 0.0], True)])
def test_undistort_inverts_distortion(d, fisheye):
    k = np.array([[800.0, 0, 320], [0, 810.0, 240], [0, 0, 1]])
    x, y = np.meshgrid(np.linspace(100, 540, 5), np.linspace(80, 400, 5))
    a, b = (x.ravel() - 320) / 800, (y.ravel() - 240) / 810
    r = np.hypot(a, b)
    if fisheye:
        t = np.arctan(r)
        s = np.where(r > 0, t * (1 + d[0] * t**2 + d[1] * t**4 + d[2] * t**6 + d[3] * t**8) / np.maximum(r, 1e-12), 1)
        u, v = a * s, b * s
    else:
        r2 = r * r
        radial = 1 + d[0] * r2 + d[1] * r2**2 + d[4] * r2**3
        u, v = a * radial + 2 * d[2] * a * b + d[3] * (r2 + 2 * a * a), b * radial + d[2] * (r2 + 2 * b * b) + 2 * d[3] * a * b
    got = geometry.undistort_points(u * 800 + 320, v * 810 + 240, k, np.array(d), fisheye)
    assert np.allclose(got[0], x.ravel(), atol=1e-4) and np.allclose(got[1], y.ravel(), atol=1e-4)
    with pytest.raises(ValueError):
        geometry.check_coefficients(k.tolist(), [0.1] * 3, fisheye)


def test_settings():
    assert messages.settings({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 5}}, {"b": 4}) == {"a": {"x": 1, "y": 5}, "b": 4}


def test_library_stands_without_text_operators():
    """Nothing outside the subpackage and the entry point imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "trailmark"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_hundredths_as_printf_gives_them(spark):
    """Ties (0.125 has an exact binary value) and decimal texts that only look like ties (0.015, 1.005)."""
    xs = [0.0, 0.00001, 0.005, 0.015, 0.045, 0.125, 0.375, 1.005, 1.115, 1.125, 2.675, 3.495, 3.4999, 3.999]
    got = [r.t for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(K.hundredths(F.col("x")).alias("t")).collect()]
    assert got == [f"{x:.2f}" for x in xs]


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(disk.getAllFiles().mkString("|").split("|"))
    before = files()
    rows = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    deadline = time.time() + 10
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < deadline:
        time.sleep(0.2)
    assert rows.count() == 10 and not left
