import random

import pytest
from pyspark.sql import functions as F

from trailmark.llm import lines


def brute(rows):
    """All pairs of distinct lines; the first of each component stays."""
    places = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            if text is not None and line.strip(lines.BLANKS):
                places.append((i, k, line.strip(lines.BLANKS)))
    distinct = sorted({x for _, _, x in places})
    sets = {x: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in distinct}
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            s, t = sets[a], sets[b]
            if min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    seen, gone = set(), {}
    for i, k, line in places:
        gone.setdefault(i, [])
        if find(line) in seen:
            gone[i].append(k)
        seen.add(find(line))
    return gone


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(n))


def table(seed):
    r = random.Random(seed)
    pool = ["Yes.", "ab", "é", "All rights reserved to the authors of this text."]
    for _ in range(40):
        base = words(r, r.choice([3, 8, 15, 60]))
        pool.append(base)
        for _ in range(r.randint(0, 3)):  # light edits: well above the threshold, or a rewrite far below
            k = r.randrange(len(base))
            pool.append(base[:k] + r.choice("XYZ") + base[k + 1 :] if len(base) > 60 else base + "  ")
    rows = [(i, "\n".join(r.choices([*pool, "", "  "], k=r.randint(1, 12)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "one two three " * 20000), (104, "one two three " * 20000 + "four"), (None, "Yes.\nonly here, nowhere else at all")]


def test_against_all_pairs(spark):
    rows = table(11)
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").selectExpr("*", "1 as id", "2 as place", "3 as component")
    want = brute(rows)
    got = lines.digests(df).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        assert [int(i) for i in x.removed.split(",") if i] == want.get(x.doc_id, []), x
    out = lines.deduplicated(df)
    assert out.columns == [*df.columns, "_emptied"]
    for x in out.collect():
        text = dict(rows)[x.doc_id]
        assert x.text == (None if text is None else "\n".join(t for k, t in enumerate(text.split("\n")) if k not in want.get(x.doc_id, [])))
    assert {x.doc_id for x in out.where("_emptied").collect()} == {i for i, g in want.items() if g and len(g) == sum(bool(t.strip(lines.BLANKS)) for t in dict(rows)[i].split("\n"))}


def test_recall_near_the_threshold(spark):
    """Pairs of lines at similarities from 0.8: at least nine in ten are found, none below is."""
    r = random.Random(2)
    rows, want = [], 0
    for i in range(150):
        base = words(r, 40)
        k = r.randrange(100)
        other = base[:k] + words(r, 4) + base[k + r.randint(10, 30) :]
        s, t = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (base, other))
        near = 100 * len(s & t) >= 80 * len(s | t)
        want += near
        rows += [(4 * i, base), (4 * i + (2 if near else 1), other)]
    got = [x.doc_id for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert all(x % 4 == 2 for x in got) and len(got) >= 0.9 * want and want > 30


def test_recall_at_every_length(spark):
    """Pairs of lines on either side of 300 characters, with more than 100 shingles that begin with a vowel."""
    r = random.Random(5)
    rows = []
    while len(rows) < 300:
        base = "".join(r.choices("aeioaeio bcdfghlmnrst", k=r.randint(301, 318)))
        k = r.randrange(100, 200)
        other = base[:k] + base[k + 25 :]
        s, t = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (base, other))
        assert len(base) > 300 > len(other)
        if 100 * len(s & t) >= 80 * len(s | t):
            rows += [(len(rows), base), (len(rows) + 1, other)]
    got = [x.doc_id for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert all(x % 2 for x in got) and len(got) >= 0.97 * len(rows) / 2


def test_recall_over_lengths(spark):
    """Pairs at similarities of 0.8 and a little more, for lines of 100 to 1500 characters: at least nine in ten at each length."""
    r = random.Random(8)
    rows, lengths = [], {}
    for n in (100, 200, 300, 500, 900, 1500):
        for _ in range(60):
            while True:
                base = words(r, n)[:n]
                k = r.randrange(n // 2)
                other = base[:k] + words(r, n)[: n // 12] + base[k + n // 12 :]
                s, t = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (base, other))
                if 100 * len(s & t) >= 80 * len(s | t):
                    break
            lengths[len(rows) + 1] = n
            rows += [(len(rows), base), (len(rows) + 1, other)]
    got = [lengths[x.doc_id] for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert all(got.count(n) >= 54 for n in set(lengths.values())), got


def test_recall_in_a_common_bucket(spark):
    """Pairs of lines that share a long boilerplate with all others, without being linked to them."""
    r = random.Random(9)
    common = words(r, 60)[:185]
    rows = []
    for i in range(400):
        own = words(r, 20)[:40]
        k = r.randrange(5, 30)
        rows += [(2 * i, f"{common} {own}"), (2 * i + 1, f"{common} {own[:k]}#{own[k + 1:]}")]
    got = [x.doc_id for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert all(x % 2 for x in got) and len(got) >= 0.97 * 400, len(got)


def test_pairs_that_share_only_the_boilerplate(spark, monkeypatch):
    """One bucket of all lines: two have the boilerplate and a few characters of their own, the others, its smallest and largest among them, a long tail."""
    keep = lines.banded
    monkeypatch.setattr(lines, "banded", lambda rows: keep(rows).withColumn("keys", F.array(F.lit(1).cast("long"))))
    r = random.Random(21)
    common = words(r, 80)[:250]
    rows = [(0, f"{common} one"), (1, f"{common} two"), *[(i, f"{common} {words(r, 60)[:120]}") for i in range(2, 60)]]
    assert [i for i, x in brute(rows).items() if x] == [1]
    got = [x.doc_id for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert got == [1]


def test_chunks_of_a_bucket(spark, monkeypatch):
    """A bucket of many chunks: each pair of its rows meets in one of the tasks."""
    monkeypatch.setattr(lines, "CHUNK_ROWS", 7)
    members = spark.createDataFrame([(1, i, 0, 99) for i in range(100)], "key long, id long, low long, high long")
    labels = spark.createDataFrame([(3, 2)], "node long, root long")
    signs = spark.createDataFrame([(i, 10, *[0] * lines.WORDS) for i in range(100)], "id long, n int, " + ", ".join(f"{w} long" for w in lines.BITMAP))
    got = [(x.a, x.b) for x in lines.crossing(members, labels, signs).collect()]
    assert len(got) == len(set(got)) == 98 * 97 // 2 - 1 and (2, 3) not in got and all(0 < a < b < 99 for a, b in got)


def test_bounds_of_near_copies(spark):
    """Long lines of one family, with repeats: all links pass the bounds, and few of the pairs that are close to a link but none."""
    r = random.Random(5)
    base = words(r, 110)[:500] + " and so on and so on and so on"
    family = []
    for i in range(60):
        line = base
        for _ in range(i % 10):
            k = r.randrange(0, 500)
            line = line[:k] + words(r, 2)[:8] + line[k + 8 :]
        family.append(line)
    family = list(dict.fromkeys(family))
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in family]
    texts = spark.createDataFrame([(i, len(sets[i]), x) for i, x in enumerate(family)], "id long, n int, line string")
    signs = lines.bitmaps(texts).persist()
    passed = {(x.a, x.b) for x in signs.alias("r").join(signs.alias("s"), (F.col("r.id") < F.col("s.id")) & lines.may_link("r", "s")).select(F.col("r.id").alias("a"), F.col("s.id").alias("b")).collect()}
    alike = {(i, j): len(s & sets[j]) / len(s | sets[j]) for i, s in enumerate(sets) for j in range(i + 1, len(sets))}
    near = [x for x, y in alike.items() if 0.65 <= y < 0.77]
    assert {x for x, y in alike.items() if y >= 0.8} <= passed
    assert len(near) > 200 and len(passed.intersection(near)) < 0.2 * len(near), (len(near), len(passed.intersection(near)))


SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz ", "digits": "0123456789-/QXZ", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыюя ", "cjk": "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经"}


@pytest.mark.parametrize("script", SCRIPTS)
def test_recall_of_foreign_tails(spark, script):
    """Pairs at similarities from 0.8 to 0.87 whose common part is mostly a boilerplate of 250 characters that all lines have; the tails are in any script."""
    r = random.Random(12)
    common = words(r, 60)[:250]
    rows = []
    while len(rows) < 400:
        own = "".join(r.choices(SCRIPTS[script], k=50))
        k, m = r.randrange(0, 30), r.randint(12, 20)
        other = own[:k] + "".join(r.choices(SCRIPTS[script], k=m)) + own[k + m :]
        s, t = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (f"{common} {own}", f"{common} {other}"))
        if 0.8 <= len(s & t) / len(s | t) <= 0.87:
            rows += [(len(rows), f"{common} {own}"), (len(rows) + 1, f"{common} {other}")]
    got = [x.doc_id for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()]
    assert all(x % 2 for x in got) and len(got) >= 0.97 * len(rows) / 2, len(got)


def test_hashes_that_collide(spark, monkeypatch):
    """Different lines with one 64-bit hash: none of them is taken for the other."""
    keep = lines.lines_of
    monkeypatch.setattr(lines, "lines_of", lambda docs: keep(docs).withColumn("id", F.when(F.col("line").startswith("clash"), F.lit(7).cast("long")).otherwise(F.col("id"))))
    rows = [(1, "clash one of these lines"), (2, "clash and quite another text"), (3, "clash one of these lines"), (4, "a line of its own"), (5, "a line of its own")]
    got = {x.doc_id: x.n_removed for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}


def test_a_line_of_every_document(spark, monkeypatch):
    """It is one row for each of its keys, so no task gets a key with all its places."""
    seen = {}
    keep = lines.written
    monkeypatch.setattr(lines, "written", lambda df, name="cut": seen.setdefault((name, len(seen)), keep(df, name)))
    monkeypatch.setattr(lines, "discard", lambda *x: None)
    rows = [(i, f"the licence line that all documents have, word for word\nown {i * 7919} words {i * 104729} of it {i}") for i in range(600)]
    got = lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").count()
    members = next(v for (name, _), v in seen.items() if name == "members")
    assert got == 599 and members.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * lines.GROUPS


def test_lines_joined_by_shuffle(spark, monkeypatch):
    """More candidate lines than are broadcast."""
    monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    rows = table(12)[:25]
    want = brute(rows)
    for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [int(i) for i in x.removed.split(",") if i] == want.get(x.doc_id, []), x


def test_ids_shared_by_different_texts(spark):
    rows = [(1, "the same line of some length\nfirst"), (1, "the same line of some length\nsecond"), (None, "the same line of some length\nthird")]
    got = sorted((x.doc_id or 0, x.n_removed) for x in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1), (1, 0), (1, 1)]


def test_empty(spark):
    assert lines.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
