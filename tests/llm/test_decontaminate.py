import random

import numpy as np
import pytest

from trailmark.llm import decontaminate, words

ITEMS = [
    (1, "A farmer named Boris has 12 sheep and sells 5 kg of wool to his neighbour Anna before Boris walks home with 12 coins in his pocket."),
    (2, "The shortest route between the harbour and the old lighthouse passes under three bridges that nobody has repaired since the flood."),
    (3, "Name the capital now"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8 9 10"),
    (6, "A farmer named Carla has 12 sheep and sells 5 kg of wool to his neighbour Denis before Carla walks home with 12 coins in his pocket."),
]
DOCS = {
    0: "",
    1: None,
    2: "before it | The shortest route between the harbour and the OLD lighthouse *** passes under three bridges, that nobody has repaired since the flood! after",
    3: "x y z A farmer named Igor has 77 sheep and sells 9 kg of wool to his neighbour Olga before Igor walks home with 77 coins in his pocket. etc",
    4: "x y z A farmer named Igor has 77 sheep and sells 9 kg of wool to his neighbour Olga before Paul walks home with 31 coins in his pocket. etc",
    5: "The shortest route between the harbour and the old mill is closed, nobody has repaired anything since the flood came",
    6: "please name the capital now, thank you",
    7: "1 2 3 4 5 6 7 8 9 10 11",
    8: "word " * 50000 + " ".join(t for _, t in ITEMS[:2]) + " word" * 1000,
    9: "prose that has nothing to do with any of the questions in the list and goes on for some more words",
}


def result(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as template", "3 as item_id")
    return decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id")).collect()


def test_items_and_reparameterised_items(spark):
    rows = [*DOCS.items(), (2, DOCS[2]), (None, DOCS[2])]
    got = result(spark, rows)
    assert len(got) == len(rows)
    found = {r.doc_id: (r.items, r.n_reparameterised) for r in got}
    assert found == {0: ([], 0), 1: ([], 0), 2: ([2], 0), 3: ([1], 1), 4: ([], 0), 5: ([], 0), 6: ([3], 0), 7: ([5], 0), 8: ([1, 2], 0), 9: ([], 0), None: ([], 0)}


def test_each_pattern_of_a_template(spark):
    """Items with equal templates whose slots repeat differently, and one without an id."""
    form = "%s has %d apples in a basket and puts them beside the %d apples that %s left on the kitchen table"
    items = [(1, "Now " + form % ("Tom", 5, 5, "Tom")), (2, "Now " + form % ("Anna", 3, 4, "Boris")), (3, "Then the old bridge over the quiet river was closed for the whole winter"), (None, "Then the old bridge over the quiet river was closed for the whole winter")]
    docs = [(1, items[0][1]), (2, items[1][1]), (3, "Now " + form % ("Olga", 8, 9, "Igor")), (4, items[2][1])]
    assert {r.doc_id: (r.items, r.n_reparameterised) for r in result(spark, docs, items)} == {1: ([1], 0), 2: ([2], 0), 3: ([2], 1), 4: ([3], 0)}
    assert [r.contaminated for r in result(spark, docs[3:], items[3:])] == [True]


def test_names_that_begin_and_items_of_slots(spark):
    """Renamed sentence starts, a heading or list before an item, and items that are mostly numbers and names."""
    form = "%s bakes %d loaves of rye bread every morning before the sun comes up. %s sells half of these loaves at the market. %s gives 3 of them to the old miller. How many loaves are left over?"
    items = [(1, form % ("Tom", 12, "Anna", "Tom")), (2, "Name the capital now"), (3, "What is 12 * 7 + 3?"), (4, "List Anna Boris Carla Denis Emil Fritz Gerda Hans Ida Jens Karl")]
    docs = [
        (1, "intro words " + form % ("Igor", 40, "Olga", "Igor")), (2, "intro words " + form % ("Igor", 40, "Olga", "Paul")), (3, "Some heading\n- Name the capital now"), (4, "so What is 12 * 7 + 3? thanks"),
        (5, "so what is 12 * 7 + 4? thanks"), (6, items[3][1].lower() + " end"), (7, items[3][1].replace("Fritz", "Felix")), (8, items[0][1]), (9, "heading\n" + items[0][1]),
    ]
    got = {r.doc_id: (r.items, r.n_reparameterised) for r in result(spark, docs, items)}
    assert got == {1: ([1], 1), 2: ([], 0), 3: ([2], 0), 4: ([3], 0), 5: ([], 0), 6: ([4], 0), 7: ([], 0), 8: ([1], 0), 9: ([1], 0)}


def test_a_common_instruction(spark, monkeypatch):
    """Documents and items that share only an instruction meet nowhere: what is written grows with documents plus items."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    common = " ".join(word() for _ in range(16))
    items = [(i, f"{common} {' '.join(word() for _ in range(24))}") for i in range(120)]
    docs = [(i, f"{' '.join(word() for _ in range(20))} {common} {' '.join(word() for _ in range(20))}") for i in range(200)]
    docs += [(1000 + i, f"{word()} {t} {word()}") for i, t in items[:5]]
    rows = {}
    keep = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name="cut": rows.setdefault(name, keep(df, name)))
    got = {x.doc_id: x["items"] for x in result(spark, docs, items)}
    assert got == {i: [] for i in range(200)} | {1000 + i: [i] for i in range(5)}
    assert rows["likely"].count() == 5 and rows["hits"].count() < 5 * 2 * 40 and rows["found"].count() < 205 * 20


def test_measured_recall_of_new_parameters(spark):
    """Items whose numbers, names and units are replaced alike are all found; where a value stands for two, none is."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    names = ["Anna", "Boris", "Carla", "Denis", "Emil", "Gerda", "Hans", "Ida", "Jens", "Karl", "Olga", "Paul"]
    forms, items, docs = {}, [], []
    for i in range(80):
        parts = [word() if r.random() < r.choice([0.6, 0.85]) else r.choice(["{a}", "{b}", "{n} {u}", "{m}"]) for _ in range(r.randint(18, 40))]
        forms[i] = f"{word()} {word()} {word()} {{n}} {word()} {{n}} " + " ".join(parts) + f" {word()} {word()}"
        values = lambda: dict(zip("ab", r.sample(names, 2), strict=True)) | {"n": r.randint(2, 99), "m": r.randint(100, 999), "u": r.choice(["kg", "miles", "hours"])}
        items.append((i, forms[i].format(**values())))
        docs.append((i, f"{word()} {word()} {forms[i].format(**values())} {word()}"))
        broken = forms[i].format(**(values() | {"n": "7"})).split(" ")
        at = [k for k, w in enumerate(broken) if w == "7"]
        broken = [str(20 + at.index(k)) if k in at else w for k, w in enumerate(broken)]  # each place another number
        docs.append((1000 + i, " ".join(broken)))
    found = {x.doc_id: set(x["items"]) for x in result(spark, docs, items)}
    assert sum(found[i] == {i} for i in range(80)) >= 0.97 * 80
    assert sum(i in found[1000 + i] for i in range(80)) == 0


def test_units_measure(spark):
    items = [(1, "put the key in the box and the box in the car before you leave the house")]
    docs = [(1, "so put the key m the box and the box m the car before you leave the house"), (2, items[0][1])]
    assert {x.doc_id: x["items"] for x in result(spark, docs, items)} == {1: [], 2: [1]}


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert [r.contaminated for r in result(spark, [(1, "some text of a document")], [])] == [False]


def test_all_planted_passages(spark, sf_dir):
    """Against a search for each item's text, spacing and case aside."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: set(r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    bench = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    for r in docs.collect():
        text = " ".join((r.text or "").lower().split())
        assert got[r.doc_id] == {i for i, t in bench.items() if t in text}


def test_words_learned_together():
    """New words are learned in one pass, numbers and sentence ends among them, as one by one; hashes of windows do not depend on the blocks they are made in."""
    new = ["plain", "Name", "USA", "5kg", "$12.5", "(3rd)", "...", "km", "seven", "end.", "'quoted.'", "a1", "²", "٣", "12:30,", "Naïve!", "x_y"]
    together, alone = decontaminate.TemplateWords(), decontaminate.TemplateWords()
    together.learn(new)
    assert [alone[w] for w in new] == [together[w] for w in new]
    assert (together.kind, together.value, together.ends) == (alone.kind, alone.value, alone.ends)
    kinds = dict(zip(new, together.kind, strict=True))
    assert [kinds[w] for w in ("plain", "Name", "USA", "5kg", "$12.5", "(3rd)", "...", "km", "٣", "a1", "²")] == [0, 3, 0, 1, 1, 1, 4, 2, 1, 0, 0]
    h = np.arange(100, dtype=np.uint64)
    want = words.windows(h, 8)
    for block in (1, 7, 93):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(words, "BLOCK", block)
            assert np.array_equal(words.windows(h, 8), want)
