"""The pipeline against plain Python over the same documents."""

import hashlib
import os
import random
import sys
from pathlib import Path

import corpus_pipeline
from trailmark.llm import langid, queries

sys.path.insert(0, str(Path(__file__).parent))
import test_jaccard  # noqa: E402
import test_lines  # noqa: E402


def test_against_plain_python(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")  # a small fixture for the brute force
    docs = docs.union(spark.createDataFrame([(9000, "12 !!", "en", "s", 5), (9001, None, "en", "s", 0)], docs.schema))
    kept, tables = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, sf_dir))
        tables[name] = kept
        if name != "bpe":
            assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert {r.doc_id for r in tables["language_id"].collect()} == {i for i, _ in rows}
    gone = test_lines.brute(rows)
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), t) for i, t in rows]
    rows = [(i, t) for i, t, old in cut if t.strip() or not gone[i]]
    assert {r.doc_id: r.text for r in tables["line_dedup"].collect()} == dict(rows)
    root = test_jaccard.brute(rows)
    rows = [(i, t) for i, t in rows if root[i][1] == i]
    assert {r.doc_id for r in tables["ngram_jaccard"].collect()} == {i for i, _ in rows}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in " ".join(t.lower().split()) for x in items)]
    assert {r.doc_id for r in tables["decontaminate"].collect()} == {i for i, _ in rows}
    tok = Tokenizer.from_file(queries.vocabulary_path())
    want = {i: hashlib.sha256(",".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.ids_sha256 for r in kept.collect()} == want


def test_clean_documents_stay(spark):
    text = "The %s committee met on Tuesday and agreed that the bridge near mill number %d should be repaired before winter comes to valley %s."
    rows = [(i, text % ("".join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11)), i * 37, "".join(chr(97 + (i * k) % 26) for k in (9, 15, 17))), "en") for i in range(3)]
    docs = spark.createDataFrame([(i, t + f" extra words number {i} " + " ".join(f"{chr(97 + i)}{k}x" for k in range(60)), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert corpus_pipeline.known_language(spark, docs, "").count() == 3
    assert corpus_pipeline.first_lines(spark, docs, "").count() == 3
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 3
    assert langid.FOLDS == 5


def test_rows_without_an_id_of_their_own(spark):
    """Clean texts that share a doc_id or have none stay; near copies and repeated rows go, whatever their ids."""
    text = {k: " ".join(f"{k}{i}word" for i in range(60)) for k in "abcdefg"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["c"]), (3, text["c"] + " end"), (None, text["d"]), (None, text["e"]), (None, text["e"] + " end"), (None, text["c"]), (4, text["f"])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    want = [(1, text["a"]), (1, text["b"]), (2, text["c"]), (4, text["f"]), (None, text["d"]), "e"]
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want) and set(want[:-1]) < set(got) and sum(i is None and t.startswith(text["e"]) for i, t in got) == 1
    assert len(corpus_pipeline.one_of_each_group(spark, docs.where("doc_id is null"), "").collect()) == 3


def test_odd_tables(spark, sf_dir):
    """Repeated rows, null ids, nulls in all columns, a very long text, names that the stages use, and no rows at all."""
    r = random.Random(3)
    prose = [" ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(80)) for _ in range(5)]
    long = " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(60_000))
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[1]), (None, prose[2]), (None, None), (3, ""), (4, "12 34"), (5, long), (6, prose[3] + "\n" + prose[1]), (7, prose[1]), (2, prose[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.selectExpr("doc_id", "text", "'en' as lang", "1 as _key", "2 as _language", "3 as _emptied", "4 as _hash", "5 as removed", "cast(null as string) as component_id", "6 as key", "7 as n")
    for source in (clash, clash.where("false")):
        kept = source
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.written(stage(spark, kept, sf_dir))
            if name != "bpe":
                assert kept.columns == clash.columns
        got = sorted(((x.doc_id or 0), x.n_tokens > 0) for x in kept.collect())
        assert got == ([(0, True), (1, True), (2, True), (2, True), (5, True), (6, True)] if source is clash else [])


def test_a_stage_is_deleted_once_the_next_is_written(spark, tmp_path, monkeypatch):
    """The tables of all stages stayed on the disk until the session ended; now there are two at most, and the one the last stage reads stays."""
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made, old = [], corpus_pipeline.written

    def written(df, name):
        out = old(df, name)
        made.append(out)
        return out

    monkeypatch.setattr(corpus_pipeline, "written", written)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, docs, d: docs.select("*")) for name in ("one", "two", "three", "four")])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 2]
    assert [os.path.exists(df.written_to.removeprefix("file:")) for df in made] == [False, False, True]
