"""Rules, language identification and BPE on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from trailmark.llm import bpe, langid, queries, rules

TEXTS = [
    None, "", " \n ", "one two", "a b c a b c d", "a a a a a", "x#y $5 %% <|endoftext|> &", "line\nline\n\nline \n \n", "É\x85b c d\x0be", "same words here " * 40,
    "UPPER CASE TEXT " * 30, "normal prose with enough words to pass the first rule " + " ".join(f"word{i}" for i in range(60)), "long" * 50000, "İstanbul ǅ ﬀ", "don't  stop\t\n\n  it's 2024", "😀 emoji 👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, "one two", "en"), (None, "no id at all", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "2 as score", "3 as ids")


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def test_rules(docs):
    rows = rules.apply_policy(rules.ledger(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute_measures(TEXTS[r.doc_id])
            failed = [n for n, e in rules.RULES.items() if eval(e, {}, r.asDict())]
            assert r.fail_bits == rules.mask(tuple(failed))
            assert r.base_failed == bool(set(failed) & set(rules.BASE)) and r.kept == (not failed)
    assert {r.doc_id for r in rows if r.kept} == {11}


def test_ablations(docs):
    ledger = rules.ledger(docs)
    rows = ledger.collect()
    for policy in rules.POLICIES:
        m = rules.mask(rules.POLICIES[policy])
        for r in rules.ablations(ledger, policy).collect():
            bit = rules.mask((r.rule,))
            assert (r.failed, r.removed_alone) == (sum(bool(x.fail_bits & bit) for x in rows), sum(x.fail_bits & m == bit for x in rows))


def test_bpe_as_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    full = {r.doc_id: r for r in bpe.encode_decode(docs, queries.vocabulary_path()).collect()}
    for r in bpe.digests(docs, queries.vocabulary_path()).collect():
        text = ("no id at all" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert full[r.doc_id].ids == ids and full[r.doc_id].decoded == decoded


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows if r.held_out]) > 0.9


def test_language_brute(spark):
    texts = {1: ("the cat and the hat", "en"), 2: ("le chat et la table", "fr"), 3: ("the dog", "en"), 4: ("12 !?", "en"), 6: ("la la", None), 7: (None, "fr"), 12: ("la table", "fr")}
    df = spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id long, text string, lang string")
    sums = {}
    vec = lambda t: langid.gram_vectors(langid.grams(t)).astype(int).sum(0)
    for i, (t, lang) in texts.items():
        if t and lang and zlib.crc32(str(i).encode()) % 5 and len(langid.grams(t)):
            sums[lang] = sums.get(lang, 0) + vec(t)
    for r in langid.identify(df).collect():
        t = texts[r.doc_id][0]
        if not t or not len(langid.grams(t)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        v = vec(t)
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(cos, key=cos.get)
        assert r.lang_pred == best and abs(r.score - cos[best]) < 1e-5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [langid.identify(empty).count(), rules.ledger(empty).count(), bpe.digests(empty, queries.vocabulary_path()).count()] == [0, 0, 0]
