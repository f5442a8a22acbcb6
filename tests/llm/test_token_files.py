"""Elias-Fano files: against plain lists, and the whole round trip against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import token_files
from trailmark.llm.queries import QUERIES, vocabulary_path
from trailmark.llm.token_files import EliasFano, Shard


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**20), st.integers(0, 2**40)), max_size=900), st.data())
def test_any_sequence(steps, data):
    values = np.cumsum(np.array(steps, np.uint64)).astype(np.int64)
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert [coded[i] for i in range(len(values))] == values.tolist()
    low = data.draw(st.integers(0, len(values)))
    high = data.draw(st.integers(low, len(values)))
    assert coded.range(low, high).tolist() == values[low:high].tolist()
    if len(values):
        wanted = int(values[low - 1]) if low else 0
        assert coded.place_of(wanted) == int(np.searchsorted(values, wanted, "right"))


def test_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.5


def expected(rows, end=0):
    library = Tokenizer.from_file(vocabulary_path())
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, ids))
        at += len(ids)
    return out


LONG = "word  and\tmore é中文 " * 30_000
ROWS = [(None, "no id"), (-7, "below zero"), (0, None), (1, ""), (2, "a b  c\n\n d <|endoftext|> e"), (2**62, " far"), (5, LONG), (6, "same"), (6, "same"), (9, "▁ x<|endoftext|>")]


@pytest.mark.parametrize("shard_ids", [1, 20, token_files.SHARD_IDS])
def test_round_trip(spark, shard_ids):
    docs = spark.createDataFrame(ROWS[::-1], "doc_id long, text string").selectExpr("*", "'x' as path", "1 as part", "2 as digest")
    files = token_files.write_shards(docs, vocabulary_path(), shard_ids=shard_ids)
    want = expected(sorted(ROWS, key=lambda r: (r[0] is not None, r[0])))
    got = sorted(((r.doc_id, r.start, list(r.ids)) for r in token_files.read_documents(files).collect()), key=lambda r: r[1])
    assert got == want
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(files).collect())
    assert rows == [(at, i, len(ids), crc(ids)) for i, at, ids in want]
    for f in files.collect():
        with Shard(f.path) as shard:
            for i in range(shard.n_docs):
                low, high = shard.bounds(i)
                assert (shard.doc_id(i), low + f.base, shard.ids(low, high).tolist()) in want
                assert shard.document_at(low) == shard.document_at(high - 1) == i


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.digests(token_files.write_shards(docs, vocabulary_path())).count() == 0


def test_broken_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    path = token_files.write_shards(docs, vocabulary_path(), folder=f"file://{tmp_path}").first().path
    data = open(path[7:], "rb").read()
    open(path[7:], "wb").write(data[:-1])
    with pytest.raises(ValueError, match="incomplete"):
        Shard(path)


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op11_elias_fano"](spark, sf_dir).collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert rows == [(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in expected(docs)]
