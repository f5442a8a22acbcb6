"""Alignment of two tokenizers against loops over bytes."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trailmark.llm import alignment
from trailmark.llm.alignment import Csr, product, transposed
from trailmark.llm.bpe import byte_symbols
from trailmark.llm.queries import QUERIES, vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


def dense(m, n):
    out = np.zeros((len(m.starts) - 1, n), int)
    for i in range(len(out)):
        np.add.at(out[i], m.columns[m.starts[i] : m.starts[i + 1]], 1)
    return out


def csr(x):
    return Csr(np.r_[0, np.cumsum(x.sum(axis=1))], np.nonzero(x)[1])


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_product(block):
    rng = np.random.default_rng(1)
    for n, k, m in [(5, 6, 7), (1, 1, 1), (30, 20, 10), (4, 0, 3)]:
        a, b = (rng.random((n, k)) < 0.3).astype(int), (rng.random((k, m)) < 0.3).astype(int)
        got = np.zeros((n, m), int)
        for i, j, v in product(csr(a), csr(b), block):
            got[i, j] += v
        assert (got == a @ b).all()
        assert (dense(transposed(csr(a), k), n) == a.T).all()


def tokens(text):
    """Pieces of both tokenizers as (id, bytes), or none."""
    library = tokens.a
    ids_a, ids_b = library.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    back = {s: i for i, s in enumerate(byte_symbols())}
    a = [(i, bytes(back[c] for c in tokens.names[i])) for i in ids_a]
    b = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()) for i in ids_b for p in [tokens.b.id_to_piece(i)]]
    want = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


tokens.a = Tokenizer.from_file(A)
tokens.a.encode_special_tokens = True
tokens.b = SentencePieceProcessor(model_file=B)
with open(A) as f:
    tokens.names = {i: s for s, i in json.load(f)["model"]["vocab"].items()}


def brute(rows):
    docs = []
    for doc_id, text in rows:
        a, b = tokens(text or "")
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, data in side:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low, shared = [], 0, 0
        for end in ends:
            left, right = ([str(x[0]) for x in side if low < x[2] <= end] for side in spans)
            groups.append(",".join(left) + "|" + ",".join(right))
            shared += len(left) * len(right)
            low = end
        docs.append((doc_id, a, b, groups, links, shared))
    counts = Counter(p for d in docs for p in set(d[4]))
    most: dict = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", shared)
        for i, a, b, groups, links, shared in docs
    ]


ROWS = [
    (1, "The quick brown fox"), (2, "The quick brown fox"), (3, None), (4, ""), (5, "naïve 中文 emoji 🙂🙃 done"), (6, "a  b\n\n\tc   "), (7, "<|endoftext|> </s> <unk> <0x41>"), (8, "▁ low bar"),
    (9, "x" * 5000 + " " + "ab" * 3000), (10, " leading"), (11, "The fox​ quick   é"), (None, "no id fox"), (1, "The same id"), (12, "1234567890 3.14159 under_score snake_case_name"),
]
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]


@pytest.mark.parametrize("common", [0, 40, alignment.COMMON])
def test_small(spark, common):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as row", "2 as pair", "3 as n")
    got = [tuple(r[n] for n in NAMES) for r in alignment.digests(docs, A, B, common).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)


def test_links(spark):
    docs = spark.createDataFrame(ROWS[:7], "doc_id long, text string")
    overlap = {i: [] for i, _ in ROWS[:7]}
    for r in alignment.links(docs, A, B).collect():
        overlap[r.doc_id].append((r.a_place, r.b_place, r.a_id, r.b_id, r.shared))
    in_group = Counter(r.doc_id for r in alignment.links(docs, A, B, shared=True).collect())
    for row, want in zip(ROWS[:7], brute(ROWS[:7]), strict=True):
        a, b = tokens(row[1] or "")
        ends_a, ends_b = (np.cumsum([len(x) for _, x in side]) for side in (a, b))
        pairs = []
        for i, (x, data) in enumerate(a):
            for j, (y, other) in enumerate(b):
                n = min(ends_a[i], ends_b[j]) - max(ends_a[i] - len(data), ends_b[j] - len(other))
                if n > 0:
                    pairs.append((i, j, x, y, n))
        assert sorted(overlap[row[0]]) == pairs and len(pairs) == want[4] and in_group[row[0]] == want[8]


def test_empty(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    whole = QUERIES["op13_token_alignment"](spark, sf_dir).collect()
    assert len(whole) == len(docs)
    short = [d for d in docs if len(d[1] or "") < 1500]
    got = [tuple(r[n] for n in NAMES) for r in alignment.digests(spark.createDataFrame(short, "doc_id long, text string"), A, B).collect()]
    assert sorted(got) == sorted(brute(short))
    by_id, alone = {r.doc_id: r for r in whole}, {g[0]: g for g in got}
    assert all((by_id[i].n_links, by_id[i].groups_sha256) == (alone[i][4], alone[i][7]) and by_id[i].count_sum >= alone[i][6] for i in alone)


def test_pieces_are_encoded_once_by_both_and_as_in_whole_texts():
    """Neither library gets a known piece again; cuts, odd characters and texts that are not given back make no difference to whole texts."""
    both = alignment.Tokenizers(A, B)
    asked: list[str] = []

    class Spy:
        def encode(self, texts, **options):
            asked.extend(texts)
            return tokens.b.encode(texts, **options)

    known, whole = both.b_of_pieces, both.b
    assert known is not None  # no token of this vocabulary spans a cut
    texts = ["One, two; don't stop.", " two  spaces\n and\nlines ", "naïve 中文 é  x", "a▁b", "<s> </s> [INST]", "3.14 (x)\t\x00", "'s", "", None]
    a, b = both(texts)
    for text, x, y in zip(texts, a, b, strict=True):
        ids_a, ids_b = both.a.library.encode(" " + (text or ""), add_special_tokens=False).ids, whole.encode(text or "")
        assert (x.tolist(), y.tolist()) == ((ids_a, ids_b) if text and both.given_back(" " + text, ids_a, ids_b) else ([], []))
    both.b = both.b_of_pieces = Spy()
    again = both(texts[:3])
    assert asked == [] and all(np.array_equal(p, q) for p, q in zip(again[1], b[:3], strict=True))
