"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

For the documents of a chunk, A has a row for each token of the byte-level vocabulary (A) and a column for each byte, with a one
where the token covers the byte; B is the same for the sentencepiece model (B). Both are CSR arrays built here. The product A·Bᵀ,
row by row after Gustavson (merge the rows of Bᵀ that a row of A names), has an entry for each pair of tokens that
overlap, worth the bytes that they share: the overlap links. Where tokens of both end at one byte a group ends; the product of the
incidences of tokens and groups has an entry for each pair of tokens in one group: the shared-group links. A product is
made in blocks of rows of bounded work, so a long document is not held as one product; of the second the digests take only
the number of entries (the counting pass of the product), as a group of n and m tokens has n·m.

A text is taken as a space and the text, as the second tokenizer adds one itself.
Counts over the corpus: in how many documents an id pair is linked. A first pass writes, for each document, its different pairs and how
often each occurs, packed; counts are combined in tasks, then grouped. A pair that is in very many documents (" the") would be one key for
all of them, so the most frequent pairs, ``COMMON`` at most, are broadcast as arrays, and only occurrences of others are
joined by shuffle: a pair beyond those is in at most 2 / ``COMMON`` of all links.

Cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty
``groups_sha256``; special tokens' strings are plain text; rows that repeat a doc_id, or have none, are documents each, and each counts; ties for
the highest count of an A id are all best; other columns are ignored; very long texts are whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks, without_collector
from .shared import written
from .tokens import Remembered, byte_level, byte_level_contents, pieces, sentence_piece_contents, sentence_pieces, unprefixed_sentence_pieces

#: Characters aligned together; multiplications of a block of a product; pairs that are broadcast at most (16 bytes each).
CHUNK_CHARS, BLOCK, COMMON = 1_000_000, 4_000_000, 1 << 18
#: Pieces of text whose ids by both tokenizers a generation of the memory holds.
REMEMBERED = 200_000


class Csr(NamedTuple):
    """A matrix of zeros and ones by rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def entries(a: Csr, b: Csr) -> np.ndarray:
    """The counting pass of a product: how many multiplications each row of ``a`` takes."""
    work = np.r_[0, np.cumsum(b.starts[a.columns + 1] - b.starts[a.columns])]
    return work[a.starts[1:]] - work[a.starts[:-1]]


def product(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of a·b, in order, in blocks of rows of about ``block`` multiplications."""
    work = entries(a, b)
    for low, high in chunks(work.tolist(), block) if work.sum() > block else [(0, len(work))] if len(work) else []:
        columns = a.columns[a.starts[low] : a.starts[high]]
        row = np.repeat(np.arange(low, high), a.starts[low + 1 : high + 1] - a.starts[low:high])
        n = b.starts[columns + 1] - b.starts[columns]
        row, column = np.repeat(row, n), b.columns[spread(b.starts[columns], n)]
        if len(row) and not np.all((row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (column[1:] >= column[:-1]))):
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])][: len(row)])
        yield row[first], column[first], np.diff(np.r_[first, len(row)])


def transposed(a: Csr, n_columns: int) -> Csr:
    rows = np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts))
    order = np.argsort(a.columns, kind="stable")
    return Csr(np.r_[0, np.cumsum(np.bincount(a.columns, minlength=n_columns))], rows[order])


class Aligned(NamedTuple):
    """Documents in a row: token ids, the token-byte and token-group matrices, and where each document's tokens and groups begin."""

    a: np.ndarray
    b: np.ndarray
    a_bytes: Csr
    bytes_b: Csr
    a_groups: Csr
    groups_b: Csr
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray


def align(a: list[np.ndarray], b: list[np.ndarray], length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """``a``, ``b``: the ids of each document, of equally many bytes in sum."""
    first_a, first_b = (np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)] for ids in (a, b))
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (a, b))
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    n = int(ends_a[-1]) if len(ends_a) else 0
    a_bytes = Csr(np.r_[0, ends_a], np.arange(n))  # a token covers neighbouring bytes, so the columns of all rows are all bytes in order
    bytes_b = Csr(np.arange(n + 1), np.repeat(np.arange(len(ids_b)), length_b[ids_b]))  # of B the transposed: one token for each byte
    both = np.zeros(n + 1, bool)
    both[ends_a] = True
    cut = np.zeros(n + 1, bool)
    cut[ends_b] = True
    ends = np.flatnonzero(both & cut)  # where a document ends, both do
    group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
    a_groups = Csr(np.arange(len(ids_a) + 1), group_a)
    groups_b = transposed(Csr(np.arange(len(ids_b) + 1), group_b), len(ends))
    return Aligned(ids_a, ids_b, a_bytes, bytes_b, a_groups, groups_b, first_a, first_b, np.r_[0, np.searchsorted(ends, np.r_[0, ends_a][first_a[1:]], "right")] if len(a) else np.zeros(1, np.int64))


class Tokenizers:
    """Both tokenizers. Ids of each text: empty ones where the text is empty or one of them does not give back its bytes.

    Texts are cut into pieces that no token of either spans, and the ids of a piece by both are remembered. A text with a piece whose
    bytes are not given back goes to both libraries whole, and so do all if the second vocabulary has tokens that span such places.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.b_of_pieces = byte_level(path_a, plain=True), sentence_pieces(path_b), unprefixed_sentence_pieces(path_b)
        self.bytes_a, self.bytes_b = byte_level_contents(path_a), sentence_piece_contents(path_b)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.shown = [s + mark for mark in ",|;" for s in self.shown]
        self.known = Remembered(self.learn, REMEMBERED)

    def given_back(self, text: str, a: list[int], b: list[int]) -> bool:
        want = text.encode()
        return b"".join(map(self.bytes_b.__getitem__, b)) == want and b"".join(map(self.bytes_a.__getitem__, a)) == want

    def all_given_back(self, new: list[str], a: list[bytes], b: list[bytes]) -> bool:
        """Whether the bytes of every piece are given back by both: as one text, and each ends where it should."""
        data = list(map(str.encode, new))
        want, ends = b"".join(data), np.cumsum(list(map(len, data)))
        for ids, kind, contents, length in ((a, self.a.kind, self.bytes_a, self.length_a), (b, np.dtype(np.uintc), self.bytes_b, self.length_b)):
            flat = np.frombuffer(b"".join(ids), kind)
            got = np.r_[0, np.cumsum(length[flat])][np.cumsum(list(map(len, ids))) // kind.itemsize]
            if not np.array_equal(got, ends) or b"".join(map(contents.__getitem__, flat.tolist())) != want:
                return False
        return True

    def learn(self, new: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each piece by both; None where its bytes are not given back."""
        if not new:
            return []
        found = self.b_of_pieces.encode(new, num_threads=1)
        a, b = self.a.ids_of(new), [array("I", ids).tobytes() for ids in found]
        if self.all_given_back(new, a, b):
            return list(zip(a, b, strict=True))
        return [(x, y) if self.given_back(p, np.frombuffer(x, self.a.kind).tolist(), ids) else None for p, x, y, ids in zip(new, a, b, found, strict=True)]

    def whole(self, text: str) -> tuple[bytes, bytes]:
        a, b = self.a([" " + text])[0], self.b.encode([text], num_threads=1)[0]
        return (a, array("I", b).tobytes()) if text and self.given_back(" " + text, np.frombuffer(a, self.a.kind).tolist(), b) else (b"", b"")

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        out: tuple[list, list] = ([], [])
        cut = [pieces(" " + t) if t and self.b_of_pieces else [] for t in texts]
        found = self.known(cut).__getitem__
        for text, some in zip(texts, cut, strict=True):
            ids = list(map(found, some))
            a, b = map(b"".join, zip(*ids, strict=True)) if ids and None not in ids else self.whole(text or "")
            out[0].append(np.frombuffer(a, self.a.kind).astype(np.int64))
            out[1].append(np.frombuffer(b, np.uintc).astype(np.int64))
        return out

    def groups_shown(self, x: Aligned) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document: every id takes its place behind the tokens of both sides before it."""
        k, n = len(self.shown) // 3, len(x.a) + len(x.b)
        sides, group_b = x.groups_b.starts, np.repeat(np.arange(len(x.groups_b.starts) - 1), np.diff(x.groups_b.starts))
        count_a = np.bincount(x.a_groups.columns, minlength=len(sides) - 1)
        code = np.zeros(n, np.int64)
        last_a, last_b = np.r_[np.diff(x.a_groups.columns) != 0, True][: len(x.a)], np.r_[np.diff(group_b) != 0, True][: len(x.b)]
        code[np.arange(len(x.a)) + sides[x.a_groups.columns]] = x.a + k * last_a
        code[np.arange(len(x.b)) + np.cumsum(count_a)[group_b]] = x.b + 2 * k * last_b
        shown = list(map(self.shown.__getitem__, code.tolist()))
        first = (x.first_a + x.first_b).tolist()
        return ["".join(shown[low:high])[:-1] for low, high in zip(first, first[1:], strict=False)]


def aligned(batches: Iterator[pd.DataFrame], paths: tuple[str, str]) -> Iterator[tuple[pd.DataFrame, Tokenizers, Aligned]]:
    """The rows of a chunk and their alignment."""
    both = Tokenizers(*paths)
    for batch in without_collector(batches):
        for low, high in chunks([len(t or "") for t in batch["text"]], CHUNK_CHARS):
            some = batch.iloc[low:high]
            a, b = both(some["text"].tolist())
            yield some, both, align(a, b, both.length_a, both.length_b)


def rows_of(docs: DataFrame) -> DataFrame:
    """A number for each row; whole numbers as text, to stay exact beside nulls."""
    doc_id, text = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def long_ids(x: pd.Series) -> pd.Series:
    return pd.Series([None if i == "" else int(i) for i in x], dtype="Int64")


def links(docs: DataFrame, path_a: str, path_b: str, shared: bool = False) -> DataFrame:
    """(doc_id, row, a_place, b_place, a_id, b_id, shared): every link of the documents, in blocks; the last column is the bytes that both cover.

    With ``shared`` the shared-group links instead; a group of n and m tokens has n·m of them, each worth 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, _, x in aligned(batches, (path_a, path_b)):
            ids, numbers = long_ids(some["doc_id"]), some["row"].to_numpy()
            for a, b, value in product(x.a_groups, x.groups_b) if shared else product(x.a_bytes, x.bytes_b):
                doc = np.searchsorted(x.first_a, a, "right") - 1
                yield pd.DataFrame({"doc_id": ids.iloc[doc].reset_index(drop=True), "row": numbers[doc], "a_place": a - x.first_a[doc], "b_place": b - x.first_b[doc], "a_id": x.a[a], "b_id": x.b[b], "shared": value})

    return rows_of(docs).mapInPandas(run, "doc_id long, row long, a_place long, b_place long, a_id long, b_id long, shared long")


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times) per row; pairs and times packed as unsigned 64-bit and 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, both, x in aligned(batches, (path_a, path_b)):
            n, k = len(some), len(both.bytes_b)
            n_links, found = np.zeros(n, np.int64), []
            for a, b, _ in product(x.a_bytes, x.bytes_b):
                doc = np.searchsorted(x.first_a, a, "right") - 1
                n_links += np.bincount(doc, minlength=n)
                key, times = np.unique((doc * len(both.bytes_a) + x.a[a]) * k + x.b[b], return_counts=True)
                found.append((key, times))
            key, times = merged(found)
            size = len(both.bytes_a) * k
            cuts = np.searchsorted(key, np.arange(n + 1) * size).tolist()
            pair, times = (key % size).astype("<u8"), times.astype("<u4")
            shared = np.r_[0, np.cumsum(entries(x.a_groups, x.groups_b))][x.first_a]
            shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in both.groups_shown(x)]
            yield pd.DataFrame({
                "row": some["row"].to_numpy(), "doc_id": long_ids(some["doc_id"]), "n_a": np.diff(x.first_a), "n_b": np.diff(x.first_b), "n_groups": np.diff(x.first_group), "n_links": n_links,
                "n_shared": np.diff(shared), "groups_sha256": shas, "pairs": [pair[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], "times": [times[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)],
            })

    return rows_of(docs).mapInPandas(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs binary, times binary")


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several blocks and how often each occurs in all."""
    if len(found) == 1:
        return found[0]
    key = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
    times = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, times, len(key)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each id pair is linked; a pair is its A id times the number of B ids, plus its B id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, n = np.unique(np.frombuffer(b"".join(batch["pairs"]), "<u8"), return_counts=True)
            yield pd.DataFrame({"pair": key.astype(np.int64), "n": n})

    return written(rows.select("pairs").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def with_best(counted: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): whether that is the most for its A id. A key here is an id of A: it has a row for each id of B at most."""
    c = F.col
    counted = counted.withColumn("a_id", F.expr(f"pair div {n_b}"))
    most = counted.groupBy("a_id").agg(F.max("n").alias("most"))
    return counted.join(most, "a_id").select("pair", "n", (c("n") == c("most")).alias("best"))


def common_from(counted: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs are in so many documents or more; from a histogram of at most 64 rows."""
    bins = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("bin")).agg(F.count("*").alias("k")).collect()
    least, held = max((r["bin"] for r in bins), default=0) + 1, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["k"]
        if held > most:
            break
        least = r["bin"]
    return 1 << least


def digests(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared) per row."""
    c, spark = F.col, docs.sparkSession
    rows = written(measured(docs, path_a, path_b), "aligned")
    counted = pair_counts(rows)
    rated = written(with_best(counted, len(sentence_piece_contents(path_b))), "rated")
    least = common_from(counted, common)
    top = rated.where(c("n") >= least).select("pair", "n", "best").toPandas().sort_values("pair")  # at most ``common`` rows
    held = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def occurrences(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair and times of all occurrences in a batch; the place of each among the common pairs, and whether it is there."""
        pair, times = np.frombuffer(b"".join(batch["pairs"]), "<u8").astype(np.int64), np.frombuffer(b"".join(batch["times"]), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(batch)), [len(p) // 8 for p in batch["pairs"]])
        known = held.value[0]
        if not len(known):
            return row, pair, times, np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        return row, pair, times, at, known[at] == pair

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, n, best = held.value
        for batch in batches:
            row, _, times, at, hit = occurrences(batch)
            row, times, at = row[hit], times[hit], at[hit]
            sums = np.zeros(len(batch), np.int64)
            np.add.at(sums, row, times * n[at])
            bests = np.zeros(len(batch), np.int64)
            np.add.at(bests, row, times * best[at])
            yield pd.DataFrame({"row": batch["row"].to_numpy(), "best_here": bests, "sum_here": sums})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, pair, times, _, hit = occurrences(batch)
            yield pd.DataFrame({"row": batch["row"].to_numpy()[row[~hit]], "pair": pair[~hit], "times": times[~hit]})

    packed = rows.select("row", "pairs", "times")
    rest = packed.mapInPandas(others, "row long, pair long, times long").join(rated.where(c("n") < least).select("pair", "n", "best"), "pair")
    rest = rest.select("row", F.when(c("best"), c("times")).otherwise(F.lit(0)).alias("best_here"), (c("times") * c("n")).alias("sum_here"))
    here = packed.mapInPandas(summed, "row long, best_here long, sum_here long")
    sums = here.unionByName(rest).groupBy("row").agg(F.sum("best_here").alias("n_best"), F.sum("sum_here").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
