"""BPE encoding and decoding through an index of pair occurrences.

Each task gathers texts, cuts them into pre-tokens and keeps one copy of each distinct pre-token.
All their symbols form one array with links to the neighbours. The index maps every adjacent pair
that has a rank to all its positions. Ranks are applied in ascending order: a rank's positions
are merged left to right and the lists of the pairs that arise are extended. A merge only makes
pairs of later ranks, so each rank is visited once.

Cases: null text is empty text (no ids, empty decoded text); a special token's string in a text
becomes its id, as in the library; very long texts and words stay whole (work is linear in their
length times the logarithm of the ranks in play); other columns are passed by name only, so
clashing names do not matter; repeated rows give repeated results; of equal ranks (places of one pair)
the leftmost is merged first, so overlapping places do not tie; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text before merges in byte-level BPE of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of text that are encoded together, and pre-tokens that a task remembers.
CHUNK_CHARS, MEMO = 8_000_000, 200_000
#: White space beside white space or at an end; a space that pieces begin with.
SPACES, SINGLE_SPACE = re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S)(?= \S)")
#: Above every id: two ids make one number.
PAIR = 1 << 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [ids[s] for s in symbols]
        back = {s: i for i, s in enumerate(symbols)}
        self.content = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.content |= {i: s.encode() for s, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left], ids[right]] = (rank, ids[left + right])
        pairs = sorted((a * PAIR + b, r) for (a, b), (r, _) in self.ranks.items())
        self.pair_keys, self.pair_ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)
        self.by_rank = {r: (pair, new) for pair, (r, new) in self.ranks.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of each word, by one pass over the ranks that occur in any of them; a rank's merges are done at once."""
    if not words:
        return []
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    raw = np.frombuffer(b"\0".join([*data, b""]), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, data), dtype=np.int64, count=len(data)) + 1) - 1
    symbol = v.byte_ids[raw]
    symbol[ends] = -1  # no pair spans two words
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        """Extends the lists of the pairs that begin at ``at``, as far as they have a rank."""
        left, right = symbol[at], symbol[after[at]]
        key = left * PAIR + right
        found = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        hit = (v.pair_keys[found] == key) & (left >= 0) & (right >= 0)
        at, rank = at[hit], v.pair_ranks[found[hit]]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(heap, r)

    add(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        (left, right), new = v.by_rank[rank]
        lists = index.pop(rank)
        at = np.sort(np.concatenate(lists) if len(lists) > 1 else lists[0])
        at = at[np.r_[True, at[1:] != at[:-1]]]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]  # else an earlier merge took one of the two
        if left == right and len(at) > 1:  # in a run, take every other pair from the left
            run_start = np.r_[True, after[at[:-1]] != at[1:]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = new, -2
        after[at] = after[gone]
        before[after[at]] = at  # a word ends with -1, so there is a next place
        behind = before[at]
        add(np.concatenate([at, behind[behind >= 0]]))
    kept = symbol[symbol != -2]
    cuts, ids = np.flatnonzero(kept == -1).tolist(), kept.tolist()
    return [ids[low:high] for low, high in zip([0, *(c + 1 for c in cuts)], cuts, strict=False)]


class Encoder:
    """Encodes the texts of a task, piece by piece; remembers at most about ``MEMO`` pieces between its calls.

    A piece ends before a single space between two other characters: no pre-token spans that place,
    so the pre-tokens of the pieces are those of the text.
    """

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.text_of = {i: str(i) for i in self.v.content}
        self.memo: dict[str, tuple[int, str, bytes, list[int]]] = {}

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or SPACES.search(text):
            return SINGLE_SPACE.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def learn(self, new: list[str]) -> None:
        """Puts into the memo, for each piece: the number of ids, the ids as text, what they decode to, the ids."""
        v = self.v
        findall, cut = v.split.findall, []
        for p in new:
            if p[1:].isalpha() and p[0] == " ":
                cut.append((p,))
            elif v.special and v.cut.search(p):
                cut.append(self.around_special(p))
            else:
                cut.append(findall(p))
        words = list(set().union(*cut))
        text, content = self.text_of, v.content
        known = {}
        for w, ids in zip(words, encode_words([w if isinstance(w, str) else "" for w in words], v), strict=True):
            ids = ids if isinstance(w, str) else [w]
            known[w] = (len(ids), ",".join([text[i] for i in ids]), b"".join([content[i] for i in ids]), ids)
        memo = self.memo
        for p, parts in zip(new, cut, strict=True):
            if len(parts) == 1:
                memo[p] = known[parts[0]]
            else:
                n, shown, data, ids = zip(*[known[w] for w in parts], strict=True)
                memo[p] = (sum(n), ",".join(shown), b"".join(data), [i for x in ids for i in x])

    def around_special(self, piece: str) -> list[str | int]:
        """Pre-tokens and ids of special tokens of a piece."""
        v, parts, at = self.v, [], 0
        for m in v.cut.finditer(piece):
            parts += v.split.findall(piece[at : m.start()])
            parts.append(v.special[m[0]])
            at = m.end()
        return parts + v.split.findall(piece[at:])

    def __call__(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes, list[int]]]]:
        """For each text what ``learn`` found of its pieces, in order."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        cut = list(map(self.pieces, texts))
        self.learn(list(set().union(*cut) - self.memo.keys()))
        for pieces in cut:
            yield list(map(self.memo.__getitem__, pieces))


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in sum, at least a row each."""
    low, total = 0, 0
    for i, n in enumerate(sizes):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def without_collector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches, with the cyclic collector off until they end: millions of small objects without cycles, its passes would take a third of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


def encode_decode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids, decoded) per row of ``docs``: the ids of the whole text, and the text decoded from those ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocab_path)
        for batch in without_collector(batches):
            texts = ["" if t is None else t for t in batch["text"]]
            for low, high in chunks([len(t) for t in texts], CHUNK_CHARS):
                docs_ = list(encode(texts[low:high]))
                ids = [[i for p in doc for i in p[3]] for doc in docs_]
                decoded = [b"".join([p[2] for p in doc]).decode("utf-8", "replace") for doc in docs_]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[low:high].to_numpy(), "ids": ids, "decoded": decoded})

    return id_and_text(docs).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; ids and decoded text never leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocab_path)
        for batch in without_collector(batches):
            texts = ["" if t is None else t for t in batch["text"]]
            rows = []
            for low, high in chunks([len(t) for t in texts], CHUNK_CHARS):
                for doc in encode(texts[low:high]):
                    text = b"".join([p[2] for p in doc]).decode("utf-8", "replace")
                    ids = ",".join([p[1] for p in doc])
                    rows.append((sum([p[0] for p in doc]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return id_and_text(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
