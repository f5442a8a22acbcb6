"""Ids of whole texts by the public libraries, and the bytes that each id stands for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

from .bpe import MEMO, SINGLE_SPACE, byte_symbols


#: Letters up to U+024F; any other character than these, printable ASCII and line breaks.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = re.compile(f"[^\n\x20-\x7e{LETTERS}]")
#: Runs of letters, runs of other characters, each with the space before, and line breaks; words with an apostrophe whole.
RUNS = re.compile(rf" ?[{LETTERS}]+| ?[^{LETTERS}\s]+|\s")
RUNS_WITH_APOSTROPHES = re.compile(rf" ?[^\s']*'\S*| ?[{LETTERS}]+| ?[^{LETTERS}\s]+|\s")
#: Pieces of a generation that is remembered, and that the library gets at once.
REMEMBERED, AT_ONCE = MEMO * 3 // 2, 2000


def pieces(text: str) -> list[str]:
    """The text, cut at places that no pre-token of byte-level BPE spans.

    Where white space is single, these are the places before each space, around each line break, and between letters and what is no letter
    (but for apostrophes); a single one at an end of the text is no exception. In texts with other characters or more white space only
    single spaces between two other characters count.
    """
    if not text:
        return []
    if "  " in text or " \n" in text or "\n\n" in text or "\n " in text or OTHER.search(text):
        return SINGLE_SPACE.split(text)
    return (RUNS_WITH_APOSTROPHES if "'" in text else RUNS).findall(text)


class Remembered:
    """What ``learn`` gives for pieces, in two generations of about ``most`` pieces each.

    A full generation becomes the one before, which the next replaces; what is asked for again moves on, so frequent pieces are learned once.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable], most: int):
        self.learn, self.most, self.now, self.before = learn, most, {}, {}

    def __call__(self, cut: list[list[str]]) -> dict:
        """A dictionary that has all these pieces."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        new = set().union(*cut).difference(self.now)
        fresh = new.difference(self.before)
        again = new.difference(fresh)
        self.now.update(zip(again, map(self.before.__getitem__, again), strict=True))
        fresh = list(fresh)
        self.now.update(zip(fresh, self.learn(fresh), strict=True))
        return self.now


class ByteLevel:
    """Byte-level BPE by the tokenizers library, piece by piece; pieces are remembered between calls.

    ``plain``: the strings of special tokens are text as any other; else a text that holds one is given to the library whole.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.length = np.array(list(map(len, byte_level_contents(path))), np.int64)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Remembered(self.ids_of, REMEMBERED)

    @property
    def memo(self) -> dict[str, bytes]:
        return self.known.now

    def learn(self, new: list[str]) -> None:
        self.memo.update(zip(new, self.ids_of(new), strict=True))

    def ids_of(self, new: list[str]) -> list[bytes]:
        """The ids of each piece."""
        out, width = [], self.kind.itemsize
        for begin in range(0, len(new), AT_ONCE):
            some = new[begin : begin + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([some], add_special_tokens=False, is_pretokenized=True)[0].ids, np.int64)
            data = ids.astype(self.kind).tobytes()
            # The fast call does not tell the piece of an id; its bytes do.
            want, got = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in some]), np.cumsum(self.length[ids])
            last = np.minimum(np.searchsorted(got, want), len(got) - 1)
            if np.array_equal(got[last], want) and got[-1] == want[-1]:
                ends = ((last + 1) * width).tolist()
            else:  # a vocabulary that does not give back all bytes
                words = self.library.encode(some, add_special_tokens=False, is_pretokenized=True).word_ids
                ends = (np.cumsum(np.bincount(np.array(words, np.int64), minlength=len(some))) * width).tolist()
            out += [data[low:high] for low, high in zip([0, *ends], ends, strict=False)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``kind`` each."""
        whole = [any(s in t for s in self.special) for t in texts]
        cut = [[] if w else pieces(t) for t, w in zip(texts, whole, strict=True)]
        found = self.known(cut).__getitem__
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes() if w else b"".join(map(found, p)) for t, w, p in zip(texts, whole, cut, strict=True)]


@lru_cache(maxsize=4)
def byte_level(path: str, plain: bool = False) -> ByteLevel:
    return ByteLevel(path, plain)


@lru_cache(maxsize=4)
def byte_level_contents(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {s: i for i, s in enumerate(byte_symbols())}
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    ids = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if i not in special} | special
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


@lru_cache(maxsize=4)
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def unprefixed_sentence_pieces(path: str):
    """The model without the space that it puts before a text; None if one of its pieces spans a place where ``pieces`` may cut."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentence_pieces(path)
    shown = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any(map(cut_inside, shown)):
        return None
    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    spec.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def cut_inside(piece: str) -> bool:
    """Whether ``pieces`` may cut a text inside this piece of a sentencepiece model: spaces only begin it, line breaks stand alone, letters and others do not mix."""
    rest = piece.replace("▁", " ").lstrip(" ")
    return " " in rest or "\n" in piece and len(piece) > 1 or len(pieces(rest)) > 1


@lru_cache(maxsize=4)
def sentence_piece_contents(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: a byte piece is its byte, in others U+2581 is a space."""
    model = sentence_pieces(path)
    n = model.get_piece_size()
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
