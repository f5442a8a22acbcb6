"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone, so tasks agree on it
without exchanging any. An n-gram's vector binds its letters' vectors, each permuted by its place (a
cyclic shift), by element-wise products. A document bundles the vectors of its n-grams by
adding them; a language's prototype bundles its documents. A document gets the language whose prototype has
the largest cosine with it.

Learning sums integer vectors per task and then per language and dimension, so the result does not
depend on the order of rows, and what reaches the driver is one vector for each language:
``MAX_LANGUAGES`` at most, else an error.

Cases: ``und`` and score 0 where the text is null or has no letter, or nothing was learned; equal cosines:
the alphabetically first language; null doc_id: held out and never learned from, as it has no fold; null lang: never learned from;
very long texts are counted whole; repeated rows count each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

#: Dimensions; letters of an n-gram; most languages; documents and code points that a task multiplies at once.
DIMENSIONS, GRAM, MAX_LANGUAGES, ROWS, CODE_POINTS = 1024, 3, 1000, 64, 400_000
FOLDS = 5


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def letter_vector(code: int, place: int) -> np.ndarray:
    bits = mix(np.uint64(code) * np.uint64(0x100000001B3) + mix(np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(0xA5A5)))
    return np.roll((np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1), place)


def grams(text: str | None) -> np.ndarray:
    """The n-grams of the letters in lower case, runs of other characters being one space; each as one number."""
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    code = np.where(letter, code, 32)
    code = np.r_[32, code[letter | np.r_[True, letter[:-1]]], 32]
    out = np.zeros(max(len(code) - GRAM + 1, 0), np.int64)
    for i in range(GRAM):
        out = (out << 21) | code[i : len(code) - GRAM + 1 + i]
    return out


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for i in range(GRAM):
        code, at = np.unique((codes >> (21 * (GRAM - 1 - i))) & ((1 << 21) - 1), return_inverse=True)
        out *= np.array([letter_vector(int(c), GRAM - 1 - i) for c in code], np.int8).reshape(-1, DIMENSIONS)[at]
    return out


def document_vectors(texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray]]:
    """The bundled vectors of a few documents at a time; long texts are added in parts."""
    low = 0
    while low < len(texts):
        high, total, held = low, 0, []
        while high < len(texts) and high - low < ROWS and (high == low or total < CODE_POINTS):
            held.append(grams(texts[high]))
            total += len(held[-1])
            high += 1
        out = np.zeros((high - low, DIMENSIONS))
        code = np.concatenate(held)
        row = np.repeat(np.arange(high - low), [len(x) for x in held])
        for at in range(0, len(code), CODE_POINTS):
            some, index = np.unique(code[at : at + CODE_POINTS], return_inverse=True)
            rows = row[at : at + CODE_POINTS]
            first, n = int(rows[0]), int(rows[-1] - rows[0]) + 1
            counts = np.bincount((rows - first) * len(some) + index, minlength=n * len(some)).reshape(n, -1)
            out[first : first + n] += counts.astype(np.float32) @ gram_vectors(some).astype(np.float32)
        yield slice(low, high), out
        low = high


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their bundled vectors, from the documents outside fold 0 that name a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_numpy()
            for some, vectors in document_vectors(list(batch["text"])):
                for lang in set(langs[some]):
                    total[lang] = total.get(lang, 0) + vectors[langs[some] == lang].sum(0)
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.astype(np.int64) for v in total.values()]})

    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInPandas(run, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).select("lang", "v.v").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r for r in found if any(r["v"])), key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([r["v"] for r in found], dtype=float).reshape(-1, DIMENSIONS)


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; the score is the cosine, at least 0."""
    langs, vectors = prototypes(docs if learn_from is None else learn_from)
    unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).T
    names = np.array([*langs, "und"], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs:
                for some, v in document_vectors(texts):
                    size = np.linalg.norm(v, axis=1)
                    cosine = np.round(v @ unit / np.maximum(size, 1e-12)[:, None], 12)
                    best[some] = np.where(size > 0, cosine.argmax(1), len(langs))
                    score[some] = np.where(size > 0, cosine.max(1).clip(0, 1), 0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names[best], "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predictor(docs: DataFrame):
    """A Pandas UDF text -> struct(lang_pred, score), learned from ``docs``: for adding the two to rows that keep their columns."""
    langs, vectors = prototypes(docs)
    unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).T
    names = np.array([*langs, "und"], dtype=object)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        best, score = np.full(len(text), len(langs)), np.zeros(len(text))
        if langs:
            for some, v in document_vectors([t if isinstance(t, str) else None for t in text]):
                size = np.linalg.norm(v, axis=1)
                cosine = np.round(v @ unit / np.maximum(size, 1e-12)[:, None], 12)
                best[some] = np.where(size > 0, cosine.argmax(1), len(langs))
                score[some] = np.where(size > 0, cosine.max(1).clip(0, 1), 0)
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    return predict
