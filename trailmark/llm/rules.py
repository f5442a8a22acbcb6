"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once, over the whole text. The ledger has a row for each document with its measurements and the
rules that failed as bits. A policy is a named version: the rules that count. Applying one is a
bitwise AND with the stored bits, without reading any text again, and an ablation counts the documents that
one rule alone removes by grouping on the masked bits (at most 2 ** rules groups, combined before the shuffle).

Cases: null or empty text has no words and fails ``few_words``; ratios are compared in integers, so equal sides never
fail by rounding; repeated rows have a row each; very long texts are measured whole, in vectors; other columns are ignored;
an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import letters
from .words import WordHashes, hashed, mix, windows, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "max_word_chars"]
SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"

#: Rule -> where it fails, from the measurements; a rule's place is its bit. Append only: stored bits stay valid.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "upper_case": "100 * n_upper > 50 * n_letters",
    "one_long_word": "max_word_chars > 1000",
}
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "few_letters"),
    "web-2": tuple(RULES),
}
CURRENT = "web-2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def measure(texts: list[str | None], memo: WordHashes) -> pd.DataFrame:
    rows, hashes = [], []
    for t in texts:
        t = t or ""
        words = words_of(t)
        h = hashed(words, memo)
        hashes.append(h)
        seen: set[str] = set()
        n_lines = n_dup = 0
        if "\n" in t:
            for line in t.split("\n"):
                if line.strip(SPACE):
                    n_lines += 1
                    n_dup += line in seen
                    seen.add(line)
        else:
            n_lines = int(bool(words))
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[code]
        changed = np.frombuffer("".join(c if len(c := x.lower()) == 1 else x for x in t).encode("utf-32-le", "surrogatepass"), np.uint32) if not t.isascii() and len(t.lower()) != len(t) else np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = len(max(words, key=len).decode("utf-8", "surrogatepass")) if words else 0
        longest = max([longest, *(len(w.decode("utf-8", "surrogatepass")) for w in {w for w in words if len(w) > longest})])
        rows.append((len(words), len(t) - sum(map(t.count, SPACE)), sum(map(t.count, SYMBOLS)), n_dup, 0, n_lines, int(letter.sum()), int((changed != code)[letter].sum()), longest))
    out = pd.DataFrame(rows, columns=MEASURES).astype(np.int64)
    out["n_repeat_words"] = repeated(hashes)
    return out


def repeated(hashes: list[np.ndarray]) -> list[int]:
    """Words of each text that lie in a window of three that occurs twice or more in it."""
    own = [windows(h, 3) if len(h) >= 3 else h[:0] for h in hashes]
    n = np.array([len(w) for w in own], np.int64)
    if not n.sum():
        return [0] * len(hashes)
    w = mix(np.concatenate(own) + mix(np.repeat(np.arange(len(own), dtype=np.uint64), n)))
    order = np.argsort(w, kind="stable")
    equal = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order] = np.r_[False, equal] | np.r_[equal, False]
    ends = np.cumsum(n)
    out = []
    for length, end in zip(n.tolist(), ends.tolist(), strict=True):
        t = twice[end - length : end]
        if not t.any():
            out.append(0)
            continue
        covered = np.zeros(length + 2, bool)
        for i in range(3):
            covered[i : i + length] |= t
        out.append(int(covered.sum()))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fail_bits): one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                out = measure(list(part["text"]), memo)
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, failed in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & passes(policy), "policy": F.lit(policy)})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, removed_alone): documents that fail a rule of the policy, and those that would be kept without it."""
    groups = rows.select(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[policy]]))
    each = groups.select("bits", "n", rule.alias("r"))
    count = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"), count(F.col("bits") == F.col("r.bit")).alias("removed_alone"))
