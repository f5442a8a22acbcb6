"""Benchmark decontamination by template canonicalisation.

Words lose punctuation and case; numbers, units and names (capitalised words inside a sentence) become typed
placeholders. What remains of an item is its template; items with equal templates whose slots repeat alike (their pattern) stand together under the smallest item_id, and
a document is held against each pattern. Windows of
``WINDOW`` template words, at least half of them literal, are hash-joined between documents and templates. Where
a document's windows agree with a template's along one alignment, the values in the slots must agree too: each value of the
item always stands for one value in the document. Then a question that only got other numbers or names is
caught, and a sentence that merely has the same shape is not. A document is contaminated by an item if consistent
alignments cover ``COVERAGE`` of the template's windows.

A capitalised word may be a name or not where a sentence (first reading: no name) or a line (first reading: a name) begins. Windows that
hold such words stand in every combination of their readings. An alignment is judged by first readings alone, and by all; either may do.
An item without a window that is half literal matches only as a whole, with its own values, if it has a literal word or ``WINDOW`` words.

Before the join a bitmap (built from the templates' windows and sized by their number, no false negatives) lets tasks drop windows
that no template has, so only windows that probably match are ever shuffled; they carry their slot values, and the text is read once.
A document is held against an item only if it has one of the item's probes, the windows that the fewest templates share, of
which coverage asks for one at least; only then are the item's other windows looked up among the document's. So windows that very many
items share, as a common instruction, never meet all items.

Cases: null or empty text has no windows (not contaminated); items of fewer words than a window count as one window; items of fewer words without a
literal word match nothing; repeated rows have equal results; rows that share a doc_id share the result; null doc_id is never
contaminated; very long texts are scanned whole; other columns are ignored; without documents the result is empty, without items nothing is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .jaccard import id_and_text, rows_of
from .shared import written
from .words import mix, windows

#: Template words of a window; share of a template's windows to be covered; bits of the bitmap for each window, and least and most in all; characters and words that a task holds at once.
WINDOW, COVERAGE, BITS_EACH, BITMAP_BITS, CHUNK_CHARS, MEMO = 8, 0.6, 32, (1 << 16, 1 << 25), 8_000_000, 300_000
# Words that stand for numbers and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ml l litre litres liter liters gallon gallons s sec seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents mph kmh kwh watt watts volt volts degree degrees"
LITERAL, NUMBER, UNIT, NAME, DROPPED = range(5)
NUMERIC = re.compile(r"[$€£¥]?[+-]?\d[\d.,:/]*\s?%?(?:st|nd|rd|th)?")
MEASURED = re.compile(r"([$€£¥]?[+-]?\d[\d.,/]*)([A-Za-z]+)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Numbers have one.
DIGIT = re.compile(r"\d")
KIND_OF = {w: NUMBER for w in NUMBERS.split()} | {w: UNIT for w in UNITS.split()}
_U = np.uint64
HOLDER, EXACT, READ_AT_ONCE = mix(np.arange(1, 6, dtype=_U)), _U(0x5DEECE66D), 100_000


class TemplateWords(dict):
    """Raw word -> row of the tables kind, literal hash, value hash, ends a sentence. Forgets all at ``MEMO`` words."""

    def __init__(self):
        self.kind, self.value, self.ends = [], [], []

    def __missing__(self, word: str) -> int:
        self.learn([word])
        return self[word]

    def learn(self, new: Iterable[str]) -> None:
        """Adds words that are not there yet."""
        at, kinds, values, ends, kind_of, digest = len(self.kind), self.kind, self.value, self.ends, KIND_OF.get, xxhash.xxh3_64_intdigest
        for word in new:
            self[word] = at
            at += 1
            plain = word.isalpha()  # no edge, no digit, no end of a sentence
            if plain:
                core, end = word, False
            else:
                core, end = EDGE.sub("", word), word.rstrip("\"')]*#$%&|<>")[-1:] in (".", "!", "?", ":")
            low = core.lower()
            kind = kind_of(low)
            if not core:
                kind = DROPPED
            elif kind is None:
                if not plain and DIGIT.search(word) and self.numeric(word, core):
                    kind = NUMBER
                else:
                    kind = NAME if core[0].isupper() and not (len(core) > 1 and core.isupper()) else LITERAL
            kinds.append(kind)
            values.append(digest(low.encode("utf-8", "surrogatepass")))
            ends.append(end)

    @staticmethod
    def numeric(word: str, core: str) -> bool:
        if NUMERIC.fullmatch(core) or NUMERIC.fullmatch(word.lstrip("(\"'[").rstrip(".,;:!?)\"']")):
            return True
        return bool(m := MEASURED.fullmatch(core)) and KIND_OF.get(m[2].lower()) == UNIT

    def templates(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: template hashes, values, which words are slots, and which have another reading."""
        if len(self) > MEMO:
            self.clear()
            self.kind, self.value, self.ends = [], [], []
        words, firsts = [], []
        for t in texts:
            row: list[str] = []
            first = []
            for line in (t or "").splitlines():
                first.append(len(row))
                row += line.split()
            words.append(row)
            firsts.append(first)
        self.learn(set().union(*words).difference(self))
        rows = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]
        kinds, values, ends = np.array(self.kind, np.int8), np.array(self.value, _U), np.array(self.ends, bool)
        for at, first in zip(rows, firsts, strict=True):
            kind = kinds[at]
            kept = kind != DROPPED
            begins = np.r_[True, ends[at][:-1]] if len(at) else np.empty(0, bool)
            fresh = np.zeros(len(at) + 1, bool)
            fresh[first] = True
            # Dropped words do not keep the next one from beginning a sentence or line.
            fresh = np.diff(np.cumsum(fresh[:-1] | begins)[kept], prepend=0) > 0
            other = (kind == NAME)[kept] & fresh
            kind = np.where((kind == NAME) & begins, LITERAL, kind)[kept]
            measures = np.r_[False, kind[:-1] == NUMBER] if len(kind) else np.empty(0, bool)
            kind = np.where((kind == UNIT) & ~measures, LITERAL, kind)  # "in" and "m" are units after a number only
            value = values[at[kept]]
            slot = kind != LITERAL
            yield np.where(slot, HOLDER[kind], value), value, slot, other


def sums(flags: np.ndarray, n: int) -> np.ndarray:
    """How many of each window of n."""
    total = np.r_[0, np.cumsum(flags)]
    return total[n:] - total[: len(total) - n]


def window_rows(texts: list[tuple], n: int, bitmap: np.ndarray | None = None):
    """(text, place, hash, slot values (0 at literals), first reading) of the windows of n words in ``templates`` of texts, as far as half literal and in the bitmap."""
    count = [len(t[0]) for t in texts]
    start = np.r_[0, np.cumsum(count)].astype(np.int64)
    if start[-1] < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty((0, n), _U), np.empty(0, bool)
    template, value, slot, other = (np.concatenate([t[i] for t in texts]) for i in range(4))
    of = np.repeat(np.arange(len(texts)), count)
    whole = of[: len(of) - n + 1] == of[n - 1 :]
    at, h, seen = [], [], []

    def keep(rows: np.ndarray, hashes: np.ndarray, slots: np.ndarray) -> None:
        ok = 2 * slots.sum(1) <= n
        at.append(rows[ok])
        h.append(hashes[ok])
        seen.append(np.where(slots[ok], view(value, n)[rows[ok]], _U(0)))

    every = windows(template, n)
    rows = np.flatnonzero(whole & (2 * sums(slot, n) <= n) & in_bitmap(every, bitmap))
    keep(rows, every[rows], view(slot, n)[rows])
    first = len(rows)
    also, places = np.where(whole, sums(other, n), 0), np.flatnonzero(other)
    before = np.r_[0, np.cumsum(other)]
    for k in np.unique(also[also > 0]).tolist():
        found = np.flatnonzero(also == k)
        for rows in np.split(found, np.arange(READ_AT_ONCE, len(found), READ_AT_ONCE)):
            where = places[before[rows][:, None] + np.arange(k)] - rows[:, None]
            for mask in range(1, 1 << k):
                turned = where[:, [i for i in range(k) if mask >> i & 1]]
                slots, words = view(slot, n)[rows], view(template, n)[rows]
                flip = ~np.take_along_axis(slots, turned, 1)
                np.put_along_axis(slots, turned, flip, 1)
                np.put_along_axis(words, turned, np.where(flip, HOLDER[NAME], np.take_along_axis(view(value, n)[rows], turned, 1)), 1)
                hashes = row_hashes(words)
                ok = in_bitmap(hashes, bitmap)
                keep(rows[ok], hashes[ok], slots[ok])
    at = np.concatenate(at)
    return of[at], at - start[of[at]], np.concatenate(h), np.concatenate(seen), np.arange(len(at)) < first


def exact_rows(texts: list[tuple], n: int, bitmap: np.ndarray | None = None):
    """As ``window_rows``: the windows of n words with their values, as they stand."""
    own = [(mix(value ^ EXACT), value, np.zeros(len(value), bool), np.zeros(len(value), bool)) for _, value, _, _ in texts]
    return window_rows(own, n, bitmap)


def view(a: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, n)


def row_hashes(words: np.ndarray) -> np.ndarray:
    """``windows`` of each row as a whole."""
    n = words.shape[1]
    out = np.full(len(words), _U(n))
    for i in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[:, i])
    return out


def in_bitmap(h: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(h), bool)
    bit = h & _U(64 * len(bitmap) - 1)
    return (bitmap[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) != 0


def pattern_of(value: np.ndarray, slot: np.ndarray, other: np.ndarray) -> int:
    """Which words that can be slots have equal values."""
    _, first, each = np.unique(value[slot | other], return_index=True, return_inverse=True)
    return xxhash.xxh3_64_intdigest(first[each].astype(np.int64).tobytes() + other.tobytes()) - 2**63


ITEM_COLUMNS = ["template", "pattern", "item_id", "n", "at", "h", "plain", "wanted", "whole"]
ITEM_SCHEMA = pa.schema([*[(x, pa.int64()) for x in ITEM_COLUMNS[:6]], ("plain", pa.bool_()), ("wanted", pa.list_(pa.int64())), ("whole", pa.bool_())])


def item_windows(items: DataFrame) -> DataFrame:
    """(template, pattern, item_id, n, at, h, plain, whole, wanted): the windows of each template and pattern, once (``plain``: first reading; ``whole``: as they stand); ``wanted`` are the slot values of its smallest item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TemplateWords()
        for part, texts in rows_of(batches, CHUNK_CHARS):
            out: list[tuple] = []
            for item, one in zip(part.column("doc_id").to_pylist(), words.templates(texts), strict=True):
                template, value, slot, other = one
                n = min(WINDOW, len(template))
                if n:
                    key, pattern = int(windows(template, len(template))[0].view(np.int64)), pattern_of(value, slot, other)
                    _, at, h, seen, plain = window_rows([one], n)
                    as_is = not plain.any() and (not slot.all() or len(template) >= WINDOW)
                    if as_is:
                        _, at, h, seen, plain = exact_rows([one], n)
                        key = int(windows(value, len(value))[0].view(np.int64))
                    out += [(key, pattern, item, n, *x, as_is) for x in zip(at.tolist(), h.view(np.int64).tolist(), plain.tolist(), seen.view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(ITEM_COLUMNS, x, strict=True)) for x in out], schema=ITEM_SCHEMA)

    rows = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "template long, pattern long, item_id long, n long, at long, h long, plain boolean, wanted array<long>, whole boolean")
    one = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "n", "plain", "whole", "wanted")).alias("one")
    first = rows.groupBy("template", "pattern", "at", "h").agg(one).select("template", "pattern", "at", "h", "one.item_id", "one.n", "one.plain", "one.whole", "one.wanted")
    return written(first, "templates")


def bitmap_of(targets: DataFrame) -> np.ndarray:
    """A bit for each window's hash, in 64-bit words; its size follows the number of windows, within bounds."""
    n = targets.count() * BITS_EACH
    bits = min(max(1 << n.bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = targets.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast((h & 63) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(bits // 64, np.int64)
    for r in words.collect():  # a row for each word at most
        bitmap[r.w] = r.b
    return bitmap


def probed(targets: DataFrame) -> DataFrame:
    """(template, pattern, h): windows of which a document that is contaminated has one at least.

    Of N places it must cover ``COVERAGE`` * N, so it has one of any N - ceil(COVERAGE * N) + 1; those whose windows the fewest templates
    share are taken. So an instruction that all items begin with is no probe, as long as it alone does not cover enough.
    """
    c = F.col
    one = ["template", "pattern"]
    shared = targets.groupBy("h").agg(F.count("*").alias("_shared"))
    levels = F.explode(F.when(c("plain"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("level")
    rows = targets.join(shared, "h").select(*one, "at", "h", "whole", "_shared", levels)
    places = rows.groupBy(*one, "level", "at").agg(F.max("_shared").alias("_shared"), F.bool_or("whole").alias("whole"))
    by = Window.partitionBy(*one, "level")  # a row for each window of an item
    need = F.when(c("whole"), c("n")).otherwise(F.ceil(c("n") * COVERAGE - 1e-9))
    places = places.withColumns({"n": F.count("*").over(by), "k": F.row_number().over(by.orderBy("_shared", "at"))}).where(c("k") <= c("n") - need + 1)
    return rows.join(places.select(*one, "level", "at"), [*one, "level", "at"]).select(*one, "h").distinct()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, exact): the items that contaminate a document; exact if every slot has the item's own value."""
    c = F.col
    targets = item_windows(items)
    sizes = [(r.n, r.whole) for r in targets.select("n", "whole").distinct().collect()]  # 2 * WINDOW rows at most
    bitmap = bitmap_of(targets)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = TemplateWords(), shared.value.view(_U)
        for part, texts in rows_of(batches, CHUNK_CHARS):
            ids, each = np.array(part.column("doc_id").to_pylist(), np.int64), list(words.templates(texts))
            for n, whole in sizes:
                of, place, h, seen, plain = (exact_rows if whole else window_rows)(each, n, known)
                values = pa.ListArray.from_arrays(np.arange(0, (len(of) + 1) * n, n, dtype=np.int32), seen.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(place), pa.array(h.view(np.int64)), values, pa.array(plain)], ["doc_id", "place", "h", "seen", "first"])

    found = id_and_text(docs.where("doc_id is not null")).mapInArrow(run, "doc_id long, place long, h long, seen array<long>, first boolean")
    found = written(found, "found")
    one = ["template", "pattern"]
    probes = written(probed(targets), "probes")
    likely = written(found.select("doc_id", "h").distinct().join(probes, "h").select("doc_id", *one).distinct(), "likely")
    of = [*one, "level"]
    level = F.explode(F.when(c("plain") & c("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("level")
    wanted = likely.join(targets, one)
    hits = written(found.join(wanted, ["doc_id", "h"]).select("doc_id", *one, level, "whole", "item_id", "at", (c("place") - c("at")).alias("shift"), "wanted", "seen"), "hits")
    slots = hits.select("doc_id", *of, "shift", F.explode(F.arrays_zip("wanted", "seen")).alias("s")).where("s.wanted <> 0 or s.seen <> 0")
    per_value = slots.select("doc_id", *of, "shift", "s.wanted", "s.seen").groupBy("doc_id", *of, "shift", "wanted").agg(F.min("seen").alias("low"), F.max("seen").alias("high"))
    alignment = per_value.groupBy("doc_id", *of, "shift").agg(F.bool_and(c("low") == c("high")).alias("consistent"), F.bool_and((c("low") == c("high")) & (c("low") == c("wanted"))).alias("same"))
    judged = hits.join(alignment, ["doc_id", *of, "shift"], "left").where(F.coalesce("consistent", F.lit(True)))
    levels = F.explode(F.when(c("plain"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("level")
    n_windows = targets.select("template", "pattern", "at", levels).groupBy(*of).agg(F.count_distinct("at").alias("n_windows"))
    exact = F.bool_and(F.coalesce("same", F.lit(True))).alias("exact")
    covered = judged.groupBy("doc_id", *of).agg(F.min("item_id").alias("item_id"), F.bool_or("whole").alias("whole"), F.count_distinct("at").alias("covered"), exact)
    enough = covered.join(n_windows, of).where(c("covered") >= F.when(c("whole"), 1).otherwise(COVERAGE) * c("n_windows"))
    return enough.groupBy("doc_id", "template").agg(F.min("item_id").alias("item_id"), F.max(c("covered") / c("n_windows")).alias("coverage"), F.bool_or("exact").alias("exact")).drop("template")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items, n_reparameterised) per row of ``docs``; items: ids, sorted."""
    per_doc = matches(docs, items).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count_if(~F.col("exact")).alias("n_reparameterised"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per_doc, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), items, F.coalesce("n_reparameterised", F.lit(0)).alias("n_reparameterised"))
