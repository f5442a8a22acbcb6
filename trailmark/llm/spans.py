"""Places of pattern matches in whole texts, with SQL functions only.

``split`` and ``regexp_extract_all`` walk the same leftmost, non-overlapping matches, so the lengths of
the pieces between them and of the matches give every match its place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span of a text: its place in code points (end exclusive), the matched text and, where a pattern has groups, one of them.
SPAN = "array<struct<start:bigint,stop:bigint,found:string,part:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: nested functions of arrays would evaluate it at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """0 and the sums up to each number."""
    return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def prefix_sums(numbers: Column) -> Column:
    """For each number the sum of those before it; in blocks of the root of their count, so long arrays are not copied for each step."""

    def blocked(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda b: running(F.slice(a, b * width + 1, width)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        bases = F.slice(running(F.transform(blocks, lambda x: F.element_at(x, -1))), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, bases, lambda x, base: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + base)))

    return let(numbers, lambda a: F.when(F.size(a) > 0, blocked(a)).otherwise(F.array().cast("array<bigint>")))


def spans(text: Column, pattern: str, part: int = 0, search: Column | None = None) -> Column:
    """The matches of a pattern as array of SPAN. ``search``: a text of the same length to search instead, as when separators are marked."""

    def placed(where: Column) -> Column:
        return let(F.regexp_extract_all(where, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, between(where, found)).otherwise(none()))

    def between(where: Column, found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(where, pattern, -1), 1, F.size(found)), lambda x: F.char_length(x).cast("long"))
        return let(gaps, lambda g: rows(where, found, g))

    def rows(where: Column, found: Column, gaps: Column) -> Column:
        before = prefix_sums(F.zip_with(gaps, found, lambda g, f: g + F.char_length(f)))
        parts = F.regexp_extract_all(where, F.lit(pattern), F.lit(part)) if part else found
        begin = F.zip_with(before, gaps, lambda b, g: b + g)
        pairs = F.zip_with(found, parts, lambda f, p: F.struct(f.alias("f"), p.alias("p")))
        shown_ = (lambda s, f: f) if search is None else (lambda s, f: F.substr(text, (s + 1).cast("int"), F.char_length(f)))
        return F.zip_with(begin, pairs, lambda s, x: F.struct(s.alias("start"), (s + F.char_length(x["f"])).alias("stop"), shown_(s, x["f"]).alias("found"), x["p"].alias("part"))).cast(SPAN)

    return let(text if search is None else search, placed)


def none() -> Column:
    return F.array().cast(SPAN)


def where_any(test: Column, found: Column) -> Column:
    """``found`` only where a cheap test passes."""
    return F.when(test, found).otherwise(none())


def shown(tagged: Column) -> Column:
    """``kind:start:end`` of an array of structs that has these fields, comma-joined in its order."""
    return F.array_join(F.transform(tagged, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def tagged(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("no"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


def redacted(text: Column, sorted_spans: Column, label) -> Column:
    """The text with the spans (sorted by start) replaced by ``label(span)``; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        new = F.struct(x["stop"].alias("at"), F.concat(acc["parts"], F.array(gap, label(x))).alias("parts"))
        return F.when(x["start"] >= acc["at"], new).otherwise(acc)

    out = F.aggregate(sorted_spans, zero, step)
    return F.concat(F.array_join(out["parts"], ""), F.substr(text, (out["at"] + 1).cast("int"), F.char_length(text)))
