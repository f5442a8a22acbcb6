"""Fuzzy line deduplication over all documents, in SQL functions only: MinHash, banding, exact verification, union-find.

A line's set is its shingles of ``SHINGLE`` characters (the whole line where it is shorter). Its signature deals
the shingles' hashes into ``GROUPS`` parts; the ``DEPTH`` smallest and the ``DEPTH`` largest of a part make a band key
each, so two lines agree in a band with probability J ** DEPTH, which finds 99 % of the pairs at J = 0.8 in one of the
12 bands, and more above. Lines of any length are signed by this one rule, from all their shingles.

A line is known by its 64-bit hash, so equal lines are one item, which is signed once whatever the number of its
places. Lines are equal if a second hash agrees as well; of different lines with one hash (if there are any) none is linked, but each is still
equal to its own repeats. In each bucket the items are first compared with its smallest and its largest one. Where the others then still
belong to different components, as under a common boilerplate, all pairs of different components are compared, in chunks of the
bucket, so every two lines that share a bucket and reach the similarity are in one component. Two exact bounds come before a pair's sets are cut: their
sizes, and the places where the parities of the shingles' hash buckets differ. Links that reach the similarity are contracted to
components, and of each component the first line (by doc_id, then place) stays.

Cases: lines are compared without outer blanks; blank lines stay and are never duplicates; null text has no lines and
stays null; rows repeated as a whole are one document and get equal results; rows that share a doc_id but not the text
are ordered by text hash; null doc_ids are last; a document may lose all its lines (text empty); very long lines are
compared whole; other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, written
from .spans import let

SHINGLE, SIMILARITY, GROUPS, DEPTH = 5, 80, 6, 5
#: Where the parts begin among 64-bit numbers.
BEGINS = [-(2**63) + g * (2**64 // GROUPS) for g in range(GROUPS)]
#: Up to so many line ids (8 bytes each) are broadcast to select candidate lines; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
BLANKS = " \t\r\x0b\x0c"
#: Bytes of a character in UTF-32; numbers of 64 bits in a bitmap; rows of a bucket that a task compares with as many others.
WIDE, WORDS, CHUNK_ROWS = 4, 16, 4000
BITMAP = [f"w{i}" for i in range(WORDS)]


def shingles(line: Column) -> Column:
    """Hashes of the shingles, with repeats; cut from characters of equal width, so each is found at once."""

    def cut(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(b) - WIDE * SHINGLE + 1, F.lit(WIDE))
        return F.when(F.length(b) > WIDE * SHINGLE, F.transform(starts, lambda i: F.xxhash64(F.substr(b, i, F.lit(WIDE * SHINGLE))))).otherwise(F.array(F.xxhash64(b)))

    return let(F.encode(line, "UTF-32"), cut)


def banded(rows: DataFrame) -> DataFrame:
    """Replaces ``line`` by ``n``, the size of its set, and ``keys``: two for each part of the universe that the line has shingles in.

    The beginnings of the parts are sorted in among the hashes, so finding and cutting the parts needs no function per element.
    """
    h = F.sort_array(F.concat(F.array_distinct(shingles(F.col("line"))), F.array(*[F.lit(b).cast("long") for b in BEGINS])))
    begins = [F.array_position("_h", F.lit(b).cast("long")).cast("int").alias(f"_{g}") for g, b in enumerate(BEGINS)]
    places = F.struct(*begins, (F.size("_h") + 1).cast("int").alias(f"_{GROUPS}"))
    # Generated, not projected: else each mention of a place would search the array anew.
    rows = rows.withColumn("_h", h).select("*", F.inline(F.array(places))).withColumn("n", F.size("_h") - GROUPS)
    keys = []
    for g in range(GROUPS):
        low, n = F.col(f"_{g}") + 1, F.col(f"_{g + 1}") - F.col(f"_{g}") - 1
        most = F.least(F.lit(DEPTH), n)
        keys += [F.when(n > 0, F.xxhash64(F.slice("_h", low, most))), F.when(n > 0, F.xxhash64(F.slice("_h", low + n - most, most), F.lit(1)))]
    return rows.withColumn("keys", F.array_compact(F.array(*keys))).drop("_h", "line", *[f"_{g}" for g in range(GROUPS + 1)])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place, line, id, other) of the lines that are not blank; ``other`` is a second hash of the line."""
    c = F.col
    rows = docs.select(F.coalesce(c("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), c("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(BLANKS))).where("line <> ''")
    return rows.withColumns({"id": F.xxhash64("line"), "other": F.xxhash64(F.lit(1), F.length("line"), "line")})


def stars(members: DataFrame) -> DataFrame:
    """(a, b): the pairs of each member (id) with the smallest and the largest one of its bucket (low, high)."""
    pairs = members.select("id", F.explode(F.array_distinct(F.array("low", "high"))).alias("center")).where("id <> center")
    return pairs.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct()


def bitmaps(texts: DataFrame) -> DataFrame:
    """(id, n, w0..w15): in each place whether an odd number of the set's hashes falls there. Shingles are rows, which stay in their task but for one of each line.

    An element that only one of two sets has turns one place, so they differ in no more places than elements; and where several
    elements of a long line share a place, one that is turned still shows, which a bit that is merely set would hide.
    """
    c = F.col
    rows = texts.select("id", "n", F.explode(F.array_distinct(shingles(c("line")))).alias("h"))  # repeats would turn a place back
    rows = rows.select("id", "n", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"), F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("word"))
    return rows.groupBy("id", "n").agg(*[F.bit_xor(F.when(c("word") == i, c("bit")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(BITMAP)])


def may_link(a: str, b: str) -> Column:
    """The exact bounds: sizes, and the places where the parities differ, as sets of one similarity differ in so many elements at most."""
    c = F.col
    differ = reduce(lambda x, y: x + y, [F.bit_count(c(f"{a}.{w}").bitwiseXOR(c(f"{b}.{w}"))) for w in BITMAP])
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (low * 100 >= high * SIMILARITY) & (differ * (100 + SIMILARITY) <= (c(f"{a}.n") + c(f"{b}.n")) * (100 - SIMILARITY))


def likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that pass the bounds."""
    c = F.col
    left = pairs.join(signs.alias("r"), c("a") == c("r.id")).select("b", F.struct("r.*").alias("r"))
    return left.join(signs.alias("s"), (c("b") == c("s.id")) & may_link("r", "s")).select(c("r.id").alias("a"), "b")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose sets reach the similarity, as a table. The sets are generated, not projected: else the filter would cut them anew."""
    c = F.col
    both = pairs.join(texts.select(c("id").alias("a"), c("line").alias("x")), "a").join(texts.select(c("id").alias("b"), c("line").alias("y")), "b")
    sets = F.struct(F.array_distinct(shingles(c("x"))).alias("s"), F.array_distinct(shingles(c("y"))).alias("t"))
    both = both.select("a", "b", F.inline(F.array(sets)))
    enough = F.size(F.array_intersect("s", "t")) * (100 + SIMILARITY) >= (F.size("s") + F.size("t")) * SIMILARITY
    return written(both.where(enough).select("a", "b"), "links")


def crossing(members: DataFrame, labels: DataFrame, signs: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components within a bucket that pass the bounds; those with its smallest and largest member were compared before.

    The rows of a bucket are dealt into chunks of about ``CHUNK_ROWS`` and a task compares two chunks, so no task has more than so many of a bucket.
    """
    c = F.col
    inner = members.where("id <> low and id <> high").join(labels, c("id") == c("node"), "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    of_key = inner.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    mixed = written(inner.join(of_key.where("least < most").select("key", "chunks"), "key"), "open")
    full = mixed.join(signs, "id").withColumn("own", F.pmod(F.xxhash64("id"), c("chunks")).cast("int"))
    left = full.withColumn("i", c("own")).withColumn("j", F.explode(F.sequence("own", c("chunks") - 1))).alias("r")
    right = full.withColumn("j", c("own")).withColumn("i", F.explode(F.sequence(F.lit(0), c("own")))).alias("s")
    same = reduce(lambda x, y: x & y, [c(f"r.{k}") == c(f"s.{k}") for k in ("key", "i", "j")])
    once = (c("r.i") < c("r.j")) | (c("r.id") < c("s.id"))
    pairs = left.join(right, same & once & (c("r.label") != c("s.label")) & may_link("r", "s"))
    pairs = written(pairs.select(F.least("r.id", "s.id").alias("a"), F.greatest("r.id", "s.id").alias("b")).distinct(), "pairs")
    discard(mixed)
    return pairs


def similar_lines(docs: DataFrame) -> DataFrame:
    """(node, root): components of lines that are linked to another."""
    c = F.col
    # A line that very many documents have is one row from here on; lines of different text with one hash are left out.
    once = lines_of(docs).groupBy("id").agg(F.first("line").alias("line"), F.min("other").alias("one"), F.max("other").alias("two")).where("one = two")
    table = written(banded(once.select("id", "line")), "lines")
    keys = table.select("id", "n", F.explode("keys").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "shared")  # its shuffle goes before the next
    few = shared.count() <= BROADCAST_IDS // 3  # a row is three numbers
    members = written(keys.join(F.broadcast(shared) if few else shared, "key"), "members")
    ids = written(members.select("id", "n").distinct(), "ids")
    discard(table, shared)
    few = ids.count() <= BROADCAST_IDS // 2
    texts = lines_of(docs).select("id", "line").join(F.broadcast(ids) if few else ids, "id").dropDuplicates(["id"])
    texts = written(texts, "texts")
    signs = written(bitmaps(texts), "signs")
    pairs = written(likely(stars(members), signs), "pairs")
    links = linked(pairs, texts)
    labels = written(connected_components(links), "labels")
    discard(ids, pairs, links)
    pairs = crossing(members, labels, signs)
    links = linked(pairs, texts)
    if not links.isEmpty():
        labels = written(connected_components(labels.select(c("node").alias("a"), c("root").alias("b")).union(links)), "labels")
    discard(members, signs, texts, pairs, links)
    return labels


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, removed) of the documents that lose lines: the places (from 0) of those that go, sorted.

    Only lines that are repeated or linked are joined with the first of their component; all others stay where they are.
    """
    c = F.col
    roots = similar_lines(docs)
    rows = written(lines_of(docs).select(F.struct("doc_id", "mark", "place").alias("at"), "id", "other"), "places")
    each = rows.groupBy("id", "other").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    each = each.join(roots, c("id") == c("node"), "left").where("n > 1 or root is not null")
    line = F.struct(c("id").alias("id"), c("other").alias("other"))
    each = each.select("id", "other", F.when(c("root").isNull(), line).otherwise(F.struct(c("root").alias("id"), F.lit(0).cast("long").alias("other"))).alias("component"), "first")
    each = written(each, "repeated")
    first = each.groupBy("component").agg(F.min("first").alias("first"))
    known = written(each.select("id", "other", "component").join(first, "component").select("id", "other", "first"), "first")  # so the join below reads two shuffles, and the rows of a very frequent line are split
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS // 4 else known  # a row is four numbers
    goes = rows.join(known, ["id", "other"]).where("at <> first")
    return goes.groupBy("at.doc_id", "at.mark").agg(F.array_sort(F.collect_set("at.place")).alias("removed"))


def n_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")), F.lit(0)).cast("long")


def with_removed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``d`` with ``removed`` beside each row, null where no line goes."""
    c = F.col
    found = removed_lines(docs).alias("f")
    rows = docs.alias("d")
    known = (F.coalesce(c("d.doc_id").cast("long"), F.lit(2**63 - 1)) == c("f.doc_id")) & (F.xxhash64(c("d.text").cast("string")) == c("f.mark"))
    return rows.join(found, known, "left")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) per row; removed: places, comma-joined."""
    c = F.col
    rows = with_removed(docs.select("doc_id", "text"))
    removed = F.coalesce("f.removed", F.array().cast("array<int>"))
    return rows.select(
        c("d.doc_id").cast("long").alias("doc_id"), n_lines(c("d.text").cast("string")).alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"),
    )


def cut_out() -> tuple[Column, Column]:
    """Of rows of ``with_removed``: the text without the removed lines, and whether it had lines and has lost them all."""
    c = F.col
    whole = c("d.text").cast("string")
    kept = F.filter(F.split(whole, "\n", -1), lambda x, i: ~F.array_contains(c("f.removed"), i))
    return F.when(c("f.removed").isNull(), whole).otherwise(F.array_join(kept, "\n")), F.coalesce(n_lines(whole) == F.size("f.removed"), F.lit(False))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; all other columns and rows stay, and ``_emptied`` tells documents that lost every line."""
    text, emptied = cut_out()
    return with_removed(docs).select(*[text.alias(n) if n == "text" else F.col(f"d.{n}") for n in docs.columns], emptied.alias("_emptied"))


def first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` as ``deduplicated``, without the documents that lost every line; ``n_chars``, where there is one, follows the text."""
    text, emptied = cut_out()
    new = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return with_removed(docs).where(~emptied).select(*[new[n].alias(n) if n in new else F.col(f"d.{n}") for n in docs.columns])
