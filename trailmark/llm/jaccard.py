"""Exact n-gram Jaccard join: universe partition and pigeonhole, one-deletion neighbourhoods, exact verification.

Sets of sizes a <= b with Jaccard >= t satisfy b <= a / t and differ in at most H = (a + b)(1 - t)/(1 + t)
elements. Sizes fall into bands such that the larger set lies in the smaller one's band or the next;
space k holds bands k and k + 1. In a space a hash deals the universe into m segments. If a set has more
than H segments that are not empty, then any partner agrees with it in one of them, so a key for each
non-empty segment's subset finds the pair. m is allocated per band by cost: the expected number of
keys, with those of the next level for sets that have too few non-empty segments. Two sets that both
have too few meet at that next level, where subsets are keyed together with their one-deletion
neighbourhoods: a segment of two or more elements then fails only by two differences. The rare sets for
which this is still too little are keyed by each element, which always suffices.

Keys are pre-aggregated in chunks, so a task of the shuffle holds at most one row of a key per chunk, however
many near copies share it; they are shuffled in ``PASSES`` parts, so the disk holds one part at a time. Candidates are stars around a member of each key,
filtered by an exact bound (the parities of 512 hash buckets differ in at most H places; where both sets
are larger than that, those of at least as many buckets as elements as well, since 512 all pass there) and
verified on whole sets: first one center for each member, then the centers that this has not put
into its component yet, then another center of the keys that still hold different components; after
each step connected components follow. Keys that still hold different components are compared
across components in chunks, the bound being part of the join. So no link between different texts
is lost, and no large group of linked texts is expanded into its pairs. Pairs are verified, and keys
compared, in as many parts as keep the sets and rows that move at once below about the size of all sets.

Cases: null or empty text is the empty set (n_shingles 0, its own component); fewer words than n make
one shingle; equal sets share a class and are verified once; rows that repeat a doc_id are one node; rows
with null doc_id get the component of their class, or null; very long texts stay whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, written
from .words import WordHashes, hashed, mix, windows, words_of

#: Words of a shingle; similarity in hundredths. Characters and keys that a task holds at once; keys of a shuffle partition.
SHINGLE, SIMILARITY = 5, 80
CHUNK_CHARS, CHUNK_KEYS, KEYS_A_PARTITION = 8_000_000, 2_000_000, 1_000_000
#: Up to so many ids (8 bytes each) are broadcast to select candidate texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
PARITY_WORDS = 8
#: Rows of a key that a task compares with as many others where a key still holds different components.
CHUNK_ROWS = 1000
#: Keys are cut to so many bytes, which only makes a few more candidates; digests to so many bits, the next one being a flag in the shuffle.
KEY_BYTES, DIGEST_BITS = 6, 56
#: Shuffles among which the keys are dealt, a power of two; each is deleted before the next begins.
PASSES = 4
#: Elements that a part of the verification or comparison may move in any case, and besides the share of all elements; partners of a member in a part.
LEAST_ELEMENTS, PARTNERS = 16_000_000, 1000
_U = np.uint64


def most_different(a: int, b: int, t: int) -> int:
    """The most elements in which sets of these sizes can differ at similarity t/100."""
    return (a + b) * (100 - t) // (100 + t)


class Bands:
    """Size bands and the segments allocated to each, as far as a size needs them."""

    def __init__(self, t: int):
        self.t, self.low, self.segments = t, [1, 2], []

    def largest_partner(self, a: int) -> int:
        return a * 100 // self.t

    def band(self, n: int) -> int:
        while self.low[-1] <= self.largest_partner(n):
            self.low.append(max(self.low[-1] + 1, self.largest_partner(self.low[-1] - 1) + 1))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def allocated(self, k: int) -> int:
        """Segments of space k: the cheapest number by the expected keys of a set of its middle size."""
        self.band(self.low[k] if k < len(self.low) else 1)
        while len(self.segments) <= k:
            i = len(self.segments)
            while len(self.low) < i + 3:
                self.low.append(max(self.low[-1] + 1, self.largest_partner(self.low[-1] - 1) + 1))
            a, need = (self.low[i] + self.low[i + 1]) / 2, most_different(self.low[i + 1] - 1, self.largest_partner(self.low[i + 1] - 1), self.t) + 1

            def cost(m: int, a: float = a, need: int = need) -> float:
                empty = math.exp(-a / m)
                mean, sd = m * (1 - empty), math.sqrt(max(m * empty * (1 - (1 + a / m) * empty), 1e-9))
                short = 0.5 * math.erfc((mean - need + 0.5) / sd / math.sqrt(2))
                return min(m, a) + short * (m + a)

            self.segments.append(min(range(need, 2 * need + 8), key=cost))
        return self.segments[k]

    def need(self, n: int, k: int) -> int:
        """Keys that a set of n elements needs in space k: one more than it can differ in from a partner there."""
        other = self.largest_partner(n) if n < self.low[k + 1] else self.low[k + 1] - 1
        return most_different(n, other, self.t) + 1


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    np.add.at(out, at, values)
    return out


def keys_of(sets: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    """The keys of each set, all spaces and levels together."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    jobs: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            k = bands.band(len(s))
            for space in (k, k - 1)[: 1 + (k > 0)]:
                jobs.setdefault(space, []).append(i)
    for space, members in jobs.items():
        m = bands.allocated(space)
        size = np.array([len(sets[i]) for i in members])
        x = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), size)
        salt = mix(np.array([space * 4 + 1], _U))[0]
        place = owner * m + (mix(x ^ salt) % _U(m)).astype(np.int64)
        part = mix(x + salt)
        total, count = sums(part, place, m * len(members)), np.bincount(place, minlength=m * len(members))
        full = mix(total + mix(np.tile(np.arange(m, dtype=_U), len(members)) * _U(8) + salt))
        filled = count.reshape(-1, m) > 0
        keys = full.reshape(-1, m)
        have, ends = filled.sum(1), np.cumsum(size)
        weight = have + (count.reshape(-1, m) > 1).sum(1)
        for j, i in enumerate(members):
            out[i].append(keys[j][filled[j]])
            need = bands.need(len(sets[i]), space)
            if have[j] >= need:
                continue
            out[i].append(mix(keys[j][filled[j]] + _U(1)))  # level 1: subsets with their one-deletion neighbourhoods
            some = slice(ends[j] - size[j], ends[j])
            p = place[some]
            many = count[p] > 1
            out[i].append(mix(mix(total[p] - part[some] + mix((p - j * m).astype(_U) * _U(8) + salt)) + _U(1))[many])
            if weight[j] < need:  # level 2: each element
                out[i].append(mix(sets[i] + mix(salt + _U(2))))
    return [np.unique(np.concatenate(x)) if x else np.empty(0, _U) for x in out]


def shingles(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(windows(hashed(words_of(text, lower=True), memo), n))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about ``most`` bytes of text."""
    for batch in batches:
        if not len(batch):
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(batch)]
        for low, high in pairwise(cuts):
            if high > low:
                part = batch.slice(low, high - low)
                yield part, part.column("text").to_pylist()


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*parts, np.empty(0, _U)]).view(np.int64))


def packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view(np.int64)


def parities(s: np.ndarray, places: int) -> np.ndarray:
    """The parities of a set's hashes in so many places (a power of two, eight to a byte); those of half as many are one half xor the other."""
    return np.packbits((np.bincount((mix(s ^ _U(77)) & _U(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8))


def wide_parities(s: np.ndarray) -> bytes | None:
    """The parities in at least as many places as the set has elements, if these are more than ``PARITY_WORDS`` hold."""
    return parities(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > PARITY_WORDS * 64 else None


def places_apart(x: np.ndarray, y: np.ndarray) -> int:
    """The places where parities differ, in as many places as the shorter has."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketches(docs: DataFrame, n: int, t: int) -> DataFrame:
    """(doc_id, n, d1, d2, p0..p7, wide, keys): size, digest and parities of each text's set; wide ones and keys at the first of equal sets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands, seen = WordHashes(), Bands(t), set()
        for part, texts in rows_of(batches, CHUNK_CHARS):
            sets = [shingles(x, n, memo) for x in texts]
            d1 = np.array([np.add.reduce(mix(s + _U(11))) for s in sets], _U) & _U((1 << DIGEST_BITS) - 1)
            d2 = np.array([np.bitwise_xor.reduce(mix(s ^ _U(0x5851F42D4C957F2D))) + _U(len(s)) for s in sets], _U)
            parity = [parities(s, PARITY_WORDS * 64).view(np.int64) for s in sets]
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = []
            for pair in zip(d1.tolist(), d2.tolist(), strict=True):
                fresh.append(pair not in seen)
                seen.add(pair)
            keys = keys_of([s if f else s[:0] for s, f in zip(sets, fresh, strict=True)], bands)
            wide = [wide_parities(s) if f else None for s, f in zip(sets, fresh, strict=True)]
            p = np.array(parity).reshape(-1, PARITY_WORDS)
            known = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*known, *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(PARITY_WORDS)], pa.array(wide, pa.binary()), pa.array([packed(k) for k in keys], pa.binary())],
                ["doc_id", "n", "d1", "d2", *[f"p{i}" for i in range(PARITY_WORDS)], "wide", "keys"],
            )

    schema = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS)) + ", wide binary, keys binary"
    return id_and_text(docs).mapInArrow(run, schema)


def pre_aggregated(batches: Iterator[pa.RecordBatch], turn: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """(key, d, center) of the keys of this turn: of the rows of a key in a chunk the first (center null, flagged if there are more) stands for it; the others name it as center."""

    def grouped(key: np.ndarray, d1: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((d1, key))
        key, d1 = key[order], d1[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])]
        key, d1 = key[new], d1[new]
        head = np.r_[True, key[1:] != key[:-1]]
        first = d1[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        more = head & np.r_[~head[1:], False]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(d1 | (more.astype(np.int64) << DIGEST_BITS)), pa.array(first, mask=head)], ["key", "d", "center"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for batch in batches:
        for d1, data in zip(batch.column("d1").to_pylist(), batch.column("keys"), strict=True):
            keys = unpacked(data.as_buffer())
            keys = keys[keys & (passes - 1) == turn]
            held.append((keys, np.full(len(keys), d1, np.int64)))
            total += len(keys)
            if total >= CHUNK_KEYS:
                yield grouped(*map(np.concatenate, zip(*held, strict=True)))
                held, total = [], 0
    if total:
        yield grouped(*map(np.concatenate, zip(*held, strict=True)))


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, center) for the rows of keys that several sets have; a partition holds all heads of its keys, about a million. Rows with a center stay as they are."""
    parts = []
    for batch in batches:
        head = pc.is_null(batch.column("center"))
        others, heads = batch.filter(pc.invert(head)), batch.filter(head)
        if len(others):
            yield pa.RecordBatch.from_arrays(others.columns, ["key", "x", "center"])
        if len(heads):
            parts.append((heads.column("key").to_numpy(), heads.column("d").to_numpy()))
    if not parts:
        return
    key, d = map(np.concatenate, zip(*parts, strict=True))
    more, d1 = d >> DIGEST_BITS != 0, d & ((1 << DIGEST_BITS) - 1)
    order = np.lexsort((d1, key))
    key, d1, more = key[order], d1[order], more[order]
    head = np.r_[True, key[1:] != key[:-1]]
    starts = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    last = d1[np.r_[starts[1:], len(key)] - 1]
    keep = (d1[starts] != last)[group] | more
    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(d1[keep]), pa.array(d1[starts][group][keep])], ["key", "x", "center"])


PARITIES = [f"p{i}" for i in range(PARITY_WORDS)]


def may_link(a: str, b: str, t: int):
    """The exact bounds: sizes, and the places where the parities differ."""
    c = F.col
    differ = reduce(lambda x, y: x + y, [F.bit_count(c(f"{a}.{p}").bitwiseXOR(c(f"{b}.{p}"))) for p in PARITIES])
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (low * 100 >= high * t) & (differ * (100 + t) <= (c(f"{a}.n") + c(f"{b}.n")) * (100 - t))


def nearer(pairs: DataFrame, wides: DataFrame, t: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose wide parities differ in few enough places, if both have them. ``wides``: rep, n, wide."""
    c = F.col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*[batch.column(k).to_pylist() for k in ("na", "nb", "wa", "wb")], strict=True):
                keep.append(x is None or y is None or places_apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + t) <= (na + nb) * (100 - t))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    for x in "ab":  # by size as well, as texts of other sizes may share the doc_id
        pairs = pairs.join(wides.select(c("rep").alias(x), c("n").alias(f"n{x}"), c("wide").alias(f"w{x}")), [x, f"n{x}"], "left")
    return pairs.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, n: int, t: int, most: int) -> list[DataFrame]:
    """Those of the pairs (a: a bucket's center, b: a member; both representatives; na, nb: sizes) whose sets reach the similarity, as tables.

    The pairs go in parts whose sets have about ``most`` elements, one part on the disk at a time; a member's pairs are of one part,
    or of several if it has many.
    """
    count, load = pairs.agg(F.count("*"), F.coalesce(F.sum(F.col("na") + F.col("nb")), F.lit(0))).first()
    parts = max(1, math.ceil(load / most), math.ceil(count / max(BROADCAST_IDS // 4, PARTNERS)))
    if parts == 1:
        return [verified_part(pairs, docs, n, t)]
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("shares"))
    place = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("shares"))), F.lit(parts)).cast("int")
    dealt = written(pairs.join(shares, "b").select("a", "b", place.alias("part")), "parts")
    links = [verified_part(dealt.where(F.col("part") == i), docs, n, t) for i in range(parts)]
    discard(dealt)
    return links


def verified_part(pairs: DataFrame, docs: DataFrame, n: int, t: int) -> DataFrame:
    """The links among a part of the pairs, as a table.

    Texts are read anew, with the centers of each member beside them, so a member's set is made once, moves to its centers and
    is never stored; only the sets of the centers move besides.
    """
    partners = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.collect_set("a").alias("partners"))
    centers = pairs.select(F.col("a").alias("doc_id")).distinct().withColumn("partners", F.array().cast("array<long>"))
    few = pairs.count() <= BROADCAST_IDS // 2  # a row is an id and its centers; parts have about half as many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part, found in rows_of(batches, CHUNK_CHARS):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("partners"), list_array([shingles(x, n, memo) for x in found])], ["id", "partners", "elements"])

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = id_and_text(docs).join(F.broadcast(ids) if few else ids, "doc_id")
        return texts.mapInArrow(run, "id long, partners array<long>, elements array<long>")

    members = sets_of(partners).select(F.explode("partners").alias("a"), F.col("id").alias("b"), F.col("elements").alias("y"))
    both = members.join(sets_of(centers).select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return written(both.where(common * (100 + t) >= (F.size("x") + F.size("y")) * t).select("a", "b").distinct(), "links")


PAIR = ["a", "b", "na", "nb"]


def pair_of(r: str, s: str) -> list[Column]:
    """Representatives and sizes of two classes."""
    return [F.col(f"{x}.{k}").alias(name) for name, x, k in zip(PAIR, (r, s, r, s), ("rep", "rep", "n", "n"), strict=True)]


def crossing_turns(rest: DataFrame, most: int) -> int:
    """Turns of ``crossing`` in which it moves about ``most`` elements (8 bytes) at once: 30 for a row of a chunk on both sides, 1 for 8 pairs, of which the bounds keep few."""
    of_key = rest.groupBy("key").agg(F.count("*").alias("n"))
    dealt, pairs = of_key.agg(F.sum(F.col("n") * F.ceil(F.col("n") / CHUNK_ROWS)), F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()
    return max(1, math.ceil((30 * (dealt or 0) + (pairs or 0) / 8) / most))


def crossing(rest: DataFrame, reps: DataFrame, t: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(a, b, na, nb): the pairs of different labels within a key that pass the bounds; the chunks of this turn. ``rest``: key, x, label.

    The rows of a key are dealt into chunks of about ``CHUNK_ROWS`` and a task compares two chunks, so no task has more than so many of a key.
    """
    c = F.col

    def mine(*chunks: Column | str) -> Column:
        return F.pmod(F.xxhash64("key", *chunks), F.lit(turns)) == turn

    sized = rest.join(rest.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")), "key")
    sized = sized.where((c("chunks") > 1) | mine(F.lit(0), F.lit(0)))
    full = sized.join(reps.withColumnRenamed("d1", "x"), "x").withColumn("own", F.pmod(F.xxhash64("x"), c("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), c("chunks") - 1))
    left = full.withColumn("i", c("own")).withColumn("j", other).where(mine("i", "j")).alias("r")
    right = full.withColumn("j", c("own")).withColumn("i", other).where(mine("i", "j")).alias("s")
    same = reduce(lambda x, y: x & y, [c(f"r.{k}") == c(f"s.{k}") for k in ("key", "i", "j")])
    pairs = left.join(right, same & (c("r.rep") < c("s.rep")) & (c("r.label") != c("s.label")) & may_link("r", "s", t))
    return pairs.select(*pair_of("r", "s")).distinct()


def components(docs: DataFrame, n: int = SHINGLE, t: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: components of the documents whose sets have Jaccard >= t/100."""
    spark, c = docs.sparkSession, F.col
    table = written(sketches(docs, n, t), "sketches")
    classes = table.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in PARITIES])
    classes = written(classes, "classes")
    reps = classes.where("rep is not null").drop("d2")

    n_keys = (table.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // KEY_BYTES
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_keys / PASSES / KEYS_A_PARTITION))

    def keys_shared(turn: int) -> DataFrame:
        """The rows of the keys of a turn that several sets have, as a table; a key's heads meet in a task, all other rows are spread."""
        rows = table.select("d1", "keys").where(F.octet_length("keys") > 0).mapInArrow(lambda batches: pre_aggregated(batches, turn, PASSES), "key long, d long, center long")
        place = F.when(c("center").isNull(), c("key")).otherwise(F.xxhash64("key", "d"))
        return written(rows.repartition(partitions, place).mapInArrow(shared_keys, "key long, x long, center long"), "keys")

    turns = [keys_shared(i) for i in range(PASSES)]
    shared = reduce(DataFrame.unionByName, turns)
    slim = written(table.select("doc_id", "n", "d1", "d2"), "sizes")
    wide = table.where("wide is not null").groupBy("d1", "d2").agg(F.first("wide").alias("wide"))
    wides = written(wide.join(classes.where("rep is not null"), ["d1", "d2"]).select("rep", "n", "wide"), "wides")
    most = LEAST_ELEMENTS + (classes.agg(F.sum("n")).first()[0] or 0) // 2
    discard(table)

    def candidates(stars: DataFrame) -> DataFrame:
        """(a, b, na, nb): representatives and sizes of the pairs of digests (c, x) that pass the bounds."""
        one, two = reps.alias("r"), reps.alias("s")
        left = stars.join(one, c("c") == c("r.d1")).select("x", F.struct("r.*").alias("r"))
        return left.join(two, (c("x") == c("s.d1")) & may_link("r", "s", t)).select(*pair_of("r", "s")).where("a <> b").distinct()

    def named(labels: DataFrame) -> DataFrame:
        return reps.select("d1", "rep").join(labels, c("rep") == c("node"), "left").select("d1", F.coalesce("root", "rep").alias("label"))

    def apart(stars: DataFrame, labels: DataFrame) -> DataFrame:
        """The stars whose ends are not of one component yet."""
        names = written(named(labels), "names")
        passing.append(names)
        of_x = stars.join(names.select(c("d1").alias("x"), c("label").alias("lx")), "x")
        return of_x.join(names.select(c("d1").alias("c"), c("label").alias("lc")), "c").where("lx <> lc").select("c", "x").distinct()

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, x, label, c): those rows (key, x) whose keys still hold different components, and the key's largest member, as a table."""
        all_rows = rows.join(named(labels).withColumnRenamed("d1", "x"), "x")
        keys = all_rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("x").alias("c")).where("low < high").select("key", "c")
        return written(all_rows.join(keys, "key"), "rest")

    tried, passing = None, []  # pairs that were verified; tables that nothing reads once the next pairs are written

    def grown(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The components with the links among ``pairs`` too; pairs tried before are left out."""
        nonlocal tried
        if tried is not None:
            ends = [F.least("a", "b").alias("a1"), F.greatest("a", "b").alias("b1")]
            pairs = pairs.select(*PAIR, *ends).join(tried.select(*ends), ["a1", "b1"], "left_anti").select(*PAIR)
        pairs = written(nearer(pairs, wides, t), "pairs")
        discard(*passing)
        passing.clear()
        found = verified(pairs, docs, n, t, most)
        links = reduce(DataFrame.unionByName, found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is not None and links.isEmpty():
            discard(*found)
            return labels
        every = links if labels is None else links.unionByName(labels.select(c("node").alias("a"), c("root").alias("b")))
        out = written(connected_components(every), "labels")
        discard(*found, *([] if labels is None else [labels]))
        return out

    stars = shared.where("center <> x").select(c("center").alias("c"), "x")
    labels = grown(None, candidates(stars.groupBy("x").agg(F.min("c").alias("c"))))  # one center for each member links most near copies
    labels = grown(labels, candidates(apart(stars.distinct(), labels)))
    rest = mixed(shared.select("key", "x").distinct(), labels)
    discard(*turns)
    labels = grown(labels, candidates(apart(rest.where("c <> x").select("c", "x").distinct(), labels)))
    mixed_rest = mixed(rest.select("key", "x"), labels)
    discard(rest)
    rest = mixed_rest.select("key", "x", "label")
    n_turns = crossing_turns(rest, most)
    if n_turns > 1:
        passing += [written(crossing(rest, reps, t, i, n_turns), "crossing") for i in range(n_turns)]
        labels = grown(labels, reduce(DataFrame.unionByName, passing).distinct())
    else:
        labels = grown(labels, crossing(rest, reps, t))
    discard(mixed_rest, wides)

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    some = slim.where("n > 0").join(of_class, ["d1", "d2"], "left").select("doc_id", "n", "component_id")
    none = slim.where("n = 0").select("doc_id", "n", c("doc_id").alias("component_id"))  # else all empty texts would be one key
    return some.unionByName(none).select("doc_id", c("n").alias("n_shingles"), "component_id")
