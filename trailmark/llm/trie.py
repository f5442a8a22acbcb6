"""Trie of conversation prefixes, by ROLLUP over positional columns of turn ids.

A turn's id is a struct of two independent 64-bit hashes of (role, text) and the bytes of its text. A conversation is cut into
blocks of ``WIDTH`` turns, one row each, with a column for each position. One ``GROUP BY node, ROLLUP(t1, ..., t8)`` aggregates
all prefixes of all blocks together, ``grouping_id`` tells the level, and blocks after the first are keyed by the node
that the block before ended in. A node is known by two running XORs of hashes of (position, turn id), which compose, so those of a
long conversation are made in parts (``operators.ranges``), and its depth.

Sums over subtrees are made by a second ROLLUP: each node belongs to the smallest conversation that has it, so a conversation owns
the end of its path, and what a subtree sums is the sum, over its members, of what they own from that depth on (running sums
from the end of each conversation).

Rebuilding: conversation c takes the first h turns of conversation c - c % 5, h = crc32(decimal c) % 9, then its own after its first h.

The digest of the conversations that end in a node is sequential, and a third of all may end in one: their ids are sorted by ranges,
each task joins runs of ``RUN`` ids into one text, and only these are hashed in order, one row for each run.

Joins on a node or conversation that very many rows name (the parent of many children) read shuffled tables, so adaptive
execution may split them. A broadcast has two rows for each part of the ordered tables at most.

Cases: null role or text is empty; null turns come first; rows of equal turn are ordered by role, then text, so repeated rows are turns each;
rows without conv_id belong to no conversation; a conversation that is rebuilt without turns is a member of the root; other columns are
ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ranges import deal, numbered, running

from .shared import written

#: Positions of a block; conversations' ids that are joined into one text.
WIDTH, RUN = 8, 4096
SLOTS = range(1, WIDTH + 1)
NODE = ["na", "nb", "depth"]


def xor(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def turn_id(role: Column, text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), F.length(role), role, text).alias("a"), F.xxhash64(F.lit(2), text, F.length(text), role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn): the turns of each conversation in order, from 1 on."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("number"), text("role"), text("text")).where("conv_id is not null")
    return numbered(deal(rows, ["conv_id"], ["number", "role", "text"], ["conv_id", turn_id(F.col("role"), F.col("text")).alias("turn")]), "place").select("conv_id", "place", "turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn) after rebuilding; a row with a null turn for each conversation besides."""
    c = F.col
    each = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    wanted = each.select("conv_id", (c("conv_id") - c("conv_id") % 5).alias("donor"), (F.crc32(c("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    donors = each.select(c("conv_id").alias("donor"), c("n").alias("given"))
    wanted = written(wanted.join(donors, "donor", "left").withColumn("given", F.least(c("h"), F.coalesce("given", F.lit(0)))), "wanted")
    heads = turns.where("place <= 8").select(c("conv_id").alias("donor"), "place", "turn")  # h is at most 8
    taken = heads.join(wanted, "donor").where("place <= h").select("conv_id", "place", "turn")
    own = turns.join(wanted, "conv_id").where("place > h").select("conv_id", (c("place") - c("h") + c("given")).alias("place"), "turn")
    none = each.select("conv_id", F.lit(1).cast("long").alias("place"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    return taken.unionByName(own).unionByName(none)


def blocks_of(turns: DataFrame):
    """A row for each conversation and block: t1 ... t8, and pa, pb, the node that it begins in."""
    c = F.col
    rows = turns.select("conv_id", F.floor((c("place") - 1) / WIDTH).alias("block"), ((c("place") - 1) % WIDTH + 1).alias("slot"), "turn")
    rows = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(c("slot") == i, c("turn"))).alias(f"t{i}") for i in SLOTS])
    dealt = deal(rows, ["conv_id"], ["block"])
    here = {"xa": xor([hashed(i, 1) for i in SLOTS]), "xb": xor([hashed(i, 2) for i in SLOTS])}
    out = running(dealt, {n: ("bit_xor", n) for n in here}, rows=dealt.rows.withColumns(here | {"ha": here["xa"], "hb": here["xb"]}))
    out = out.withColumns({"pa": c("xa").bitwiseXOR(c("ha")), "pb": c("xb").bitwiseXOR(c("hb"))}).drop("xa", "xb", "ha", "hb")
    return dealt._replace(rows=written(out, "blocks"))


def hashed(slot: int, which: int) -> Column:
    """What a turn adds to the id of its node; nothing where there is none."""
    t = F.col(f"t{slot}")
    return F.when(t.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(10 + which), F.col("block") * WIDTH + slot, t["a"], t["b"]))


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of all blocks with their aggregates: NODE, level, last turn, parent (ua, ub)."""
    slots = ", ".join(f"t{i}" for i in SLOTS)
    sql = f"SELECT pa, pb, block, {slots}, {WIDTH} - bit_count(grouping_id() & {2**WIDTH - 1}) AS level, {aggregates} FROM {{rows}} GROUP BY pa, pb, block, ROLLUP({slots})"
    out = rows.sparkSession.sql(sql, rows=rows)
    c = F.col
    last = reduce(lambda e, i: e.when(c("level") == i, c(f"t{i}")), list(SLOTS)[1:], F.when(c("level") == 1, c("t1")))
    step = [reduce(lambda e, i: e.when(c("level") == i, hashed(i, w)), list(SLOTS)[1:], F.when(c("level") == 1, hashed(1, w))) for w in (1, 2)]  # noqa: B023
    there = (c("level") == 0) & (c("block") == 0) | last.isNotNull()  # a rolled-up block is the node before it, a missing turn is no node
    ids = {"na": xor([c("pa"), *[hashed(i, 1) for i in SLOTS]]), "nb": xor([c("pb"), *[hashed(i, 2) for i in SLOTS]]), "depth": c("block") * WIDTH + c("level")}
    out = out.where(there).withColumns(ids | {"bytes": F.coalesce(last["bytes"], F.lit(0)), "ua": step[0], "ub": step[1]})
    return out.withColumns({"ua": c("na").bitwiseXOR(c("ua")), "ub": c("nb").bitwiseXOR(c("ub"))}).drop("pa", "pb", *[f"t{i}" for i in SLOTS])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(NODE, ends_sha256): of the ids of the conversations that end in each node, ascending."""
    names = [*NODE, "conv_id"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids = None, []
        for batch in batches:
            out = []
            for row in zip(*[batch[n].tolist() for n in names], strict=True):
                if row[:3] != now or len(ids) >= RUN:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = row[:3], []
                ids.append(row[3])
            yield pd.DataFrame(out, columns=[*names, "ids"])
        if ids:
            yield pd.DataFrame([(*now, ids[0], ",".join(map(str, ids)))], columns=[*names, "ids"])

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*[batch[n].tolist() for n in [*NODE, "ids"]], strict=True):
                if node != now:
                    if digest:
                        out.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if digest:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    ordered = ends.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
    joined = ordered.mapInPandas(runs, "na long, nb long, depth long, conv_id long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*names).mapInPandas(digested, "na long, nb long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the rebuilt conversations."""
    c = F.col
    dealt = blocks_of(rebuilt(turns_of(conversations)))
    nodes = written(rolled_up(dealt.rows, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    ids = {"na": xor([c("pa"), *[hashed(i, 1) for i in SLOTS]]), "nb": xor([c("pb"), *[hashed(i, 2) for i in SLOTS]])}
    length = sum((c(f"t{i}").isNotNull().cast("long") for i in SLOTS), F.lit(0))
    last = dealt.rows.withColumns(ids | {"depth": c("block") * WIDTH + length})
    ends = written(last.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "block").alias("end")).select("conv_id", "end.*"), "ends")

    children = nodes.where("depth > 0").groupBy(c("ua").alias("na"), c("ub").alias("nb"), (c("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    above = nodes.select(c("na").alias("ua"), c("nb").alias("ub"), (c("depth") + 1).alias("depth"), c("conv_id").alias("parent_conv_id"))
    known = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = written(known.withColumns({"leaf": (c("n_children") == 0).cast("long"), "saved": (c("n_convs") - 1) * c("bytes")}), "known")

    owned = known.where("depth > 0").select("conv_id", "block", "level", "leaf", "saved")
    values = [F.sum(F.when(c("level") == i, c(n))).alias(f"{n}{i}") for i in SLOTS for n in ("leaf", "saved")]
    owned = owned.groupBy("conv_id", "block").agg(*values)
    rows = dealt.rows.join(owned, ["conv_id", "block"], "left").na.fill(0, [f"{n}{i}" for i in SLOTS for n in ("leaf", "saved")])
    inside = {n: sum((c(f"{n}{i}") for i in SLOTS), F.lit(0).cast("long")) for n in ("leaf", "saved")}
    rows = written(rows.withColumns({f"{n}_here": e for n, e in inside.items()}), "owned")
    rows = running(dealt, {n: ("sum", f"{n}_here") for n in inside}, reverse=True, rows=rows)  # from this block on
    from_slot = {f"{n}_from{i}": c(n) - sum((c(f"{n}{j}") for j in range(1, i)), F.lit(0)) for n in inside for i in SLOTS}
    rows = rows.select("conv_id", "block", "pa", "pb", *[f"t{i}" for i in SLOTS], *[e.alias(n) for n, e in from_slot.items()])
    sums = rolled_up(rows, ", ".join(f"sum({n}) AS {n}" for n in from_slot))
    at_level = {n: reduce(lambda e, i: e.when(c("level") == i, c(f"{n}_from{i}")), list(SLOTS)[1:], F.when(c("level") <= 1, c(f"{n}_from1"))) for n in inside}  # noqa: B023
    sums = sums.select(*NODE, at_level["leaf"].alias("n_leaves"), at_level["saved"].alias("saved_tokens"))

    out = known.select(*NODE, "ua", "ub", "conv_id", "n_convs", "n_children", "leaf").join(sums, NODE).join(ends_digests(ends), NODE, "left")
    out = out.join(above, ["ua", "ub", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    root_leaf = F.when(c("depth") == 0, c("leaf")).otherwise(F.lit(0))  # the root is in no block
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (c("n_leaves") + root_leaf).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
