"""Chat formatting as a prefix tree over all conversations.

A node is a turn after a given history: its id digests its parent's id, role and text, so conversations that
share their first turns share those nodes, and grouping by id merges them, combined before the shuffle.
Each node is formatted once. A node belongs to the smallest conversation that has it, so a conversation's path
is a few stretches of one owner each; a node's key names these stretches (17 bytes each) and its depth. The nodes
are sorted by key, which is depth-first order, and a distributed running sum (within range partitions, then over
the partitions' totals) gives each its place in the packed stream. A token here is a code point. A node carries the position id of its first token (the length of its
history) and the intervals of the packed stream that its tokens attend to besides themselves: its
ancestors, neighbouring intervals joined.

Template: ``<s>assistant\\n...</s>`` for the assistant, ``[INST]role\\n...[/INST]`` for other roles. Inside texts and roles
a backslash is doubled and each control string gets one backslash after its first character; a line break in a
role becomes ``<\\n>``. Runs of backslashes from texts are even, so this is undone without loss.

Conversations stream through a task turn by turn, sorted; only running digests, one key and the joined intervals are held,
and what a turn writes does not grow with the turns before it, but with the branches on its path.

Cases: null text or role is empty; rows of a conversation are ordered by turn, then role, then text, so ties and repeated rows are
separate turns in a fixed order; rows with null conv_id form one conversation; other columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .shared import written

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Stands for a null conv_id.
NO_ID = -(2**63)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    for c in CONTROL:
        text = text.replace(c[0] + "\\" + c[1:], c)
    return text.replace("\\\\", "\\")


class Packed(NamedTuple):
    """nodes: one row per node of the tree, ``start`` its place in the stream; links: (conv_id, depth, node_id), the turns of each conversation."""

    nodes: DataFrame
    links: DataFrame


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def format_tree(conversations: DataFrame) -> Packed:
    """Merges, formats and packs conversations (conv_id, turn, role, text)."""
    c = F.col
    text, role = F.coalesce(c("text").cast("string"), F.lit("")), F.coalesce(c("role").cast("string"), F.lit(""))
    rows = conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.replace(escaped(c("role")), F.lit("\n"), F.lit("<\\n>")), F.lit("\n"))
    learn = c("role") == "assistant"
    begin = F.concat(F.when(learn, F.lit("<s>")).otherwise(F.lit("[INST]")), head)
    rows = rows.withColumns({"begin": begin, "body": escaped(c("text")), "end": F.when(learn, F.lit("</s>")).otherwise(F.lit("[/INST]"))})
    mask = [F.char_length("begin").alias("mask_start"), F.when(learn, F.char_length("body")).otherwise(F.lit(0)).alias("mask_chars")]
    rows = rows.select("conv_id", "turn", "role", "text", F.concat("begin", "body", "end").alias("segment"), *mask)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, depth, position, node = object(), 0, 0, b""
        for batch in batches:
            out = []
            for conv, r, t, segment in zip(batch["conv_id"], batch["role"], batch["text"], batch["segment"], strict=True):
                if not same(conv, now):
                    now, depth, position, node = conv, 0, 0, b""
                parent = node
                digest = hashlib.blake2b(parent, digest_size=16)
                for part in (r.encode(), t.encode()):
                    digest.update(len(part).to_bytes(8, "big") + part)
                node = digest.digest()
                out.append((depth, node, parent, position, len(segment)))
                depth, position = depth + 1, position + len(segment)
            keep = batch[["conv_id", "segment", "mask_start", "mask_chars"]].reset_index(drop=True)
            yield pd.concat([keep, pd.DataFrame(out, columns=["depth", "node_id", "parent_id", "position", "n_chars"])], axis=1)

    schema = "conv_id long, segment string, mask_start int, mask_chars int, depth long, node_id binary, parent_id binary, position long, n_chars long"
    turns = written(by_conversation(rows, "turn", "role", "text").mapInPandas(chain, schema), "turns")
    links = turns.select("conv_id", "depth", "node_id")
    first = ["parent_id", "depth", "position", "n_chars", "segment", "mask_start", "mask_chars"]
    owner = F.min(F.coalesce("conv_id", F.lit(NO_ID))).alias("owner")
    nodes = written(turns.groupBy("node_id").agg(*[F.first(x).alias(x) for x in first], owner, F.count("*").alias("n_conversations")), "nodes")
    nodes = placed(nodes, keyed(links, nodes))
    return Packed(nodes.join(attended(links, nodes), "node_id").drop("owner"), links)


def keyed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, key): keys in depth-first order. In each stretch what branches off before a turn comes before it, and after the turn that it continues."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, of, stretch = object(), None, b""
        for batch in batches:
            ids, keys = [], []
            for conv, depth, node, owner in zip(batch["conv_id"], batch["depth"], batch["node_id"], batch["owner"], strict=True):
                if conv != now:
                    now, of, stretch = conv, None, b""
                if owner != of:
                    of, stretch = owner, stretch + struct.pack(">QBQ", depth, 0, owner - NO_ID)
                if owner == conv:
                    ids.append(node)
                    keys.append(stretch + struct.pack(">QB", depth, 1))
            yield pd.DataFrame({"node_id": ids, "key": keys})

    return along(links, nodes.select("node_id", "owner")).mapInPandas(walk, "node_id binary, key binary")


def along(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The conversations with columns of their nodes, turn by turn. A node has one row of its owner, as a path never repeats a node."""
    known = F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id")
    return by_conversation(links.select(known, "depth", "node_id").join(nodes, "node_id"), "depth")


def placed(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``start`` and ``stop``, a node's interval of the packed stream in depth-first order."""

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            local = total + batch["n_chars"].cumsum() - batch["n_chars"]
            total += int(batch["n_chars"].sum())
            yield pd.DataFrame({"node_id": batch["node_id"], "part": part, "local": local, "n_chars": batch["n_chars"]})

    keys = written(keys.join(nodes.select("node_id", "n_chars"), "node_id"), "keys")  # a table, as finding the ranges reads it too
    ordered = keys.repartitionByRange("key").sortWithinPartitions("key")
    local = written(ordered.mapInPandas(running, "node_id binary, part long, local long, n_chars long"), "places")
    totals = local.groupBy("part").agg(F.sum("n_chars").alias("total"))
    # One row for each partition of the sort: their number is that of shuffle partitions, whatever the input.
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    places = local.join(F.broadcast(bases), "part").select("node_id", (F.col("base") + F.col("local")).alias("start"), (F.col("base") + F.col("local") + F.col("n_chars")).alias("stop"))
    return written(nodes.join(places, "node_id"), "placed")


def attended(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, attends): the joined intervals of the ancestors, found along one conversation that has the node."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), []
        for batch in batches:
            ids, out = [], []
            for conv, node, start, stop, owner in zip(batch["conv_id"], batch["node_id"], batch["start"], batch["stop"], batch["owner"], strict=True):
                if conv != now:
                    now, held = conv, []
                if owner == conv:
                    ids.append(node)
                    out.append([{"start": a, "stop": b} for a, b in held])
                if held and held[-1][1] == start:
                    held[-1] = (held[-1][0], stop)
                else:
                    held.append((start, stop))
            yield pd.DataFrame({"node_id": ids, "attends": out})

    return along(links, nodes.select("node_id", "start", "stop", "owner")).mapInPandas(walk, "node_id binary, attends array<struct<start:long,stop:long>>")


def read_back(packed: Packed) -> DataFrame:
    """(conv_id, turn, role, text, learned) of every conversation, parsed from the formatted segments along its path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [parsed(s, a, n) for s, a, n in zip(batch["segment"], batch["mask_start"], batch["mask_chars"], strict=True)]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["depth"], "role": [p[0] for p in parts], "text": [p[1] for p in parts], "learned": [p[2] for p in parts]})

    rows = packed.links.join(packed.nodes.select("node_id", "segment", "mask_start", "mask_chars"), "node_id")
    return by_conversation(rows, "depth").mapInPandas(parse, StructType.fromDDL("conv_id long, turn long, role string, text string, learned string"))


def parsed(segment: str, mask_start: int, mask_chars: int) -> tuple[str, str, str]:
    """Role, text, and the text under the loss mask, without escapes."""
    inner = segment[3:-4] if segment.startswith("<s>") else segment[6:-7]
    head, _, body = inner.partition("\n")
    return unescape(head.replace("<\\n>", "\n")), unescape(body), unescape(segment[mask_start : mask_start + mask_chars])


def conversation_digests(packed: Packed) -> DataFrame:
    """Per conversation, read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, intervals."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = object(), None, []

        def closed() -> tuple:
            n, turns, chars, loss, formatted, wrong = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, wrong)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "misplaced"]
        for batch in batches:
            for conv, segment, a, n, position in zip(batch["conv_id"], batch["segment"], batch["mask_start"], batch["mask_chars"], batch["position"], strict=True):
                if not same(conv, now):
                    if state:
                        out.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, learned = parsed(segment, a, n)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[5] += position != state[4]
                state[4] += len(segment)
            yield pd.DataFrame(out, columns=names)
            out = []
        if state:
            yield pd.DataFrame([closed()], columns=names)

    rows = packed.links.join(packed.nodes.select("node_id", "segment", "mask_start", "mask_chars", "position"), "node_id")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, misplaced long"
    return by_conversation(rows, "depth").mapInPandas(digest, schema)
