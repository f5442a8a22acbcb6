"""Folds in order of rows, split over blocks of a key: leases, batches by count or time, caches with eviction.

A machine reads the rows of a key in order and changes a state. The rows of a key are cut into blocks of ``block`` rows, dealt to tasks by key
and block. First each block is summarised: what it does to any state that can enter it. The summaries of a key are then applied one
after the other (one small row for each block), and with the state that enters each block known, all blocks are replayed at once.
So a key with very many rows is split, and a task holds the rows of one block.

Where a summary can only guess the state (a FIFO cache), ``settled_fold`` replays the blocks and compares what left each with what
was taken to enter the next; those entered by another state are replayed again, until nothing changes. The result is
exact; each round settles at least one more block of each key, and a cache that has forgotten how it began settles at once.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, _parse_datatype_string

from trailmark.session import written

from .ranges import deal, numbered

#: Rows of a block.
BLOCK = 16_384
Rows = dict[str, list]


class Machine(Protocol):
    """``schema`` names what ``replay`` gives for each row of a block, besides the key and the state that leaves; no state is None."""

    schema: str

    def summary(self, rows: Rows) -> Any: ...
    def leave(self, summary: Any, state: Any) -> Any: ...
    def replay(self, rows: Rows, state: Any) -> tuple[Rows, Any]: ...


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, int, Rows]]:
    """(key, block, columns) of rows that come sorted by key and block."""
    now, held = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        of = list(zip(columns["_key"], columns["_block"], strict=True))
        low = 0
        while low < len(of):
            if of[low] == of[-1]:
                high = len(of)
            else:
                high = low + 1
                while of[high] == of[low]:
                    high += 1
            part = {n: v[low:high] for n, v in columns.items()}
            if held is not None and of[low] == now:
                for n, v in part.items():
                    held[n] += v
            else:
                if held is not None:
                    yield (*now, held)
                now, held = of[low], part
            low = high
    if held is not None:
        yield (*now, held)


def table(schema: pa.Schema, rows: Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: rows[n] for n in schema.names}, schema=schema)


def dealt_blocks(rows: DataFrame, key: str, order: list[str], block: int) -> DataFrame:
    """The rows with _key, _block and _place, as a table."""
    c = F.col
    places = numbered(deal(rows.where(c(key).isNotNull()), [key], order))
    return written(places.withColumns({"_key": c(key), "_block": F.floor((c("_place") - 1) / block)}), "blocks")


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_place")


def composed(cells: DataFrame, machine: Machine) -> DataFrame:
    """(_key, _block, _state): the state that enters each block."""
    head = [cells.schema["_key"], StructField("_block", LongType())]
    with_summary = StructType([*head, StructField("_summary", BinaryType())])
    with_state = StructType([*head, StructField("_state", BinaryType())])
    first, second = to_arrow_schema(with_summary), to_arrow_schema(with_state)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b, rows in groups(batches):
            yield table(first, {"_key": [k], "_block": [b], "_summary": [pickle.dumps(machine.summary(rows))]})

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: Rows = {"_key": batch.column("_key").to_pylist(), "_block": batch.column("_block").to_pylist(), "_state": []}
            for k, summary in zip(out["_key"], batch.column("_summary").to_pylist(), strict=True):
                if k != now:
                    now, state = k, None
                out["_state"].append(pickle.dumps(state))
                state = machine.leave(pickle.loads(summary), state)
            yield table(second, out)

    summaries = by_block(cells).mapInArrow(summarised, with_summary)
    return summaries.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(applied, with_state)


def replayed(cells: DataFrame, states: DataFrame, machine: Machine, key: str) -> DataFrame:
    """What the machine gives for each row, and for each block a row with the state that leaves it (``_state``, else null)."""
    names = [f.name for f in _parse_datatype_string(machine.schema).fields]
    out = StructType([cells.schema["_key"], StructField("_block", LongType()), *_parse_datatype_string(machine.schema).fields, StructField("_state", BinaryType())])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b, rows in groups(batches):
            state = pickle.loads(rows.pop("_state")[0])  # the first row holds it
            found, left = machine.replay({n: v[1:] for n, v in rows.items()}, state)
            n = len(next(iter(found.values())))
            filled = {f: [*found[f], None] for f in names}
            yield table(shape, {"_key": [k] * (n + 1), "_block": [b] * (n + 1), **filled, "_state": [None] * n + [pickle.dumps(left)]})

    both = cells.withColumn("_state", F.lit(None).cast("binary")).unionByName(states.withColumn("_place", F.lit(0).cast("long")), allowMissingColumns=True)
    return by_block(both).mapInArrow(run, out)


def result(rows: DataFrame, machine: Machine, key: str) -> DataFrame:
    names = [f.name for f in _parse_datatype_string(machine.schema).fields]
    return rows.where("_state is null").select(F.col("_key").alias(key), *names)


def fold(rows: DataFrame, key: str, order: list[str], machine: Machine, block: int = BLOCK) -> DataFrame:
    """(key, what the machine gives for each row). Rows without a key are none of the machine's; ``order`` tells all rows of a key apart."""
    cells = dealt_blocks(rows, key, order, block)
    return result(replayed(cells, composed(cells, machine), machine, key), machine, key)


def settled_fold(rows: DataFrame, key: str, order: list[str], machine: Machine, block: int = BLOCK) -> DataFrame:
    """As ``fold``, for machines whose summaries only guess."""
    c, at = F.col, ["_key", "_block"]
    cells = dealt_blocks(rows, key, order, block)
    entered = written(composed(cells, machine), "entered")
    found: list[DataFrame] = []
    again = entered
    while True:
        here = cells if not found else cells.join(again.select(*at), at, "left_semi")
        found = [f.join(again.select(*at), at, "left_anti") for f in found]
        found.append(written(replayed(here, again, machine, key), "replayed"))
        left = found[-1].where("_state is not null").select("_key", (c("_block") + 1).alias("_block"), c("_state").alias("_left"))
        changed = written(entered.join(left, at).where("_left <> _state").select(*at, c("_left").alias("_state")), "changed")
        if not changed.limit(1).count():
            break
        entered = written(entered.join(changed.select(*at), at, "left_anti").unionByName(changed), "entered")
        again = changed
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return result(out, machine, key)


class Fifo:
    """A set of at most ``cap`` members that forgets the one that came first: a member passes if it is not held, and is held then.

    The state is the held members in order. A null member always passes and is never held. The guess: each different member of a block
    is taken to come in once, where it is first seen, unless it is held.
    """

    schema = "id long, passes boolean"

    def __init__(self, cap: int, member: str, row: str = "id"):
        self.cap, self.member, self.row = cap, member, row

    def summary(self, rows: Rows) -> list:
        return [m for m in dict.fromkeys(rows[self.member]) if m is not None][-self.cap :]

    def leave(self, summary: list, state: list | None) -> list:
        held = dict.fromkeys(state or [])
        return [*held, *[m for m in summary if m not in held]][-self.cap :]

    def replay(self, rows: Rows, state: list | None) -> tuple[Rows, list]:
        held, passes = dict.fromkeys(state or []), []
        for m in rows[self.member]:
            passes.append(m is None or m not in held)
            if m is not None and m not in held:
                held[m] = None
                if len(held) > self.cap:
                    del held[next(iter(held))]
        return {"id": rows[self.row], "passes": passes}, list(held)


class CountOrTime:
    """Batches that close at ``count`` rows or ``wait`` after their first row, whichever is first; a row at just that time begins another one.

    The state is (time of the open batch's first row, its rows, number of the batch).
    """

    schema = "id long, batch long, place long"

    def __init__(self, count: int, wait: int, time: str = "us", row: str = "id"):
        self.count, self.wait, self.time, self.row = count, wait, time, row

    def heads(self, us: list[int], at: int) -> list[int]:
        """The rows that begin a batch, from row ``at`` on."""
        out = []
        while at < len(us):
            out.append(at)
            at = min(at + self.count, bisect_left(us, us[at] + self.wait))
        return out

    def first(self, us: list[int], state: tuple | None) -> int:
        """The first row that does not join the open batch."""
        return 0 if state is None else min(self.count - state[1], bisect_left(us, state[0] + self.wait), len(us))

    def summary(self, rows: Rows) -> tuple:
        """The times of the first rows, and for each row that can begin the first batch here: the last batch and the number of batches."""
        us, n = rows[self.time], len(rows[self.time])
        after: list[tuple] = [()] * n
        for i in range(n - 1, -1, -1):
            j = min(i + self.count, bisect_left(us, us[i] + self.wait))
            after[i] = (us[i], n - i, 1) if j >= n else (*after[j][:2], after[j][2] + 1)
        return us[: self.count], after[: self.count + 1], n

    def leave(self, summary: tuple, state: tuple | None) -> tuple:
        us, after, n = summary
        at = self.first(us, state)
        if at >= n:  # all rows join the open batch
            return (state[0], state[1] + n, state[2])
        begin, k, batches = after[at]
        return begin, k, (state[2] if state else 0) + batches

    def replay(self, rows: Rows, state: tuple | None) -> tuple[Rows, tuple]:
        us, n = rows[self.time], len(rows[self.time])
        at, number = self.first(us, state), state[2] if state else 0
        batch, place = [number] * at, [state[1] + i + 1 for i in range(at)] if state else []
        heads = self.heads(us, at)
        for low, high in zip(heads, [*heads[1:], n], strict=False):
            number += 1
            batch += [number] * (high - low)
            place += range(1, high - low + 1)
        if not heads:
            return {"id": rows[self.row], "batch": batch, "place": place}, (state[0], state[1] + n, number)
        return {"id": rows[self.row], "batch": batch, "place": place}, (us[heads[-1]], n - heads[-1], number)


class Leases:
    """Who holds a key: a claim succeeds where nobody holds it, a renewal or release only by the holder; a lease ends ``ttl`` after its last success.

    The state is (holder, when the lease ends, number of the lease); the holder is None after a release. What happens after a success
    does not depend on anything before it, so a block is summarised by what follows from the first renewal or release of each
    worker, and from each claim that can be the first to succeed (those up to ``ttl`` after the block's first row, and the next one).
    """

    schema = "id long, outcome string, lease long"

    def __init__(self, ttl: int, time: str = "us", worker: str = "worker", action: str = "action", row: str = "id"):
        self.ttl, self.time, self.worker, self.action, self.row = ttl, time, worker, action, row

    def following(self, rows: Rows) -> tuple[list[int], dict]:
        """For each row, were it a success: the next success (or the number of rows). Also each worker's first renewal or release."""
        us, workers, actions = rows[self.time], rows[self.worker], rows[self.action]
        n = len(us)
        next_claim, own, out = [n] * (n + 1), {}, [n] * n
        for i in range(n - 1, -1, -1):
            if actions[i] == "release":
                out[i] = next_claim[i + 1]
            else:
                ends, j = us[i] + self.ttl, own.get(workers[i], n)
                out[i] = j if j < n and us[j] < ends else next_claim[max(i + 1, bisect_left(us, ends))]
            next_claim[i] = i if actions[i] == "claim" else next_claim[i + 1]
            if actions[i] != "claim":
                own[workers[i]] = i
        return out, own

    def after(self, rows: Rows, i: int, n_leases: int) -> tuple:
        released = rows[self.action][i] == "release"
        return None if released else rows[self.worker][i], rows[self.time][i] + self.ttl, n_leases

    def summary(self, rows: Rows) -> tuple[dict, list]:
        us, actions = rows[self.time], rows[self.action]
        following, own = self.following(rows)
        n = len(us)
        leaves: list[tuple] = [()] * n
        for i in range(n - 1, -1, -1):
            claims = int(actions[i] == "claim")
            j = following[i]
            leaves[i] = self.after(rows, i, claims) if j >= n else (*leaves[j][:2], leaves[j][2] + claims)
        claims = []
        for i in range(n):
            if actions[i] == "claim":
                claims.append((us[i], leaves[i]))
                if us[i] >= us[0] + self.ttl:
                    break
        return {w: (us[i], leaves[i]) for w, i in own.items()}, claims

    def leave(self, summary: tuple[dict, list], state: tuple | None) -> tuple | None:
        own, claims = summary
        worker, ends, number = state or (None, None, 0)
        if worker is not None and worker in own and own[worker][0] < ends:
            found = own[worker][1]
        else:
            found = next((x for t, x in claims if worker is None or t >= ends), None)
        return state if found is None else (*found[:2], number + found[2])

    def replay(self, rows: Rows, state: tuple | None) -> tuple[Rows, tuple | None]:
        us, workers, actions = rows[self.time], rows[self.worker], rows[self.action]
        holder, ends, number = state or (None, None, 0)
        outcome, lease = [], []
        for t, w, a in zip(us, workers, actions, strict=True):
            held = holder is not None and t < ends
            if a == "claim":
                good = not held
                if good:
                    holder, number = w, number + 1
            else:
                good = held and holder == w
            if good:
                ends = t + self.ttl
                if a == "release":
                    holder = None
            outcome.append({"claim": "claimed", "renew": "renewed", "release": "released"}[a] if good else "refused")
            lease.append(number if good else None)
        return {"id": rows[self.row], "outcome": outcome, "lease": lease}, None if number == 0 else (holder, ends, number)
