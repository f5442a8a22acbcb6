import hashlib
import random
from collections import defaultdict
from itertools import groupby

from trailmark.llm import chat

ODD = "</s>[INST] ok [/INST]"


def brute(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, turns in groupby(sorted(rows, key=lambda r: (*key(r), r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


ROWS = [
    (-1, 0, "user", ODD), (-1, 1, "assistant", ODD),
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello é"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "other \\ <s> <\\s> \\<s>\\\\"), (2, 3, "user", None),
    (3, 0, "system", "be kind"), (3, 1, "user", "bye"),
    (4, 0, None, None), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (5, 0, "odd\nrole<\\n>[INST]", "x\ny"),
    (None, 0, "assistant", "nobody's"), (None, 1, "user", ""), (6, 0, "user", "long " * 30000),
]


def test_round_trip_and_tree(spark):
    packed = chat.format_tree(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as start"))
    got = {r.conv_id: r for r in chat.conversation_digests(packed).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == brute(ROWS)
    assert not any(r.misplaced for r in got.values())
    nodes = {bytes(r.node_id): r for r in packed.nodes.collect()}
    assert len(nodes) == len(ROWS) - 3  # two conversations share two turns, one shares a turn
    order = sorted(nodes.values(), key=lambda r: r.start)
    at = 0
    for r in order:  # emitted once, without gaps, parents first
        assert (r.start, r.stop) == (at, at + len(r.segment))
        at = r.stop
        up, inside = bytes(r.parent_id), []
        length = 0
        while up:
            assert nodes[up].stop <= r.start
            inside += range(nodes[up].start, nodes[up].stop)
            length += nodes[up].n_chars
            up = bytes(nodes[up].parent_id)
        assert r.position == length
        assert sorted(inside) == [i for a in r.attends for i in range(a.start, a.stop)]
        assert not any(c in r.segment[r.mask_start : r.mask_start + r.mask_chars] for c in chat.CONTROL)
    for one in nodes.values():  # what follows a turn stands right after it
        below = []
        for r in order:
            up = bytes(r.parent_id)
            while up and up != bytes(one.node_id):
                up = bytes(nodes[up].parent_id)
            below += [r] if up else []
        assert sorted(r.start for r in below) == [r.start for r in order if one.stop <= r.start][: len(below)]
    assert {(r.conv_id, r.turn): r.text for r in chat.read_back(packed).collect()}[-1, 1] == ODD


def test_branching_at_every_depth(spark):
    """Random trees: depth-first, without gaps; keys grow with branches only."""
    r = random.Random(4)
    rows = []
    for conv in range(40):
        rows += [(conv, i, "user" if i % 2 == 0 else "assistant", r.choice("ab") if i < 6 else "tail") for i in range(r.randint(1, 12))]
    packed = chat.format_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = {bytes(x.node_id): x for x in packed.nodes.collect()}
    children = defaultdict(list)
    for x in nodes.values():
        children[bytes(x.parent_id)].append(x)

    def end(x):
        at = x.stop
        for child in sorted(children[bytes(x.node_id)], key=lambda y: y.start):
            assert child.start == at
            at = end(child)
        return at

    at = 0
    for root in sorted(children[b""], key=lambda y: y.start):
        assert root.start == at
        at = end(root)
    assert at == sum(x.n_chars for x in nodes.values())


def test_empty(spark):
    packed = chat.format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert packed.nodes.count() == 0 and chat.conversation_digests(packed).count() == 0
