import hashlib
import re

from trailmark.llm import secrets

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
RANDOM = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3dE5f"
TEXTS = [
    None, "", "plain prose, nothing here", 'say token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### more', "é😀 PASSWORD: hunter2hunter2 passwd=short api_key='abcdefgh' apiKey = x",
    f"{KEY} then {KEY[:15]} AKIAAKIA{KEY}", "f" * 31 + "g" + "0" * 32 + " " + "ab" * 16 + "G", f"id {KEY}\nkey {RANDOM}\n", f"lonely {RANDOM} here", f"{RANDOM} at https://db.example.com/x and user=alice",
    f"user=alice {'w ' * 150} {RANDOM}", "secret secret=secret:abcdefghij token==abcdefghi", "x" * 30000 + " token=abcdefgh1 " + "0123456789abcdef" * 300, ("token: abcdefgh%d " * 400) % tuple(range(400)),
]


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def show(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_base_and_linked(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[7])]
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as mark", "3 as hex")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[7 if r.doc_id is None else r.doc_id]
        base = brute(text)
        kinds = [k for _, _, k, _ in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, secrets.KINDS[:3]))
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        added = [x for x in r.spans.split(",") if x and x not in show(base).split(",")]
        at = (text or "").find(RANDOM)
        weak = f"weak_secret:{at}:{at + len(RANDOM)}"
        if r.doc_id in (7, None):
            assert added == [weak]
        elif r.doc_id == 9:
            assert weak in added and {x.split(":")[0] for x in added} == {"weak_secret", "endpoint", "weak_id"}
        else:
            assert not added, (r.doc_id, added)


def test_whole_weak_parts(spark):
    """Values after '=', with padding, and of any length."""
    long = RANDOM * 5
    name = "bob." * 30 + "x"
    url = "https://db.example.com/" + "path/" * 80
    cases = [
        (f"{KEY}\nAWS_SECRET_ACCESS_KEY={RANDOM}\n", "weak_secret", RANDOM),
        (f"export AWS_ACCESS_KEY_ID={KEY}; export AWS_SECRET_ACCESS_KEY='{RANDOM}'", "weak_secret", RANDOM),
        (f"?id={KEY}&sig={RANDOM}&x=1", "weak_secret", RANDOM),
        (f"{KEY} {RANDOM}=", "weak_secret", RANDOM + "="),
        (f"{KEY} KEY={RANDOM}==", "weak_secret", RANDOM + "=="),
        (f"{KEY} {long} end", "weak_secret", long),
        (f"user={name} {RANDOM}", "weak_id", name),
        (f"{KEY} token=abcdefgh1 {url}", "endpoint", url),
        ("token=abcdefgh1 at a.b.c.d.e.f.example:5432 now", "endpoint", "a.b.c.d.e.f.example:5432"),
        (f"token=abcdefgh1 at {'x' * 80}.example:80", "endpoint", "x" * 80 + ".example:80"),
        (f"token=abcdefgh1 at {'a.' * 30000}b:8080", "endpoint", "a." * 30000 + "b:8080"),
    ]
    for r in secrets.digests(spark.createDataFrame([(i, x[0]) for i, x in enumerate(cases)], "doc_id long, text string")).collect():
        text, kind, part = cases[r.doc_id]
        stop = text.find(part) + len(part)
        assert any(x.startswith(f"{kind}:") and x.endswith(f":{stop}") for x in r.spans.split(",")), (text, r.spans)


def test_scopes_across_buckets(spark):
    """Existence in scope, against all pairs, at many distances."""
    rows = []
    for gap in range(0, 420, 7):
        for lead in (0, 90, 199, 200, 350):
            rows.append((len(rows), "-" * 0 + " " * lead + f"login=bobby{' ' * gap} {RANDOM}"))
    for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        near = text.find(RANDOM) - text.find("login") <= secrets.SCOPE
        assert ("weak_secret" in r.spans) == near and ("weak_id" in r.spans) == near


def test_ids_shared_by_different_texts(spark):
    rows = [(1, f"{KEY} {RANDOM}"), (1, f"alone {RANDOM}"), (None, "token=abcdefgh1"), (None, None)]
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.n_assign, x.n_access, "weak_secret" in x.spans) for x in got) == [(0, 0, 0, False), (0, 1, 0, False), (1, 0, 0, False), (1, 0, 1, True)]


def test_masked_and_empty(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh1 b"), (2, "none")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.masked(df).collect()} == {1: "a <assign> b", 2: "none"}
    assert secrets.digests(df.where("doc_id > 5")).count() == 0
