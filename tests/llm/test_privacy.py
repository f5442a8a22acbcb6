import hashlib
import math
import random
import re

import pytest

from trailmark.llm import privacy


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(0, m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), "phone", m.end()))
    return out


TEXTS = [
    None, "", "nothing", "é😀 a.b@c.d.e, x@y x@y.z. q@@a.b a@b.cx_y@z.com @a.b.c ..@a..b a@-.- b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.00255 1.2.3 1.2.3.4444444444444",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 411111111111111111111111 1 2 3 4 5 6 7 8 9", "+1 (743) 555-3824 +12 +1234567890123456 + 1 +1.2.3.4.5.6.7.8.9) ++15555550123-",
    " ab@c.d 41111111 4111 1111 1111 1111", "7" * 20000, "1 " * 20000, "a." * 20000 + "@b.c", "a@b" + ".c" * 20000, "1." * 9000,
]


def show(spans):
    return ",".join(f"{k}:{a}:{b}" for _, a, k, b in spans)


def test_base(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choices(["a", "@", ".", "1", "23", "+", " ", "-", "(", "_", "x.y", "255", "é"], k=r.randint(0, 120))) for _ in range(400)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5])]
    got = privacy.digests(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as email", "2 as entity", "3 as n_t")).collect()
    assert len(got) == len(rows)
    for x in got:
        base = brute(texts[5 if x.doc_id is None else x.doc_id])
        kinds = [s[2] for s in base]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == list(map(kinds.count, privacy.KINDS[:4])), texts[x.doc_id][:100]
        assert x.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and x.spans.startswith(show(base))


def test_disclosing_terms(spark):
    r = random.Random(4)
    vocab = ["word%s" % "abcdefghij"[i] for i in range(10)]
    texts = [" ".join(r.choices(vocab, k=12)) for _ in range(60)]
    for i in range(8):  # a nickname that gives an address away, a name that half gives it away
        texts.append(f"{' '.join(r.choices(vocab, k=5))} Nightowl {'Halfling ' if i < 6 else ''}wrote to boss@corp.example and {' '.join(r.choices(vocab, k=5))}")
    texts += ["Halfling alone " + " ".join(r.choices(vocab, k=4))] * 2
    texts += ["single context unique-name writes one@corp.example today"] * 9  # copies prove nothing
    n = len(texts)
    words = [set(w for w in re.split(r"[^\w'-]+", t.lower()) if len(w) >= privacy.TERM_LETTERS) for t in texts]
    has = [i for i, t in enumerate(texts) if "boss@" in t]
    ratio = {}
    for t in set().union(*words):
        both = sum(t in words[i] for i in has)
        if both >= privacy.CONTEXTS:
            ratio[t] = math.log2(n * both / (len(has) * sum(t in w for w in words))) / math.log2(n / len(has))
    flagged = {t for t, x in ratio.items() if x >= privacy.GENERALISE} - {"boss", "corp", "example"}
    assert "nightowl" in flagged
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in privacy.digests(df).collect():
        text = texts[x.doc_id]
        base = show(brute(text))
        found = [(int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"]
        want = [m.span() for m in re.finditer(r"[^\W\d_][\w'-]*", text) if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for _, a, _, b in brute(text))] if x.doc_id in has else []
        assert sorted(found) == want, (text, base)
    out = {x.doc_id: x.text for x in privacy.sanitised(df).collect()}
    assert "<email>" in out[60] and "Nightowl" not in out[60] and "boss" not in out[60] and out[0] == texts[0]


def test_signatures_of_different_texts(spark):
    """A name in a fixed signature beside an address is evidence where the texts above differ, and so is one far from it; copies of one text are none."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    for _ in range(6):
        texts.append("Farthing " + " ".join(word() for _ in range(60)) + "\nwritten and signed by Nightowl, a.b@corp.example, all rights of the authors")
    texts += ["Written by Copycat, c.d@corp.example"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in privacy.digests(df).collect():
        text = texts[x.doc_id]
        found = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"}
        assert all((w in found) == (w in text) for w in ("Nightowl", "Farthing")) and "Copycat" not in found, text


@pytest.mark.parametrize("layout", ["beside", "far", "both"])
def test_any_distance(spark, layout):
    """A name that only documents with one address hold gives it away at any distance."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    for i in range(12):
        middle = " ".join(word() for _ in range(70 if layout == "far" or (layout == "both" and i % 2) else 1))
        texts.append(f"{' '.join(word() for _ in range(9))} Nightowl {middle} boss@corp.example {' '.join(word() for _ in range(40))}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = privacy.digests(df).collect()
    n, has = len(texts), [set(re.findall(r"[a-z']{4,}", t.lower())) for t in texts if "boss@" in t]
    for x in rows:
        text = texts[x.doc_id]
        found = {text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"}
        # By brute force over documents: PMI against information content.
        flagged = set()
        for t in set().union(*has) if "boss@" in text else ():
            both, alone = sum(t in w for w in has), sum(t in re.findall(r"[a-z']{4,}", d.lower()) for d in texts)
            if both >= privacy.CONTEXTS and math.log2(n * both / (len(has) * alone)) / math.log2(n / len(has)) >= privacy.GENERALISE:
                flagged.add(t)
        assert found == (flagged - {"boss", "corp", "example"}) & set(re.findall(r"[a-z']{4,}", text.lower()))
        assert ("nightowl" in found) == ("boss@" in text)


def test_ids_shared_by_different_texts(spark):
    rows = [(1, "a@b.cd"), (1, "nothing"), (None, "1.2.3.4"), (None, "a@b.cd and 1.2.3.4"), (None, None)]
    got = privacy.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.n_email, x.n_ip) for x in got) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]


def test_empty(spark):
    assert privacy.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
