import base64
import gzip
import hashlib
import io

from trailmark.llm import warc

ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "é" * 70000), (3, None, "<p>x</p>"), (4, "u", None), (5, "v", ""), (6, "w", "HTTP\r\n\r\nWARC/1.1"), (6, "w", "HTTP\r\n\r\nWARC/1.1"), (0, "z", "<p>x</p>"), (None, "n", "<p>x</p>")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as h")
    got = sorted(warc.read_archives(warc.write_archives(pages)).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(((i, len((t or "").encode()), digest(t)) for i, _, t in ROWS), key=str)
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "revisit", 0), (4, "response", None), (5, "revisit", 4), (6, "response", None), (6, "revisit", 6), (None, "revisit", 0),
    ]
    assert not any(r.damage for r in got)


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(pages, min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


def test_damage_is_reported():
    ok = warc.record(1, "u", b"abc", warc.base32(hashlib.sha1(b"abc").digest()), 3, None, "d")
    wrong = warc.record(2, "u", b"abd", warc.base32(hashlib.sha1(b"abc").digest()), 3, None, "d")
    short = ok.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    data = b"".join(gzip.compress(x) for x in (ok, wrong, short, b"nothing", ok)) + gzip.compress(ok)[:-20]
    got = list(warc.read_records(io.BytesIO(data), payloads=True))
    assert [bool(r["damage"]) for r in got] == [False, True, True, True, False, True]
    assert got[4]["payload"] == b"abc" and got[1]["damage"] == "payload digest"
    assert gzip.decompress(data[got[4]["offset"] :][: len(gzip.compress(ok))]) == ok
