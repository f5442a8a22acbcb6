"""WARC archives: one gzip member per record, written by tasks, read back sequentially.

Writing: each task streams its rows into archives of its own in the shared folder, starting another beyond
``ARCHIVE_BYTES``, and returns their paths; a name holds the task attempt, so only the attempt that succeeded is ever read.
Of records with equal payloads (of ``min_bytes`` at least) the one with the smallest page_id is a response, the others
are revisits that name it and carry no payload. Only (page_id, digest) pairs are grouped for that, combined before the shuffle;
a large group of copies is a single key of counts, and the join back may be split where it is skewed.

Reading: an archive is decompressed in steps of ``READ_BYTES``, member by member; a record is its header block, then
``Content-Length`` bytes which are digested as they come. A wrong digest, a short or a broken member is reported in
``damage``, and reading goes on with the next member where there is one.

Cases: null html is an empty payload; null url an empty target; null page_id stays null and is last in the order; rows that repeat a page_id and
payload: one response, the others revisit it; other columns are ignored; an empty table writes no archive and reads as an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.session import shared_folder

from .shared import written

ARCHIVE_BYTES, READ_BYTES, HEADER_BYTES = 256 << 20, 256 << 10, 64 << 20
#: Version line, and profile of revisits with an equal payload.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:page:{}>"
FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, damage string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def storage(path: str):
    """File system and path of a URI, as tasks see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """The bytes of a record, uncompressed; a revisit has the response's header block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {RECORD.format('' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {RECORD.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): what becomes of each page."""
    c = F.col
    rows = pages.select(c("page_id").cast("long").alias("page_id"), F.coalesce(c("url").cast("string"), F.lit("")).alias("url"), F.coalesce(c("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"h": F.sha1("html"), "order": F.coalesce("page_id", F.lit(2**63 - 1))})
    ids = rows.where(F.octet_length("html") >= min_bytes).groupBy("h", "order").agg(F.count("*").alias("copies"))
    firsts = ids.groupBy("h").agg(F.min("order").alias("first"), F.sum("copies").alias("n")).where("n > 1").select("h", "first")
    known = written(ids.join(firsts, "h"), "copies")
    out = rows.join(known.select("h", "order", "first"), ["h", "order"], "left")
    place = F.lit(1)
    if known.where((c("copies") > 1) & (c("order") == c("first"))).limit(1).count():  # rows repeated as a whole
        place = F.row_number().over(Window.partitionBy("h", "order").orderBy("url"))
    out = out.withColumn("place", place)
    return out.select("page_id", "url", "html", F.when((c("order") != c("first")) | (c("place") > 1), c("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes every row as a record and returns (archive, records, bytes), one row per archive."""
    target = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n, out, name, count, size = TaskContext.get(), 0, None, "", 0, 0
        system, base = storage(target)
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.gz"
                    out, count, size, n = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0, n + 1
                payload = html.encode("utf-8", "surrogatepass")
                clean = url.replace("\r", "%0D").replace("\n", "%0A")
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                plain = record(None if page_id == "" else page_id, clean, payload, base32(hashlib.sha1(payload).digest()), len(payload), None if refers_to == "" else refers_to, date)
                data = pack.compress(plain) + pack.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pd.DataFrame([(f"{target}/{name}", count, size)], columns=["archive", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{target}/{name}", count, size)], columns=["archive", "records", "bytes"])

    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)  # noqa: E731  whole numbers stay exact beside nulls
    rows = planned(pages, min_bytes).select(text("page_id"), "url", "html", text("refers_to"))
    return written(rows.mapInPandas(run, "archive string, records long, bytes long"), "archives")


class Members:
    """The decompressed bytes of an archive, member by member, in steps."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.offset = stream, b"", 0
        self.data, self.unzip = b"", None

    def begin(self) -> bool:
        """Opens the next member; false at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        self.data, self.unzip = b"", zlib.decompressobj(31)
        return bool(self.rest)

    def more(self) -> bool:
        """Adds bytes to ``data``; false at the end of the member."""
        while not self.unzip.eof:
            if not self.rest:
                self.rest = self.stream.read(READ_BYTES)
            if not self.rest:
                raise EOFError("the archive ends inside a member")
            before = len(self.rest)
            got = self.unzip.decompress(self.rest, READ_BYTES)
            self.rest = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            self.offset += before - len(self.rest)
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if seen > HEADER_BYTES:
                raise ValueError("a header without an end")
            if not self.more():
                raise EOFError("the member ends inside a header")
        out, self.data = self.data[:at], self.data[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in parts."""
        while n:
            if not self.data and not self.more():
                raise EOFError("the member is shorter than its Content-Length")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive; of a payload only length and digest are kept, unless ``payloads``."""
    members = Members(stream)
    while members.begin():
        out = dict.fromkeys(["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "damage", "payload"]) | {"offset": members.offset}
        try:
            version, *lines = members.until(b"\r\n\r\n").split(b"\r\n")
            if version != VERSION:
                raise ValueError("no record begins here")
            head = {k.lower(): v for k, v in (x.decode("utf-8", "replace").split(": ", 1) for x in lines)}
            number = lambda k: int(x) if (x := head.get(k, "")[10:-1]) else None
            out |= {"page_id": number("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": number("warc-refers-to")}
            block, payload, size, held, body = hashlib.sha1(), hashlib.sha1(), 0, bytearray(), False
            kept: list[bytes] = []
            http = b""
            for part in members.take(int(head["content-length"])):
                block.update(part)
                if not body:
                    seen = max(0, len(held) - 4)
                    held += part
                    if (at := held.find(b"\r\n\r\n", seen)) < 0:
                        if len(held) > HEADER_BYTES:
                            raise ValueError("a header without an end")
                        continue
                    http, part, body = bytes(held[:at]), bytes(held[at + 4 :]), True
                payload.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            while members.more():
                if len(members.data) > 4:
                    raise ValueError("the member is longer than its record")
            said = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if head["warc-type"] == "revisit":
                fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
                out |= {"payload_bytes": int(fields[b"Content-Length"]), "payload_digest": said}
            else:
                out |= {"payload_bytes": size, "payload_digest": base32(payload.digest()), "payload": b"".join(kept) if payloads else None}
                if out["payload_digest"] != said:
                    out["damage"] = "payload digest"
            if base32(block.digest()) != head.get("warc-block-digest", "").removeprefix("sha1:"):
                out["damage"] = out["damage"] or "block digest"
        except (ValueError, KeyError, EOFError, zlib.error) as e:
            out["damage"] = str(e) or type(e).__name__
            yield out
            if isinstance(e, zlib.error) or not members.unzip or not members.unzip.eof:
                try:
                    while members.more():
                        members.data = b""
                except (EOFError, zlib.error):
                    return
            continue
        yield out


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives (column ``archive``: URIs), each archive read by one task from its start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for batch in batches:
            for archive in batch["archive"]:
                system, path = storage(archive)
                rows: list[dict] = []
                with system.open_input_stream(path, compression=None) as stream:
                    for x in read_records(stream):
                        rows.append(x | {"archive": archive})
                        if len(rows) >= 5000:
                            yield frame(rows, names)
                            rows = []
                yield frame(rows, names)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInPandas(run, FIELDS)


def frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "payload_bytes", "refers_to", "offset"):
        out[c] = out[c].astype("Int64")
    return out
