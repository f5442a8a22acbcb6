"""Token ids in binary files, with document boundaries in Elias-Fano code.

A file (shard) holds one concatenated array of ids and two monotone sequences in Elias-Fano code: where each document ends
in that array, and the document ids. A sequence of n values below u takes 2 + log2(u / n) bits a value: the low bits packed,
the high bits in unary in a bit vector. ``select`` finds the i-th one of that vector from a sampled pointer (32 bits for each
``SAMPLE`` values) and the counts of the words after it; there is no table of 64-bit offsets.

    magic (8 bytes), 8 unsigned 64-bit integers: documents, ids, bytes of an id, documents without doc_id, least doc_id, and
    the bytes of the ends, of the document ids, of the ids; then these three sections. All little-endian.

Writing: documents are dealt to tasks by ranges of doc_id (and digest of the text, so a repeated doc_id is no single task) and sorted;
each task encodes and appends ids to files of its own in the shared folder, another one beyond ``SHARD_IDS``, and returns their
paths. A name holds the task attempt, so only attempts that succeeded are ever read. The order of the files is the order of
doc_id; where each begins in the whole is a running sum over the files' counts (a row for each file). Reading: each file is
read by one task, in parts.

Cases: null text is empty (one end id); a special token's string in a text becomes its id, as in the library; null doc_id comes first,
and repeated ones are ordered by a digest of the text, then the text; equal rows give equal documents one after the other; a very long
text is whole in one file, whatever its length; other columns are ignored; an empty table writes no file and reads as an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.session import shared_folder

from .bpe import chunks, id_and_text, without_collector
from .shared import written
from .tokens import byte_level
from .warc import storage

#: Ids and documents from which on a task begins another file; characters encoded together; ids read together.
SHARD_IDS, SHARD_DOCS, CHUNK_CHARS, READ_IDS = 1 << 25, 1 << 20, 4_000_000, 1 << 20
#: Ones of the bit vector from one sampled pointer to the next.
SAMPLE = 256
MAGIC, HEADER, SEQUENCE = b"EFTOKEN1", "<8s8Q", "<3Q"


class EliasFano:
    """A sequence of non-decreasing integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        bits = max(0, (int(v[-1] + np.uint64(1)) // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            planes = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            packed = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
            low[: len(packed)] = packed
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(at[-1]) + 64) // 64 * 64 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack(SEQUENCE, self.n, self.low_bits, len(self.high)) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, size = struct.unpack_from(SEQUENCE, data)
        at = struct.calcsize(SEQUENCE)
        k = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", k, at)
        high = np.frombuffer(data, np.uint8, size, at + 4 * k)
        return cls(n, bits, np.frombuffer(data, np.uint8, offset=at + 4 * k + size), high, samples)

    def select(self, i: int) -> int:
        """The place of the i-th one: counts of words from the sampled pointer on, then the bits of one word."""
        words = self.high.view("<u8")
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at >> 6
        now = int(words[word]) & (-1 << (at & 63))  # the pointer's own one is the first
        while (k := now.bit_count()) <= left:
            left, word = left - k, word + 1
            now = int(words[word])
        for _ in range(left):
            now &= now - 1
        return word * 64 + (now & -now).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        b = self.low_bits
        first = i * b
        rest = int.from_bytes(self.low[first >> 3 : (first + b + 7 >> 3)].tobytes(), "little") >> (first & 7) & ((1 << b) - 1)
        return (self.select(i) - i) << b | rest

    def range(self, low: int, high: int) -> np.ndarray:
        """The values from place ``low`` up to ``high``, exclusive, from the sampled pointer before them on."""
        if low >= high:
            return np.zeros(0, np.int64)
        at = int(self.samples[low // SAMPLE]) >> 3
        last = (high - 1) // SAMPLE + 1
        end = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:end], bitorder="little")) + at * 8
        ones = ones[ones >= int(self.samples[low // SAMPLE])]
        first = low - low % SAMPLE
        upper = ones[low - first : high - first] - np.arange(low, high)
        b = self.low_bits
        if not b:
            return upper
        start, stop = low * b, high * b
        bits = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].reshape(-1, b)
        return (upper << b) | (bits.astype(np.int64) << np.arange(b)).sum(axis=1)

    def place_of(self, value: int) -> int:
        """How many values are at most ``value``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self[middle] <= value else (low, middle)
        return low


class Shard:
    """A file, read at random: only its header and the two coded sequences are in memory."""

    def __init__(self, path: str):
        system, at = storage(path)
        self.file = system.open_input_file(at)
        head = struct.calcsize(HEADER)
        magic, self.n_docs, self.n_ids, width, self.n_null, least, *sizes = struct.unpack(HEADER, self.file.read_at(head, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.kind, self.least = np.dtype(f"<u{width}"), least - (1 << 64) if least >> 63 else least
        self.ends = EliasFano.from_bytes(self.file.read_at(sizes[0], head))
        self.doc_ids = EliasFano.from_bytes(self.file.read_at(sizes[1], head + sizes[0]))
        self.first = head + sizes[0] + sizes[1]
        if self.file.size() != self.first + sizes[2] or sizes[2] != self.n_ids * width:
            raise ValueError(f"{path} is incomplete")

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends[i - 1] if i else 0, self.ends[i]

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids from place ``low`` up to ``high`` of the array."""
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((high - low) * w, self.first + low * w), self.kind)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.doc_ids[i - self.n_null] + self.least

    def document_at(self, place: int) -> int:
        """Which document holds the id at ``place``."""
        return self.ends.place_of(place)


def write_shards(docs: DataFrame, vocab_path: str, end_id: int = 0, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes and writes all documents; (part, no, path, n_docs, n_ids, coded_bytes, base) per file, ``base`` the ids before it."""
    target = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encode = TaskContext.get(), byte_level(vocab_path)
        end, no = np.array([end_id], encode.kind).tobytes(), 0
        system, base = storage(target)
        parts: list[bytes] = []
        sizes: list[int] = []
        known: list[int | None] = []

        def flush() -> pd.DataFrame:
            nonlocal no, parts, sizes, known
            system.create_dir(base, recursive=True)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{no:05d}.tokens"
            some = [i for i in known if i is not None]
            least = some[0] if some else 0
            ends = EliasFano.of(np.cumsum(np.array(sizes, np.int64))).to_bytes()
            ids = EliasFano.of(np.array([i - least for i in some], np.uint64)).to_bytes()
            width = encode.kind.itemsize
            head = struct.pack(HEADER, MAGIC, len(sizes), sum(sizes), width, len(known) - len(some), least % (1 << 64), len(ends), len(ids), sum(sizes) * width)
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(head + ends + ids)
                for p in parts:
                    out.write(p)
            row = (task.partitionId(), no, f"{target}/{name}", len(sizes), sum(sizes), len(ends) + len(ids))
            parts, sizes, known, no = [], [], [], no + 1
            return pd.DataFrame([row], columns=["part", "no", "path", "n_docs", "n_ids", "coded_bytes"])

        held = 0
        for batch in without_collector(batches):
            texts = ["" if t is None else t for t in batch["text"]]
            for low, high in chunks([len(t) for t in texts], CHUNK_CHARS):
                got = encode(texts[low:high])
                ids = [None if i == "" else int(i) for i in batch["doc_id"].iloc[low:high]]
                for doc_id, data in zip(ids, got, strict=True):
                    parts += (data, end)
                    sizes.append(len(data) // len(end) + 1)
                    known.append(doc_id)
                    held += sizes[-1]
                    if held >= shard_ids or len(sizes) >= SHARD_DOCS:
                        held = 0
                        yield flush()
        if sizes:
            yield flush()

    c = F.col
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "digest"]
    rows = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.select(F.coalesce(c("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")  # whole numbers stay exact beside nulls
    files = written(rows.mapInPandas(run, "part int, no int, path string, n_docs long, n_ids long, coded_bytes long"), "shards")
    earlier = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).cast("long"))


def each_document(shard: Shard) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, begin, end) of each document, decoded in runs."""
    before = 0
    for low in range(0, shard.n_docs, 1 << 14):
        high = min(shard.n_docs, low + (1 << 14))
        ids = shard.doc_ids.range(max(low, shard.n_null) - shard.n_null, max(high, shard.n_null) - shard.n_null)
        nulls = [None] * (high - low - len(ids))
        for doc_id, end in zip(nulls + [i + shard.least for i in ids.tolist()], shard.ends.range(low, high).tolist(), strict=True):
            yield doc_id, before, end
            before = end


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) per document of the files, ``start`` its place in the whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                with Shard(path) as shard:
                    held, n = [], 0
                    for doc_id, low, high in each_document(shard):
                        held.append((doc_id, base + low, shard.ids(low, high).astype(np.int64)))
                        n += high - low
                        if n >= READ_IDS:
                            yield frame(held, ["doc_id", "start", "ids"])
                            held, n = [], 0
                    yield frame(held, ["doc_id", "start", "ids"])

    return one_task_each(files).mapInPandas(run, "doc_id long, start long, ids array<long>")


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the files; the checksum is of the ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                with Shard(path) as shard:
                    rows, at, held = [], 0, b""
                    for doc_id, low, high in each_document(shard):
                        crc = 0
                        for place in range(low, high, READ_IDS):  # a document longer than that is read in parts
                            until = min(high, place + READ_IDS)
                            if until > at + len(held) // 4:
                                at, held = place, shard.ids(place, min(shard.n_ids, place + READ_IDS)).astype("<u4").tobytes()
                            crc = zlib.crc32(memoryview(held)[(place - at) * 4 : (until - at) * 4], crc)
                        rows.append((doc_id, base + low, high - low, crc))
                        if len(rows) >= 10_000:
                            yield frame(rows, ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    yield frame(rows, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return one_task_each(files).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def one_task_each(files: DataFrame) -> DataFrame:
    files = files.select("path", "base")
    return files.repartition(max(1, files.count()), "path")


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out
