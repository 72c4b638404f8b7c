"""Web archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and ends in the seek table of the seekable
format: a skippable frame with the compressed and plain size of every frame. The index maps a record id to bundle, frame and
the offset inside the plain frame, so that one record is read by decoding one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import filesystem
from palisade.llm.registry import query
from palisade.storage import materialize, scratch_path

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
# Fixed values of WARC 1.1.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
BUNDLES_A_TASK = 2
INDEX = "id string, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"
RECORD = "id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, intact boolean"


def digest(payload: bytes) -> str:
    """Base-32 SHA-1; 20 bytes need no padding."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A URL that fits a header line: control characters, spaces and non-ASCII are percent-encoded."""
    if not url:
        return "about:blank"
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _name(key: str | None, payload_digest: str) -> str:
    return f"<urn:page:{'' if key is None else key}:{payload_digest}>"


def _key(name: str) -> str | None:
    return name.removeprefix("<urn:page:").rpartition(":")[0] or None


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which tells the payload's length, and leaves the payload out."""
    sha = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(key, sha)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to, sha)}"]
    return VERSION + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview | bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` of a plain frame, and where the next one starts. Damage raises ``ValueError``."""
    raw = bytes(data) if not isinstance(data, bytes) else data
    stop = raw.find(b"\r\n\r\n", start)
    if stop < 0 or not raw.startswith(VERSION, start):
        raise ValueError(f"no WARC record at offset {start}")
    fields = dict(line.split(": ", 1) for line in raw[start + len(VERSION) : stop].decode().split("\r\n"))
    body = stop + 4
    end = body + int(fields["Content-Length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {start} is cut")
    payload_start = raw.index(b"\r\n\r\n", body) + 4
    length = int(re.search(rb"Content-Length: (\d+)", raw[body:payload_start])[1])
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else raw[payload_start:end]
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "id": _key(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": sha,
        "refers_to": _key(fields["WARC-Refers-To"]) if revisit else None,
        "payload": payload,
        "intact": None if revisit else len(payload) == length and digest(payload) == sha,
    }, end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of these (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *pair) for pair in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_sizes(source: pa.NativeFile, length: int) -> list[tuple[int, int]]:
    """(compressed, plain) sizes of all frames, from the footer of an open file."""
    source.seek(length - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the file")
    source.seek(length - 9 - 8 * count)
    return list(struct.iter_unpack("<II", source.read(8 * count)))


class _Bundle:
    """Writer of one bundle; what it returns is the index."""

    def __init__(self, folder: str) -> None:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"  # a name of its own for each attempt: only the index makes a bundle count
        self.out = system.open_output_stream(filesystem(self.name)[1], compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.written = 0
        self.waiting: list[tuple[str | None, bytes]] = []
        self.held = 0
        self.index: list[tuple] = []

    def add(self, key: str | None, data: bytes) -> None:
        self.waiting.append((key, data))
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        plain = b"".join(data for _, data in self.waiting)
        packed = self.packer.compress(plain)
        start = 0
        for key, data in self.waiting:
            self.index.append((key, self.name, len(self.sizes), self.written, len(packed), start, len(data)))
            start += len(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.written += len(packed)
        self.waiting, self.held = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        return self.index


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row below ``folder`` (shared by all executors) and return the index, a row per record.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is a response, the others are
    revisits of it; rows that repeat that id and payload are responses too. Null payloads are empty, a null id sorts last and
    is written as an empty id (responses only if all ids of the payload are null). A null URL becomes ``about:blank``.
    Payload groups are counted before any shuffle of payloads; the join to the group's first id has one row per payload on
    one side, so adaptive execution splits a payload that many rows share. A task that is run again writes new bundles, and
    only the bundles of the attempt that succeeded are in the index, which is written as a table at once.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    first = rows.groupBy("same").agg(F.min("id").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in INDEX.split(", ")]
        bundle = None

        def done(index: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*index)) or [[] for _ in names]
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("id", "url", "first"))
            for place, (key, url, head) in enumerate(zip(*columns)):
                data = batch["payload"][place].as_py()
                revisit = len(data) >= least_bytes and head is not None and key != head
                bundle = bundle or _Bundle(folder)
                shown = None if key is None else str(key)
                bundle.add(shown, record(shown, url, data, str(head) if revisit else None, revisit, date))
                if bundle.written >= BUNDLE_BYTES:
                    yield done(bundle.close())
                    bundle = None
        if bundle:
            yield done(bundle.close())

    joined = rows.join(first, "same").select("id", "url", "payload", "first")
    return materialize(joined.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles named in ``index``, read frame by frame with the seek table of each bundle.

    ``intact`` is true for a response whose payload has the length and digest that its headers state, null for revisits.
    Records come back in no stated order, with null and repeated page ids as they were written, a row each; empty payloads are
    empty, not null. An empty index gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch["bundle"].to_pylist():
                system, path = filesystem(name)
                length = system.get_file_info(path).size
                with system.open_input_file(path) as source:
                    sizes = frame_sizes(source, length)
                    source.seek(0)
                    for packed, plain in sizes:
                        data = unpacker.decompress(source.read(packed), max_output_size=plain)
                        found, at = [], 0
                        while at < len(data):
                            entry, at = parse(data, at)
                            found.append(entry if payloads else entry | {"payload": None})
                        yield pa.RecordBatch.from_pylist(found, _RECORD_SCHEMA)

    bundles = materialize(index.select("bundle").distinct(), "bundles")
    tasks = -(-bundles.count() // BUNDLES_A_TASK)  # a number of its own keeps adaptive execution from joining the tiny partitions
    return bundles.repartition(max(1, tasks), "bundle").mapInArrow(run, RECORD)


_RECORD_SCHEMA = pa.schema(
    [("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())]
)


def fetch_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows only: each is read by seeking to its frame and to its offset inside.

    A row that is asked for twice comes twice; null ids and empty payloads are as in ``read_archives``; no rows ask for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["bundle"])
                with system.open_input_file(path) as source:
                    source.seek(row["frame_start"])
                    data = unpacker.decompress(source.read(row["frame_bytes"]))
                yield pa.RecordBatch.from_pylist([parse(data, row["record_start"])[0]], _RECORD_SCHEMA)

    return index.mapInArrow(run, RECORD)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT *, sha1(payload) AS hex FROM p),
f AS (SELECT payload, min(page_id) AS head FROM p GROUP BY payload),
d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, head,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest
  FROM h JOIN f USING (payload)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM d
"""


@query("op1_seekable_archives", ORACLE)
def op1_seekable_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    found = read_archives(index, payloads=False)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
