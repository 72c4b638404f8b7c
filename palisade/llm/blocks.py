"""Token ids on disk as patched frame-of-reference blocks.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A block stores its minimum and packs the
differences at a width that a percentile of them needs; the higher bits of the few wider ones go to an exception list.
The file ends with the documents' ids and lengths, the start of every block and a footer, so that any span of ids is read by
decoding the blocks it touches.

Layout, little-endian: blocks; document keys (int64), their null flags (uint8) and lengths (uint32); block starts (uint64);
footer of five numbers (uint64): offset of the keys, documents, ids, blocks, magic.
Block: count (uint32), minimum (uint32), width (uint8), exceptions (uint32), packed differences, positions (uint32), high bits (uint32).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.batches import filesystem
from palisade.llm.registry import query
from palisade.llm.wordtokens import word_encoder
from palisade.storage import materialize, scratch_path

BLOCK = 4096
PERCENTILE = 90
MAGIC = 0x31304B434F4C4250
FOOTER = struct.Struct("<5Q")
HEAD = struct.Struct("<IIBI")
MANIFEST = "part int, path string, docs long, tokens long"


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit ids."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    rank = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, rank)[rank]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    places = np.flatnonzero(high).astype("<u4")
    if width:
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    return HEAD.pack(len(ids), low, width, len(places)) + packed + places.tobytes() + high[places].astype("<u4").tobytes()


def unpack_block(data: bytes, start: int = 0) -> np.ndarray:
    """The ids of the block at ``start``."""
    count, low, width, exceptions = HEAD.unpack_from(data, start)
    start += HEAD.size
    size = -(-count * width // 8)
    rest = np.zeros(count, np.uint32)
    if width:
        bits = np.zeros((count, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, start), count=count * width, bitorder="little").reshape(count, width)
        rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    places = np.frombuffer(data, "<u4", exceptions, start + size)
    high = np.frombuffer(data, "<u4", exceptions, start + size + 4 * exceptions)
    rest[places] |= high << np.uint32(width)
    return rest + np.uint32(low)


class BlockWriter:
    """Writes one file; ids are held for one block at a time."""

    def __init__(self, path: str) -> None:
        system, inner = filesystem(path)
        self.out = system.open_output_stream(inner, compression=None)
        self.at = self.tokens = 0
        self.waiting: list[bytes] = []
        self.held = 0
        self.starts: list[int] = []
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * 4 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for start in range(0, whole, BLOCK):
            data = pack_block(ids[start : min(start + BLOCK, whole)])
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting = [ids[whole:].tobytes()]
        self.held = len(self.waiting[0])

    def close(self) -> None:
        self._flush(True)
        tail = (np.array(self.keys, "<i8"), np.array(self.nulls, np.uint8), np.array(self.lengths, "<u4"), np.array(self.starts, "<u8"))
        self.out.write(b"".join(a.tobytes() for a in tail) + FOOTER.pack(self.at, len(self.keys), self.tokens, len(self.starts), MAGIC))
        self.out.close()


class BlockReader:
    """Reads one file: the index at once, blocks as they are asked for."""

    def __init__(self, path: str) -> None:
        system, inner = filesystem(path)
        length = system.get_file_info(inner).size
        self.source = system.open_input_file(inner)
        self.source.seek(length - FOOTER.size)
        self.end, docs, self.tokens, blocks, magic = FOOTER.unpack(self.source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.source.seek(self.end)
        self.keys = np.frombuffer(self.source.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(self.source.read(docs), np.uint8).astype(bool)
        self.lengths = np.frombuffer(self.source.read(4 * docs), "<u4").astype(np.int64)
        self.starts = np.frombuffer(self.source.read(8 * blocks), "<u8").astype(np.int64)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of the file; only the blocks that hold them are read."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + count - 1) // BLOCK
        low = int(self.starts[first])
        high = int(self.starts[last + 1]) if last + 1 < len(self.starts) else self.end
        self.source.seek(low)
        data = self.source.read(high - low)
        ids = np.concatenate([unpack_block(data, int(self.starts[b]) - low) for b in range(first, last + 1)])
        return ids[start - first * BLOCK : start - first * BLOCK + count]

    def documents(self, span: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, start in the file, ids)`` of every document in order; about ``span`` blocks are held at a time."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            begin = int(ends[at] - self.lengths[at])
            stop = max(at + 1, int(np.searchsorted(ends, begin + span * BLOCK, side="right")))
            ids = self.read(begin, int(ends[stop - 1]) - begin)
            for d in range(at, stop):
                start = int(ends[d] - self.lengths[d])
                yield (None if self.nulls[d] else int(self.keys[d])), start, ids[start - begin : start - begin + int(self.lengths[d])]
            at = stop


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write files below ``folder`` in ascending id order; returns the manifest.

    ``(part, path, docs, tokens)``, a row per file; files follow each other by part. Ids are spread over the files by range,
    null first; repeated ids keep a row each, ordered by a hash of the text, so even a hot id is spread. Null text counts as
    empty: the end id alone. An empty table gives an empty manifest. A task that is run again writes a new file, and only the
    file of the attempt that succeeded is in the manifest, which is written as a table at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = word_encoder(path), None
        for batch in batches:
            for key, ids in zip(batch["id"].to_pylist(), encoder.encode_all(batch["text"], end_id)):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.tokens"
                    system, inner = filesystem(folder)
                    system.create_dir(inner, recursive=True)
                    writer = BlockWriter(name)
                writer.add(key, ids)
        if writer:
            writer.close()
            part = TaskContext.get().partitionId()
            columns = [[part], [name], [len(writer.keys)], [writer.tokens]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "path", "docs", "tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    return materialize(chosen.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(id, start, ids)`` of every document from the files: start counts the ids of all documents before it, ids is little-endian.

    Null and repeated ids come back as they were written, a row each; a document without tokens has its end id alone. A document
    of any length is one row. An empty manifest gives no rows.
    """
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                rows: list[tuple] = []
                held = 0
                for key, start, ids in BlockReader(path).documents():
                    rows.append((key, before + start, ids.astype("<u4").tobytes()))
                    held += len(rows[-1][2])
                    if held > 1 << 24 or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    files = max(1, manifest.count())  # a number of its own keeps adaptive execution from joining the tiny partitions
    return placed.select("path", "before").repartition(files, "path").mapInArrow(run, "id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    key, start, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "ids"])




@query("op6_patched_token_blocks")
def op6_patched_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(manifest).select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
