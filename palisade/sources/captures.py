"""Packet captures of any size, read by byte range.

A capture is cut into ranges of bytes, and a range holds the records that start in it. The first record of a range is found by
trying offsets until a chain of plausible record headers follows. That may be wrong, so nothing relies on it: every range also
tells where the first record after it starts, and a range that begins elsewhere than its predecessor ends is read again from
there, until all agree. Then frames are read from the agreed bounds. Classic captures and the block format (pcapng) are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.sources.traffic import _MAGIC, decode_frames
from palisade.storage import materialize

RANGE = 128 << 20
TASK = 128 << 20  # bytes of ranges that a task reads
CHAIN = 16  # headers in a row that must be plausible
CHUNK = 4 << 20  # bytes read at a time
LARGEST = 1 << 18  # bytes of a frame where a capture names no limit
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20
INDEX = "path string, length long, low long, high long, start long, stop long, frames long, turns long, error string"
FRAMES = "path string, offset long, timestamp double, frame binary"

# Fixed values of the block format.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ORDER_MARK = 0x1A2B3C4D
RESOLUTION = 9  # the option that holds an interface's clock


class FileBytes:
    """Bytes of a file at any place, read in chunks."""

    def __init__(self, path: str) -> None:
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, count: int) -> bytes:
        """``count`` bytes from ``at``, fewer at the end of the file."""
        if not self.at <= at or at + count > self.at + len(self.held):
            self.file.seek(min(at, self.size))
            self.at, self.held = at, self.file.read(max(count, min(CHUNK, max(0, self.size - at))))
        return self.held[at - self.at : at - self.at + count]


@dataclass(frozen=True)
class Record:
    """A record or block: where it ends, and the frame it may hold."""

    end: int
    data_at: int | None = None
    captured: int = 0
    time: float | None = None


class Cut(ValueError):
    """A record that the file ends in, or that can't be one."""


class Classic:
    """Records of a classic capture."""

    step = 1
    turns = 0

    def __init__(self, file: FileBytes) -> None:
        order, self.scale = _MAGIC[file.read(0, 4)]
        if file.size < 24:
            raise Cut("not a packet capture")
        self.file, self.header, self.first = file, struct.Struct(order + "IIII"), 24
        self.limit = max(struct.unpack_from(order + "I", file.read(0, 24), 16)[0], LARGEST)

    def record(self, at: int) -> Record:
        head = self.file.read(at, 16)
        if len(head) < 16:
            raise Cut(f"the record at offset {at} is cut")
        seconds, fraction, captured, _ = self.header.unpack(head)
        if at + 16 + captured > self.file.size:
            raise Cut(f"the record at offset {at} is cut")
        return Record(at + 16 + captured, at + 16, captured, seconds + fraction / self.scale)

    def plausible(self, at: int) -> int | None:
        """The end of what may be a record."""
        head = self.file.read(at, 16)
        if len(head) < 16:
            return None
        seconds, fraction, captured, original = self.header.unpack(head)
        end = at + 16 + captured
        fits = seconds and fraction < self.scale and 0 < captured <= min(self.limit, max(original, 1)) and end <= self.file.size
        return end if fits else None


@dataclass
class Blocks:
    """Blocks of a pcapng file; interfaces are those seen so far in the section."""

    file: FileBytes
    step: int = 4
    order: str = "<"
    clocks: list[tuple[int, float]] = field(default_factory=list)
    limits: list[int] = field(default_factory=list)
    first: int = 0
    turns: int = 0  # sections and interfaces

    def __post_init__(self) -> None:
        at = 0
        while at < self.file.size:  # the blocks before the first frame
            kind = self._kind(at)
            if kind in (SIMPLE, ENHANCED):
                break
            at = self.record(at).end
        self.first, self.turns = at, 0

    def _kind(self, at: int) -> int:
        head = self.file.read(at, 4)
        return struct.unpack(self.order + "I", head)[0] if len(head) == 4 else -1

    def record(self, at: int) -> Record:
        head = self.file.read(at, 12)
        if len(head) < 12:
            raise Cut(f"the block at offset {at} is cut")
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            self.order = "<" if struct.unpack("<I", head[8:12])[0] == ORDER_MARK else ">"
            self.clocks, self.limits, self.turns = [], [], self.turns + 1
        kind, length = struct.unpack(self.order + "II", head[:8])
        if length < 12 or length % 4 or at + length > self.file.size:
            raise Cut(f"the block at offset {at} is cut")
        if kind == INTERFACE:
            self._interface(self.file.read(at, length))
        if kind == ENHANCED and length >= 32:
            interface, high, low, captured, _ = struct.unpack(self.order + "IIIII", self.file.read(at + 8, 20))
            base, power = self.clocks[interface] if interface < len(self.clocks) else (0, 1e-6)
            if captured <= length - 32:
                return Record(at + length, at + 28, captured, base + (high << 32 | low) * power)
        if kind == SIMPLE and length >= 16:
            original = struct.unpack(self.order + "I", self.file.read(at + 8, 4))[0]
            limit = self.limits[0] if self.limits and self.limits[0] else original
            return Record(at + length, at + 12, min(original, limit, length - 16))
        return Record(at + length)

    def _interface(self, block: bytes) -> None:
        power, at = 1e-6, 16
        while at + 4 <= len(block) - 4:
            code, length = struct.unpack_from(self.order + "HH", block, at)
            if code == 0:
                break
            if code == RESOLUTION and length:
                value = block[at + 4]
                power = 2.0 ** -(value & 127) if value & 128 else 10.0**-value
            at += 4 + (length + 3) // 4 * 4
        self.clocks.append((0, power))
        self.limits.append(struct.unpack_from(self.order + "I", block, 12)[0] if len(block) >= 20 else 0)
        self.turns += 1

    def plausible(self, at: int) -> int | None:
        head = self.file.read(at, 8)
        if len(head) < 8:
            return None
        kind, length = struct.unpack(self.order + "II", head)
        if kind != SECTION and kind >> 31 or length < 12 or length % 4 or at + length > self.file.size:
            return None
        return at + length if self.file.read(at + length - 4, 4) == head[4:8] else None


def open_capture(path: str) -> Classic | Blocks:
    """Reader of a capture by its first bytes."""
    file = FileBytes(path)
    head = file.read(0, 4)
    if head in _MAGIC:
        return Classic(file)
    if head == b"\x0a\x0d\x0d\x0a":
        return Blocks(file)
    raise Cut("not a packet capture")


def find_start(capture: Classic | Blocks, low: int) -> int:
    """The first offset from ``low`` on where a chain of plausible headers starts or the file ends."""
    if low <= capture.first:
        return capture.first
    at = -(-low // capture.step) * capture.step
    while at < capture.file.size:
        end, count = at, 0
        while end is not None and end < capture.file.size and count < CHAIN:
            end, count = capture.plausible(end), count + 1
        if end is not None:
            return at
        at += capture.step
    return capture.file.size


def _index_range(path: str, length: int, low: int, high: int, start: int | None) -> tuple:
    """One row of the index; ``start`` is the first record's place where it is known."""
    frames, error, at, turns = 0, None, start, 0
    try:
        capture = open_capture(path)
        at = start = find_start(capture, low) if start is None else start
        while at < min(high, length):
            found = capture.record(at)
            frames += found.data_at is not None
            at = found.end
        turns = capture.turns
    except Cut as problem:
        error = str(problem) if low == 0 or str(problem) != "not a packet capture" else None
        at = start = length if start is None else start
        at = length
    return path, length, low, high, start, at, frames, turns, error


def _indexed(ranges: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("path", "length", "low", "high", "start"))):
                yield pa.RecordBatch.from_pylist([dict(zip(names, _index_range(*row)))], schema=schema)

    return ranges.mapInArrow(run, INDEX)


def _dealt(ranges: DataFrame, *by: str) -> DataFrame:
    """Ranges dealt to tasks of about ``TASK`` bytes, so that many small captures share a task.

    A few ranges have a task each, up to the session's number of shuffle partitions.
    """
    total, count = ranges.agg(F.sum(F.col("high") - F.col("low")), F.count(F.lit(1))).first()
    least = min(count, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(max(1, least, -(-(total or 0) // TASK)), *by)


def capture_index(spark: SparkSession, path: str, range_bytes: int = RANGE, pattern: str = "*.pcap*") -> DataFrame:
    """``(path, length, low, high, start, stop, frames, turns, error)``: agreed bounds of every range of every capture.

    ``error`` tells what is wrong with a file that is no capture or ends inside a record; its whole records count. Empty files
    are passed over. A pcapng file that changes its interfaces or sections on the way is one range, read as a stream.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    step = F.lit(range_bytes)
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step.cast("long")))
    ranges = files.select("path", "length", lows.alias("low")).withColumn("high", F.least(F.col("low") + step, F.col("length")))
    unknown = materialize(ranges.withColumn("start", F.lit(None).cast("long")), "ranges")
    index = materialize(_indexed(_dealt(unknown, "path", "low")), "index")
    while True:
        turning = index.filter("turns > 0 AND (low > 0 OR high < length)").select("path").distinct()
        checked = index.join(turning, "path", "left_anti").withColumn("expected", F.lag("stop").over(Window.partitionBy("path").orderBy("low")))
        agreed = F.col("expected").isNull() | (F.col("expected") == F.col("start"))
        wrong = checked.filter(~agreed).select("path", "length", "low", "high", F.col("expected").alias("start"))
        if turning.isEmpty() and wrong.isEmpty():
            return index
        whole = turning.join(files, "path").select("path", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"), F.lit(None).cast("long").alias("start"))
        index = materialize(checked.filter(agreed).drop("expected").union(_indexed(wrong.union(whole))), "index")


def read_frames(index: DataFrame) -> DataFrame:
    """``(path, offset, timestamp, frame)`` of every frame; a task holds a few megabytes of a file at a time."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("timestamp", pa.float64()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop"))):
                capture, at, rows, held = open_capture(path), start, [], 0
                while at < stop:
                    try:
                        found = capture.record(at)
                    except Cut:
                        break  # told by the index
                    if found.data_at is not None:
                        rows.append((path, at, found.time, capture.file.read(found.data_at, found.captured)))
                        held += found.captured
                    at = found.end
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    some = index.filter(F.col("start") < F.col("stop")).select("path", "start", "stop", "low", "high")
    return _dealt(some, "path", "start").select("path", "start", "stop").mapInArrow(run, FRAMES)


def damaged_captures(index: DataFrame) -> DataFrame:
    """``(path, error)`` of files that are no captures or end inside a record."""
    return index.filter("error IS NOT NULL").select("path", "error").distinct()


def packets(frames: DataFrame) -> DataFrame:
    """Decoded packets of the frames that hold an IPv4 packet."""
    return decode_frames(frames).filter(F.col("src_ip").isNotNull())


def _reason(frame: Column) -> Column:
    kind = F.hex(F.substring(frame, 13, 2))
    kind = F.when(kind == "8100", F.hex(F.substring(frame, 17, 2))).otherwise(kind)
    named = F.when(kind == "0806", "ARP").when(kind == "86DD", "IPv6").when(kind == "0800", "damaged IPv4").otherwise("no IP")
    return F.when(F.length(frame) < 14, "short frame").otherwise(named)


def other_frames(frames: DataFrame) -> DataFrame:
    """``(path, offset, timestamp, reason)`` of the frames without an IPv4 packet: the quarantine of ``packets``."""
    kept = frames.withColumn("path", F.struct("path", "offset", "timestamp", _reason(F.col("frame")).alias("reason")))
    return decode_frames(kept).filter(F.col("src_ip").isNull()).select("path.*")
