"""Traffic records from CSV files, packet captures and message streams."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Everything arrives as text; validation does the typing, so a bad field never loses its row silently.
RAW_TRAFFIC = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "src_ip", "dst_ip", "protocol", "length", "payload")]
    + [T.StructField("_corrupt", T.StringType())]
)
MESSAGE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("timestamp", "src_ip", "dst_ip", "protocol", "length", "threat_type", "confidence")
    ]
)
FRAMES = "path string, timestamp double, frame binary, error string"
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e6),
    b"\xa1\xb2\xc3\xd4": (">", 1e6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e9),
    b"\xa1\xb2\x3c\x4d": (">", 1e9),
}
_BATCH = 20_000


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a network log with header; a malformed line is kept in ``_corrupt``."""
    return spark.read.schema(RAW_TRAFFIC).csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=False
    )


class Truncated(ValueError):
    """A capture that ends inside a record."""

    def __init__(self, offset: int) -> None:
        super().__init__(f"the record at offset {offset} is cut")


def _frames(content: bytes) -> Iterator[tuple[float, bytes]]:
    """Time and bytes of each record of one classic capture file."""
    if content[:4] not in _MAGIC or len(content) < 24:
        raise ValueError("not a packet capture")
    order, scale = _MAGIC[content[:4]]
    header = struct.Struct(order + "IIII")
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, captured, _ = header.unpack_from(content, at)
        if at + 16 + captured > len(content):
            raise Truncated(at)
        yield seconds + fraction / scale, content[at + 16 : at + 16 + captured]
        at += 16 + captured
    if at < len(content):
        raise Truncated(at)


def split_captures(files: DataFrame, strict: bool = True) -> DataFrame:
    """One row per captured frame from rows of ``path`` and ``content``.

    Files are spread over tasks and leave each task in small batches. A file that is no capture, or ends inside a record,
    fails the job; with ``strict=False`` its whole records stay and one more row has ``error`` set.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for moment, frame in _frames(bytes(content)):
                        rows.append((path, moment, frame, None))
                        if len(rows) == _BATCH:
                            yield pd.DataFrame(rows, columns=["path", "timestamp", "frame", "error"])
                            rows = []
                except ValueError as problem:
                    if strict:
                        raise ValueError(f"{path}: {problem}") from problem
                    rows.append((path, None, None, str(problem)))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "timestamp", "frame", "error"])

    return files.select("path", "content").mapInPandas(cut, FRAMES)


def _number(frame: Column, at: Column, width: int) -> Column:
    return F.conv(F.hex(F.substr(frame, at, F.lit(width))), 16, 10).cast("int")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Ethernet/IPv4 header fields as columns; every frame stays, non-IP ones with NULL addresses."""
    frame = F.col("frame")
    tagged = F.hex(F.substring(frame, 13, 2)) == "8100"
    ip_at = F.when(tagged, F.lit(19)).otherwise(F.lit(15))
    located = frames.withColumn("ip_at", ip_at).withColumn("first", _number(frame, F.col("ip_at"), 1))
    ethertype = F.hex(F.substr(frame, F.col("ip_at") - 2, F.lit(2)))
    is_ip = (ethertype == "0800") & (F.shiftright("first", 4) == 4) & (F.length(frame) >= F.col("ip_at") + 19)
    at = F.col("ip_at")
    address = lambda start: F.concat_ws(".", *[_number(frame, start + i, 1) for i in range(4)])
    total = _number(frame, at + 2, 2)
    available = F.length(frame) - at + 1
    headed = located.withColumn("is_ip", F.coalesce(is_ip, F.lit(False))).withColumns(
        {
            "src_ip": F.when(F.col("is_ip"), address(at + 12)),
            "dst_ip": F.when(F.col("is_ip"), address(at + 16)),
            "protocol": F.when(F.col("is_ip"), _number(frame, at + 9, 1)),
            "length": F.when(F.col("is_ip"), F.when(total > 0, F.least(total, available)).otherwise(available)),
            "transport_at": at + F.col("first").bitwiseAND(F.lit(15)) * 4,
        }
    )
    start, protocol = F.col("transport_at"), F.col("protocol")
    ported = protocol.isin(6, 17) & (F.length(frame) >= start + 3)
    flags = F.when((protocol == 6) & (F.length(frame) >= start + 13), _number(frame, start + 13, 1))
    return headed.select(
        "path",
        F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")).alias("timestamp"),
        "src_ip",
        "dst_ip",
        "protocol",
        "length",
        F.when(ported, _number(frame, start + 2, 2)).alias("dport"),
        F.coalesce((flags.bitwiseAND(F.lit(2)) > 0) & (flags.bitwiseAND(F.lit(16)) == 0), F.lit(False)).alias("syn_only"),
    )


def _capture_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)


def read_captures(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Packets of all capture files below ``path``; files are the unit of parallelism.

    With ``strict=False`` damaged files give what they hold; ``rejected_captures`` lists them.
    """
    return decode_frames(split_captures(_capture_files(spark, path), strict).filter(F.col("error").isNull()))


def rejected_captures(spark: SparkSession, path: str) -> DataFrame:
    """``(path, error)`` of capture files that are damaged: the quarantine of ``read_captures(strict=False)``."""
    return split_captures(_capture_files(spark, path), strict=False).filter(F.col("error").isNotNull()).select("path", "error")


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by file extension. Captures are read by byte range; a damaged one fails, and frames without an IPv4 packet
    are left to ``captures.other_frames``."""
    if path.endswith((".pcap", ".pcapng")):
        from palisade.sources import captures  # which decodes by this module

        index = captures.capture_index(spark, path)
        damaged = captures.damaged_captures(index).first()
        if damaged:
            raise ValueError(f"{damaged['path']}: {damaged['error']}")
        return captures.packets(captures.read_frames(index)).select("timestamp", "src_ip", "dst_ip", "protocol", "length")
    if path.endswith(".csv"):
        return read_traffic_csv(spark, path)
    raise ValueError(f"unsupported file format: {path}")


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options: str
) -> DataFrame:
    """Raw Kafka stream; ``options`` carries the security settings. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", starting)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def threat_events(spark: SparkSession, servers: str, topic: str = "threat-events", **options: str) -> DataFrame:
    """The threat topic from its first message on."""
    return kafka_messages(spark, servers, topic, starting="earliest", **options)


def parse_messages(stream: DataFrame, value: str = "value", schema: T.StructType = MESSAGE) -> DataFrame:
    """JSON bodies of any stream with a ``value`` column as record columns."""
    return stream.select(F.from_json(F.col(value).cast("string"), schema).alias("record")).select("record.*")
