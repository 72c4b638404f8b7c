"""Readers and writers on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from palisade.operators import enrichment, validation
from palisade.plans import storage_queries, streams
from palisade.sources import intel, sinks, traffic


def frame(protocol, source, target, port, flags=0x02):
    transport = struct.pack(">HHIIBBHHH", 12345, port, 0, 0, 0x50, flags, 0, 0, 0) if protocol == 6 else struct.pack(">HHHH", 54321, port, 8, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(transport), 0, 0, 64, protocol, 0, bytes(source), bytes(target))
    return b"\xaa" * 6 + b"\xbb" * 6 + b"\x08\x00" + ip + transport


def capture(frames, order="<"):
    body = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for number, data in enumerate(frames):
        body += struct.pack(order + "IIII", 1_700_000_000 + number, 250_000, len(data), len(data)) + data
    return body


@pytest.mark.parametrize("order", ["<", ">"])
def test_capture_files(spark, tmp_path, order):
    frames = [frame(6, (192, 168, 1, 1), (192, 168, 1, 254), 80), frame(17, (192, 168, 1, 2), (8, 8, 8, 8), 53), b"\x00" * 20, frame(6, (10, 0, 0, 1), (10, 0, 0, 2), 445, 0x12)]
    (tmp_path / "a.pcap").write_bytes(capture(frames, order))
    rows = traffic.read_captures(spark, str(tmp_path / "a.pcap")).orderBy("timestamp").collect()
    assert [(r.src_ip, r.dst_ip, r.protocol, r.dport, r.syn_only) for r in rows] == [
        ("192.168.1.1", "192.168.1.254", 6, 80, True),
        ("192.168.1.2", "8.8.8.8", 17, 53, False),
        (None, None, None, None, False),
        ("10.0.0.1", "10.0.0.2", 6, 445, False),
    ]
    assert rows[0].length == 40 and rows[1].length == 28
    # The record reader hands on IP packets only.
    assert traffic.read_traffic(spark, str(tmp_path / "a.pcap")).count() == 3


def test_corrupt_capture_fails_or_is_skipped(spark, tmp_path):
    (tmp_path / "good.pcap").write_bytes(capture([frame(6, (1, 1, 1, 1), (2, 2, 2, 2), 80)]))
    (tmp_path / "bad.pcap").write_bytes(b"not a capture at all, sorry")
    with pytest.raises(Exception, match="not a packet capture"):
        traffic.read_captures(spark, str(tmp_path)).collect()
    assert traffic.read_captures(spark, str(tmp_path), strict=False).count() == 1


@pytest.mark.parametrize("lost", [5, 60])
def test_truncated_capture_is_told(spark, tmp_path, lost):
    whole = capture([frame(6, (1, 1, 1, 1), (2, 2, 2, 2), 80)] * 2)
    (tmp_path / "cut.pcap").write_bytes(whole[:-lost])
    with pytest.raises(Exception, match="is cut"):
        traffic.read_captures(spark, str(tmp_path)).collect()
    assert traffic.read_captures(spark, str(tmp_path), strict=False).count() == 1
    assert [r.error for r in traffic.rejected_captures(spark, str(tmp_path)).collect()] == ["the record at offset 94 is cut"]


def test_csv_log_end_to_end(spark, tmp_path):
    log = "timestamp,src_ip,dst_ip,protocol,length,payload\n2023-08-20 14:30:01,10.0.0.1,93.184.216.34,TCP,1500,GET /\n2023-08-20 14:30:02,10.0.0.2,8.8.8.8,UDP,78,q\nbad,10.0.0.3,8.8.8.8,ICMP,64,e\n"
    (tmp_path / "log.csv").write_text(log)
    checked = validation.validate_records(traffic.read_traffic(spark, str(tmp_path / "log.csv")))
    assert [r.reasons for r in validation.rejected_records(checked).collect()] == [["timestamp"]]
    known = spark.createDataFrame([("ip", "93.184.216.34", "phishing", 0.95)], "type string, value string, threat_type string, confidence double")
    rows = enrichment.enrich_traffic(validation.valid_records(checked), known).orderBy("src_ip").collect()
    assert [(r.protocol, r.threat_type, r.confidence) for r in rows] == [(6, "phishing", 0.95), (17, None, None)]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        traffic.read_traffic(spark, "x.docx")


def test_control_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"indicators": [{"type": "ip", "value": "1.2.3.4", "threat_type": "c2", "confidence": 0.9, "first_seen": "2023-08-01"}, {"type": "domain", "value": "x.y", "threat_type": "c2", "confidence": 0.8, "sources": ["a"]}]}, indent=1))
    assert intel.read_indicators(spark, str(tmp_path / "i.json")).filter("first_seen IS NOT NULL OR sources IS NOT NULL").count() == 2
    assert intel.read_blacklist(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"domains": ["a.b"], "ips": [], "patterns": ["x$"]}))
    assert {tuple(r) for r in intel.read_blacklist(spark, str(tmp_path / "b.json")).collect()} == {("domain", "a.b"), ("pattern", "x$")}
    (tmp_path / "r.json").write_text(json.dumps({"version": "1", "rules": [{"name": "a", "active": True}, {"name": "b", "active": False}]}))
    assert [r.name for r in intel.read_rules(spark, str(tmp_path / "r.json")).collect()] == ["a"]
    books = tmp_path / "books"
    books.mkdir()
    (books / "one.json").write_text(json.dumps({"name": "p", "triggers": ["t"], "actions": [{"name": "block_ioc", "type": "f", "parameters": {"iocs": ["{h}"], "n": 3}}]}, indent=1))
    parameters = intel.read_playbooks(spark, str(books)).select(F.get("actions.parameters", F.lit(0)).alias("p")).first().p
    assert json.loads(parameters["iocs"]) == ["{h}"] and parameters["n"] == "3"


def test_invalid_events_are_quarantined(spark, tmp_path):
    events = spark.createDataFrame([('{"threat":"phishing"}', "s"), ("invalid", "s"), ('{"a":1}', None)], "body string, source string")
    sinks.send_events(sinks.event_envelopes(events, F.col("body"), F.col("source")), f"{tmp_path}/sent", f"{tmp_path}/bad")
    sent = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/sent").collect()]
    assert len(sent) == 1 and sent[0]["event"] == {"threat": "phishing"} and sent[0]["index"] == "threat_detection"
    assert spark.read.json(f"{tmp_path}/bad").count() == 2


def test_a_batch_sent_again_replaces_itself(spark, tmp_path):
    events = spark.createDataFrame([('{"a":1}', "s"), ("invalid", "s")], "body string, source string")
    for _ in range(2):
        sinks.send_events(sinks.event_envelopes(events, F.col("body"), F.col("source")), f"{tmp_path}/sent", f"{tmp_path}/bad", batch="7")
    assert spark.read.text(f"{tmp_path}/sent/*").count() == 1 and spark.read.json(f"{tmp_path}/bad/*").count() == 1


def test_a_black_list_that_cant_be_read_is_no_empty_list(spark, tmp_path, monkeypatch):
    from pyspark.errors import AnalysisException

    class Broken:
        def schema(self, _):
            return self

        def json(self, *_, **__):
            raise AnalysisException("denied", errorClass="UNSUPPORTED_FEATURE")

    class Session:
        read = Broken()

    with pytest.raises(AnalysisException):
        intel.read_blacklist(Session(), "x")


def test_digests_of_files(spark, tmp_path):
    import hashlib

    for name, data in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest().upper()), ("b.bin", hashlib.sha256(b"2").hexdigest()), ("c.bin", "00")], "path string, expected string")
    assert {r.path: r.intact for r in intel.check_digests(files, manifest).collect()} == {"a.bin": True, "b.bin": False, "c.bin": False}


def test_addresses_that_cant_be_located_are_told(spark):
    ranges = spark.createDataFrame([(167772160, 184549375, "US")], "first long, last long, country string")
    exits = spark.createDataFrame([("10.0.0.1",)], "ip string")
    rows = spark.createDataFrame([("10.0.0.1",), ("2001:db8::1",), (None,)], "ip string")
    found = {r.ip: (r.country, r.locatable) for r in enrichment.country_risk(rows, "ip", ranges, exits).collect()}
    assert found == {"10.0.0.1": ("US", True), "2001:db8::1": (None, False), None: (None, False)}


def test_csv_files_with_line_breaks_are_bounded(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(storage_queries, "scratch_path", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(storage_queries, "CSV_FILES", {"maxRecordsPerFile": "50"})
    found = storage_queries.process_file_scan(spark, small)
    rows = spark.read.parquet(f"{small}/events.parquet").count()
    assert found.count() == rows and len(list((tmp_path / "processes").glob("part-*.csv"))) >= rows / 50


@pytest.mark.parametrize("rows, files", [(400, 5), (2, 1), (0, 1)])
def test_parts_in_time_have_as_many_files_each(spark, tmp_path, monkeypatch, rows, files):
    monkeypatch.setattr(streams, "FILE_ROWS", 25)
    events = spark.range(rows).select("id", F.timestamp_seconds(F.col("id") * 7).alias("at")) if rows else spark.createDataFrame([(1, None)], "id long, at timestamp")
    if rows == 0:
        events = events.withColumn("at", F.timestamp_seconds(F.col("id")))
    assert streams.timed_files(events, "at", 3, str(tmp_path / "files")) == files
    made = sorted((tmp_path / "files").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    spans = [[r["id"] for r in spark.read.parquet(*map(str, made[i : i + files])).collect()] for i in range(0, len(made), files)]
    assert sorted(x for part in spans for x in part) == list(range(rows)) or not rows
    assert all(max(a) < min(b) for a, b in zip(spans, spans[1:]) if a and b)


def test_copies_of_a_text_take_little_room_in_csv_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(storage_queries, "scratch_path", lambda _, label: str(tmp_path / label))
    found = storage_queries.process_file_scan(spark, small)
    sizes = spark.read.parquet(f"{small}/documents.parquet").select(F.sha2(F.replace("text", F.lit("\r"), F.lit("")), 256).alias("content_hash"), F.octet_length("text").alias("n")).distinct()
    rows = spark.read.parquet(f"{small}/events.parquet").count()
    written, text = sum(f.stat().st_size for f in (tmp_path / "processes").glob("part-*")), found.join(sizes, "content_hash").agg(F.sum("n")).first()[0]
    assert found.count() == rows and written * 5 < text
