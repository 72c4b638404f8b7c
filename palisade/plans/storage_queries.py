"""Sources and sinks: data derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from palisade.functions import text as tx
from palisade.operators import enrichment, validation
from palisade.plans import fixtures as fx
from palisade.plans.content import demo_key
from palisade.plans.intel import IOC_SQL, enriched_iocs
from palisade.plans.registry import query
from palisade.operators import threats
from palisade.sources import captures, intel, ledger, sinks, traffic
from palisade.storage import materialize, scratch_path

_RECORDS = "event_id, epoch_us(date_trunc('second', ts)) AS micros, src_ip, dst_ip, protocol, length"


def traffic_files(spark, sf):
    """Traffic as CSV text columns, protocol by name."""
    return fx.traffic(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "src_ip",
        "dst_ip",
        validation.protocol_name(F.col("protocol")).alias("protocol"),
        "length",
        F.concat(F.lit("event, "), F.col("event_id").cast("string")).alias("payload"),
    )


@query("csv_traffic_scan", f"WITH {fx.TRAFFIC} SELECT {_RECORDS} FROM traffic")
def csv_traffic_scan(spark, sf):
    path = scratch_path(spark, "traffic") + ".csv"
    traffic_files(spark, sf).write.csv(path, header=True)
    good = validation.valid_records(validation.validate_records(traffic.read_traffic(spark, path)))
    event_id = F.regexp_extract("payload", "([0-9]+)", 1).cast("long").alias("event_id")
    return good.select(event_id, F.unix_micros("timestamp").alias("micros"), "src_ip", "dst_ip", "protocol", "length")


def _hex(value, digits):
    return F.lpad(F.hex(value), digits, "0")


def _little(value, width):
    big = _hex(value, width * 2)
    return F.concat(*[F.substring(big, i, 2) for i in range(width * 2 - 1, 0, -2)])


def capture_blobs(spark, sf, size: int = 500):
    """Capture files of at most ``size`` packets, built byte by byte from the traffic rows."""
    rows = fx.traffic(spark, sf)
    octets = lambda ip: F.concat(*[_hex(F.get(F.split(ip, "[.]"), F.lit(i)).cast("int"), 2) for i in range(4)])
    ethernet = F.lit("AABBCCDDEEFF" "112233445566" "0800")
    ip = F.concat(
        F.lit("4500"), _hex(F.col("length"), 4), F.lit("00000000" "40"), _hex(F.col("protocol"), 2), F.lit("0000"), octets("src_ip"), octets("dst_ip")
    )
    tcp = F.concat(F.lit("3039"), _hex(F.col("dport"), 4), F.lit("0000000000000000" "50"), F.when(F.col("syn_only"), "02").otherwise("12"), F.lit("2000" "0000" "0000"))
    udp = F.concat(F.lit("3039"), _hex(F.col("dport"), 4), F.lit("0008" "0000"))
    head = F.concat(ethernet, ip, F.when(F.col("protocol") == 6, tcp).when(F.col("protocol") == 17, udp).otherwise("0800000000000000"))
    frame = F.rpad(head, 28 + F.col("length") * 2, "0")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    captured = (F.length(frame) / 2).cast("long")
    seconds = F.floor(micros / F.lit(1_000_000))
    record = F.concat(_little(seconds, 4), _little(micros - seconds * 1_000_000, 4), _little(captured, 4), _little(captured, 4), frame)
    # event ids are unique, so a file holds at most ``size`` of them
    grouped = rows.select(F.floor(F.col("event_id") / size).alias("file"), F.struct("event_id", record.alias("r")).alias("e"))
    files = grouped.groupBy("file").agg(F.array_sort(F.collect_list("e")).alias("e"))
    header = F.lit("D4C3B2A1" "0200" "0400" "00000000" "00000000" "FFFF0000" "01000000")
    body = F.array_join(F.transform("e", lambda e: e["r"]), "")
    return files.select(F.concat(F.lit("capture-"), F.col("file").cast("string"), F.lit(".pcap")).alias("path"), F.unhex(F.concat(header, body)).alias("content"))


_PACKETS = """SELECT 'capture-' || (event_id // 500) || '.pcap' AS path, epoch_us(ts) AS micros, src_ip, dst_ip, protocol,
  CAST(greatest(length, CASE protocol WHEN 6 THEN 40 ELSE 28 END) AS INTEGER) AS captured, length,
  CASE WHEN protocol = 1 THEN -1 ELSE dport END AS dport, syn_only FROM traffic"""


@query("packet_capture_scan", f"WITH {fx.TRAFFIC} SELECT path, micros, src_ip, dst_ip, protocol, length, dport, syn_only FROM ({_PACKETS})")
def packet_capture_scan(spark, sf):
    packets = traffic.decode_frames(traffic.split_captures(capture_blobs(spark, sf)))
    return packets.select("path", F.unix_micros("timestamp").alias("micros"), "src_ip", "dst_ip", "protocol", "length", "dport", "syn_only").fillna(-1, ["dport"])


@query(
    "sink_formats",
    f"WITH {fx.TRAFFIC} SELECT format, count(*) AS records, CAST(sum(length) AS BIGINT) AS bytes FROM traffic, (SELECT unnest(['parquet', 'csv', 'json']) AS format) GROUP BY format",
)
def sink_formats(spark, sf):
    records = fx.traffic(spark, sf).select("event_id", "src_ip", "length")
    base = scratch_path(spark, "sinks")
    for ending in ("parquet", "csv.gz", "jsonl"):
        sinks.save_records(records, f"{base}/records.{ending}")
    schema = "event_id long, src_ip string, length int"
    stored = {
        "parquet": spark.read.parquet(f"{base}/records.parquet"),
        "csv": spark.read.schema(schema).csv(f"{base}/records.csv.gz", header=True),
        "json": spark.read.schema(schema).json(f"{base}/records.jsonl"),
    }
    union = None
    for name, df in stored.items():
        named = df.select(F.lit(name).alias("format"), "length")
        union = named if union is None else union.union(named)
    return union.groupBy("format").agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"))


_ENVELOPES = """envelopes AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN '"text"' WHEN event_id % 10 = 4 THEN '{broken' ELSE props END AS event,
  CASE WHEN event_id % 10 <> 5 THEN event_type END AS source, ts FROM events)"""


def envelopes(spark, sf):
    turn = F.col("event_id") % 10
    body = F.when(turn == 3, '"text"').when(turn == 4, "{broken").otherwise(F.col("props"))
    return sinks.event_envelopes(
        fx.table(spark, sf, "events"), body, F.when(turn != 5, F.col("event_type")), F.col("ts"), keep=["event_id"]
    )


@query(
    "event_envelopes",
    f"""WITH {_ENVELOPES} SELECT event_id, event, 'security:log' AS sourcetype, source, 'threat_detection' AS index, epoch_us(ts) AS time_micros,
      event_id % 10 NOT IN (3, 4, 5) AS valid FROM envelopes""",
)
def event_envelopes(spark, sf):
    return envelopes(spark, sf)


@query(
    "event_sink",
    f"WITH {_ENVELOPES} SELECT source, count(*) AS sent, CAST(sum(CAST(json_extract(event, '$.k') AS BIGINT)) AS BIGINT) AS k FROM envelopes WHERE event_id % 10 NOT IN (3, 4, 5) GROUP BY source",
)
def event_sink(spark, sf):
    path = scratch_path(spark, "events")
    sinks.send_events(envelopes(spark, sf), f"{path}/sent", f"{path}/quarantine")
    sent = spark.read.schema("event struct<k long>, source string").json(f"{path}/sent")
    return sent.groupBy("source").agg(F.count(F.lit(1)).alias("sent"), F.sum("event.k").alias("k"))


@query(
    "search_documents",
    """SELECT event_id, 'threats-' || event_type AS _index, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "@timestamp", event_type AS threat_type,
      CASE WHEN value >= 70 THEN 'critical' ELSE 'low' END AS severity, '10.0.0.' || (user_id % 250) AS source_ip, props AS event_data FROM events""",
)
def search_documents(spark, sf):
    return search_index(spark, sf).drop("timestamp")


def search_index(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("source_ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")))
    severity = F.when(F.col("value") >= 70, "critical").otherwise("low")
    index = F.concat(F.lit("threats-"), F.col("event_type"))
    return sinks.search_documents(
        events, F.col("ts"), F.col("event_type"), severity, F.col("source_ip"), F.col("props"), index, keep=["event_id"]
    )


@query("search_by_index", "SELECT event_id, props AS event_data FROM events WHERE event_type = 'error' AND value >= 70")
def search_by_index(spark, sf):
    path = scratch_path(spark, "documents")
    sinks.write_documents(search_index(spark, sf), path)
    stored = spark.read.schema("event_id long, severity string, event_data string, _index string").json(path)
    hits = validation.term_search(stored.filter("_index = 'threats-error'"), "severity", "critical")
    return hits.select("event_id", "event_data")


@query("audit_digests", "SELECT event_id, props AS event, sha256(props) AS hash, epoch_us(ts) AS micros FROM events")
def audit_digests(spark, sf):
    entries = sinks.audit_entries(fx.table(spark, sf, "events"), F.col("props"), F.col("ts").cast("timestamp"), keep=["event_id"])
    path = scratch_path(spark, "audit")
    sinks.append_audit(entries, path)
    stored = spark.read.schema("event_id long, timestamp timestamp, user string, event string, hash string").json(path)
    return stored.filter("user IS NOT NULL").select("event_id", "event", "hash", F.unix_micros("timestamp").alias("micros"))


@query("threat_store", f"WITH {IOC_SQL} SELECT type, threat_level, count(*) AS threats FROM levels GROUP BY type, threat_level")
def threat_store(spark, sf):
    path = scratch_path(spark, "threats")
    scored = materialize(threats.score_feed(enriched_iocs(spark, sf)), "scored")
    for _ in range(2):  # a batch that is sent twice counts once
        sinks.store_threats(scored, path, "first")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("type").cast("string").alias("type"), "threat_level").agg(F.count(F.lit(1)).alias("threats"))


@query(
    "indicator_file_scan",
    "SELECT 'ip' AS type, '10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS value, 'class-' || (c_nationkey % 5) AS threat_type, 0.5 AS confidence, 'feed a|feed b' AS sources FROM customer".replace(
        "0.5 AS", "CAST(0.5 AS DOUBLE) AS"
    ),
)
def indicator_file_scan(spark, sf):
    key = F.col("c_custkey")
    entry = F.struct(
        F.lit("ip").alias("type"),
        F.concat(F.lit("10.1."), F.floor(key / 250).cast("string"), F.lit("."), (key % 250).cast("string")).alias("value"),
        F.concat(F.lit("class-"), (F.col("c_nationkey") % 5).cast("string")).alias("threat_type"),
        F.lit(0.5).alias("confidence"),
        F.array(F.lit("feed a"), F.lit("feed b")).alias("sources"),
    )
    # customer keys are unique, so a document holds at most 100 indicators
    documents = fx.table(spark, sf, "customer").groupBy(F.floor(key / 100).alias("n")).agg(F.collect_list(entry).alias("indicators"))
    path = scratch_path(spark, "indicators")
    documents.select("indicators").write.json(path)
    rows = intel.read_indicators(spark, path, lines=True)
    return rows.select("type", "value", "threat_type", "confidence", F.array_join("sources", "|").alias("sources"))


@query(
    "blacklist_file_scan",
    """SELECT 'domain' AS kind, 'part-' || p_partkey || '.example' AS value FROM part
    UNION ALL SELECT 'ip', '10.2.' || (p_partkey // 250) || '.' || (p_partkey % 250) FROM part WHERE p_partkey % 2 = 0""",
)
def blacklist_file_scan(spark, sf):
    key = F.col("p_partkey")
    domain = F.concat(F.lit("part-"), key.cast("string"), F.lit(".example"))
    address = F.when(key % 2 == 0, F.concat(F.lit("10.2."), F.floor(key / 250).cast("string"), F.lit("."), (key % 250).cast("string")))
    documents = fx.table(spark, sf, "part").groupBy(F.floor(key / 100).alias("n"))
    documents = documents.agg(F.collect_list(domain).alias("domains"), F.collect_list(address).alias("ips"))
    path = scratch_path(spark, "blacklist")
    documents.select("domains", "ips").write.json(path)
    return intel.read_blacklist(spark, path, lines=True)


@query(
    "rule_file_scan",
    "SELECT 'supplier-' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'file' ELSE 'domain' END AS type, 'high' AS severity, 'Block|Isolate' AS mitigation FROM supplier WHERE s_nationkey % 2 = 0",
)
def rule_file_scan(spark, sf):
    key = F.col("s_suppkey")
    rule = F.struct(
        F.concat(F.lit("supplier-"), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, "hash").when(key % 3 == 1, "file").otherwise("domain").alias("type"),
        F.lit("[.]crypt$").alias("pattern"),
        F.lit("high").alias("severity"),
        F.array(F.lit("Block"), F.lit("Isolate")).alias("mitigation"),
        (F.col("s_nationkey") % 2 == 0).alias("active"),
    )
    path = scratch_path(spark, "rules")
    fx.table(spark, sf, "supplier").select(F.array(rule).alias("rules")).write.json(path)
    rows = intel.read_rules(spark, path, lines=True)
    return rows.select("name", "type", "severity", F.array_join("mitigation", "|").alias("mitigation"))


@query(
    "playbook_file_scan",
    "SELECT 'playbook-' || s_suppkey AS name, 'trigger-' || (s_suppkey % 7) AS trigger, 'isolate_host' AS action, '{source_ip}' AS ip_address, '[\"a\",\"b\"]' AS items FROM supplier",
)
def playbook_file_scan(spark, sf):
    key = F.col("s_suppkey").cast("string")
    parameters = F.struct(F.lit("{source_ip}").alias("ip_address"), F.array(F.lit("a"), F.lit("b")).alias("items"))
    action = F.struct(F.lit("isolate_host").alias("name"), F.lit("network").alias("type"), parameters.alias("parameters"))
    trigger = F.concat(F.lit("trigger-"), (F.col("s_suppkey") % 7).cast("string"))
    path = scratch_path(spark, "playbooks")
    fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("playbook-"), key).alias("name"), F.array(trigger).alias("triggers"), F.array(action).alias("actions")
    ).write.json(path)
    rows = intel.read_playbooks(spark, path, lines=True)
    return rows.select(
        "name",
        F.get("triggers", F.lit(0)).alias("trigger"),
        F.get("actions.name", F.lit(0)).alias("action"),
        F.get("actions.parameters", F.lit(0))["ip_address"].alias("ip_address"),
        F.get("actions.parameters", F.lit(0))["items"].alias("items"),
    )


# A file whose fields hold line breaks can't be split, so one task reads it whole, compressed or not.
CSV_FILES = {"maxRecordsPerFile": "4000", "compression": "gzip"}


@query("labelled_file_scan", f"WITH {fx.MAILS} SELECT url, sha256(replace(text, chr(13), '')) AS text_hash, label FROM mails")
def labelled_file_scan(spark, sf):
    path = scratch_path(spark, "samples")
    mails = fx.mails(spark, sf).select("url", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "label")
    mails.write.options(**CSV_FILES).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return intel.read_url_samples(spark, path).select("url", F.sha2("text", 256).alias("text_hash"), "label")


@query(
    "process_file_scan",
    f"""WITH {fx.PROCESSES} SELECT process_id, sha256(replace(text, chr(13), '')) AS content_hash, api_call_count, round(process_duration, 6) AS process_duration, files,
      api_call_count || '.00 ' || (event_id % 90) || '.50' AS steps, is_ransomware FROM processes JOIN documents USING (doc_id)""",
)
def process_file_scan(spark, sf):
    path = scratch_path(spark, "processes")
    content = fx.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("file_content"))
    # few bytes of events become many of text, so events are spread before; merged by document, a text's copies lie side by side
    # in a file, where compression meets them
    fx.processes(spark, sf).repartition("event_id").join(content.hint("merge"), "doc_id").select(
        "process_id",
        "file_content",
        "api_call_count",
        "process_duration",
        F.to_json("created_files").alias("created_files"),
        F.to_json(F.array(F.col("api_call_count").cast("double"), (F.col("event_id") % 90) + 0.5)).alias("behavior_sequence"),
        "is_ransomware",
    ).write.options(**CSV_FILES).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = intel.read_process_samples(spark, path)
    steps = F.array_join(F.transform("behavior_sequence", lambda x: F.format_string("%.2f", x)), " ")
    content = F.sha2("file_content", 256).alias("content_hash")
    return rows.select("process_id", content, "api_call_count", "process_duration", F.array_join("created_files", "|").alias("files"), steps.alias("steps"), "is_ransomware")


@query("dataset_digests", "SELECT doc_id AS path, doc_id % 10 <> 7 AS intact FROM documents")
def dataset_digests(spark, sf):
    documents = fx.table(spark, sf, "documents")
    files = documents.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    expected = F.when(F.col("doc_id") % 10 == 7, F.sha2("source", 256)).otherwise(F.sha2("text", 256))
    manifest = documents.select(F.col("doc_id").alias("path"), F.upper(expected).alias("expected"))
    return intel.check_digests(files, manifest).select("path", "intact")


@query(
    "ingested_files",
    f"""WITH {fx.TRAFFIC}, {fx.cte('indicators', fx.INDICATOR_COLUMNS, fx.INDICATORS)}, best AS (SELECT value, max_by(threat_type, confidence) AS threat_type FROM indicators GROUP BY value)
    SELECT t.src_ip, coalesce(s.threat_type, d.threat_type, '') AS threat_type, count(*) AS records, CAST(sum(length) AS BIGINT) AS bytes
    FROM traffic t LEFT JOIN best s ON s.value = t.src_ip LEFT JOIN best d ON d.value = t.dst_ip GROUP BY ALL""",
)
def ingested_files(spark, sf):
    """A CSV log read, validated, enriched, its address encrypted, saved, read back and decrypted."""
    base = scratch_path(spark, "ingest")
    traffic_files(spark, sf).write.csv(f"{base}/log.csv", header=True)
    good = validation.valid_records(validation.validate_records(traffic.read_traffic(spark, f"{base}/log.csv")))
    enriched = enrichment.enrich_traffic(good, fx.indicators(spark))
    sinks.save_records(tx.encrypt_fields(enriched, ["src_ip"], demo_key()), f"{base}/log.parquet")
    plain = tx.decrypt_fields(spark.read.parquet(f"{base}/log.parquet"), ["src_ip"], demo_key())
    return plain.groupBy("src_ip", F.coalesce("threat_type", F.lit("")).alias("threat_type")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes")
    )


ARP = "00000000" "00000000" "2A000000" "2A000000" "FFFFFFFFFFFF" "112233445566" "0806" "0001080006040001" "112233445566" "0A000001" "000000000000" "0A000002"


def write_captures(spark, sf, path):
    """The capture files of the traffic, each with one frame more that is no IP packet; written by tasks."""

    def write(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                system, inner = FileSystem.from_uri(path)
                system.create_dir(inner, recursive=True)
                with system.open_output_stream(f"{inner}/{name}") as file:
                    file.write(bytes(content) + bytes.fromhex(ARP))
            yield frame[["path"]]

    return capture_blobs(spark, sf).mapInPandas(write, "path string").count()


@query(
    "captured_files",
    f"""WITH {fx.TRAFFIC}, {fx.cte('indicators', fx.INDICATOR_COLUMNS, fx.INDICATORS)}, best AS (SELECT value, max_by(threat_type, confidence) AS threat_type FROM indicators GROUP BY value)
    SELECT t.src_ip, coalesce(s.threat_type, d.threat_type, '') AS threat_type, count(*) AS records, CAST(sum(length) AS BIGINT) AS bytes
    FROM traffic t LEFT JOIN best s ON s.value = t.src_ip LEFT JOIN best d ON d.value = t.dst_ip GROUP BY ALL
    UNION ALL SELECT 'quarantine', 'ARP', count(DISTINCT event_id // 500), 0 FROM traffic
    UNION ALL SELECT 'quarantine', 'damaged', 0, 0""",
)
def captured_files(spark, sf):
    """Capture files read by ranges of 50,000 bytes, packets enriched, everything else counted."""
    base = scratch_path(spark, "captures")
    write_captures(spark, sf, base)
    index = captures.capture_index(spark, base, 50_000)
    frames = captures.read_frames(index)
    enriched = enrichment.enrich_traffic(captures.packets(frames), fx.indicators(spark))
    found = enriched.groupBy("src_ip", F.coalesce("threat_type", F.lit("")).alias("threat_type")).agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"))
    other = captures.other_frames(frames).groupBy(F.lit("quarantine").alias("src_ip"), F.col("reason").alias("threat_type")).agg(F.count(F.lit(1)).alias("records"), F.lit(0).cast("long").alias("bytes"))
    damaged = captures.damaged_captures(index).agg(F.lit("quarantine").alias("src_ip"), F.lit("damaged").alias("threat_type"), F.count(F.lit(1)).alias("records"), F.lit(0).cast("long").alias("bytes"))
    return found.unionByName(other).unionByName(damaged)


@query(
    "audit_verification",
    """WITH numbered AS (SELECT event_type AS batch, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM events)
    SELECT batch, position, CASE WHEN event_id % 97 = 1 THEN 'removed' ELSE 'changed' END AS problem FROM numbered WHERE event_id % 97 = 1 OR event_id % 89 = 2
    UNION ALL SELECT 'seals broken', 0, 'none'""",
)
def audit_verification(spark, sf):
    """Audit batches, each written twice, then checked after lines were changed and removed."""
    log = ledger.AuditLog(spark, scratch_path(spark, "audit-log"))
    events = materialize(fx.table(spark, sf, "events").select("event_id", "event_type", F.concat_ws(" ", "event_id", "props").alias("line")), "audit-lines")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a batch for each type of event
    for kind in kinds:
        for _ in range(2):
            log.append(events.filter(F.col("event_type") == kind), kind, "line", ["event_id"])
    number = F.substring_index("line", " ", 1).cast("long")
    tampered = log.lines.read(ledger.LINES).filter(number % 97 != 1).withColumn("line", F.when(number % 89 == 2, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    broken = log.broken_seals()
    state = spark.createDataFrame([("seals broken", len(broken), ", ".join(f"{b}: {w}" for b, w in broken) or "none")], "batch string, position long, problem string")
    return log.verify(tampered).union(state)
