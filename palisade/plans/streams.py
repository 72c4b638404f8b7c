"""Streaming jobs run to the end over a file stream of the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.text import byte_entropy
from palisade.operators import models
from palisade.plans import fixtures as fx
from palisade.plans.intel import IOC_SQL, url_reports
from palisade.plans.learning import ALERT_SCORE, timeline_scores
from palisade.plans.registry import query
from palisade.storage import materialize, scratch_path
from palisade.streaming import detection, jobs


def stream(spark, sf_dir, name):
    """A given table as a file stream."""
    schema = fx.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def packet_stream(spark, sf_dir):
    kind = F.col("event_type")
    return stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_id",
        "event_type",
        "value",
        F.when(kind == "signup", 17).when(kind == "error", 1).otherwise(6).alias("protocol"),
    )


@query(
    "stream_ingest",
    f"""WITH {fx.cte('indicators', fx.INDICATOR_COLUMNS, fx.INDICATORS)}, best AS (SELECT value, max_by(threat_type, confidence) AS threat_type FROM indicators GROUP BY value),
      good AS (SELECT *, '10.0.0.' || (user_id % 250) AS src_ip FROM events WHERE event_type <> 'error')
    SELECT src_ip, coalesce(threat_type, '') AS threat_type, count(*) AS records, 0 AS rejected FROM good LEFT JOIN best ON best.value = src_ip GROUP BY ALL
    UNION ALL SELECT 'rejected', 'protocol', 0, count(*) FROM events WHERE event_type = 'error'""",
)
def stream_ingest(spark, sf):
    kind = F.col("event_type")
    body = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
            F.lit("8.8.8.8").alias("dst_ip"),
            F.when(kind == "signup", "UDP").when(kind == "error", "what").otherwise("TCP").alias("protocol"),
            F.lit("64").alias("length"),
        )
    )
    base = scratch_path(spark, "stream-ingest")
    messages = stream(spark, sf, "events").select(F.encode(body, "UTF-8").alias("value"))
    jobs.ingest(messages, fx.indicators(spark), f"{base}/sent", f"{base}/rejected", f"{base}/checkpoint").awaitTermination()
    sent = spark.read.schema("event struct<src_ip string, threat_type string>").json(f"{base}/sent").select("event.*")
    good = sent.groupBy("src_ip", F.coalesce("threat_type", F.lit("")).alias("threat_type")).agg(F.count(F.lit(1)).alias("records"))
    rejected = spark.read.schema("reasons array<string>").json(f"{base}/rejected").select(F.explode("reasons").alias("threat_type"))
    bad = rejected.groupBy(F.lit("rejected").alias("src_ip"), "threat_type").agg(F.count(F.lit(1)).alias("rejected"))
    zero = F.lit(0).cast("long")
    return good.withColumn("rejected", zero).unionByName(bad.withColumn("records", zero))


@query("stream_threat_feed", f"WITH {IOC_SQL} SELECT type, threat_level, count(*) AS threats FROM levels WHERE type = 'url' GROUP BY type, threat_level")
def stream_threat_feed(spark, sf):
    base = scratch_path(spark, "stream-threats")
    # The example links join the pages by way of a file of their own, as a second feed would.
    fx.samples(spark, sf).filter("sample_id >= 9000000000").write.parquet(f"{base}/examples")
    pages = stream(spark, sf, "pages").select(F.col("page_id").alias("sample_id"), "url")
    examples = spark.readStream.schema("sample_id long, url string").parquet(f"{base}/examples")
    feed = pages.union(examples).select(F.concat(F.lit("u"), F.col("sample_id").cast("string")).alias("key"), F.lit("url").alias("type"), F.col("url").alias("value"))
    jobs.threat_stream(
        feed, fx.indicators(spark), url_reports(spark, sf), fx.rules(spark), f"{base}/store", f"{base}/serious", f"{base}/checkpoint"
    ).awaitTermination()
    stored = spark.read.parquet(f"{base}/store")
    return stored.groupBy("type", "threat_level").agg(F.count(F.lit(1)).alias("threats"))


@query(
    "stream_protocol_counts",
    f"WITH {fx.TRAFFIC} SELECT protocol, count(*) AS packets FROM traffic GROUP BY protocol",
)
def stream_protocol_counts(spark, sf):
    base = scratch_path(spark, "stream-protocols")
    jobs.running_protocol_counts(packet_stream(spark, sf), f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    counts = spark.read.parquet(f"{base}/counts")
    # Later batches hold larger running counts.
    return counts.groupBy("protocol").agg(F.max("packets").alias("packets"))


@query(
    "packet_rate_alerts",
    f"WITH {fx.TRAFFIC} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_micros, count(*) AS packets FROM traffic GROUP BY 1 HAVING count(*) > 15",
)
def packet_rate_alerts(spark, sf):
    traffic = fx.traffic(spark, sf).withColumn("timestamp", F.col("ts").cast("timestamp"))
    alerts = jobs.rate_alerts(traffic, 15, step="1 hour")
    return alerts.select(F.unix_micros("window_start").alias("window_micros"), "packets")


@query(
    "stream_rate_alerts",
    f"""WITH {fx.TRAFFIC}, windows AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS packets FROM traffic GROUP BY 1)
    SELECT epoch_us(w) AS window_micros, packets FROM windows WHERE packets > 15""",
)
def stream_rate_alerts(spark, sf):
    base = scratch_path(spark, "stream-rates")
    jobs.stream_rate_alerts(packet_stream(spark, sf), f"{base}/alerts", f"{base}/checkpoint", 15, step="1 hour").awaitTermination()
    alerts = spark.read.schema("window_start timestamp, window_end timestamp, packets long").parquet(f"{base}/alerts/*")
    return alerts.groupBy(F.unix_micros("window_start").alias("window_micros")).agg(F.max("packets").alias("packets"))


FILE_ROWS = 100_000  # of a file, about


def timed_files(rows, time, parts, path):
    """Rows written in ``parts`` that follow each other in time; returns the number of files of each part.

    A file stream that takes so many files at a time reads part by part. All parts have the same number of files, by the rows of
    the smallest, and none of these is empty unless its part is.
    """
    edges = rows.select(F.percentile_approx(time, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    place = sum((F.col(time) > F.lit(e)).cast("int") for e in edges)
    numbered = materialize(rows.withColumn("_part", place), "timed")
    sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    files = max(1, min(sizes.get(part, 0) for part in range(parts)) // FILE_ROWS)
    for part in range(parts):
        numbered.filter(F.col("_part") == part).drop("_part").repartition(files).write.mode("append").parquet(path)
    return files


def detect_in_stream(spark, sf, model_path, base):
    """Events as a stream of several batches, scored by the saved model; alerts from a second stream over the scores."""
    documents = fx.table(spark, sf, "documents").select("doc_id", byte_entropy(F.col("text")).alias("entropy"))
    processes = fx.processes(spark, sf).withColumn("timestamp", F.col("ts").cast("timestamp")).join(documents, "doc_id").drop("created_files", "ts")
    files = timed_files(processes, "timestamp", 3, f"{base}/events")
    rows = spark.readStream.schema(processes.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/events")
    windows = detection.trailing_stream(rows, "process_id", "timestamp", "event_id", {"steps": "api_call_count", "entropies": "entropy"}, expire="365 days")
    model = models.TimelineModel.load(spark, model_path)
    score = lambda batch: model.score(batch, ["event_id", "process_id", "timestamp"])
    scoring = detection.score_windows(windows, score, f"{base}/scores", f"{base}/scoring")
    scoring.awaitTermination()
    detection.report_late_rows(spark, scoring, f"{base}/late")
    stored = spark.readStream.schema("event_id long, process_id long, timestamp timestamp, score double, predicted int")
    stored = stored.option("recursiveFileLookup", "true").parquet(f"{base}/scores")
    alerts = detection.quiet_stream(stored, "process_id", "timestamp", "event_id", ALERT_SCORE)
    jobs.start(alerts, lambda batch, name: batch.write.mode("overwrite").parquet(f"{base}/alerts/{name}"), f"{base}/alerting").awaitTermination()


@query(
    "stream_detection",
    """SELECT 'scored' AS kind, count(*) AS n FROM events UNION ALL SELECT 'processes', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'unlike the batch', 0 UNION ALL SELECT 'alerts unlike the batch', 0 UNION ALL SELECT 'late', 0""",
)
def stream_detection(spark, sf):
    """The model's scores and alerts in a stream, held row by row against those of the batch."""
    base = scratch_path(spark, "stream-detection")
    model, windows, _ = timeline_scores(spark, sf)
    model.save(spark, f"{base}/model")
    detect_in_stream(spark, sf, f"{base}/model", base)
    batch = materialize(model.score(windows, ["event_id", "process_id", "timestamp"]), "batch-scores")
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/scores")
    alerts = spark.read.option("recursiveFileLookup", "true").schema("event_id long, score double, kind string").parquet(f"{base}/alerts").filter("kind = 'alert'")
    wanted = detection.quiet_alerts(batch, "process_id", "timestamp", "event_id", ALERT_SCORE)
    unlike = lambda a, b, c: a.select(c).exceptAll(b.select(c)).union(b.select(c).exceptAll(a.select(c)))
    counted = lambda kind, rows: rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    late = spark.read.schema("late_rows long").json(f"{base}/late").agg(F.lit("late").alias("kind"), F.coalesce(F.sum("late_rows"), F.lit(0)).alias("n"))
    return (
        counted("scored", found)
        .union(counted("processes", found.select("process_id").distinct()))
        .union(counted("unlike the batch", unlike(found, batch, ["event_id", "score"])))
        .union(counted("alerts unlike the batch", unlike(alerts, wanted, ["event_id", "score"])))
        .union(late)
    )


@query(
    "stream_scan_sources",
    f"""WITH {fx.TRAFFIC}, seen AS (SELECT src_ip, dst_ip, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS w FROM traffic, (SELECT unnest(range(4)) AS k) WHERE syn_only)
    SELECT epoch_us(w) AS window_micros, src_ip, count(*) AS syn_packets, count(DISTINCT dst_ip) AS distinct_targets FROM seen GROUP BY ALL""",
)
def stream_scan_sources(spark, sf):
    """Sources and the addresses they probe in windows of a day, every six hours, from a stream of several batches."""
    base = scratch_path(spark, "stream-scans")
    rows = fx.traffic(spark, sf).select(F.col("ts").cast("timestamp").alias("timestamp"), "src_ip", "dst_ip", "syn_only")
    files = timed_files(rows, "timestamp", 3, f"{base}/packets")
    packets = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/packets")
    jobs.stream_scans(packets, f"{base}/windows", f"{base}/checkpoint", target="dst_ip", window="1 day", slide="6 hours").awaitTermination()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/windows")
    last = stored.groupBy("window_start", "src_ip").agg(F.max("syn_packets").alias("syn_packets"), F.max_by("targets", "syn_packets").alias("targets"))  # counts only grow
    return last.select(F.unix_micros("window_start").alias("window_micros"), "src_ip", "syn_packets", F.hll_sketch_estimate("targets").alias("distinct_targets"))


@query("stream_dashboard", "SELECT event_type, count(*) AS threats FROM events GROUP BY event_type")
def stream_dashboard(spark, sf):
    base = scratch_path(spark, "stream-dashboard")
    jobs.dashboard(packet_stream(spark, sf), "event_type", f"{base}/counts", f"{base}/checkpoint", jobs.DRAIN).awaitTermination()
    return jobs.dashboard_counts(spark, "event_type", f"{base}/counts")
