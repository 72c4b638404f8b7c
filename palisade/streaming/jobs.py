"""Streaming jobs. Each one is a batch operator applied to a stream; sinks are idempotent per batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import enrichment, reports, threats, validation
from palisade.sources import sinks
from palisade.sources.ledger import BatchLedger
from palisade.sources.traffic import parse_messages

DRAIN = {"availableNow": True}
REFRESH = {"processingTime": "30 seconds"}
WATERMARK = "10 minutes"
PACKETS_PER_SECOND = 1000  # fixed value


def start(
    stream: DataFrame,
    each: Callable[[DataFrame, str], None],
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``each(batch, batch_name)`` per micro-batch. A repeated batch has the same name, so writers that
    overwrite a folder of that name stay exact when a batch is retried."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN))
    return writer.foreachBatch(lambda batch, number: each(batch, f"batch={number}")).start()


def forward(path: str, source: Column, body: Callable[[DataFrame], Column]) -> Callable[[DataFrame, str], None]:
    """Batch writer that sends rows as collector envelopes."""

    def send(batch: DataFrame, name: str) -> None:
        envelopes = sinks.event_envelopes(batch, body(batch), source, F.col("timestamp"))
        sinks.envelope_json(envelopes).write.mode("overwrite").text(f"{path}/{name}")

    return send


def whole_row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), sinks.JSON_OPTIONS)


def ingest(
    messages: DataFrame,
    indicators: DataFrame,
    path: str,
    quarantine: str,
    checkpoint: str,
    trigger: dict | None = None,
    value: str = "value",
) -> StreamingQuery:
    """Parse, validate, enrich and forward traffic messages; rejected ones are kept with their reasons."""
    checked = validation.validate_records(parse_messages(messages, value))
    send = forward(path, F.lit("stream"), whole_row)

    def each(batch: DataFrame, name: str) -> None:
        batch.persist()
        send(enrichment.enrich_traffic(validation.valid_records(batch), indicators), name)
        validation.rejected_records(batch).write.mode("overwrite").options(**sinks.JSON_OPTIONS).json(f"{quarantine}/{name}")
        batch.unpersist()

    return start(checked, each, checkpoint, trigger=trigger)


def threat_stream(
    iocs: DataFrame,
    indicators: DataFrame,
    votes: DataFrame,
    rules: DataFrame,
    store: str,
    serious: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Enrich, score and store indicator events; those of level high and above also go to ``serious``.

    Serves the polled feeds (with a processing-time trigger) and the threat topic alike.
    """

    def each(batch: DataFrame, name: str) -> None:
        scored = threats.score_feed(threats.enrich_iocs(batch, indicators, votes, rules))
        scored.write.mode("overwrite").parquet(f"{store}/{name}")
        stored = batch.sparkSession.read.parquet(f"{store}/{name}")
        threats.serious(stored).write.mode("overwrite").options(**sinks.JSON_OPTIONS).json(f"{serious}/{name}")

    return start(iocs, each, checkpoint, trigger=trigger)


def running_protocol_counts(packets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Complete counts per protocol after each batch; the state has one row per protocol number."""
    counts = packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))
    write = lambda batch, name: batch.write.mode("overwrite").parquet(f"{path}/{name}")
    return start(counts, write, checkpoint, mode="complete", trigger=trigger)


def rates(packets: DataFrame, time: str = "timestamp", step: str = "1 second") -> DataFrame:
    """Packets per window; the batch twin of the rate alert."""
    counts = packets.groupBy(F.window(time, step).alias("w")).agg(F.count(F.lit(1)).alias("packets"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "packets")


def rate_alerts(packets: DataFrame, limit: int = PACKETS_PER_SECOND, time: str = "timestamp", step: str = "1 second") -> DataFrame:
    """Windows with more packets than the limit."""
    return rates(packets, time, step).filter(F.col("packets") > limit)


def stream_rate_alerts(
    packets: DataFrame,
    path: str,
    checkpoint: str,
    limit: int = PACKETS_PER_SECOND,
    time: str = "timestamp",
    step: str = "1 second",
    watermark: str = WATERMARK,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rate alerts; rows later than the watermark are dropped, so the state stays bounded.

    A running stream appends an alert once its window is closed. A drained one ends with windows still open: it writes every
    window as it stands after each batch, in a folder a batch, and the largest count of a window is its last.
    """
    alerts = rate_alerts(packets.withWatermark(time, watermark), limit, time, step)
    if trigger is None or trigger == DRAIN:
        each = lambda batch, name: batch.write.mode("overwrite").parquet(f"{path}/{name}")
        return start(alerts, each, checkpoint, mode="update", trigger=DRAIN)
    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).format("parquet").start(path)


def scan_windows(packets: DataFrame, target: str = "dport", time: str = "timestamp", window: str = "1 hour", slide: str = "15 minutes", lg_k: int = 14) -> DataFrame:
    """Per sliding window and source: SYN-only packets, and the distinct targets as a sketch that can be merged.

    The sketch has a bounded size (2 ** ``lg_k`` small counters, standard error below one percent), whatever a source scans, so
    this is the form for a stream; ``reports.scan_sources`` is the exact count of a batch.
    """
    probes = packets.filter("syn_only").groupBy(F.window(time, window, slide).alias("w"), "src_ip")
    found = probes.agg(F.count(F.lit(1)).alias("syn_packets"), F.hll_sketch_agg(target, lg_k).alias("targets"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_ip", "syn_packets", "targets")


def scan_totals(windows: DataFrame, by: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """Windows merged by ``by``: packets summed and sketches united, which counts a target once however often it was seen."""
    return windows.groupBy(*by).agg(F.sum("syn_packets").alias("syn_packets"), F.hll_sketch_estimate(F.hll_union_agg("targets")).alias("distinct_targets"))


def stream_scans(
    packets: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK, trigger: dict | None = None, time: str = "timestamp", **settings
) -> StreamingQuery:
    """``scan_windows`` of a stream: every window that a batch changed, as it stands then, in the batch's folder."""
    found = scan_windows(packets.withWatermark(time, watermark), time=time, **settings)
    return start(found, lambda batch, name: batch.write.mode("overwrite").parquet(f"{path}/{name}"), checkpoint, mode="update", trigger=trigger)


def score_stream(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    respond: Callable[[DataFrame], DataFrame],
    scores: str,
    responses: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each batch once, then plan responses for what the threshold lets through."""

    def each(batch: DataFrame, name: str) -> None:
        score(batch).write.mode("overwrite").parquet(f"{scores}/{name}")
        stored = batch.sparkSession.read.parquet(f"{scores}/{name}")
        respond(stored).write.mode("overwrite").options(**sinks.JSON_OPTIONS).json(f"{responses}/{name}")

    return start(rows, each, checkpoint, trigger=trigger)


def dashboard(events: DataFrame, name: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Threat counts, a version for every refresh; ``dashboard_counts`` reads the newest whole one."""
    counts = reports.threat_counts(events, name)
    publish = lambda batch, label: BatchLedger(batch.sparkSession, path).write(batch, label)
    return start(counts, publish, checkpoint, mode="complete", trigger=trigger or REFRESH)


def dashboard_counts(spark: SparkSession, name: str, path: str) -> DataFrame:
    """``(name, threats)`` of the newest version of a dashboard."""
    return BatchLedger(spark, path).latest(f"{name} string, threats long")
