"""Writers and the envelopes they write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.storage import materialize

from palisade.functions.text import encrypt_text, iso_timestamp

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
DEFAULT_SOURCETYPE = "security:log"
DEFAULT_EVENT_INDEX = "threat_detection"
DEFAULT_DOCUMENT_INDEX = "security-threats"


def save_records(df: DataFrame, path: str) -> None:
    """Format by extension: snappy Parquet, gzip CSV, otherwise JSON lines. One write holds every row."""
    writer = df.write.mode("overwrite")
    if path.endswith(".parquet"):
        writer.option("compression", "snappy").parquet(path)
    elif path.endswith(".csv.gz"):
        writer.option("compression", "gzip").csv(path, header=True)
    else:
        writer.options(**JSON_OPTIONS).json(path)


def event_envelopes(
    df: DataFrame,
    body: Column,
    source: Column,
    time: Column | None = None,
    sourcetype: str = DEFAULT_SOURCETYPE,
    index: str = DEFAULT_EVENT_INDEX,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Collector envelopes around a JSON body; ``valid`` is false when the body is no object or there is no source."""
    moment = F.current_timestamp() if time is None else time
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return df.select(
        *keep,
        body.alias("event"),
        F.lit(sourcetype).alias("sourcetype"),
        source.alias("source"),
        F.lit(index).alias("index"),
        F.unix_micros(moment.cast("timestamp")).alias("time_micros"),
        (is_object & source.isNotNull()).alias("valid"),
    )


def envelope_json(envelopes: DataFrame) -> DataFrame:
    """The line sent per valid event: body as nested object, time in epoch seconds."""
    line = F.to_json(
        F.struct(
            F.parse_json("event").alias("event"),
            "sourcetype",
            "source",
            "index",
            (F.col("time_micros") / F.lit(1e6)).alias("time"),
        )
    )
    return envelopes.filter("valid").select(line.alias("value"))


def send_events(envelopes: DataFrame, path: str, quarantine: str | None = None, batch: str | None = None) -> None:
    """Write valid envelopes as text lines; invalid ones go to ``quarantine``.

    With a ``batch`` name they go to a folder of that name, so that sending a batch again replaces it. The envelopes are
    written once before they are split, so both parts come from one evaluation.
    """
    stored = materialize(envelopes, "envelopes")
    mode, below = ("append", "") if batch is None else ("overwrite", f"/batch={batch}")
    envelope_json(stored).write.mode(mode).text(path + below)
    if quarantine:
        stored.filter("NOT valid").write.mode(mode).json(quarantine + below)


def search_documents(
    df: DataFrame,
    time: Column,
    threat_type: Column,
    severity: Column,
    source_ip: Column,
    event_data: Column,
    index: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Documents of the search index: date, two keywords, an address and the opaque body as JSON text."""
    return df.select(
        *keep,
        (F.lit(DEFAULT_DOCUMENT_INDEX) if index is None else index).alias("_index"),
        iso_timestamp(time).alias("@timestamp"),
        time.alias("timestamp"),
        threat_type.alias("threat_type"),
        severity.alias("severity"),
        source_ip.alias("source_ip"),
        event_data.alias("event_data"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """Append documents, one folder per index, so a search by index reads only its folder."""
    documents.write.mode("append").options(**JSON_OPTIONS).partitionBy("_index").json(path)


def audit_entries(df: DataFrame, event: Column, time: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Audit lines with time, user, event and its SHA-256 (Spark has no SHA-3)."""
    return df.select(
        *keep,
        (F.current_timestamp() if time is None else time).alias("timestamp"),
        F.current_user().alias("user"),
        event.alias("event"),
        F.sha2(event, 256).alias("hash"),
    )


def append_audit(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Append audit lines. A named batch has a folder of its own and replaces itself; sealed lines are in ``ledger.AuditLog``."""
    folder, mode = (path, "append") if batch is None else (f"{path}/batch={batch}", "overwrite")
    entries.write.mode(mode).options(**JSON_OPTIONS).json(folder)


def encrypted_rows(df: DataFrame, key: Column) -> DataFrame:
    """Each row as one encrypted JSON text."""
    return df.select(encrypt_text(F.to_json(F.struct(*df.columns)), key).alias("payload"))


def store_threats(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append scored threats, foldered by type and level. A named batch is written once however often it is sent."""
    folder, mode = (path, "append") if batch is None else (f"{path}/batch={batch}", "overwrite")
    df.write.mode(mode).partitionBy("type", "threat_level").parquet(folder)
