"""Batches written twice, failed attempts, and audit lines that were tampered with."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.sources import ledger


def test_a_batch_counts_once(spark, tmp_path):
    store = ledger.BatchLedger(spark, str(tmp_path / "store"))
    assert store.read("id long").count() == 0 and store.entries() == []
    first = store.write(spark.range(10), "batch=1", source="a")
    assert store.write(spark.range(10), "batch=1") == first and first["source"] == "a"
    store.write(spark.range(5), "batch=2")
    spark.range(99).write.parquet(str(tmp_path / "store/data/batch=3/failed"))  # an attempt without a line
    assert [tuple(r) for r in store.read("id long").groupBy("batch").count().orderBy("batch").collect()] == [("batch=1", 10), ("batch=2", 5)]
    assert [e["batch"] for e in store.entries()] == ["batch=1", "batch=2"]
    assert store.latest("id long").count() == 5
    with pytest.raises(ValueError):
        store.write(spark.range(1), "../elsewhere")


def log_of(spark, tmp_path):
    log = ledger.AuditLog(spark, str(tmp_path / "audit"))
    rows = spark.range(3000).select("id", F.concat(F.lit("line "), F.col("id") % 2900).alias("text"))  # some lines repeat
    for batch, low, high in (("b1", 0, 1500), ("b2", 1500, 3000), ("b3", 0, 1), ("b4", 0, 0)):
        for _ in range(2):
            log.append(rows.filter((F.col("id") >= low) & (F.col("id") < high)), batch, "text", ["id"])
    return log


def test_audit_lines_are_checked(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert log.verify().count() == 0 and log.broken_seals() == []
    assert {e["batch"]: e["rows"] for e in log.seals.entries()} == {"b1": 1500, "b2": 1500, "b3": 1, "b4": 0}
    lines = log.lines.read(ledger.LINES)
    assert [r["line"] for r in lines.filter("batch = 'b2'").orderBy("position").limit(2).collect()] == ["line 1500", "line 1501"]
    swapped = F.when((F.col("batch") == "b1") & F.col("position").isin(20, 21), 41 - F.col("position")).otherwise(F.col("position"))
    bent = lines.withColumn("position", swapped).filter("NOT (batch = 'b2' AND position = 7)")
    bent = bent.withColumn("line", F.when((F.col("batch") == "b2") & (F.col("position") == 9), None).otherwise(F.col("line")))
    bent = bent.unionByName(spark.createDataFrame([(5, "new", "b3")], "position long, line string, batch string"))
    found = sorted(map(tuple, log.verify(bent).collect()))
    assert found == [("b1", 20, "moved"), ("b1", 21, "moved"), ("b2", 7, "removed"), ("b2", 9, "changed"), ("b3", 5, "added")]


def test_seals_are_checked_too(spark, tmp_path):
    log = log_of(spark, tmp_path)
    path = Path(tmp_path / "audit/seals/ledger/b2.json")
    entry = json.loads(path.read_text())
    path.write_text(json.dumps(entry | {"root": "0" * 64}))
    assert ("b2", "root") in log.broken_seals() and ("b2", "chain") in log.broken_seals()
    path.write_text(json.dumps(entry))
    other = f"{tmp_path}/forged"
    spark.read.parquet(entry["path"]).withColumn("digest", F.when(F.col("position") == 3, F.sha2("digest", 256)).otherwise(F.col("digest"))).write.parquet(other)
    path.write_text(json.dumps(entry | {"path": other}))
    assert log.broken_seals() == [("b2", "root")]
    path.unlink()  # a batch taken out breaks the chain of the next one
    assert log.broken_seals() == [("b3", "chain")]


def test_lines_written_before_a_failure_are_sealed_later(spark, tmp_path):
    log = ledger.AuditLog(spark, str(tmp_path / "audit"))
    log.lines.write(spark.createDataFrame([(0, "kept")], ledger.LINES), "b")
    entry = log.append(spark.createDataFrame([(1, "other")], "id long, text string"), "b", "text", ["id"])
    assert entry["rows"] == 1 and log.verify().count() == 0
    assert log.lines.read(ledger.LINES).first()["line"] == "kept"
