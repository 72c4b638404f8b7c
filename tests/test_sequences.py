"""Trailing windows, the sequence model and detection in a stream."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import models, ranking, sequences
from palisade.streaming import detection, jobs

START = datetime(2024, 1, 1)


def plain_windows(rows, length):
    """Rows (id, key, time, value) -> id: the latest values of its key up to itself."""
    held, found = defaultdict(list), {}
    for i, key, time, value in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        held[key].append(value)
        found[i] = held[key][-length:]
    return found


@pytest.mark.parametrize("length, block", [(1, 1), (4, 5), (32, 4096), (7, 7)])
def test_trailing_windows(spark, length, block):
    r = random.Random(length)
    rows = [(i, r.choice([0, 0, 0, 1, 2, None]), START + timedelta(seconds=r.randrange(60)), None if r.random() < 0.1 else r.random()) for i in range(200)]
    table = spark.createDataFrame([(*x, "v") for x in rows], "id long, key long, time timestamp, value double, v string").repartition(4)
    found = {x["id"]: x["last"] for x in sequences.trailing_windows(table, "key", "time", "id", {"last": "value"}, length, block).collect()}
    assert found == plain_windows(rows, length)


def test_positions_of_a_hot_key(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("key"))
    placed = ranking.group_positions(rows, "key", ["id"])
    assert placed.filter("key = -7").agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.countDistinct("position")).first() == (16667, 0, 16666, 16667)
    assert placed.filter("key = -7 AND position * 3 <> id").count() == 0


def plain_model(samples, width, order):
    """Log-odds by (context, symbol) from (label, symbols), straight from the definition."""
    counts = {y: Counter() for y in (0, 1)}
    for label, s in samples:
        for t, symbol in enumerate(s):
            for k in range(min(t, order) + 1):
                counts[label][tuple(s[t - k : t]), symbol] += 1

    def p(y, context, symbol):
        lower = p(y, context[1:], symbol) if context else 1 / width
        after = {s: n for (c, s), n in counts[y].items() if c == context}
        if not after:
            return lower
        return (after.get(symbol, 0) + len(after) * lower) / (sum(after.values()) + len(after))

    return lambda context, symbol: math.log(p(1, context, symbol) / p(0, context, symbol))


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_sequence_model_by_its_definition(spark, order):
    r = random.Random(order)
    edges = (1.0, 2.0)
    rows = [(i % 2, [float(r.choices((0, 1, 2), (3, 1, 1) if i % 2 else (1, 1, 3))[0]) for _ in range(r.randrange(9))]) for i in range(40)] + [(None, [1.0]), (1, None), (0, [None, float("nan"), 5.0])]
    table = spark.createDataFrame(rows, "label int, steps array<double>")
    model = sequences.SequenceModel.fit(table, "label", "steps", edges, order)
    symbol = lambda x: 0 if x is None or x != x else sum(x >= e for e in edges)
    odds = plain_model([(y, list(map(symbol, s))) for y, s in rows if y is not None and s], 3, order)
    assert len(model.log_odds) == sum(3 ** (k + 1) for k in range(order + 1))
    for row in table.select("steps", model.score(F.col("steps")).alias("score")).collect():
        s = [symbol(x) for x in row["steps"] or []]
        assert row["score"] == pytest.approx(sum(odds(tuple(s[max(0, t - order) : t]), x) for t, x in enumerate(s)), abs=1e-9)


def test_sequence_model_tells_orders_of_steps_apart(spark, tmp_path):
    """Both classes use the same steps equally often; only what follows what differs, which sums over steps can't see."""
    r = random.Random(1)

    def sample(label):
        s = [r.randrange(3)]
        while len(s) < 20:
            s.append((s[-1] + (1 if r.random() < 0.7 else 2)) % 3 if label else (s[-1] + (2 if r.random() < 0.7 else 1)) % 3)
        return [float(x) for x in s]

    rows = [(i, i % 2, sample(i % 2)) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, label int, steps array<double>")
    model = sequences.SequenceModel.fit(table.filter("id < 400"), "label", "steps", (1.0, 2.0))
    model.save(spark, str(tmp_path / "model"))
    assert sequences.SequenceModel.load(spark, str(tmp_path / "model")) == model
    quality = ranking.ranking_quality(table.filter("id >= 400").select("label", model.score(F.col("steps")).alias("score")), "score", "label").first()
    assert quality["auc"] > 0.95


# --- streams


def event(i, key, second, value):
    return (i, key, START + timedelta(seconds=second), float(value))


SCHEMA = "event_id long, process_id long, timestamp timestamp, value double"


def run_windows(spark, folder, base, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    windows = detection.trailing_stream(rows, "process_id", "timestamp", "event_id", {"last": "value"}, length=3, **options)
    query = detection.score_windows(windows, lambda batch: batch.withColumn("score", F.aggregate("last", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))), f"{base}/scores", f"{base}/checkpoint")
    query.awaitTermination()
    return query


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.mode("append").parquet(folder)


def read(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def test_stream_windows_like_the_batch_over_restarts(spark, tmp_path):
    r = random.Random(2)
    folder, base = str(tmp_path / "events"), str(tmp_path / "out")
    rows = [event(i, r.choice([0, 0, 1, 2]), 10 * i + r.randrange(5), r.randrange(50)) for i in range(120)]
    for start in range(0, 60, 20):
        add_file(spark, folder, rows[start : start + 20])
    run_windows(spark, folder, base)
    for start in range(60, 120, 20):  # a new run goes on from the checkpoint
        add_file(spark, folder, rows[start : start + 20] + rows[start : start + 2])  # two events come twice
    run_windows(spark, folder, base)
    found = {x["event_id"]: x["last"] for x in read(spark, f"{base}/scores").collect()}
    assert read(spark, f"{base}/scores").count() == 120
    assert found == plain_windows(rows, 3)
    assert len(list((tmp_path / "out" / "scores").iterdir())) >= 6


def test_disordered_and_late_rows(spark, tmp_path):
    folder, base = str(tmp_path / "events"), str(tmp_path / "out")
    add_file(spark, folder, [event(1, 0, 100, 1), event(2, 0, 200, 2)])
    add_file(spark, folder, [event(3, 0, 150, 3), event(4, 0, 300, 4)])  # the first is older, but not behind the watermark
    add_file(spark, folder, [event(5, 1, 5000, 5)])
    add_file(spark, folder, [event(9, 1, 5001, 9)])  # Spark drops rows by the watermark of the batch before the last
    add_file(spark, folder, [event(6, 0, 10, 6), event(7, 0, 20, 7), event(8, 0, 5000, 8)])  # two behind the watermark
    query = run_windows(spark, folder, base, expire="2 hours", watermark="10 minutes")
    found = {x["event_id"]: (x["last"], x["disordered"]) for x in read(spark, f"{base}/scores").collect()}
    assert found[3] == ([1.0, 3.0], True) and found[4] == ([3.0, 2.0, 4.0], False)
    assert set(found) == {1, 2, 3, 4, 5, 8, 9} and found[8][0] == [2.0, 4.0, 8.0]
    assert detection.report_late_rows(spark, query, f"{base}/late") == 2
    assert spark.read.json(f"{base}/late").agg(F.sum("late_rows")).first()[0] == 2


def test_state_expires_by_its_timer(spark, tmp_path):
    folder, base = str(tmp_path / "events"), str(tmp_path / "out")
    add_file(spark, folder, [event(1, 0, 0, 1)])
    add_file(spark, folder, [event(2, 1, 10_000, 2)])  # moves the watermark over the first key's timer
    add_file(spark, folder, [event(3, 1, 10_001, 3)])
    add_file(spark, folder, [event(4, 0, 10_002, 4)])
    run_windows(spark, folder, base, expire="10 minutes", watermark="1 minute")
    assert {x["event_id"]: x["last"] for x in read(spark, f"{base}/scores").collect()} == {1: [1.0], 2: [2.0], 3: [2.0, 3.0], 4: [4.0]}


def plain_alerts(rows, threshold, quiet):
    last, found, silenced = {}, [], Counter()
    for i, key, time, score in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        if score > threshold:
            if key in last and time < last[key][0] + timedelta(seconds=quiet):
                silenced[last[key][1]] += 1
                continue
            last[key] = (time, i)
            found.append(i)
    return found, silenced


def test_one_alert_per_key_and_quiet_period(spark, tmp_path):
    r = random.Random(4)
    rows = [event(i, r.randrange(3), 20 * i + r.randrange(20), r.random()) for i in range(200)]
    found, silenced = plain_alerts(rows, 0.4, 120)
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("value", "score")
    batch = detection.quiet_alerts(table.repartition(4), "process_id", "timestamp", "event_id", 0.4, "2 minutes").collect()
    assert sorted(x["event_id"] for x in batch) == sorted(found)
    assert {x["event_id"]: x["suppressed"] for x in batch if x["suppressed"]} == dict(silenced)
    folder, base = str(tmp_path / "scores"), str(tmp_path / "out")
    for start in range(0, 200, 50):
        table.filter((F.col("event_id") >= start) & (F.col("event_id") < start + 50)).repartition(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        alerts = detection.quiet_stream(stream, "process_id", "timestamp", "event_id", 0.4, "2 minutes")
        jobs.start(alerts, lambda b, name: b.write.mode("overwrite").parquet(f"{base}/alerts/{name}"), f"{base}/checkpoint").awaitTermination()
    streamed = read(spark, f"{base}/alerts")
    assert sorted(x["event_id"] for x in streamed.filter("kind = 'alert'").collect()) == sorted(found)
    closed = {x["event_id"]: x["suppressed"] for x in streamed.filter("kind = 'closed'").collect()}
    assert closed and all(silenced[i] == n for i, n in closed.items())


def test_timeline_model_uses_the_order_of_steps(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for key in range(120):
        step, bad = 0, key % 2
        for i in range(12):
            step = (step + (1 if r.random() < (0.85 if bad else 0.15) else 2)) % 3
            rows.append((key * 100 + i, key, START + timedelta(seconds=i), step * 30.0, 4.0 + r.random(), 10.0, 2.0, bad))
    table = spark.createDataFrame(rows, "event_id long, process_id long, timestamp timestamp, step double, entropy double, api_call_count double, process_duration double, is_ransomware int")
    windows = sequences.trailing_windows(table, "process_id", "timestamp", "event_id", {"steps": "step", "entropies": "entropy"}).cache()
    last = windows.filter("event_id % 100 = 11")
    model = models.TimelineModel.fit(windows.filter("process_id < 80"), (20.0, 40.0), rounds=5)
    model.save(spark, str(tmp_path / "model"))
    again = models.TimelineModel.load(spark, str(tmp_path / "model"))
    scored = again.score(last.filter("process_id >= 80"), ["event_id", "is_ransomware"])
    assert ranking.ranking_quality(scored, "score", "is_ransomware").first()["auc"] > 0.9
    assert scored.exceptAll(model.score(last.filter("process_id >= 80"), ["event_id", "is_ransomware"])).count() == 0


def test_sketches_of_scans_are_near_the_exact_counts(spark):
    """Four sources probe 10 to 50,000 ports over several windows; the merged sketches are within two percent and of bounded size."""
    sizes = {"a": 10, "b": 1000, "c": 20_000, "d": 50_000}
    rows = [spark.range(n * 2).select(F.lit(s).alias("src_ip"), (F.col("id") % n).alias("dport"), F.timestamp_seconds(F.col("id") % 7200).alias("timestamp"), F.lit(True).alias("syn_only")) for s, n in sizes.items()]
    packets = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    windows = jobs.scan_windows(packets).cache()
    assert windows.agg(F.max(F.length("targets"))).first()[0] < 20_000
    for row in jobs.scan_totals(windows).collect():
        assert abs(row["distinct_targets"] - sizes[row["src_ip"]]) <= 0.02 * sizes[row["src_ip"]]
    exact = packets.filter("src_ip = 'd' AND timestamp < '1970-01-01 01:00:00'").agg(F.countDistinct("dport")).first()[0]
    hour = windows.filter("src_ip = 'd' AND window_start = '1970-01-01 00:00:00'").select(F.hll_sketch_estimate("targets")).first()[0]
    assert abs(hour - exact) <= 0.02 * exact
