"""Detection by a model in a stream, with keyed state.

Three steps, each with a checkpoint of its own: state per key holds the latest events and hands every event on with the window
that ends there; each batch of windows is scored by a saved model and stored under the batch's name; a second stream over the
stored scores keeps one alert per key and quiet period. State is dropped by event-time timers. Rows behind the watermark are
left out by Spark and counted.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.operators.sequences import LENGTH
from palisade.streaming.jobs import WATERMARK, start

EXPIRE = "1 hour"
QUIET = "10 minutes"


def seconds(duration: str) -> int:
    """Seconds of a duration like ``10 minutes``."""
    return int(pd.Timedelta(duration).total_seconds())


def trailing_stream(
    rows: DataFrame, key: str, time: str, tie: str, columns: Mapping[str, str], length: int = LENGTH, expire: str = EXPIRE, watermark: str = WATERMARK
) -> DataFrame:
    """The stream's rows, each with arrays of the latest ``length`` values of its key up to and with itself.

    The streaming twin of ``trailing_windows``. Values are doubles, NaN counts as null; ``tie`` is a whole number that tells
    events of one moment apart. An event that comes again while it is in its key's state is left out. An event older than
    others of its key, but not behind the watermark, gets the window as it should have been and ``disordered``; later events
    see it. A key's state is the latest ``length`` events and is dropped ``expire`` after the newest one.
    """
    names = list(columns)
    stamped = rows.withColumn("_at", F.unix_micros(time)).withColumns({f"_{n}": F.col(c).cast("double") for n, c in columns.items()})
    stamped = stamped.withWatermark(time, watermark)
    shown = [f for f in rows.schema.fields]
    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    out = T.StructType([*shown, *arrays, T.StructField("disordered", T.BooleanType())])
    state_type = T.StructType([T.StructField("at", T.ArrayType(T.LongType())), T.StructField("tie", T.ArrayType(T.LongType())), *arrays])
    wait = seconds(expire) * 1000

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        held = [tuple(event) for event in held]
        found = pd.concat(list(frames)).sort_values(["_at", tie], kind="stable")
        known = {event[:2] for event in held}
        windows, kept = [], []
        clean = [[None if v != v else v for v in found[f"_{n}"].tolist()] for n in names]
        for place, event in enumerate(zip(found["_at"].tolist(), found[tie].tolist(), *clean)):
            if event[:2] in known:
                continue
            known.add(event[:2])
            late = bool(held) and event[:2] < held[-1][:2]
            insort(held, event, key=lambda e: e[:2])
            end = held.index(event) + 1 if late else len(held)
            windows.append([[e[2 + i] for e in held[max(0, end - length) : end]] for i in range(len(names))] + [late])
            kept.append(place)
            del held[: max(0, len(held) - length)]
        state.update(tuple(list(part) for part in zip(*held)))
        state.setTimeoutTimestamp(held[-1][0] // 1000 + wait)
        result = found.iloc[kept][[f.name for f in shown]].reset_index(drop=True)
        for i, name in enumerate([*names, "disordered"]):
            result[name] = pd.Series([w[i] for w in windows], dtype=object if i < len(names) else bool)
        yield result

    return stamped.groupBy(key).applyInPandasWithState(follow, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def score_windows(windows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write ``score(batch)`` of every batch of windows under the batch's name; a repeated batch replaces itself."""
    return start(windows, lambda batch, name: score(batch).write.mode("overwrite").parquet(f"{path}/{name}"), checkpoint, trigger=trigger)


def late_rows(query: StreamingQuery) -> int:
    """Rows behind the watermark that the query's stateful steps left out, over its kept progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


def report_late_rows(spark: SparkSession, query: StreamingQuery, path: str) -> int:
    """Write ``(batch, late_rows)`` of the kept progress reports as a side output; returns their sum."""
    rows = [(r["batchId"], sum(op["numRowsDroppedByWatermark"] for op in r["stateOperators"])) for r in query.recentProgress]
    spark.createDataFrame(rows, "batch long, late_rows long").write.mode("overwrite").json(path)
    return late_rows(query)


ALERT = "score double, suppressed long, kind string"


def quiet_stream(scores: DataFrame, key: str, time: str, tie: str, threshold: float, quiet: str = QUIET, watermark: str = WATERMARK) -> DataFrame:
    """One alert per key and quiet period: ``(key, time, tie, score, suppressed, kind)``.

    A score above the threshold is an ``alert`` unless an alert of its key came less than ``quiet`` before; such scores are
    counted. When the period is over, a timer drops the state, and if scores were suppressed a ``closed`` row tells how many.
    Scores that come again, or before the key's last alert, change nothing.
    """
    kinds = {f.name: f for f in scores.schema.fields}
    out = T.StructType([kinds[key], kinds[time], kinds[tie], *T.StructType.fromDDL(ALERT).fields])
    pause = seconds(quiet) * 1_000_000
    stamped = scores.withColumn("_at", F.unix_micros(time)).withWatermark(time, watermark).filter(F.col("score") > threshold)

    def watch(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        at, last_tie, seen_at, seen_tie, suppressed = state.get if state.exists else (None, None, None, None, 0)
        if state.hasTimedOut:
            state.remove()
            if suppressed:
                rows.append((group[0], pd.Timestamp(at, unit="us"), last_tie, None, suppressed, "closed"))
        else:
            found = pd.concat(list(frames)).sort_values(["_at", tie], kind="stable")
            for now, number, score, moment in zip(found["_at"].tolist(), found[tie].tolist(), found["score"].tolist(), found[time]):
                if seen_at is not None and (now, number) <= (seen_at, seen_tie):
                    continue
                seen_at, seen_tie = now, number
                if at is not None and now < at + pause:
                    suppressed += 1
                    continue
                if suppressed:
                    rows.append((group[0], pd.Timestamp(at, unit="us"), last_tie, None, suppressed, "closed"))
                rows.append((group[0], moment, number, score, 0, "alert"))
                at, last_tie, suppressed = now, number, 0
            state.update((at, last_tie, seen_at, seen_tie, suppressed))
            state.setTimeoutTimestamp(max((at + pause) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields])

    return stamped.groupBy(key).applyInPandasWithState(
        watch, out, "at long, tie long, seen_at long, seen_tie long, suppressed long", "append", GroupStateTimeout.EventTimeTimeout
    )


def quiet_alerts(scored: DataFrame, key: str, time: str, tie: str, threshold: float, quiet: str = QUIET) -> DataFrame:
    """The batch twin of ``quiet_stream``: the rows of kind ``alert``, and ``suppressed``, the scores each one silenced.

    Only scores above the threshold are moved; a key's are read in order, and one alert is held at a time.
    """
    pause = seconds(quiet) * 1_000_000
    high = scored.filter(F.col("score") > threshold).select(key, F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie"), "score")
    out = T.StructType([high.schema[key], *T.StructType.fromDDL("at long, tie long, score double, suppressed long").fields])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alert: list | None = None
        for batch in batches:
            done = []
            for row in zip(*(batch[c].to_pylist() for c in (key, "at", "tie", "score"))):
                if alert is not None and row[0] == alert[0] and row[1] < alert[1] + pause:
                    alert[4] += 1
                    continue
                if alert is not None:
                    done.append(alert)
                alert = [*row, 0]
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, a)) for a in done], schema=_arrow(out))
        if alert is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, alert))], schema=_arrow(out))

    return high.repartition(key).sortWithinPartitions(key, "at", "tie").mapInArrow(pick, out).withColumn(time, F.timestamp_micros("at")).drop("at").withColumnRenamed("tie", tie)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
