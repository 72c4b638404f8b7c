"""Exact ranks, quantiles and ranking metrics without a single-task sort.

A global rank is built in two steps: equal values are summed first (a hot value becomes one row), the
distinct values are cut into bins at approximate quantiles, and the totals of the bins give each bin its
offset. Only inside a bin is anything sorted. The bin edges influence balance, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.storage import materialize

BINS = 1024
HASH_BUCKET_HEX = 3  # 4096 buckets


def bin_index(value: Column, edges: Column, capacity: int = BINS) -> Column:
    """Number of ascending ``edges`` (at most ``capacity``) below the value, by binary search inside the row."""
    steps = []
    step = 1
    while step <= capacity:
        steps.insert(0, F.lit(step))
        step *= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, by: F.when(F.get(edges, at + by - 1) < value, at + by).otherwise(at),
    )


def value_positions(
    df: DataFrame, value: str, weights: Mapping[str, Column], by: Sequence[str] = (), bins: int = BINS
) -> DataFrame:
    """One row per distinct value (within ``by``) with the sum of each weight and ``<weight>_before``,
    the sum over all smaller values. ``by`` names columns with few values, such as a feature name."""
    groups = list(by)
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
    distinct = distinct.agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = distinct.groupBy(*groups).agg(F.percentile_approx(value, shares, F.lit(10 * bins)).alias("_edges"))
    edged = distinct.join(edges, groups) if groups else distinct.withColumn("_edges", edges.scalar())
    binned = edged.withColumn("_bin", bin_index(F.col(value), F.col("_edges"), bins)).drop("_edges")
    totals = binned.groupBy(*groups, "_bin").agg(*[F.sum(n).alias(n) for n in weights])
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bin", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in weights]
    )
    smaller = Window.partitionBy(*groups, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = binned.withColumns({f"_{n}_inside": F.coalesce(F.sum(n).over(smaller), F.lit(0)) for n in weights})
    # Without groups at most ``bins`` rows; groups may be many, so Spark decides by their size.
    joined = inside.join(offsets if groups else F.broadcast(offsets), [*groups, "_bin"])
    return joined.select(
        *groups,
        value,
        *weights,
        *[(F.col(f"_{n}_offset") + F.col(f"_{n}_inside")).alias(f"{n}_before") for n in weights],
    )


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value)`` rows of several numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")


def _ordered_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; NaN is the largest, both zeros are one."""
    whole = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = whole.view(np.uint64)
    return np.where(bits >> np.uint64(63) != 0, ~bits, bits | np.uint64(1 << 63))


def _value_of(key: int) -> float:
    """The double of a key."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _histogram(numbers: DataFrame, active: Mapping[int, set[int]], level: int) -> DataFrame:
    """``(place, prefix, bucket, n)``: rows by the next 16 bits of their keys, for the prefixes wanted of each column.

    A task holds one array of 65,536 counts for each wanted prefix, and hands on what isn't zero.
    """
    shift = 48 - 16 * level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(place, prefix): np.zeros(1 << 16, np.int64) for place, prefixes in active.items() for prefix in prefixes}
        for batch in batches:
            for place, prefixes in active.items():
                keys = _ordered_keys(batch.column(place).drop_null().to_numpy(zero_copy_only=False))
                above = keys >> np.uint64(shift + 16) if level else np.zeros(len(keys), np.uint64)
                bucket = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                for prefix in prefixes:
                    own = bucket if not level else bucket[above == np.uint64(prefix)]
                    if len(own):
                        counts[place, prefix] += np.bincount(own, minlength=1 << 16)
        for (place, prefix), found in counts.items():
            some = np.flatnonzero(found)
            columns = [np.full(len(some), place, np.int32), np.full(len(some), prefix, np.int64), some.astype(np.int32), found[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "prefix", "bucket", "n"])

    parts = numbers.mapInArrow(run, "place int, prefix long, bucket int, n long")
    return parts.groupBy("place", "prefix", "bucket").agg(F.sum("n").alias("n"))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(feature, share, quantile)``, exact with linear interpolation; a column without numbers has none.

    Selection by histograms: doubles become 64-bit keys of the same order, and four passes each settle 16 bits of the keys at
    the wanted ranks. No row is shuffled or sorted; a pass shuffles at most 65,536 counts for each rank and task.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    spark = df.sparkSession
    first = materialize(_histogram(numbers, {i: {0} for i in range(len(columns))}, 0), "histogram")
    rows = {r["place"]: r["rows"] for r in first.groupBy("place").agg(F.sum("n").alias("rows")).collect()}
    at = {(i, float(s)): (n - 1) * float(s) for i, n in rows.items() for s in shares}
    ranks = sorted({(i, int(f(a))) for (i, _), a in at.items() for f in (floor, ceil)})
    known = {(i, rank): (0, rank) for i, rank in ranks}  # the settled bits of the key, and the rank among the rows that share them
    for level in range(4):
        if not known:
            break
        active: dict[int, set[int]] = {}
        for (i, _), (prefix, _) in known.items():
            active.setdefault(i, set()).add(prefix)
        counts = first if level == 0 else materialize(_histogram(numbers, active, level), "histogram")
        smaller = Window.partitionBy("place", "prefix").orderBy("bucket")
        placed = counts.withColumn("upto", F.sum("n").over(smaller)).withColumn("before", F.col("upto") - F.col("n"))
        asked = spark.createDataFrame([(i, prefix, inside, rank) for (i, rank), (prefix, inside) in known.items()], "place int, prefix long, inside long, rank long")
        met = placed.join(asked, ["place", "prefix"]).filter((F.col("before") <= F.col("inside")) & (F.col("inside") < F.col("upto")))
        known = {(r["place"], r["rank"]): (r["prefix"] << 16 | r["bucket"], r["inside"] - r["before"]) for r in met.collect()}  # a row for each rank
    value = {where: _value_of(prefix) for where, (prefix, _) in known.items()}
    found = []
    for (i, share), a in at.items():
        low, high = value[i, floor(a)], value[i, ceil(a)]
        found.append((columns[i], share, low if low == high else low + (high - low) * (a - floor(a))))
    return spark.createDataFrame(found, "feature string, share double, quantile double")


def ranking_quality(scored: DataFrame, score: str, label: str, recall: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and the best precision at the wanted recall."""
    weights = {
        "positives": F.when(F.col(label) == 1, 1).otherwise(0),
        "negatives": F.when(F.col(label) == 0, 1).otherwise(0),
    }
    placed = value_positions(scored, score, weights, by=by)
    sums = placed.groupBy(*by).agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    sides = placed.join(sums, list(by)) if by else placed.withColumn("_s", sums.select(F.struct("_p", "_n")).scalar()).select(
        "*", F.col("_s._p"), F.col("_s._n")
    )
    caught = F.col("_p") - F.col("positives_before")
    alarms = caught + F.col("_n") - F.col("negatives_before")
    pairs = F.col("positives") * (F.col("negatives_before") + F.col("negatives") / 2)
    enough = F.try_divide(caught, F.col("_p")) >= recall  # a group without positives has no recall
    return sides.groupBy(*by).agg(
        F.try_divide(F.sum(pairs), (F.first("_p") * F.first("_n")).cast("double")).alias("auc"),
        F.max(F.when(enough, F.try_divide(caught, alarms))).alias("precision_at_recall"),
    )


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """``fold`` 0..folds-1: rank of the key's digest inside its label, dealt out in turn.

    Buckets of the digest spread a label over many tasks; the bucket counts give each bucket its offset.
    """
    hashed = df.withColumn("_digest", F.md5(F.col(key).cast("string"))).withColumn(
        "_bucket", F.substring("_digest", 1, HASH_BUCKET_HEX)
    )
    counts = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_slot"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_digest", key)
    ranked = hashed.withColumn("_rank", F.row_number().over(inside))
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_slot"))
    placed = ranked.join(offsets, same)
    return placed.withColumn("fold", ((F.col("_offset") + F.col("_rank") - 1) % folds).cast("int")).drop(
        "_digest", "_bucket", "_slot", "_label", "_offset", "_rank"
    )


def group_positions(df: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows with ``name``, their place from 0 inside ``key`` in the order of the columns ``order``; null keys are one group.

    Rows are spread by range over key and order and sorted where they are, so a hot key takes many partitions. Only the
    bounds of each key in each partition are added up.
    """
    tie = F.monotonically_increasing_id()
    spread = df.withColumn("_tie", tie).repartitionByRange(key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie")
    placed = materialize(spread.withColumn("_turn", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_turn", 33)  # the partition a row was sorted in
    spans = placed.groupBy(part.alias("_part"), F.col(key).alias("_key")).agg(F.min("_turn").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    shifts = spans.select("_part", "_key", (before - F.col("_first")).alias("_shift"))
    joined = placed.join(shifts, (part == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_turn") + F.col("_shift")).drop("_turn", "_part", "_key", "_shift")
