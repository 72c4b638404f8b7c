"""Feature engineering for anomaly and process models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import numeric
from palisade.functions.text import byte_entropy, looks_encrypted, note_keyword_count
from palisade.operators.ranking import bin_index, long_form, quantiles
from palisade.storage import materialize

# Candidate features, the core pair and the variance limit.
CANDIDATES = (
    "duration", "tx_bytes", "rx_bytes", "bytes_per_second", "packet_size_var", "protocol_entropy", "tls_ratio",
    "dns_query_freq",
)
CORE = ("bytes_per_second", "protocol_entropy")
MIN_VARIANCE = 0.01
MIN_FEATURES = 3


def traffic_features(flows: DataFrame) -> DataFrame:
    """Adds rate, packet variance and protocol entropy to flow rows."""
    return flows.withColumns(
        {
            "bytes_per_second": numeric.per_second(F.col("tx_bytes"), F.col("duration")),
            "packet_size_var": numeric.pair_variance(F.col("tx_packets"), F.col("rx_packets")),
            "protocol_entropy": numeric.protocol_entropy(F.col("protocol")),
        }
    )


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of population variances."""
    return df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])


def choose_features(
    found: Mapping[str, float | None], threshold: float = MIN_VARIANCE, core: Sequence[str] = CORE
) -> tuple[list[str], list[str]]:
    """Selected and removed names given the variances; the core pair is always in, fewer than three is an error."""
    selected = [n for n, v in found.items() if v is not None and v > threshold]
    selected += [n for n in core if n not in selected]
    if len(selected) < MIN_FEATURES:
        raise ValueError("too few features for a reliable detection")
    return selected, [n for n in found if n not in selected]


def select_features(df: DataFrame, candidates: Sequence[str] = CANDIDATES) -> tuple[list[str], list[str]]:
    """Feature choice from one aggregate row; optional candidates the input lacks are left out."""
    present = [c for c in candidates if c in df.columns]
    return choose_features(variances(df, present).first().asDict())


def robust_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and inter-quartile range per column; a zero range becomes 1. Three numbers per column are read."""
    found = {(r["feature"], r["share"]): r["quantile"] for r in quantiles(df, columns).collect()}
    missing = [c for c in columns if (c, 0.5) not in found]
    if missing:
        raise ValueError(f"columns without any value can't be scaled: {missing}")
    spread = {c: found[c, 0.75] - found[c, 0.25] for c in columns}
    return {c: (found[c, 0.5], spread[c] or 1.0) for c in columns}


def standard_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero deviation becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, parameters: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(x - centre) / spread`` for each column of the fitted parameters."""
    return df.withColumns({c: (F.col(c) - F.lit(centre)) / F.lit(spread) for c, (centre, spread) in parameters.items()})


def group_variance(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sample variance of the group on each of its rows.

    The variance is aggregated map-side and joined back, so a hot group is never gathered in one task.
    """
    spread = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.var_samp(value).alias(name))
    return df.join(spread, F.col(key) == F.col("_key"), "left").drop("_key")


def behavior_sequences(
    df: DataFrame, key: str, time: str, tie: str, value: str, length: int = 32, name: str = "behavior_sequence"
) -> DataFrame:
    """The latest ``length`` values per key in time order, padded with zeros in front.

    Spark limits the rank before the shuffle (window group limit), so a task never sees a whole hot key.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    kept = df.select(key, time, tie, F.col(value).cast("double").alias(value))
    kept = kept.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= length)
    ordered = F.sort_array(F.collect_list(F.struct(time, tie, value)))
    rows = kept.groupBy(key).agg(F.transform(ordered, lambda r: r[value]).alias("_values"))
    padding = F.array_repeat(F.lit(0.0), length - F.size("_values"))
    return rows.select(key, F.concat(padding, F.col("_values")).alias(name))


def process_features(processes: DataFrame) -> DataFrame:
    """Entropy of the content, call rate, entropy variance per process, encryption flag, note words.

    Rows that come with an ``entropy`` keep it: contents that many rows share are measured once, before they are joined. The
    row features are written once without the content: the variance needs them twice, and the content should be read only once.
    """
    measured = F.col("entropy") if "entropy" in processes.columns else byte_entropy(F.col("file_content"))
    rated = processes.withColumns(
        {
            "entropy": measured,
            "api_calls_per_sec": numeric.per_second(F.col("api_call_count"), F.col("process_duration")),
            "ransom_note_keywords": note_keyword_count(F.col("created_files")),
        }
    )
    rated = rated.withColumn("encryption_pattern", looks_encrypted(F.col("entropy"), F.col("created_files")))
    rated = materialize(rated.drop("file_content"), "process-features")
    return group_variance(rated, "process_id", "entropy", "file_entropy_variance")


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, rows, mean, deviation)`` per column in one pass."""
    return long_form(df, columns).groupBy("feature").agg(
        F.count("value").alias("rows"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")
    )


def stability_index(baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature over the baseline's quantile bins; empty shares count as 1e-4."""
    shares = [i / bins for i in range(1, bins)]
    edges = quantiles(baseline, columns, shares).groupBy("feature").agg(
        F.array_sort(F.collect_list("quantile")).alias("_edges")
    )

    def binned(df: DataFrame, name: str) -> DataFrame:
        # The edges are `bins - 1` numbers per named column.
        placed = long_form(df, columns).filter(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")
        counts = placed.groupBy("feature", bin_index(F.col("value"), F.col("_edges"), bins).alias("bin"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"))
        rows = Window.partitionBy("feature")
        return counts.select("feature", "bin", (F.col("n") / F.sum("n").over(rows)).alias(name))

    both = binned(baseline, "expected").join(binned(current, "actual"), ["feature", "bin"], "full")
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-4))
    gap = (floor("actual") - floor("expected")) * F.ln(floor("actual") / floor("expected"))
    return both.groupBy("feature").agg(F.sum(gap).alias("stability_index"))


