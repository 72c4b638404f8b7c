"""Counts, shares, series and model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palisade.operators.validation import level_number, protocol_name

# Ports that ransomware uses, and the refresh and series steps of the dashboard.
RANSOMWARE_PORTS = (3389, 445, 1433)
SERIES_STEP = "4 hours"


def packet_totals(packets: DataFrame) -> DataFrame:
    """All packets, IP packets, SYN-only packets and packets to ransomware ports, in one pass."""
    tcp = F.col("protocol") == 6
    return packets.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count("protocol").alias("ip_packets"),
        F.count_if(tcp & F.col("syn_only")).alias("syn_only_packets"),
        F.count_if(tcp & F.col("dport").isin(*RANSOMWARE_PORTS)).alias("ransomware_port_packets"),
    )


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Packets per protocol number, with its name."""
    counts = packets.filter(F.col("protocol").isNotNull()).groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))
    return counts.withColumn("protocol_name", protocol_name(F.col("protocol")))


def protocol_distribution(packets: DataFrame) -> DataFrame:
    """Share of each protocol in percent; the total is a scalar over the handful of counts."""
    counts = protocol_counts(packets)
    total = counts.agg(F.sum("packets")).scalar()
    return counts.withColumn("percent", F.col("packets") * F.lit(100.0) / total)


def scan_sources(packets: DataFrame) -> DataFrame:
    """SYN-only packets and distinct destination ports per source."""
    probes = packets.filter("syn_only")
    return probes.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("syn_packets"), F.count_distinct("dport").alias("distinct_ports")
    )


def threat_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("threats"))


def traffic_series(df: DataFrame, time: str, amount: str, step: str = SERIES_STEP) -> DataFrame:
    """Traffic per time bucket, labelled by the bucket's start."""
    sums = df.groupBy(F.window(time, step).alias("w")).agg(F.sum(amount).alias("traffic"))
    return sums.select(F.col("w.start").alias("time"), "traffic")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``rows / (classes * rows of the class)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return counts.withColumn("t", totals).select(
        label, "n", (F.col("t.rows") / (F.col("t.classes") * F.col("n"))).alias("weight")
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = confusion_matrix(df, label, predicted)
    per_class = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("guess")),
                F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("guess")),
            )
        ).alias("c"),
        F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"),
    )
    # Each hit is seen once from either side.
    sums = per_class.groupBy("c.class").agg(
        F.sum("c.truth").alias("support"), F.sum("c.guess").alias("guessed"), (F.sum("hit") / 2).alias("hits")
    )
    precision = F.try_divide(F.col("hits"), F.col("guessed").cast("double"))
    recall = F.try_divide(F.col("hits"), F.col("support").cast("double"))
    rated = sums.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select("class", "precision", "recall", F.coalesce(f1, F.lit(0.0)).alias("f1"), "support")


def mean_score(scored: DataFrame, score: str = "decision") -> DataFrame:
    """Average decision value; a falling mean is the sign of a poisoned data set."""
    return scored.agg(F.avg(score).alias("mean_score"))


def counted(df: DataFrame, reasons: Column) -> tuple[DataFrame, Observation]:
    """The same rows with counters of saved and skipped rows that fill in when the rows are written.

    Give the rows a session of their own (``newSession``) when the application also scores with ML models:
    Spark cannot serialize a model's closure once its session has observed something.
    """
    seen = Observation()
    watched = df.observe(
        seen, F.count_if(F.size(reasons) == 0).alias("saved"), F.count_if(F.size(reasons) > 0).alias("skipped")
    )
    return watched, seen


def newest(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The newest rows; each task keeps ``n``, so no full sort happens."""
    return df.orderBy(F.desc(time), tie).limit(n)


def by_severity(df: DataFrame, severity: str, time: str, tie: str) -> DataFrame:
    """Alert cards, worst first, newest first within a severity."""
    return df.orderBy(F.desc(level_number(F.col(severity))), F.desc(time), tie)
