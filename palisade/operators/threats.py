"""Feed processing: enrich indicators, score them, keep the serious ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import enrichment, rules as rule_ops
from palisade.operators.scoring import score_threats

# Indicator types.
TYPES = ("ip", "domain", "url", "hash", "email", "file")


def enrich_iocs(iocs: DataFrame, indicators: DataFrame, reports: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, type, value)`` rows with known threat and confidence, vote count and worst rule severity.

    The steps are snapshot look-ups and rule names in the row; the feed is read once. Rules look only at values of their own type.
    """
    best = enrichment.best_indicators(indicators)
    known = {"known_threat": F.col("threat_type"), "known_confidence": F.col("confidence")}
    found = enrichment.lookup(iocs, "value", best, "value", known)
    votes = reports.groupBy("url_hash").agg(F.max(F.struct("scan_date", "positives")).alias("r"))
    hashed = found.withColumn("_hash", F.sha2("value", 256))
    found = enrichment.lookup(hashed, "_hash", votes, "url_hash", {"positives": F.col("r.positives")}).drop("_hash")
    subjects = {t: F.when(F.col("type") == t, F.col("value")) for t in ("domain", "file", "hash")}
    named = rule_ops.with_rule_names(found, subjects, rules)
    levels = rule_ops.levels_by_name(rules)
    worst = F.array_max(F.transform("rules", lambda n: F.try_element_at(levels, n))) if levels is not None else F.lit(0)
    return named.withColumns({"positives": F.coalesce("positives", F.lit(0)), "rule_level": F.coalesce(worst, F.lit(0))})


def score_feed(enriched: DataFrame) -> DataFrame:
    return score_threats(enriched, "known_confidence", "rule_level", "positives")


def serious(scored: DataFrame, minimum: int = 4) -> DataFrame:
    """Threats of level high and above, the ones a response is planned for."""
    return scored.filter(F.col("threat_level") >= minimum)
