"""Score arithmetic: ensemble, uncertainty, fusion, typosquatting, threat level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import numeric, urls
from palisade.operators.validation import level_name

# Our cut points and weights where only a name is given.
LEVEL_CUTS = ((0.9, 5), (0.7, 4), (0.4, 3), (0.2, 2))
SCORE_WEIGHTS = {"confidence": 0.6, "severity": 0.25, "votes": 0.15}
TYPO_WEIGHTS = {"bias": 1.5, "length": -0.03, "entropy": 0.4, "brand_distance": -0.6, "keyboard_distance": -0.3}


def ensemble_score(ml: Column, decision: Column) -> Column:
    """Model score weighted by one minus the anomaly decision value."""
    return ml * (1 - decision)


def uncertainty(members: Sequence[DataFrame], key: str, score: str) -> DataFrame:
    """Mean and population deviation of repeated predictions of the same row."""
    stacked = members[0].select(key, score)
    for member in members[1:]:
        stacked = stacked.unionByName(member.select(key, score))
    return stacked.groupBy(key).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("uncertainty"))


def fused_verdict(ml: Column, rule: Column, uncertain: Column, intel_hit: Column) -> Column:
    """Malicious on any intelligence hit, else when the blend clears a bar that rises with uncertainty."""
    blend = F.lit(0.6) * ml + F.lit(0.4) * rule
    return F.when(intel_hit, F.lit(True)).otherwise(blend > F.lit(0.5) + F.lit(0.1) * uncertain)


def typosquat_features(domain: Column, brands: Sequence[str]) -> dict[str, Column]:
    return {
        "length": F.length(domain),
        "entropy": urls.character_entropy(domain),
        "brand_distance": urls.nearest_brand(domain, brands)["distance"],
        "keyboard_distance": urls.keyboard_distance(domain, brands),
    }


def typosquat_likelihood(features: dict[str, Column]) -> Column:
    """Logistic score of the typosquat features with fixed weights; a brand's own name scores 0."""
    z = F.lit(TYPO_WEIGHTS["bias"])
    for name, column in features.items():
        z = z + F.lit(TYPO_WEIGHTS[name]) * column
    return F.when(features["brand_distance"] == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))


def threat_score(confidence: Column, level: Column, positives: Column, engines: int = 92) -> Column:
    """Weighted confidence, severity and votes within [0, 1]; NaN, NULL and overflow are tamed part by part."""
    parts = {
        "confidence": numeric.clipped(confidence),
        "severity": numeric.clipped(level / F.lit(5.0)),
        "votes": numeric.clipped(positives / F.lit(float(engines))),
    }
    total = sum((F.lit(SCORE_WEIGHTS[n]) * c for n, c in parts.items()), F.lit(0.0))
    return numeric.clipped(total)


def threat_level(score: Column) -> Column:
    """Ordinal level 1 to 5 of a score."""
    column = F.when(score >= LEVEL_CUTS[0][0], LEVEL_CUTS[0][1])
    for cut, level in LEVEL_CUTS[1:]:
        column = column.when(score >= cut, level)
    return column.otherwise(1)


def score_threats(df: DataFrame, confidence: str, level: str, positives: str) -> DataFrame:
    """Adds ``threat_score``, ``threat_level`` and its name."""
    scored = df.withColumn("threat_score", threat_score(F.col(confidence), F.col(level), F.col(positives)))
    scored = scored.withColumn("threat_level", threat_level(F.col("threat_score")))
    return scored.withColumn("threat_level_name", level_name(F.col("threat_level")))
