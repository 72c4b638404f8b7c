"""Record validation, input checks and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.urls import is_dotted_quad

# Protocol numbers and severity levels.
PROTOCOLS = {"ICMP": 1, "TCP": 6, "UDP": 17}
LEVELS = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def protocol_number(protocol: Column) -> Column:
    """IANA number from a number or a name; NULL for anything else."""
    column = protocol.try_cast("int")
    for name, number in PROTOCOLS.items():
        column = F.when(F.upper(protocol) == name, F.lit(number)).otherwise(column)
    return column


def protocol_name(number: Column) -> Column:
    column = number.cast("string")
    for name, value in PROTOCOLS.items():
        column = F.when(number == value, F.lit(name)).otherwise(column)
    return column


def level_number(name: Column) -> Column:
    """Ordinal of a severity name, 1 to 5."""
    column = F.lit(None).cast("int")
    for level, number in LEVELS.items():
        column = F.when(F.lower(name) == level, F.lit(number)).otherwise(column)
    return column


def level_name(number: Column) -> Column:
    column = F.lit(None).cast("string")
    for level, value in LEVELS.items():
        column = F.when(number == value, F.lit(level)).otherwise(column)
    return column


def validate_records(raw: DataFrame) -> DataFrame:
    """Typed record columns and ``reasons``, the fields that failed; an empty array means valid.

    Other columns pass through. Nothing is dropped here: filter on ``reasons`` to split.
    """
    have = set(raw.columns)
    text = lambda name: F.col(name).cast("string")
    typed = {
        "timestamp": F.try_to_timestamp(text("timestamp")),
        "src_ip": text("src_ip"),
        "dst_ip": text("dst_ip"),
        "protocol": protocol_number(text("protocol")),
        "length": text("length").try_cast("int"),
    }
    optional = {
        "threat_type": text("threat_type") if "threat_type" in have else F.lit(None).cast("string"),
        "confidence": text("confidence").try_cast("double") if "confidence" in have else F.lit(None).cast("double"),
    }
    failed = [F.when(column.isNull(), F.lit(name)) for name, column in typed.items()]
    if "confidence" in have:
        failed.append(F.when(F.col("confidence").isNotNull() & optional["confidence"].isNull(), F.lit("confidence")))
    if "_corrupt" in have:
        failed.append(F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")))
    rest = [c for c in raw.columns if c not in typed and c not in optional and c != "_corrupt"]
    return raw.select(
        *rest,
        *[c.alias(n) for n, c in {**typed, **optional}.items()],
        F.array_compact(F.array(*failed)).alias("reasons"),
    )


def valid_records(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected_records(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def ipv4_shaped(ip: Column) -> Column:
    return F.coalesce(is_dotted_quad(ip), F.lit(False))


def input_problem(url: Column, text: Column, longest_url: int | None = None, longest_text: int | None = None) -> Column:
    """Why a URL/text pair is refused, NULL when it is fine. Lengths are only limited where the caller says so."""
    never = F.lit(False)
    return (
        F.when(url.isNull(), "url missing")
        .when(never if longest_url is None else F.length(url) > longest_url, "url too long")
        .when(url.rlike(r"[\x00\n\r]"), "url characters")
        .when(text.isNull(), "text missing")
        .when(never if longest_text is None else F.length(text) > longest_text, "text too long")
    )


def training_violations(df: DataFrame) -> DataFrame:
    """One row counting each rule a labelled table breaks; all zero means the schema holds."""
    broken = lambda condition: F.count_if(condition)
    url = F.col("url")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        broken(url.isNull()).alias("url_missing"),
        broken(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")).alias("url_not_uri"),
        broken(F.col("text").isNull()).alias("text_missing"),
        broken(F.col("label").isNull()).alias("label_missing"),
        broken(~F.col("label").isin(0, 1)).alias("label_out_of_range"),
    )


def batch_projection(scored: DataFrame, url: str, prediction: str, score: str) -> DataFrame:
    """What leaves a batch of any size: the URL's digest in place of the URL, the prediction and the risk score."""
    return scored.select(F.sha2(F.col(url), 256).alias("url_hash"), F.col(prediction).alias("prediction"), F.col(score).alias("risk_score"))


def term_search(df: DataFrame, field: str, value: str, order: str | None = None, size: int | None = None) -> DataFrame:
    """Rows whose keyword field equals the term; with ``size`` the first so many hits by ``order``."""
    hits = df.filter(F.col(field) == value)
    return hits if size is None else hits.orderBy(order).limit(size)


def recent(df: DataFrame, time: str, hours: int = 24, reference: Column | None = None) -> DataFrame:
    """Rows of the last hours before ``reference``, by default the newest row."""
    end = df.agg(F.max(time)).scalar() if reference is None else reference
    return df.filter(F.col(time) >= end - F.expr(f"INTERVAL '{hours}' HOUR"))


def at_least(df: DataFrame, level: str, minimum: str = "high") -> DataFrame:
    """Rows whose severity is the minimum or worse."""
    return df.filter(level_number(F.col(level)) >= LEVELS[minimum])


def above(df: DataFrame, score: str, threshold: float = 0.85) -> DataFrame:
    return df.filter(F.col(score) > threshold)
