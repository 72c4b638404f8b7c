"""Indicators, black lists, rules, playbooks, labelled data sets and feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDICATORS = (
    "indicators array<struct<type string, value string, threat_type string, confidence double, "
    "first_seen date, last_seen date, sources array<string>>>"
)
BLACKLIST = "domains array<string>, ips array<string>, patterns array<string>"
RULES = (
    "version string, rules array<struct<name string, type string, pattern string, severity string, "
    "description string, mitigation array<string>, active boolean>>"
)
PLAYBOOK = (
    "name string, version string, description string, triggers array<string>, "
    "actions array<struct<name string, type string, parameters map<string,string>, priority string>>"
)
URL_SAMPLES = "url string, text string, label int"
PROCESS_SAMPLES = (
    "process_id long, file_content string, api_call_count long, process_duration double, "
    "created_files string, behavior_sequence string, is_ransomware int"
)
# Addresses known to be malicious, and the feed names.
KNOWN_MALICIOUS_IPS = ("94.130.14.15", "192.42.116.41")
FEEDS = ("virustotal", "mitre_attack", "alienvault_otx", "misp", "crowdstrike")
FEED_COLUMNS = "type string, value string, threat_type string, confidence double"


def read_indicators(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per indicator of nested files: one document per file, or with ``lines`` one per line."""
    documents = spark.read.schema(INDICATORS).json(path, multiLine=not lines)
    return documents.select(F.explode("indicators").alias("i")).select("i.*")


def explode_blacklist(document: DataFrame) -> DataFrame:
    """``(kind, value)`` rows from the three arrays."""
    kinds = {"domain": "domains", "ip": "ips", "pattern": "patterns"}
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in kinds]), F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in kinds.values()])
    )
    return document.select(F.explode(entries).alias("kind", "values")).select("kind", F.explode("values").alias("value"))


def read_blacklist(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Black list entries. Only a path that isn't there gives an empty list: any other fault must not switch the list off."""
    try:
        document = spark.read.schema(BLACKLIST).json(path, multiLine=not lines)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        document = spark.createDataFrame([], BLACKLIST)
    return explode_blacklist(document)


def read_rules(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Active rules of rule files."""
    document = spark.read.schema(RULES).json(path, multiLine=not lines)
    return document.select(F.explode("rules").alias("r")).select("r.*").filter("active")


def read_playbooks(spark: SparkSession, directory: str, lines: bool = False) -> DataFrame:
    """All playbooks of a directory; a list parameter stays JSON text until it is resolved."""
    return spark.read.schema(PLAYBOOK).json(directory, multiLine=not lines)


def union_feeds(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """All feeds in one table with the feed's name; columns one of them lacks become NULL."""
    union = None
    for name, feed in feeds.items():
        named = feed.withColumn("feed", F.lit(name))
        union = named if union is None else union.unionByName(named, allowMissingColumns=True)
    if union is None:
        raise ValueError("no feed given")
    return union


def known_malicious(spark: SparkSession, addresses: tuple[str, ...] = KNOWN_MALICIOUS_IPS) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in addresses])).alias("ip"))


def read_url_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled URL and mail samples; quoted fields may span lines."""
    return spark.read.schema(URL_SAMPLES).csv(path, header=True, multiLine=True, escape='"')


def read_process_samples(spark: SparkSession, path: str) -> DataFrame:
    """Process behaviour; the list fields are JSON text in the file."""
    rows = spark.read.schema(PROCESS_SAMPLES).csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumns(
        {
            "created_files": F.from_json("created_files", "array<string>"),
            "behavior_sequence": F.from_json("behavior_sequence", "array<double>"),
        }
    )


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 of each file of a binary scan."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def check_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each manifest entry ``(path, expected)`` with the digest found; ``intact`` is false when it differs or is missing."""
    found = manifest.join(file_digests(files), "path", "left")
    return found.withColumn("intact", F.coalesce(F.col("sha256") == F.lower("expected"), F.lit(False)))
