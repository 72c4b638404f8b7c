"""Black list and indicator-rule matching.

Regular expressions have no join key, so they are never joined: the active rules, a control table, become literals of one
projection and each pattern is compiled once per task. Patterns stand in blocks, and a block is only tried where one
expression made of all its patterns matches. The input is scanned once for any number of rules of any type; a row's hits are
an array of that row, so nothing is shuffled to remove repeats and nothing is joined back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.enrichment import lookup
from palisade.operators.validation import level_name, level_number

BLOCK = 50
# A group reference counts groups from the start of the expression, so such a pattern can't stand inside another one.
_REFERENCE = re.compile(r"\\[1-9]|\\k<|\(\?<[A-Za-z]")


def pattern_names(subject: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Sorted distinct names of the ``(name, pattern)`` pairs found in the subject; empty for NULL."""
    empty = F.array().cast("array<string>")
    pairs = sorted(set(patterns))
    found = []
    for start in range(0, len(pairs), BLOCK):
        block = pairs[start : start + BLOCK]
        names = F.array_compact(F.array(*[F.when(subject.rlike(p), F.lit(n)) for n, p in block]))
        if len(block) > 1 and not any(_REFERENCE.search(p) for _, p in block):
            names = F.when(subject.rlike("|".join(f"(?:{p})" for _, p in block)), names).otherwise(empty)
        found.append(names)
    return F.array_sort(F.array_distinct(F.concat(*found))) if found else empty


def _pairs(patterns: DataFrame) -> list[tuple[str, str]]:
    """Pairs of a control table."""
    return [(r["name"], r["pattern"]) for r in patterns.select("name", "pattern").distinct().collect()]


def regex_matches(df: DataFrame, subject: Column, patterns: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``name`` for each name of ``patterns(name, pattern)`` found in the subject, once a row."""
    return df.select(*keep, F.explode(pattern_names(subject, _pairs(patterns))).alias("name"))


def with_blacklist_entries(samples: DataFrame, blacklist: DataFrame, url: str, parts: Column, names: Column) -> DataFrame:
    """``samples`` with ``entries``, the ``(kind, value)`` of each black-list entry the row's URL meets.

    Domains match the host or its registered domain, addresses the host, patterns the whole URL. Names are two look-ups
    against the list reduced to one row per value; a row is never joined to itself.
    """
    listed = blacklist.filter(F.col("kind").isin("domain", "ip")).groupBy(F.lower("value").alias("value"))
    listed = listed.agg(F.bool_or(F.col("kind") == "domain").alias("domain"), F.bool_or(F.col("kind") == "ip").alias("ip"))
    patterns = [(v, v) for (v,) in blacklist.filter("kind = 'pattern'").select("value").distinct().collect()]
    keyed = samples.withColumns({"_host": parts["host"], "_registered": names["registered_domain"]})
    found = lookup(keyed, "_host", listed, "value", {"_on_host": F.struct("domain", "ip")})
    found = lookup(found, "_registered", listed, "value", {"_on_registered": F.struct("domain")})
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    by_name = F.array(
        F.when(F.col("_on_host")["domain"], entry("domain", F.col("_host"))),
        F.when(F.col("_on_registered")["domain"], entry("domain", F.col("_registered"))),
        F.when(F.col("_on_host")["ip"], entry("ip", F.col("_host"))),
    )
    by_pattern = F.transform(pattern_names(F.col(url), patterns), lambda p: entry("pattern", p))
    return found.withColumn("entries", F.array_distinct(F.concat(F.array_compact(by_name), by_pattern))).drop(
        "_host", "_registered", "_on_host", "_on_registered"
    )


def blacklist_matches(listed: DataFrame, key: str) -> DataFrame:
    """``(key, kind, value)`` for each entry of rows with ``entries``."""
    return listed.select(key, F.explode("entries").alias("e")).select(key, "e.kind", "e.value")


def with_blacklist_flag(listed: DataFrame) -> DataFrame:
    """``blacklisted`` in place of ``entries``: is there one?"""
    return listed.withColumn("blacklisted", F.size("entries") > 0).drop("entries")


def clean_samples(listed: DataFrame) -> DataFrame:
    """Rows that meet no entry."""
    return listed.filter(F.size("entries") == 0).drop("entries")


def with_rule_names(df: DataFrame, subjects: Mapping[str, Column], rules: DataFrame, name: str = "rules") -> DataFrame:
    """``df`` with the sorted distinct names of the active rules that each row meets.

    ``subjects`` maps a rule type to the column its patterns look at. Rules of type ``hash`` are compared for equality by a
    look-up, case folded; all others are regular expressions.
    """
    active = rules.filter("active")
    table = active.select("type", "name", "pattern").distinct()
    known = [(r["type"], r["name"], r["pattern"]) for r in table.filter("type <> 'hash'").collect()]
    parts = [pattern_names(s, [(n, p) for t, n, p in known if t == kind]) for kind, s in subjects.items() if kind != "hash"]
    found = df
    if "hash" in subjects:
        digests = table.filter("type = 'hash'").groupBy(F.lower("pattern").alias("_digest")).agg(F.array_sort(F.collect_set("name")).alias("names"))
        found = found.withColumn("_subject", F.lower(subjects["hash"]))
        found = lookup(found, "_subject", digests, "_digest", {"_by_digest": F.col("names")})
        parts.append(F.coalesce("_by_digest", F.array().cast("array<string>")))
    return found.withColumn(name, F.array_sort(F.array_distinct(F.concat(*parts)))).drop("_subject", "_by_digest")


def rule_hits(df: DataFrame, key: str, subjects: Mapping[str, Column], rules: DataFrame) -> DataFrame:
    """``(key, name)`` for each active rule met."""
    return with_rule_names(df, subjects, rules, "_names").select(key, F.explode("_names").alias("name"))


def levels_by_name(rules: DataFrame) -> Column | None:
    """Literal map of rule names to their severity, the worst of rules that share a name; None without rules."""
    level = F.max(level_number(F.col("severity"))).alias("level")
    pairs = [F.lit(v) for r in rules.groupBy("name").agg(level).filter("level IS NOT NULL").orderBy("name").collect() for v in (r["name"], r["level"])]
    return F.create_map(*pairs) if pairs else None


def rule_verdicts(hits: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Per key the rule names, worst severity and the mitigations, both lists sorted.

    One row per key and rule arrives, so the sets are bounded by the number of rules.
    """
    detail = rules.filter("active").select("name", level_number(F.col("severity")).alias("level"), "mitigation")
    return (
        hits.join(detail, "name")
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_set("name")).alias("indicators"),
            F.max("level").alias("level"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitigation")))).alias("mitigations"),
        )
        .withColumn("threat_level", level_name(F.col("level")))
    )


def capture_summary(hits: DataFrame, key: str) -> DataFrame:
    """Detected threats and the sorted distinct pattern names of a capture or sample set."""
    return hits.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("detected_threats"),
        F.array_sort(F.collect_set("name")).alias("malicious_patterns"),
    )


def analysis_verdicts(verdicts: DataFrame, playbooks: DataFrame, key: str, trigger_of_level: Mapping[str, str]) -> DataFrame:
    """Threat level, indicators and the actions of the playbooks that the level triggers."""
    trigger = F.lit(None).cast("string")
    for level, name in trigger_of_level.items():
        trigger = F.when(F.col("threat_level") == level, F.lit(name)).otherwise(trigger)
    actions = (
        playbooks.select(F.explode("triggers").alias("_trigger"), F.explode("actions.name").alias("action"))
        .groupBy("_trigger")
        .agg(F.array_sort(F.collect_set("action")).alias("recommended_actions"))
    )
    return (
        verdicts.withColumn("_trigger", trigger)
        .join(actions, "_trigger", "left")
        .select(
            key,
            "threat_level",
            "indicators",
            F.coalesce("recommended_actions", F.array().cast("array<string>")).alias("recommended_actions"),
        )
    )
