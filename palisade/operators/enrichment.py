"""Look-ups against intelligence snapshots.

Every look-up is an equi-join to a snapshot reduced to one row per key first, so a join never multiplies
rows. No broadcast is forced: Spark broadcasts a snapshot below its size threshold (static estimate or the
size AQE measured) and otherwise shuffles, where AQE splits the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import urls
from palisade.functions.numeric import ipv4_number
from palisade.functions.text import age_in_days

# Words and limits of the checks.
HOSTING_WORDS = r"hosting|bulletproof|cloud"
DATACENTRES = r"Amazon|Google|Microsoft"
PARKED_WORDS = r"domain for sale|parked|godaddy"
YOUNG_DOMAIN_DAYS = 30
VOTE_LIMIT = 3
ENGINES = 92
BLOCKLIST_ZONE = "dbl.spamhaus.org"
# Country codes and issuers are the caller's choice; these are only defaults.
RISKY_COUNTRIES = ("IR", "KP", "RU", "SY")
TRUSTED_ISSUERS = ("DigiCert Inc", "Google Trust Services", "Let's Encrypt", "Sectigo Limited")
_PREFIX_BITS = 16


def lookup(
    df: DataFrame, key: str, snapshot: DataFrame, snapshot_key: str, columns: Mapping[str, Column], fold: bool = False
) -> DataFrame:
    """``df`` plus derived snapshot columns; misses give NULL, and no row of ``df`` is multiplied or lost.

    Of several snapshot rows with one key the smallest counts, by the derived columns from left to right. ``fold`` compares
    keys without regard to case. Rows without a key meet nothing: their keys are replaced by a number of their own, so
    that they don't all travel to one partition.
    """
    folded = (lambda c: F.lower(c)) if fold else (lambda c: c)
    derived = snapshot.select(folded(F.col(snapshot_key).cast("string")).alias("_key"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_found"))
    one = derived.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_found").alias("_found"))
    asked = folded(F.col(key).cast("string"))
    spread = F.concat(F.lit("\x00"), F.pmod(F.hash(*_numbers(df)), F.lit(1024)).cast("string"))
    met = df.withColumn("_asked", F.coalesce(asked, spread)).join(one, F.col("_asked") == F.col("_key"), "left")
    return met.withColumns({n: F.col("_found")[n] for n in columns}).drop("_asked", "_key", "_found")


def _numbers(df: DataFrame) -> list[Column]:
    """The first few narrow columns: enough to tell rows apart without keeping wide ones in the plan."""
    return [F.col(f"`{name}`") for name, kind in df.dtypes if kind in ("int", "bigint", "double", "timestamp", "timestamp_ntz")][:3] or [F.lit(0)]


def best_indicators(indicators: DataFrame) -> DataFrame:
    """One row per value: its most confident entry, ties by threat type."""
    rank = F.struct(F.col("confidence"), F.col("threat_type"))
    best = indicators.filter(F.col("value").isNotNull()).groupBy("value").agg(F.max(rank).alias("best"))
    return best.select("value", "best.threat_type", "best.confidence")


def enrich_traffic(traffic: DataFrame, indicators: DataFrame) -> DataFrame:
    """``threat_type`` and ``confidence`` of the source address, else of the destination, else NULL."""
    best = best_indicators(indicators)
    bare = traffic.drop("threat_type", "confidence")
    for side in ("src", "dst"):
        hit = F.struct("threat_type", "confidence")
        bare = lookup(bare, f"{side}_ip", best, "value", {f"{side}_hit": hit})
    hit = F.coalesce("src_hit", "dst_hit")
    return bare.withColumns({"threat_type": hit["threat_type"], "confidence": hit["confidence"]}).drop("src_hit", "dst_hit")


def malicious_sources(packets: DataFrame, addresses: DataFrame) -> DataFrame:
    """Packets per known-malicious source address."""
    counted = packets.groupBy("src_ip").agg(F.count(F.lit(1)).alias("hits"))
    return counted.join(addresses.select(F.col("ip").alias("src_ip")).distinct(), "src_ip", "left_semi")


def file_verdicts(files: DataFrame, digest: str, verdicts: DataFrame) -> DataFrame:
    """Threat type and confidence of each known digest."""
    rank = F.struct("confidence", "threat_type")
    best = verdicts.groupBy(F.lower("hash").alias("hash")).agg(F.max(rank).alias("v"))
    return lookup(files, digest, best, "hash", {"threat_type": F.col("v.threat_type"), "confidence": F.col("v.confidence")}, fold=True)


def reputation_votes(df: DataFrame, url: str, reports: DataFrame) -> DataFrame:
    """Malicious when more than three engines say so; the score reads ``n/92``."""
    latest = reports.groupBy("url_hash").agg(F.max(F.struct("scan_date", "positives")).alias("r"))
    hashed = df.withColumn("url_hash", F.sha2(F.col(url), 256))
    found = lookup(hashed, "url_hash", latest, "url_hash", {"positives": F.col("r.positives"), "scan_date": F.col("r.scan_date")})
    positives = F.coalesce(F.col("positives"), F.lit(0))
    return found.withColumns(
        {
            "malicious": positives > VOTE_LIMIT,
            "score": F.concat(positives.cast("string"), F.lit(f"/{ENGINES}")),
        }
    ).drop("positives", "url_hash")


def safe_browsing(df: DataFrame, url: str, entries: DataFrame) -> DataFrame:
    """Any listed entry that is malicious, and the sorted distinct threats of all entries."""
    per_url = entries.groupBy("url").agg(
        F.bool_or("malicious").alias("malicious"), F.array_sort(F.collect_set("threat")).alias("threats")
    )
    found = lookup(df, url, per_url, "url", {"listed_malicious": F.col("malicious"), "threats": F.col("threats")})
    return found.withColumns(
        {
            "listed_malicious": F.coalesce("listed_malicious", F.lit(False)),
            "threats": F.coalesce("threats", F.array().cast("array<string>")),
        }
    )


def registration_age(df: DataFrame, domain: str, registrations: DataFrame, reference: Column) -> DataFrame:
    """Age in days by the first creation date; unknown is -1. Younger than 30 days or unknown is suspicious."""
    created = F.get("created", F.lit(0))
    facts = {"age_days": age_in_days(created, reference), "registrar": F.col("registrar")}
    found = lookup(df, domain, registrations, "domain", facts)
    age = F.coalesce(F.col("age_days"), F.lit(-1))
    return found.withColumns({"age_days": age, "young_domain": age < YOUNG_DOMAIN_DAYS})


def dns_facts(df: DataFrame, domain: str, records: DataFrame, blocklist: DataFrame) -> DataFrame:
    """DNSSEC key present, mail exchangers, authenticated answer, block-list membership."""
    facts = {
        "dnssec": F.col("dnskeys") > 0,
        "mx": F.array_sort("mx"),
        "authenticated": F.col("authenticated"),
    }
    found = lookup(df, domain, records, "domain", facts)
    asked = found.withColumn("dbl_query", urls.reverse_labels(F.col(domain), BLOCKLIST_ZONE))
    listed = blocklist.select("name").distinct()
    asked = lookup(asked, "dbl_query", listed, "name", {"dbl_listed": F.lit(True)})
    return asked.withColumns(
        {
            "dnssec": F.coalesce("dnssec", F.lit(False)),
            "mx": F.coalesce("mx", F.array().cast("array<string>")),
            "authenticated": F.coalesce("authenticated", F.lit(False)),
            "dbl_listed": F.coalesce("dbl_listed", F.lit(False)),
        }
    )


def domain_facts(registrations: DataFrame, records: DataFrame, reference: Column) -> DataFrame:
    """``(domain, days_since_registration, dnssec_enabled)``: both snapshots reduced to one row per domain and put together."""
    ages = registrations.groupBy("domain").agg(F.min(age_in_days(F.get("created", F.lit(0)), reference)).alias("days_since_registration"))
    keys = records.groupBy("domain").agg(F.min((F.col("dnskeys") > 0).cast("int")).alias("dnssec_enabled"))
    return ages.join(keys, "domain", "full")


def with_domain_facts(df: DataFrame, domain: str, facts: DataFrame) -> DataFrame:
    """``df`` with ``days_since_registration`` (-1 where unknown) and ``dnssec_enabled`` (0 where unknown), by one look-up."""
    names = {"days_since_registration": -1, "dnssec_enabled": 0}
    found = lookup(df, domain, facts, "domain", {n: F.col(n) for n in names})
    return found.withColumns({n: F.coalesce(n, F.lit(unknown)) for n, unknown in names.items()})


def url_record(df: DataFrame, facts: DataFrame, url: str = "url") -> DataFrame:
    """The whole feature record of each URL: the features of its text and the facts of its registered domain."""
    return with_domain_facts(urls.url_features(df, url), "registered_domain", facts)


def asn_reputation(df: DataFrame, ip: str, asns: DataFrame) -> DataFrame:
    """Network number, description, hosting risk and data-centre flag of an address."""
    facts = {
        "asn": F.col("asn"),
        "asn_description": F.col("description"),
        "asn_high_risk": F.lower("description").rlike(HOSTING_WORDS),
        "datacentre": F.col("description").rlike(DATACENTRES),
    }
    return lookup(df, ip, asns, "ip", facts)


def _by_prefix(ranges: DataFrame) -> DataFrame:
    """Each ``[first, last]`` range once per address prefix it touches (at most 65536)."""
    step = F.lit(1 << _PREFIX_BITS)
    return ranges.withColumn("_prefix", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor(F.col("last") / step))))


def country_risk(
    df: DataFrame,
    ip: str,
    ranges: DataFrame,
    exits: DataFrame,
    risky: Sequence[str] = RISKY_COUNTRIES,
) -> DataFrame:
    """Country of an address by the narrowest range holding it, risk flag, VPN-exit flag.

    ``locatable`` is false for addresses that the ranges can't hold, such as IPv6: their country is unknown, not safe.

    Only distinct addresses meet the ranges, through an equi-join on the address prefix, so neither a hot
    address nor the interval condition reaches the large table.
    """
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_number", ipv4_number(F.col("_ip")))
    addresses = addresses.withColumn("_prefix", F.floor(F.col("_number") / F.lit(1 << _PREFIX_BITS)))
    inside = addresses.join(_by_prefix(ranges), "_prefix").filter(F.col("_number").between(F.col("first"), F.col("last")))
    width = F.struct(F.col("last") - F.col("first"), F.col("country"))
    located = inside.groupBy("_ip").agg(F.min_by("country", width).alias("country"))
    found = lookup(df, ip, located, "_ip", {"country": F.col("country")})
    found = lookup(found, ip, exits.select("ip").distinct(), "ip", {"vpn_exit": F.lit(True)})
    return found.withColumns(
        {
            "country_high_risk": F.coalesce(F.col("country").isin(*risky), F.lit(False)),
            "vpn_exit": F.coalesce("vpn_exit", F.lit(False)),
            "locatable": ipv4_number(F.col(ip)).isNotNull(),
        }
    )


def certificate_facts(df: DataFrame, host: str, certificates: DataFrame, reference: Column) -> DataFrame:
    """Validity, self-signing, key size, and whether the names of the certificate cover the host."""
    facts = {
        "cert_valid": F.col("not_after") > reference,
        "self_signed": F.col("issuer") == F.col("subject"),
        "key_size": F.coalesce("key_size", F.lit(0)),
        "san": F.col("san"),
    }
    found = lookup(df, host, certificates, "host", facts)
    parent = F.regexp_replace(host, r"^[^.]*", "*")
    covered = F.exists("san", lambda n: (F.lower(n) == F.col(host)) | (F.lower(n) == parent))
    return found.withColumn("subject_mismatch", ~covered)


def transparency_log(entries: DataFrame, trusted: Sequence[str] = TRUSTED_ISSUERS) -> DataFrame:
    """Log entries with a flag for issuers outside the trusted list."""
    return entries.withColumn("unusual_issuer", ~F.col("issuer").isin(*trusted))


def unusual_issuers(df: DataFrame, domain: str, entries: DataFrame, trusted: Sequence[str] = TRUSTED_ISSUERS) -> DataFrame:
    """Certificates logged per domain and how many come from unusual issuers."""
    per_domain = (
        transparency_log(entries, trusted)
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("issued"), F.count_if("unusual_issuer").alias("unusual"))
    )
    found = lookup(df, domain, per_domain, "domain", {"issued": F.col("issued"), "unusual": F.col("unusual")})
    zero = F.lit(0).cast("long")
    return found.withColumns({"issued": F.coalesce("issued", zero), "unusual": F.coalesce("unusual", zero)})


def listed_phish(df: DataFrame, url: str, phish: DataFrame) -> DataFrame:
    """Membership in a verified phishing list."""
    found = lookup(df, url, phish.select("url").distinct(), "url", {"in_database": F.lit(True)})
    return found.withColumn("in_database", F.coalesce("in_database", F.lit(False)))


def abuse_reports(df: DataFrame, ip: str, reports: DataFrame) -> DataFrame:
    """Abuse confidence (0 when unknown), provider and usage of an address."""
    facts = {"abuse_confidence": F.col("abuse_confidence"), "isp": F.col("isp"), "usage_type": F.col("usage_type")}
    found = lookup(df, ip, reports, "ip", facts)
    return found.withColumn("abuse_confidence", F.coalesce("abuse_confidence", F.lit(0)))


def pulses(df: DataFrame, indicator: str, pulse_table: DataFrame) -> DataFrame:
    """Sorted distinct pulse names per indicator, empty when there are none."""
    per_indicator = pulse_table.groupBy("indicator").agg(F.array_sort(F.collect_set("pulse")).alias("pulses"))
    found = lookup(df, indicator, per_indicator, "indicator", {"pulses": F.col("pulses")})
    return found.withColumn("pulses", F.coalesce("pulses", F.array().cast("array<string>")))


def parked(html: Column) -> Column:
    """Does a crawled body read like a parked or for-sale domain?"""
    return F.coalesce(F.lower(html).rlike(PARKED_WORDS), F.lit(False))


def tls_fingerprints(connections: DataFrame, bad: DataFrame) -> DataFrame:
    """Connections whose version and cipher form a known-bad fingerprint."""
    marked = connections.withColumn("fingerprint", F.concat("version", "cipher"))
    return marked.join(bad.select("fingerprint").distinct(), "fingerprint", "left_semi")


def scan_results(df: DataFrame, url: str, results: DataFrame) -> DataFrame:
    """Latest result link of a URL scan, empty when it was never scanned."""
    latest = results.groupBy("url").agg(F.max_by("result", "scanned").alias("result"))
    found = lookup(df, url, latest, "url", {"result": F.col("result")})
    return found.withColumn("result", F.coalesce("result", F.lit("")))


def url_intelligence(checked: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The five checks of a URL folded into one ``intel`` struct; expects the columns the checks above add."""
    intel = F.struct(
        F.struct(F.col("listed_malicious").alias("malicious"), "threats").alias("safe_browsing"),
        F.struct(F.col("blacklisted").alias("listed")).alias("internal_blacklist"),
        F.struct("cert_valid", "self_signed", "key_size").alias("certificate"),
        F.struct("age_days", F.col("young_domain").alias("suspicious")).alias("domain_registration"),
        F.struct("dnssec", "authenticated", "dbl_listed").alias("dns_security"),
    )
    return checked.select(*keep, intel.alias("intel"))


def intelligence_hit(intel: Column) -> Column:
    """True when a list calls the URL bad outright."""
    return (
        intel["safe_browsing"]["malicious"] | intel["internal_blacklist"]["listed"] | intel["dns_security"]["dbl_listed"]
    )
