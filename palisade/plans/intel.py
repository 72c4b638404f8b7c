"""Intelligence look-ups and rule matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import urls
from palisade.operators import enrichment as en
from palisade.operators import rules, threats
from palisade.plans import fixtures as fx
from palisade.plans.links import _BLACK, known, listed_samples
from palisade.plans.registry import query, registered_sql
from palisade.storage import materialize
from palisade.sources import intel as sources



def reference_time():
    """The moment ages are counted to, just after the newest event."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


_INDICATORS = fx.cte("indicators", fx.INDICATOR_COLUMNS, fx.INDICATORS)
_BEST = """best AS (SELECT value, max_by(threat_type, (confidence, threat_type)) AS threat_type, CAST(max(confidence) AS DOUBLE) AS confidence
  FROM indicators GROUP BY value)"""


def joined(column, separator="|"):
    return F.array_join(column, separator)


@query(
    "traffic_enrichment",
    f"""WITH {fx.TRAFFIC}, {_INDICATORS}, {_BEST} SELECT event_id, src_ip, dst_ip, coalesce(s.threat_type, d.threat_type) AS threat_type,
      coalesce(s.confidence, d.confidence, 0) AS confidence
    FROM traffic t LEFT JOIN best s ON s.value = src_ip LEFT JOIN best d ON d.value = dst_ip""",
)
def traffic_enrichment(spark, sf):
    enriched = en.enrich_traffic(fx.traffic(spark, sf), fx.indicators(spark))
    return enriched.select("event_id", "src_ip", "dst_ip", "threat_type", "confidence").fillna(0.0, ["confidence"])


BAD_IPS = ("10.0.0.7", "10.0.0.9", *sources.KNOWN_MALICIOUS_IPS)


@query(
    "malicious_source_hits",
    f"WITH {fx.TRAFFIC} SELECT src_ip, count(*) AS hits FROM traffic WHERE src_ip IN {BAD_IPS!r} GROUP BY src_ip",
)
def malicious_source_hits(spark, sf):
    return en.malicious_sources(fx.traffic(spark, sf), sources.known_malicious(spark, BAD_IPS))


_RULES = fx.cte("rules", fx.RULE_COLUMNS, fx.RULES)
_RULE_HITS = f"""{_RULES}, hits AS (
  SELECT DISTINCT sample_id, name FROM names JOIN rules ON active AND type = 'domain' AND regexp_matches(host, pattern)
  UNION SELECT DISTINCT sample_id, name FROM names JOIN rules ON active AND type = 'file' AND regexp_matches(path, pattern)),
verdicts AS (SELECT sample_id, string_agg(DISTINCT name, '|' ORDER BY name) AS indicators,
    max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS level
  FROM hits JOIN rules USING (name) GROUP BY sample_id),
mitigated AS (SELECT sample_id, string_agg(DISTINCT m, '|' ORDER BY m) AS mitigations
  FROM (SELECT sample_id, unnest(string_split(mitigations, '|')) AS m FROM hits JOIN rules USING (name)) GROUP BY sample_id)"""
_LEVEL_NAME = "CASE level WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END"


def _rule_hits(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf))
    subjects = {"domain": F.col("parts.host"), "file": F.col("parts.path")}
    return rules.rule_hits(parsed, "sample_id", subjects, fx.rules(spark))


@query(
    "ioc_rule_verdicts",
    f"WITH {fx.DECODED}, {_RULE_HITS} SELECT sample_id, indicators, level, mitigations, {_LEVEL_NAME} AS threat_level FROM verdicts JOIN mitigated USING (sample_id)",
)
def ioc_rule_verdicts(spark, sf):
    verdicts = rules.rule_verdicts(_rule_hits(spark, sf), fx.rules(spark), "sample_id")
    return verdicts.withColumns({"indicators": joined("indicators"), "mitigations": joined("mitigations")})


@query(
    "capture_summary",
    f"WITH {fx.DECODED}, {_RULE_HITS} SELECT count(*) AS detected_threats, string_agg(DISTINCT name, '|' ORDER BY name) AS malicious_patterns FROM hits",
)
def capture_summary(spark, sf):
    summary = rules.capture_summary(_rule_hits(spark, sf), "sample_id")
    return summary.withColumn("malicious_patterns", joined("malicious_patterns"))


_TRIGGERS = {"critical": "mass_file_encryption", "high": "ransomware_detected"}
_PLAYBOOK_ACTIONS = f"""{fx.cte('books', fx.PLAYBOOK_COLUMNS, fx.PLAYBOOKS)}, {fx.cte('steps', fx.ACTION_COLUMNS, fx.ACTIONS)},
offered AS (SELECT trigger, string_agg(DISTINCT action, '|' ORDER BY action) AS actions
  FROM (SELECT playbook, unnest(string_split(triggers, '|')) AS trigger FROM books) JOIN steps USING (playbook) GROUP BY trigger)"""


@query(
    "traffic_analysis_verdicts",
    f"""WITH {fx.DECODED}, {_RULE_HITS}, {_PLAYBOOK_ACTIONS} SELECT sample_id, {_LEVEL_NAME} AS threat_level, indicators, coalesce(actions, '') AS recommended_actions
    FROM verdicts LEFT JOIN offered ON trigger = CASE level WHEN 5 THEN 'mass_file_encryption' WHEN 4 THEN 'ransomware_detected' END""",
)
def traffic_analysis_verdicts(spark, sf):
    verdicts = rules.rule_verdicts(_rule_hits(spark, sf), fx.rules(spark), "sample_id")
    analysed = rules.analysis_verdicts(verdicts, fx.playbooks(spark), "sample_id", _TRIGGERS)
    return analysed.withColumns({"indicators": joined("indicators"), "recommended_actions": joined("recommended_actions")})


# --- snapshots that grow with the tables ---------------------------------------------------------------


@query(
    "file_hash_verdicts",
    """WITH verdicts AS (SELECT sha256(text) AS hash, CASE doc_id % 3 WHEN 0 THEN 'ransomware' ELSE 'trojan' END AS threat_type, (doc_id % 100) / 100.0 AS confidence
      FROM documents WHERE lang <> 'en'),
    best AS (SELECT hash, max_by(threat_type, (confidence, threat_type)) AS threat_type, max(confidence) AS confidence FROM verdicts GROUP BY hash)
    SELECT doc_id, sha256(text) AS digest, threat_type, round(CAST(coalesce(confidence, -1) AS DOUBLE), 6) AS confidence
    FROM documents LEFT JOIN best ON hash = sha256(text)""",
)
def file_hash_verdicts(spark, sf):
    documents = fx.table(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    verdicts = documents.filter("lang <> 'en'").select(
        F.col("digest").alias("hash"),
        F.when(F.col("doc_id") % 3 == 0, "ransomware").otherwise("trojan").alias("threat_type"),
        ((F.col("doc_id") % 100) / 100.0).alias("confidence"),
    )
    shown = F.when(F.col("doc_id") % 2 == 0, F.upper("digest")).otherwise(F.col("digest"))  # half of the digests come in capitals
    found = en.file_verdicts(documents.select("doc_id", shown.alias("digest")), "digest", verdicts)
    return found.withColumn("digest", F.lower("digest")).fillna(-1.0, ["confidence"])


_REPORTS = """reports AS (SELECT sha256(url) AS url_hash, CAST(page_id % 9 AS INTEGER) AS positives, '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS scan_date
  FROM pages WHERE url LIKE 'https%'),
latest AS (SELECT url_hash, max(scan_date) AS scan_date, max_by(positives, (scan_date, positives)) AS positives FROM reports GROUP BY url_hash)"""


def url_reports(spark, sf):
    pages = fx.table(spark, sf, "pages").filter("url LIKE 'https%'")
    day = F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    return pages.select(
        F.sha2("url", 256).alias("url_hash"), (F.col("page_id") % 9).cast("int").alias("positives"), F.concat(F.lit("2024-01-"), day).alias("scan_date")
    )


@query(
    "reputation_votes",
    f"""WITH {fx.SAMPLES}, {_REPORTS} SELECT sample_id, scan_date, coalesce(positives, 0) > 3 AS malicious, coalesce(positives, 0) || '/92' AS score
    FROM samples LEFT JOIN latest ON url_hash = sha256(url)""",
)
def reputation_votes(spark, sf):
    voted = en.reputation_votes(fx.samples(spark, sf).select("sample_id", "url"), "url", url_reports(spark, sf))
    return voted.select("sample_id", "scan_date", "malicious", "score")


_BROWSING = """entries AS (SELECT url, page_id % 4 = 0 AS malicious, CASE page_id % 3 WHEN 0 THEN 'MALWARE' WHEN 1 THEN 'SOCIAL_ENGINEERING' ELSE 'UNWANTED' END AS threat
  FROM pages WHERE url LIKE 'http:%'),
listed AS (SELECT url, bool_or(malicious) AS malicious, string_agg(DISTINCT threat, '|' ORDER BY threat) AS threats FROM entries GROUP BY url)"""


def browsing_entries(spark, sf):
    threat = F.when(F.col("page_id") % 3 == 0, "MALWARE").when(F.col("page_id") % 3 == 1, "SOCIAL_ENGINEERING").otherwise("UNWANTED")
    return fx.table(spark, sf, "pages").filter("url LIKE 'http:%'").select("url", (F.col("page_id") % 4 == 0).alias("malicious"), threat.alias("threat"))


@query(
    "safe_browsing",
    f"""WITH {fx.SAMPLES}, {_BROWSING} SELECT sample_id, coalesce(malicious, false) AS listed_malicious, coalesce(threats, '') AS threats
    FROM samples LEFT JOIN listed USING (url)""",
)
def safe_browsing(spark, sf):
    found = en.safe_browsing(fx.samples(spark, sf), "url", browsing_entries(spark, sf))
    return found.select("sample_id", "listed_malicious", joined("threats").alias("threats"))


# One registration per second domain; dates follow from the length of the name.
_REGISTRATIONS = """registrations AS (SELECT DISTINCT registered_domain AS domain, TIMESTAMP '2024-01-31' - to_days(CAST(length(registered_domain) * 3 - 30 AS INTEGER)) AS created,
    CASE WHEN length(registered_domain) % 2 = 0 THEN 'Registrar A' ELSE 'Registrar B' END AS registrar
  FROM names WHERE registered_domain <> '' AND length(registered_domain) % 5 <> 0)"""


def registrations(parsed):
    length = F.length("domain")
    domains = parsed.select(F.col("names.registered_domain").alias("domain")).filter("domain <> '' AND length(domain) % 5 <> 0").distinct()
    first = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(length * 3 - 30)
    later = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return domains.select("domain", F.array(first, later).alias("created"), F.when(length % 2 == 0, "Registrar A").otherwise("Registrar B").alias("registrar"))


@query(
    "registration_age",
    f"""WITH {fx.DECODED}, {_REGISTRATIONS}, aged AS (SELECT sample_id, coalesce(CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created)) / 86400000000.0) AS INTEGER), -1) AS age_days, registrar
      FROM names LEFT JOIN registrations ON names.registered_domain = registrations.domain)
    SELECT sample_id, age_days, registrar, age_days < 30 AS young_domain, coalesce(registrar <> 'Registrar A', true) AS registrar_differs FROM aged""",
)
def registration_age(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).withColumn("registered_domain", F.col("names.registered_domain"))
    found = en.registration_age(parsed, "registered_domain", registrations(parsed), reference_time())
    differs = F.coalesce(F.col("registrar") != "Registrar A", F.lit(True))
    return found.select("sample_id", "age_days", "registrar", "young_domain", differs.alias("registrar_differs"))


_DNS = """dns AS (SELECT DISTINCT registered_domain AS domain, length(registered_domain) % 3 AS dnskeys, 'mx2.' || registered_domain AS m2, 'mx1.' || registered_domain AS m1,
    length(registered_domain) % 2 = 0 AS authenticated FROM names WHERE registered_domain <> ''),
blocked AS (SELECT DISTINCT array_to_string(list_reverse(string_split(registered_domain, '.')), '.') || '.dbl.spamhaus.org' AS name
  FROM names WHERE registered_domain LIKE '%parcel%' OR registered_domain = 'example.org')"""


def dns_records(parsed):
    domains = parsed.select(F.col("names.registered_domain").alias("domain")).filter("domain <> ''").distinct()
    length = F.length("domain")
    exchangers = F.array(F.concat(F.lit("mx2."), "domain"), F.concat(F.lit("mx1."), "domain"))
    records = domains.select("domain", (length % 3).alias("dnskeys"), exchangers.alias("mx"), (length % 2 == 0).alias("authenticated"))
    blocked = domains.filter("domain LIKE '%parcel%' OR domain = 'example.org'")
    return records, blocked.select(urls.reverse_labels(F.col("domain"), en.BLOCKLIST_ZONE).alias("name"))


@query(
    "dns_facts",
    f"""WITH {fx.DECODED}, {_DNS} SELECT sample_id, coalesce(dnskeys > 0, false) AS dnssec, coalesce(m1 || '|' || m2, '') AS mx,
      coalesce(authenticated, false) AS authenticated, blocked.name IS NOT NULL AS dbl_listed
    FROM names LEFT JOIN dns ON dns.domain = registered_domain
    LEFT JOIN blocked ON blocked.name = array_to_string(list_reverse(string_split(registered_domain, '.')), '.') || '.dbl.spamhaus.org'""",
)
def dns_facts(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).withColumn("registered_domain", F.col("names.registered_domain"))
    records, blocked = dns_records(parsed)
    found = en.dns_facts(parsed, "registered_domain", records, blocked)
    return found.select("sample_id", "dnssec", joined("mx").alias("mx"), "authenticated", "dbl_listed")


_SAMPLE_FEATURES = ("url_network_features", "url_domain_features", "url_path_features", "url_security_features")


@query(
    "url_feature_record",
    f"""WITH facts AS (WITH {fx.DECODED}, {_REGISTRATIONS}, {_DNS} SELECT sample_id,
        coalesce(CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created)) / 86400000000.0) AS INTEGER), -1) AS days_since_registration,
        CAST(coalesce(dnskeys > 0, false) AS INTEGER) AS dnssec_enabled
      FROM names LEFT JOIN registrations r ON r.domain = registered_domain LEFT JOIN dns ON dns.domain = registered_domain)
    SELECT * FROM facts JOIN ({') JOIN ('.join(f"{registered_sql(n)}" + f") AS {n} USING (sample_id" for n in _SAMPLE_FEATURES)})""",
)
def url_feature_record(spark, sf):
    """Every feature of every sample, with the age and the keys of its domain."""
    samples = fx.samples(spark, sf)
    parsed = urls.with_url_parts(samples)
    facts = en.domain_facts(registrations(parsed), dns_records(parsed)[0], reference_time())
    names = [f.name for f in urls.url_features(samples).schema if f.name not in samples.columns]
    record = en.url_record(samples.select("sample_id", "url"), facts)
    return known(record.select("sample_id", *names, "days_since_registration", "dnssec_enabled"))


_ASNS = """asns AS (SELECT DISTINCT src_ip AS ip, user_id % 250 AS asn,
    CASE user_id % 4 WHEN 0 THEN 'Amazon Technologies' WHEN 1 THEN 'Bulletproof Hosting Ltd' WHEN 2 THEN 'Google Cloud' ELSE 'City Telecom' END AS description
  FROM traffic WHERE user_id % 5 <> 0)"""


def asns(traffic):
    turn = F.col("user_id") % 4
    description = F.when(turn == 0, "Amazon Technologies").when(turn == 1, "Bulletproof Hosting Ltd").when(turn == 2, "Google Cloud").otherwise("City Telecom")
    known = traffic.filter("user_id % 5 <> 0")
    return known.select(F.col("src_ip").alias("ip"), (F.col("user_id") % 250).alias("asn"), description.alias("description"))


@query(
    "asn_reputation",
    f"""WITH {fx.TRAFFIC}, {_ASNS}, one AS (SELECT ip, min(asn) AS asn, min_by(description, (asn, description)) AS description FROM asns GROUP BY ip)
    SELECT event_id, coalesce(asn, -1) AS asn, description AS asn_description, coalesce(regexp_matches(lower(description), 'hosting|bulletproof|cloud'), false) AS asn_high_risk,
      coalesce(regexp_matches(description, 'Amazon|Google|Microsoft'), false) AS datacentre
    FROM traffic LEFT JOIN one ON ip = src_ip""",
)
def asn_reputation(spark, sf):
    traffic = fx.traffic(spark, sf)
    found = en.asn_reputation(traffic, "src_ip", asns(traffic))
    return found.select("event_id", "asn", "asn_description", "asn_high_risk", "datacentre").fillna(-1, ["asn"]).fillna(False)


RANGE_COLUMNS = "first, last, country"
# 10.0.0.0-63, 10.0.0.64-99, all of 10/8, 198.51.100.0-127
RANGES = ((167772160, 167772223, "RU"), (167772224, 167772259, "DE"), (167772160, 184549375, "US"), (3325256704, 3325256831, "KP"))
EXITS = ("10.0.0.11", "10.0.0.120")


@query(
    "country_risk",
    f"""WITH {fx.TRAFFIC}, {fx.cte('ranges', RANGE_COLUMNS, RANGES)}, addresses AS (SELECT DISTINCT src_ip,
        list_reduce(list_transform(string_split(src_ip, '.'), lambda o: CAST(o AS BIGINT)), lambda a, b: a * 256 + b) AS n FROM traffic),
      located AS (SELECT src_ip, min_by(country, (last - first, country)) AS country FROM addresses JOIN ranges ON n BETWEEN first AND last GROUP BY src_ip)
    SELECT event_id, country, coalesce(country IN ('IR', 'KP', 'RU', 'SY'), false) AS country_high_risk, src_ip IN {EXITS!r} AS vpn_exit, true AS locatable
    FROM traffic LEFT JOIN located USING (src_ip)""",
)
def country_risk(spark, sf):
    ranges = fx.inline(spark, RANGE_COLUMNS, RANGES).withColumns({c: F.col(c).cast("long") for c in ("first", "last")})
    exits = sources.known_malicious(spark, EXITS)
    found = en.country_risk(fx.traffic(spark, sf), "src_ip", ranges, exits)
    return found.select("event_id", "country", "country_high_risk", "vpn_exit", "locatable")


_CERTIFICATES = """certificates AS (SELECT DISTINCT host, TIMESTAMP '2024-02-01' + to_days(CAST(length(host) - 20 AS INTEGER)) AS not_after,
    'CN=' || CASE WHEN length(host) % 3 = 0 THEN host ELSE 'Issuing CA' END AS issuer, 'CN=' || host AS subject, CAST(CASE WHEN length(host) % 4 = 0 THEN 1024 ELSE 2048 END AS INTEGER) AS key_size,
    CASE length(host) % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*', '*') ELSE 'other.example' END AS san
  FROM names WHERE host IS NOT NULL AND scheme = 'https')"""


def certificates(parsed):
    hosts = parsed.filter("parts.scheme = 'https' AND parts.host IS NOT NULL").select("parts.host").distinct()
    length = F.length("host")
    san = F.when(length % 3 == 0, F.col("host")).when(length % 3 == 1, F.regexp_replace("host", "^[^.]*", "*")).otherwise("other.example")
    return hosts.select(
        "host",
        (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(length - 20)).alias("not_after"),
        F.concat(F.lit("CN="), F.when(length % 3 == 0, F.col("host")).otherwise("Issuing CA")).alias("issuer"),
        F.concat(F.lit("CN="), "host").alias("subject"),
        F.when(length % 4 == 0, 1024).otherwise(2048).alias("key_size"),
        F.array(F.lit("backup.example"), san).alias("san"),
    )


@query(
    "certificate_facts",
    f"""WITH {fx.DECODED}, {_CERTIFICATES} SELECT sample_id, coalesce(not_after > TIMESTAMP '2024-02-01', false) AS cert_valid, coalesce(issuer = subject, false) AS self_signed,
      coalesce(key_size, -1) AS key_size, coalesce(NOT (san = host OR san = regexp_replace(host, '^[^.]*', '*')), false) AS subject_mismatch
    FROM names LEFT JOIN certificates USING (host)""",
)
def certificate_facts(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).withColumn("host", F.col("parts.host"))
    found = en.certificate_facts(parsed, "host", certificates(parsed), reference_time())
    return found.select("sample_id", "cert_valid", "self_signed", "key_size", "subject_mismatch").fillna(False).fillna(-1, ["key_size"])


@query(
    "unusual_issuers",
    f"""WITH {fx.DECODED}, log AS (SELECT registered_domain AS domain, CASE sample_id % 3 WHEN 0 THEN 'Corner Shop CA' ELSE 'DigiCert Inc' END AS issuer FROM names WHERE registered_domain <> ''),
      per AS (SELECT domain, count(*) AS issued, count(*) FILTER (WHERE issuer NOT IN ('DigiCert Inc', 'Google Trust Services', 'Let''s Encrypt', 'Sectigo Limited')) AS unusual FROM log GROUP BY domain)
    SELECT sample_id, coalesce(issued, 0) AS issued, coalesce(unusual, 0) AS unusual FROM names LEFT JOIN per ON per.domain = registered_domain""",
)
def unusual_issuers(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).select("sample_id", "names.registered_domain")
    issuer = F.when(F.col("sample_id") % 3 == 0, "Corner Shop CA").otherwise("DigiCert Inc")
    log = parsed.filter("registered_domain <> ''").select(F.col("registered_domain").alias("domain"), issuer.alias("issuer"))
    return en.unusual_issuers(parsed, "registered_domain", log).select("sample_id", "issued", "unusual")


@query(
    "phish_list_membership",
    f"WITH {fx.SAMPLES} SELECT sample_id, url IN (SELECT url FROM pages WHERE url LIKE '%spam-farm%' OR url LIKE '%html') AS in_database FROM samples",
)
def phish_list_membership(spark, sf):
    phish = fx.table(spark, sf, "pages").filter("url LIKE '%spam-farm%' OR url LIKE '%html'")
    return en.listed_phish(fx.samples(spark, sf), "url", phish).select("sample_id", "in_database")


ABUSE_COLUMNS = "ip, abuse_confidence, isp, usage_type"
# Some addresses have two reports; the one with the smaller values counts.
ABUSE = tuple((f"10.0.0.{n}", n % 101, f"ISP {n % 7}", "Data Center" if n % 2 else "Fixed Line") for n in range(0, 150, 3)) + tuple(
    (f"10.0.0.{n}", n % 101 + 5, "ISP 9", "Other") for n in range(0, 150, 15)
)


@query(
    "abuse_reports",
    f"""WITH {fx.TRAFFIC}, {fx.cte('abuse', ABUSE_COLUMNS, ABUSE)} SELECT event_id, coalesce(abuse_confidence, 0) AS abuse_confidence, isp, usage_type
    FROM traffic LEFT JOIN (SELECT ip, min(abuse_confidence) AS abuse_confidence, min_by(isp, abuse_confidence) AS isp, min_by(usage_type, abuse_confidence) AS usage_type FROM abuse GROUP BY ip) ON ip = src_ip""",
)
def abuse_reports(spark, sf):
    found = en.abuse_reports(fx.traffic(spark, sf), "src_ip", fx.inline(spark, ABUSE_COLUMNS, ABUSE))
    return found.select("event_id", "abuse_confidence", "isp", "usage_type")


@query(
    "indicator_pulses",
    f"""WITH {fx.DECODED}, pulse AS (SELECT DISTINCT registered_domain AS indicator, 'pulse-' || (sample_id % 4) AS pulse FROM names WHERE suffix = 'com'),
      per AS (SELECT indicator, string_agg(pulse, '|' ORDER BY pulse) AS pulses FROM pulse GROUP BY indicator)
    SELECT sample_id, coalesce(pulses, '') AS pulses FROM names LEFT JOIN per ON indicator = registered_domain""",
)
def indicator_pulses(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).select("sample_id", "names.registered_domain", "names.suffix")
    pulse = parsed.filter("suffix = 'com'").select(
        F.col("registered_domain").alias("indicator"), F.concat(F.lit("pulse-"), (F.col("sample_id") % 4).cast("string")).alias("pulse")
    )
    return en.pulses(parsed, "registered_domain", pulse).select("sample_id", joined("pulses").alias("pulses"))


@query(
    "parked_pages",
    "SELECT page_id, regexp_matches(lower(html), 'domain for sale|parked|godaddy|<nav>') AS parked, regexp_matches(lower(html), 'domain for sale|parked|godaddy') AS parked_only FROM pages",
)
def parked_pages(spark, sf):
    # No page is parked; the second form adds a phrase pages do contain, so the check is not all misses.
    html = F.col("html")
    widened = F.when(F.lower(html).contains("<nav>"), F.concat(html, F.lit(" Domain For Sale "))).otherwise(html)
    return fx.table(spark, sf, "pages").select("page_id", en.parked(widened).alias("parked"), en.parked(html).alias("parked_only"))


@query(
    "tls_fingerprints",
    """SELECT event_id, version || cipher AS fingerprint FROM (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'TLSv1.2' WHEN 1 THEN 'TLSv1.3' ELSE 'TLSv1' END AS version,
      CASE event_id % 4 WHEN 0 THEN 'RC4-MD5' ELSE 'AES256-GCM' END AS cipher FROM events) WHERE version || cipher IN ('TLSv1RC4-MD5', 'TLSv1.2RC4-MD5')""",
)
def tls_fingerprints(spark, sf):
    turn = F.col("user_id") % 3
    connections = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(turn == 0, "TLSv1.2").when(turn == 1, "TLSv1.3").otherwise("TLSv1").alias("version"),
        F.when(F.col("event_id") % 4 == 0, "RC4-MD5").otherwise("AES256-GCM").alias("cipher"),
    )
    bad = fx.inline(spark, "fingerprint", (("TLSv1RC4-MD5",), ("TLSv1.2RC4-MD5",), ("TLSv1.2RC4-MD5",)))
    return en.tls_fingerprints(connections, bad).select("event_id", "fingerprint")


@query(
    "url_scan_results",
    f"""WITH {fx.SAMPLES}, scans AS (SELECT url, max_by('result/' || page_id, page_id) AS result FROM pages WHERE length(url) % 2 = 0 GROUP BY url)
    SELECT sample_id, coalesce(result, '') AS result FROM samples LEFT JOIN scans USING (url)""",
)
def url_scan_results(spark, sf):
    scans = fx.table(spark, sf, "pages").filter("length(url) % 2 = 0").select(
        "url", F.concat(F.lit("result/"), F.col("page_id").cast("string")).alias("result"), F.col("page_id").alias("scanned")
    )
    return en.scan_results(fx.samples(spark, sf), "url", scans).select("sample_id", "result")


def url_intelligence_table(spark, sf):
    """Every sample with the struct of its five checks."""
    return url_intelligence_of(spark, sf, fx.samples(spark, sf).select("sample_id", "url"))


def url_intelligence_of(spark, sf, links):
    """Links ``(sample_id, url)`` with the struct of their five checks."""
    # Five checks look at the parsed URLs, so they are parsed once.
    parsed = materialize(urls.with_url_parts(links), "parsed-urls")
    checked = rules.with_blacklist_flag(listed_samples(spark, parsed))
    keys = {"host": F.col("parts.host"), "registered_domain": F.col("names.registered_domain")}
    parsed, checked = parsed.withColumns(keys), checked.withColumns(keys)
    records, blocked = dns_records(parsed)
    checked = en.safe_browsing(checked, "url", browsing_entries(spark, sf))
    checked = en.registration_age(checked, "registered_domain", registrations(parsed), reference_time())
    checked = en.dns_facts(checked, "registered_domain", records, blocked)
    checked = en.certificate_facts(checked, "host", certificates(parsed), reference_time())
    return en.url_intelligence(checked, ["sample_id", "url"])


INTELLIGENCE_SQL = f"""{fx.DECODED}, {_BLACK}, {_BROWSING}, {_REGISTRATIONS}, {_DNS}, {_CERTIFICATES}, intelligence AS (
  SELECT n.sample_id, n.url, coalesce(l.malicious, false) AS browsing_malicious, n.sample_id IN (SELECT sample_id FROM hits) AS blacklisted,
    coalesce(CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(r.created)) / 86400000000.0) AS INTEGER), -1) AS age_days,
    coalesce(d.dnskeys > 0, false) AS dnssec, b.name IS NOT NULL AS dbl_listed, coalesce(c.issuer = c.subject, false) AS self_signed
  FROM names n LEFT JOIN listed l USING (url) LEFT JOIN registrations r ON r.domain = n.registered_domain LEFT JOIN dns d ON d.domain = n.registered_domain
  LEFT JOIN blocked b ON b.name = array_to_string(list_reverse(string_split(n.registered_domain, '.')), '.') || '.dbl.spamhaus.org'
  LEFT JOIN certificates c ON c.host = n.host)"""


@query(
    "url_intelligence",
    f"""WITH {INTELLIGENCE_SQL} SELECT sample_id, browsing_malicious, blacklisted, age_days, dnssec, dbl_listed, self_signed,
      browsing_malicious OR blacklisted OR dbl_listed AS hit FROM intelligence""",
)
def url_intelligence(spark, sf):
    intel = F.col("intel")
    return url_intelligence_table(spark, sf).select(
        "sample_id",
        intel["safe_browsing"]["malicious"].alias("browsing_malicious"),
        intel["internal_blacklist"]["listed"].alias("blacklisted"),
        intel["domain_registration"]["age_days"].alias("age_days"),
        intel["dns_security"]["dnssec"].alias("dnssec"),
        intel["dns_security"]["dbl_listed"].alias("dbl_listed"),
        F.coalesce(intel["certificate"]["self_signed"], F.lit(False)).alias("self_signed"),
        en.intelligence_hit(intel).alias("hit"),
    )


# --- indicator feed ------------------------------------------------------------------------------------

IOC_SQL = f"""{fx.DECODED}, {_INDICATORS}, {_BEST}, {_REPORTS}, {_RULES}, iocs AS (
  SELECT 'h' || sample_id AS key, 'domain' AS type, host AS value FROM names WHERE host IS NOT NULL
  UNION ALL SELECT 'u' || sample_id, 'url', url FROM names
  UNION ALL SELECT 'p' || sample_id, 'file', path FROM names
  UNION ALL SELECT 'i' || event_id, 'ip', '10.0.0.' || (user_id % 250) FROM events
  UNION ALL SELECT 'x' || event_id, 'hash', sha256(props) FROM events),
ioc_hits AS (SELECT DISTINCT key, name, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS level
  FROM iocs JOIN rules ON active AND iocs.type = rules.type AND CASE iocs.type WHEN 'hash' THEN lower(iocs.value) = lower(pattern) ELSE regexp_matches(iocs.value, pattern) END),
worst AS (SELECT key, max(level) AS rule_level, string_agg(name, '|' ORDER BY name) AS rules FROM ioc_hits GROUP BY key),
enriched AS (SELECT iocs.key, iocs.type, iocs.value, best.threat_type AS known_threat, coalesce(best.confidence, 0) AS known_confidence,
    coalesce(positives, 0) AS positives, coalesce(rule_level, 0) AS rule_level, coalesce(rules, '') AS rules
  FROM iocs LEFT JOIN best ON best.value = iocs.value LEFT JOIN latest ON url_hash = sha256(iocs.value) LEFT JOIN worst ON worst.key = iocs.key),
scores AS (SELECT *, 0.6 * least(1, greatest(0, known_confidence)) + 0.25 * rule_level / 5.0 + 0.15 * positives / 92.0 AS threat_score FROM enriched),
levels AS (SELECT *, CASE WHEN threat_score >= 0.9 THEN 5 WHEN threat_score >= 0.7 THEN 4 WHEN threat_score >= 0.4 THEN 3 WHEN threat_score >= 0.2 THEN 2 ELSE 1 END AS threat_level FROM scores)"""


def iocs(spark, sf):
    """Hosts, URLs and paths of the samples, source addresses and digests of the events as an indicator feed."""
    parsed = urls.with_url_parts(fx.samples(spark, sf))
    key = lambda letter: F.concat(F.lit(letter), F.col("sample_id").cast("string")).alias("key")
    hosts = parsed.filter("parts.host IS NOT NULL").select(key("h"), F.lit("domain").alias("type"), F.col("parts.host").alias("value"))
    links = parsed.select(key("u"), F.lit("url"), "url")
    paths = parsed.select(key("p"), F.lit("file"), "parts.path")
    addresses = fx.traffic(spark, sf).select(F.concat(F.lit("i"), F.col("event_id").cast("string")), F.lit("ip"), "src_ip")
    digests = fx.table(spark, sf, "events").select(F.concat(F.lit("x"), F.col("event_id").cast("string")), F.lit("hash"), F.sha2("props", 256))
    return hosts.union(links).union(paths).union(addresses).union(digests)


def enriched_iocs(spark, sf):
    return threats.enrich_iocs(iocs(spark, sf), fx.indicators(spark), url_reports(spark, sf), fx.rules(spark))


@query(
    "ioc_enrichment",
    f"WITH {IOC_SQL} SELECT key, type, value, known_threat, CAST(known_confidence AS DOUBLE) AS known_confidence, positives, rule_level, rules FROM enriched",
)
def ioc_enrichment(spark, sf):
    enriched = enriched_iocs(spark, sf).withColumn("rules", joined("rules")).fillna(0.0, ["known_confidence"])
    return enriched.select("key", "type", "value", "known_threat", "known_confidence", "positives", "rule_level", "rules")


@query(
    "ioc_threat_scores",
    f"""WITH {IOC_SQL} SELECT key, round(threat_score, 6) AS threat_score, threat_level,
      CASE threat_level WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS threat_level_name FROM levels""",
)
def ioc_threat_scores(spark, sf):
    return threats.score_feed(enriched_iocs(spark, sf)).select("key", "threat_score", "threat_level", "threat_level_name")


@query("serious_threats", f"WITH {IOC_SQL} SELECT key, type, value, threat_level FROM levels WHERE threat_level >= 3")
def serious_threats(spark, sf):
    scored = threats.score_feed(enriched_iocs(spark, sf))
    return threats.serious(scored, 3).select("key", "type", "value", "threat_level")


@query(
    "feed_union",
    """SELECT feed, coalesce(source, '') AS source, count(*) AS entries, count(n_chars) AS with_size, count(toxic) AS with_label FROM (
      SELECT 'documents' AS feed, source, doc_id, n_chars, NULL AS toxic FROM documents UNION ALL
      SELECT 'labels', NULL, doc_id, NULL, toxic FROM labels UNION ALL SELECT 'pages', NULL, page_id, NULL, NULL FROM pages UNION ALL
      SELECT 'conversations', role, conv_id, length(text), NULL FROM conversations) GROUP BY ALL""",
)
def feed_union(spark, sf):
    feeds = {
        "documents": fx.table(spark, sf, "documents").select("source", "doc_id", "n_chars"),
        "labels": fx.table(spark, sf, "labels").select("doc_id", "toxic"),
        "pages": fx.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")),
        "conversations": fx.table(spark, sf, "conversations").select(
            F.col("role").alias("source"), F.col("conv_id").alias("doc_id"), F.length("text").cast("long").alias("n_chars")
        ),
    }
    return sources.union_feeds(feeds).groupBy("feed", F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("entries"), F.count("n_chars").alias("with_size"), F.count("toxic").alias("with_label")
    )
