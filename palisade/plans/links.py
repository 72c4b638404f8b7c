"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import urls
from palisade.operators import enrichment, rules, scoring
from palisade.plans import fixtures as fx
from palisade.plans.registry import query


def known(df):
    """NULL integers shown as -1, so that both engines hand out whole numbers."""
    return df.fillna(-1)


@query(
    "url_decode",
    f"WITH {fx.SAMPLES} SELECT sample_id, url_decode(url) AS decoded, CAST(len(regexp_extract_all(url, '%[0-9a-fA-F]{{2}}')) AS INTEGER) AS escapes FROM samples",
)
def url_decode(spark, sf):
    return fx.samples(spark, sf).select(
        "sample_id", urls.percent_decode(F.col("url")).alias("decoded"), urls.percent_escapes(F.col("url")).alias("escapes")
    )


@query(
    "url_split",
    f"WITH {fx.DECODED} SELECT sample_id, scheme, netloc, host, coalesce(port, -1) AS port, path, query, fragment FROM parts",
)
def url_split(spark, sf):
    fields = ("scheme", "netloc", "host", "port", "path", "query", "fragment")
    parsed = fx.samples(spark, sf).withColumn("parts", urls.url_parts(urls.percent_decode(F.col("url"))))
    return known(parsed.select("sample_id", *[F.col(f"parts.{f}").alias(f) for f in fields]))


@query(
    "domain_split",
    f"WITH {fx.DECODED} SELECT sample_id, suffix, domain, subdomain, registered_domain FROM names",
)
def domain_split(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf))
    return parsed.select("sample_id", "names.suffix", "names.domain", "names.subdomain", "names.registered_domain")


_count = "CAST(length({0}) - length(replace({0}, '{1}', '')) AS INTEGER)"


@query(
    "url_network_features",
    f"""WITH {fx.DECODED} SELECT sample_id, CAST(scheme = 'https' AS INTEGER) AS uses_https,
      CASE WHEN scheme = 'https' THEN coalesce(port, 443) ELSE 80 END AS port_number, coalesce(port, -1) AS explicit_port,
      coalesce(CAST(regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AS INTEGER), -1) AS has_ipv4,
      coalesce(CAST(contains(host, ':') AS INTEGER), -1) AS has_ipv6, CAST(netloc IN ('bit.ly', 'goo.gl') AS INTEGER) AS is_shortened
    FROM names""",
)
def url_network_features(spark, sf):
    names = ("uses_https", "port_number", "explicit_port", "has_ipv4", "has_ipv6", "is_shortened")
    return known(urls.url_features(fx.samples(spark, sf)).select("sample_id", *names))


@query(
    "url_domain_features",
    f"""WITH {fx.DECODED} SELECT sample_id, suffix AS tld, coalesce({_count.format('subdomain', '.')} + 1, -1) AS subdomain_count,
      coalesce(CAST(length(domain) AS INTEGER), -1) AS domain_length, CAST(starts_with(netloc, 'xn--') AS INTEGER) AS is_idn, registered_domain
    FROM names""",
)
def url_domain_features(spark, sf):
    names = ("tld", "subdomain_count", "domain_length", "is_idn", "registered_domain")
    return known(urls.url_features(fx.samples(spark, sf)).select("sample_id", *names))


@query(
    "url_path_features",
    f"""WITH {fx.DECODED} SELECT sample_id, {_count.format('path', '/')} AS path_depth,
      CASE WHEN query <> '' THEN CAST(len(string_split(query, '&')) AS INTEGER) ELSE 0 END AS num_params,
      CAST(regexp_matches(query, 'token|auth|session') AS INTEGER) AS has_suspicious_param,
      CASE WHEN regexp_matches(path, '(?:^|/)[^/]*[^/.][^/]*?\\.[^./]+/?$')
        THEN lower(regexp_extract(path, '(?:^|/)[^/]*[^/.][^/]*?(\\.[^./]+)/?$', 1)) ELSE 'none' END AS file_extension
    FROM names""",
)
def url_path_features(spark, sf):
    names = ("path_depth", "num_params", "has_suspicious_param", "file_extension")
    return urls.url_features(fx.samples(spark, sf)).select("sample_id", *names)


_SIX = """(CAST(contains(p.netloc, '@') AS INTEGER) + CAST(len(regexp_extract_all(p.url, '%[0-9a-fA-F]{2}')) >= 3 AS INTEGER)
      + CAST(regexp_matches(p.url, '[\\x{200B}-\\x{200D}\\x{FEFF}]') AS INTEGER)
      + CAST(regexp_matches(coalesce(p.host, ''), '(^|[.])xn--') AS INTEGER)
      + CAST(regexp_matches(coalesce(p.host, ''), '[^\\x00-\\x7F]') AS INTEGER) + CAST(contains(p.path, '//') AS INTEGER)) / 6.0"""


@query(
    "url_security_features",
    f"""WITH {fx.DECODED} SELECT sample_id, round({fx.entropy_sql('decoded')}, 6) AS entropy,
      round(len(regexp_extract_all(decoded, '[^a-zA-Z0-9/:.?=&-]')) / CAST(NULLIF(length(decoded), 0) AS DOUBLE), 6) AS special_char_ratio,
      CAST(len(regexp_extract_all(decoded, '%[0-9a-fA-F]{{2}}')) AS INTEGER) AS hex_char_count,
      CAST(len(regexp_extract_all(url, '%[0-9a-fA-F]{{2}}')) AS INTEGER) AS raw_hex_char_count,
      round({_SIX}, 6) AS obfuscation_score
    FROM names p""",
)
def url_security_features(spark, sf):
    names = ("entropy", "special_char_ratio", "hex_char_count", "raw_hex_char_count", "obfuscation_score")
    return urls.url_features(fx.samples(spark, sf)).select("sample_id", *names)


@query(
    "url_feature_summary",
    f"""WITH {fx.DECODED} SELECT suffix AS tld, count(*) AS urls, round(avg({fx.entropy_sql('decoded')}), 6) AS mean_entropy,
      round(avg({_SIX}), 6) AS mean_obfuscation, CAST(max({_count.format('path', '/')}) AS INTEGER) AS deepest_path,
      CAST(sum(CAST(scheme = 'https' AS INTEGER)) AS BIGINT) AS https_urls
    FROM names p GROUP BY suffix""",
)
def url_feature_summary(spark, sf):
    features = urls.url_features(fx.samples(spark, sf))
    return features.groupBy("tld").agg(
        F.count(F.lit(1)).alias("urls"),
        F.avg("entropy").alias("mean_entropy"),
        F.avg("obfuscation_score").alias("mean_obfuscation"),
        F.max("path_depth").alias("deepest_path"),
        F.sum("uses_https").alias("https_urls"),
    )


@query(
    "url_canonical_forms",
    f"""WITH {fx.SAMPLES} SELECT sample_id,
      CASE WHEN regexp_matches(url, '^([^:/?#]+:)?//') THEN
        lower(regexp_extract(url, '^(([^:/?#]+:)?//[^/?#]*)', 1)) || substr(url, length(regexp_extract(url, '^(([^:/?#]+:)?//[^/?#]*)', 1)) + 1)
        ELSE url END AS canonical,
      regexp_replace(url, '[^A-Za-z0-9_.~:/?#\\[\\]@!$&''()*+,;=-]', '', 'g') AS stripped
    FROM samples""",
)
def url_canonical_forms(spark, sf):
    url = F.col("url")
    return fx.samples(spark, sf).select("sample_id", urls.canonical_url(url).alias("canonical"), urls.stripped_url(url).alias("stripped"))


# The SQL edit distance counts bytes; one mark per other character makes it count characters.
_ASCII = "(SELECT *, regexp_replace(domain, '[^\\x00-\\x7F]', '*', 'g') AS ascii FROM names)"
_BRANDS = "brands(brand) AS (" + fx.values([(b,) for b in fx.BRAND_NAMES]) + ")"


@query(
    "brand_distance",
    f"""WITH {fx.DECODED}, {_BRANDS} SELECT sample_id, domain, CAST(min(levenshtein(ascii, brand)) AS INTEGER) AS distance,
      min_by(brand, (levenshtein(ascii, brand), brand)) AS brand
    FROM {_ASCII}, brands WHERE domain IS NOT NULL GROUP BY sample_id, domain""",
)
def brand_distance(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).filter("names.domain IS NOT NULL")
    nearest = parsed.withColumn("near", urls.nearest_brand(F.col("names.domain"), fx.BRAND_NAMES))
    return nearest.select("sample_id", "names.domain", "near.distance", "near.brand")


_ROWS = urls.KEYBOARD_ROWS
_KEYS = f"translate(lower({{0}}), '{''.join(_ROWS)}', '{''.join(str(n) * len(row) for n, row in enumerate(_ROWS, 1))}')"


@query(
    "typosquat_scores",
    f"""WITH {fx.DECODED}, {_BRANDS}, features AS (
      SELECT sample_id, domain, CAST(length(domain) AS INTEGER) AS length, {fx.entropy_sql('domain')} AS entropy,
        CAST(min(levenshtein(ascii, brand)) AS INTEGER) AS brand_distance,
        CAST(min(levenshtein({_KEYS.format('ascii')}, {_KEYS.format('brand')})) AS INTEGER) AS keyboard_distance
      FROM {_ASCII}, brands WHERE domain <> '' GROUP BY sample_id, domain)
    SELECT sample_id, domain, length, round(entropy, 6) AS entropy, brand_distance, keyboard_distance,
      round(CASE WHEN brand_distance = 0 THEN 0.0 ELSE
        1 / (1 + exp(-(1.5 - 0.03 * length + 0.4 * entropy - 0.6 * brand_distance - 0.3 * keyboard_distance))) END, 6) AS likelihood
    FROM features""",
)
def typosquat_scores(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).select("sample_id", "names.domain").filter("domain <> ''")
    features = parsed.withColumns(scoring.typosquat_features(F.col("domain"), fx.BRAND_NAMES))
    return features.withColumn("likelihood", scoring.typosquat_likelihood({n: F.col(n) for n in scoring.TYPO_WEIGHTS if n != "bias"}))


@query(
    "reverse_dns_names",
    f"""WITH {fx.DECODED} SELECT sample_id, array_to_string(list_reverse(string_split(host, '.')), '.') || '.dbl.spamhaus.org' AS dns_name
    FROM parts WHERE host IS NOT NULL""",
)
def reverse_dns_names(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf)).filter("parts.host IS NOT NULL")
    return parsed.select("sample_id", urls.reverse_labels(F.col("parts.host"), enrichment.BLOCKLIST_ZONE).alias("dns_name"))


BLACKLIST_COLUMNS = "kind, value"
BLACKLIST = (
    ("domain", "spam-farm.example.org"), ("domain", "g1thub.com"), ("domain", "parcel-desk.net"), ("ip", "192.168.1.1"),
    ("pattern", "utm_source="), ("pattern", "^http://.*[.]html$"),
)


def parsed_samples(spark, sf):
    return urls.with_url_parts(fx.samples(spark, sf))


def listed_samples(spark, parsed):
    """Parsed samples with the black-list entries they meet."""
    entries = fx.inline(spark, BLACKLIST_COLUMNS, BLACKLIST)
    return rules.with_blacklist_entries(parsed, entries, "url", F.col("parts"), F.col("names"))


_BLACK = f"""{fx.cte('blacklist', BLACKLIST_COLUMNS, BLACKLIST)}, hits AS (
  SELECT sample_id, kind, value FROM names JOIN blacklist ON kind = 'domain' AND (value = host OR value = registered_domain)
  UNION SELECT sample_id, kind, value FROM names JOIN blacklist ON kind = 'ip' AND value = host
  UNION SELECT sample_id, kind, value FROM names JOIN blacklist ON kind = 'pattern' AND regexp_matches(url, value))"""


@query("blacklist_matches", f"WITH {fx.DECODED}, {_BLACK} SELECT * FROM hits")
def blacklist_matches(spark, sf):
    return rules.blacklist_matches(listed_samples(spark, parsed_samples(spark, sf)), "sample_id")


@query(
    "blacklist_clean_urls",
    f"WITH {fx.DECODED}, {_BLACK} SELECT sample_id, url FROM samples ANTI JOIN hits USING (sample_id)",
)
def blacklist_clean_urls(spark, sf):
    return rules.clean_samples(listed_samples(spark, parsed_samples(spark, sf))).select("sample_id", "url")


@query(
    "url_verdict_report",
    f"""WITH {fx.DECODED}, {_BLACK}, flagged AS (SELECT DISTINCT sample_id FROM hits)
    SELECT suffix AS tld, CASE WHEN f.sample_id IS NULL THEN 'clean' ELSE 'blacklisted' END AS verdict, count(*) AS urls,
      CAST(sum(CAST(scheme = 'https' AS INTEGER)) AS BIGINT) AS https_urls
    FROM names n LEFT JOIN flagged f USING (sample_id) GROUP BY 1, 2""",
)
def url_verdict_report(spark, sf):
    flagged = rules.with_blacklist_flag(listed_samples(spark, parsed_samples(spark, sf)))
    flagged = flagged.select(F.col("names.suffix").alias("tld"), F.col("parts.scheme").alias("scheme"), "blacklisted")
    verdict = F.when(F.col("blacklisted"), "blacklisted").otherwise("clean")
    return (
        flagged.groupBy("tld", verdict.alias("verdict"))
        .agg(F.count(F.lit(1)).alias("urls"), F.sum((F.col("scheme") == "https").cast("int")).alias("https_urls"))
        .orderBy("tld", "verdict")
    )
