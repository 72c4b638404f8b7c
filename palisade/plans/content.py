"""Text, digest and content-indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import indicators as ind
from palisade.functions import text as tx
from palisade.functions import urls
from palisade.operators import tokens, validation
from palisade.plans import fixtures as fx
from palisade.plans.registry import query

_PHONE = fx.literal(tx.PHONE)
_SSN = fx.literal(tx.SOCIAL_SECURITY)


def demo_key():
    """A key for the checks; jobs take theirs from the caller."""
    return F.lit(b"0123456789abcdef0123456789abcdef")



def texts(spark, sf):
    """All documents, with the example texts added."""
    documents = fx.table(spark, sf, "documents").select("doc_id", "text")
    return documents.union(fx.samples(spark, sf).select("sample_id", "text").filter("sample_id >= 9000000000"))


_TEXTS = f"""{fx.SAMPLES}, texts AS (SELECT doc_id, text FROM documents
  UNION ALL SELECT sample_id, text FROM samples WHERE sample_id >= 9000000000)"""


@query(
    "pii_redaction",
    f"""WITH {_TEXTS} SELECT doc_id, sha256(clean) AS clean_hash,
      CAST((length(clean) - length(replace(clean, '[REDACTED]', ''))) / 10 AS INTEGER) AS redactions
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, {_SSN}, '[REDACTED]', 'g'), {_PHONE}, '[REDACTED]', 'g') AS clean FROM texts)""",
)
def pii_redaction(spark, sf):
    clean = texts(spark, sf).withColumn("clean", tx.redact_pii(F.col("text")))
    return clean.select("doc_id", F.sha2("clean", 256).alias("clean_hash"), urls.count_of(F.col("clean"), tx.REDACTION).alias("redactions"))


@query(
    "encoding_detection",
    f"""WITH {_TEXTS}, all_texts AS (SELECT 'document-' || doc_id AS id, text FROM texts
      UNION ALL SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations)
    SELECT id, regexp_matches(text, '^[A-Za-z0-9+/]+={{0,2}}\\n?\\z') AS base64, regexp_matches(text, '^[0-9a-fA-F]+\\n?\\z') AS hex,
      regexp_matches(text, '\\\\u[0-9a-fA-F]{{4}}') AS unicode FROM all_texts""",
)
def encoding_detection(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    both = texts(spark, sf).select(F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("id"), "text").union(turns)
    return both.select("id", tx.encoding_flags(F.col("text")).alias("e")).select("id", "e.*")


@query(
    "input_sanitizing",
    f"""WITH {fx.SAMPLES} SELECT sample_id, regexp_replace(replace(url, '--', ''), '[^A-Za-z0-9_-]', '', 'g') AS clean_url,
      sha256(regexp_replace(replace(text, '--', ''), '[^A-Za-z0-9_-]', '', 'g')) AS clean_text_hash FROM samples""",
)
def input_sanitizing(spark, sf):
    return fx.samples(spark, sf).select(
        "sample_id",
        tx.sanitize_input(F.col("url")).alias("clean_url"),
        F.sha2(tx.sanitize_input(F.col("text")), 256).alias("clean_text_hash"),
    )


_BYTE_ENTROPY = """bytes AS (SELECT doc_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents),
  counts AS (SELECT doc_id, b, CAST(count(*) AS DOUBLE) AS n FROM bytes WHERE b <> '' GROUP BY doc_id, b),
  shares AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM counts),
  entropies AS (SELECT doc_id, -sum(p * log2(p + 1e-9)) AS entropy FROM shares GROUP BY doc_id)"""


@query("byte_entropy", f"WITH {_BYTE_ENTROPY} SELECT doc_id, round(entropy, 6) AS entropy FROM entropies")
def byte_entropy(spark, sf):
    documents = fx.table(spark, sf, "documents")
    return documents.select("doc_id", tx.byte_entropy(F.col("text")).alias("entropy"))


_TOKENS = """tokens AS (SELECT doc_id, unnest(list) AS token, generate_subscripts(list, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS list FROM documents)),
  ranked AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS rank FROM tokens GROUP BY token),
  vocabulary AS (SELECT token, n, CAST(rank + 1 AS INTEGER) AS token_id FROM ranked)"""


@query("vocabulary", f"WITH {_TOKENS} SELECT token, n, token_id FROM vocabulary")
def vocabulary(spark, sf):
    return tokens.vocabulary(fx.table(spark, sf, "documents"), "text")


@query(
    "token_sequences",
    f"""WITH {_TOKENS}, ids AS (SELECT doc_id, CAST((pos - 1) // 1024 AS INTEGER) AS win, string_agg(token_id, ' ' ORDER BY pos) AS s, count(*) AS n
      FROM tokens JOIN vocabulary USING (token) GROUP BY doc_id, win)
    SELECT doc_id, coalesce(win, 0) AS "window", CAST(coalesce(n, 0) AS INTEGER) AS used, sha256(trim(coalesce(s, '') || repeat(' 0', CAST(1024 - coalesce(n, 0) AS INTEGER)))) AS sequence_hash
    FROM documents LEFT JOIN ids USING (doc_id)""",
)
def token_sequences(spark, sf):
    documents = fx.table(spark, sf, "documents")
    encoded = tokens.token_sequences(documents, "doc_id", "text", tokens.vocabulary(documents, "text"))
    used = F.size(F.filter("sequence", lambda t: t > 0))
    return encoded.select("doc_id", "window", used.alias("used"), F.sha2(F.array_join("sequence", " "), 256).alias("sequence_hash"))


@query(
    "field_encryption",
    "SELECT doc_id, sha256(text) AS recovered_hash, source AS recovered_source, true AS text_hidden, true AS source_hidden FROM documents",
)
def field_encryption(spark, sf):
    documents = fx.table(spark, sf, "documents").select("doc_id", "text", "source", F.col("text").alias("plain"), F.col("source").alias("plain_source"))
    hidden = tx.encrypt_fields(documents, ["text", "source", "absent"], demo_key())
    hidden = hidden.withColumns({"text_hidden": F.col("text") != F.col("plain"), "source_hidden": F.col("source") != F.col("plain_source")})
    shown = tx.decrypt_fields(hidden, ["text", "source"], demo_key())
    return shown.select("doc_id", F.sha2("text", 256).alias("recovered_hash"), F.col("source").alias("recovered_source"), "text_hidden", "source_hidden")


@query("tamper_detection", "SELECT doc_id, true AS rejected FROM documents")
def tamper_detection(spark, sf):
    documents = fx.table(spark, sf, "documents").select("doc_id", tx.encrypt_text(F.col("text"), demo_key()).alias("cipher"))
    tail = F.when(F.substring("cipher", -10, 10) == "xxxxxxxxxx", "yyyyyyyyyy").otherwise("xxxxxxxxxx")
    broken = F.concat(F.substring("cipher", F.lit(1), F.length("cipher") - 10), tail)
    return documents.select("doc_id", tx.decrypt_text(broken, demo_key()).isNull().alias("rejected"))


@query(
    "content_digests",
    "SELECT 'page' AS kind, page_id AS id, sha256(url) AS digest FROM pages UNION ALL SELECT 'document', doc_id, sha256(text) FROM documents",
)
def content_digests(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.sha2("url", 256).alias("digest"))
    documents = fx.table(spark, sf, "documents")
    return pages.union(documents.select(F.lit("document"), "doc_id", F.sha2("text", 256)))


@query(
    "json_records",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS parses,
      to_json({'event_id': event_id, 'kind': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT)}) AS encoded FROM events""",
)
def json_records(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return events.select(
        "event_id",
        "k",
        F.try_parse_json("props").isNotNull().alias("parses"),
        F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "k")).alias("encoded"),
    )


@query(
    "time_functions",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, epoch_us(ts) AS micros,
      strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS from_epoch,
      CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0) AS INTEGER) AS age_days FROM events""",
)
def time_functions(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf, "events").select(
        "event_id",
        tx.iso_timestamp(ts).alias("iso"),
        F.unix_micros(ts).alias("micros"),
        F.date_format(F.timestamp_seconds(F.unix_seconds(ts)), "yyyy-MM-dd HH:mm:ss").alias("from_epoch"),
        tx.age_in_days(ts, F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age_days"),
    )


@query(
    "ransom_note_keywords",
    f"""WITH {fx.PROCESSES} SELECT event_id,
      CAST(len(regexp_extract_all(replace(files, '|', ' '), '(?i)readme|decrypt|recover|restore|ransom|how_to')) AS INTEGER) AS keywords FROM processes""",
)
def ransom_note_keywords(spark, sf):
    return fx.processes(spark, sf).select("event_id", tx.note_keyword_count(F.col("created_files")).alias("keywords"))


@query(
    "encryption_pattern",
    f"""WITH {fx.PROCESSES}, {_BYTE_ENTROPY} SELECT event_id,
      entropy + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END > 7.2 AND len(list_filter(string_split(files, '|'), lambda f: regexp_matches(f, '[.](locky|zepto|xyz|crypt)$'))) > 0 AS encryption_pattern
    FROM processes JOIN entropies USING (doc_id)""",
)
def encryption_pattern(spark, sf):
    # Prose never reaches the entropy of cipher text, so every second event adds three bits to meet the rule.
    entropies = fx.table(spark, sf, "documents").select("doc_id", tx.byte_entropy(F.col("text")).alias("entropy"))
    joined = fx.processes(spark, sf).join(entropies, "doc_id")
    lifted = F.col("entropy") + F.when(F.col("event_id") % 2 == 0, 3).otherwise(0)
    return joined.select("event_id", tx.looks_encrypted(lifted, F.col("created_files")).alias("encryption_pattern"))


@query(
    "mail_authentication",
    """WITH headers AS (SELECT event_id, 'mx.example; SPF=' || CASE event_type WHEN 'error' THEN 'fail' ELSE 'pass' END || ' smtp.mailfrom=a; dkim='
      || CASE WHEN user_id % 3 = 0 THEN 'none' ELSE 'pass' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE '; dmarc=Pass' END AS header FROM events),
    found AS (SELECT event_id, lower(regexp_extract(header, '(?i)\\bdmarc=([a-z]+)', 1)) AS dmarc, lower(regexp_extract(header, '(?i)\\bdkim=([a-z]+)', 1)) AS dkim,
      lower(regexp_extract(header, '(?i)\\bspf=([a-z]+)', 1)) AS spf FROM headers)
    SELECT *, dmarc = 'pass' AND dkim = 'pass' AND spf = 'pass' AS authenticated FROM found""",
)
def mail_authentication(spark, sf):
    header = F.concat(
        F.lit("mx.example; SPF="),
        F.when(F.col("event_type") == "error", "fail").otherwise("pass"),
        F.lit(" smtp.mailfrom=a; dkim="),
        F.when(F.col("user_id") % 3 == 0, "none").otherwise("pass"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("; dmarc=Pass"),
    )
    return fx.table(spark, sf, "events").select("event_id", tx.mail_authentication(header).alias("a")).select("event_id", "a.*")


@query(
    "input_validation",
    f"""WITH {fx.SAMPLES}, inputs AS (SELECT 's' || sample_id AS id, url, text FROM samples
      UNION ALL SELECT 'd' || doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://a' || chr(10) || 'b' WHEN 2 THEN 'http://' || repeat('x', 2042) ELSE 'http://ok' END, text FROM documents)
    SELECT id, coalesce(CASE WHEN url IS NULL THEN 'url missing' WHEN length(url) > 2048 THEN 'url too long'
      WHEN regexp_matches(url, '[\\x00\\n\\r]') THEN 'url characters' WHEN text IS NULL THEN 'text missing'
      WHEN length(text) > 10000 THEN 'text too long' END, 'valid') AS outcome FROM inputs""",
)
def input_validation(spark, sf):
    samples = fx.samples(spark, sf).select(F.concat(F.lit("s"), F.col("sample_id").cast("string")).alias("id"), "url", "text")
    turn = F.col("doc_id") % 5
    url = (
        F.when(turn == 0, F.lit(None).cast("string"))
        .when(turn == 1, F.lit("http://a\nb"))
        .when(turn == 2, F.concat(F.lit("http://"), F.repeat(F.lit("x"), F.lit(2042))))
        .otherwise("http://ok")
    )
    documents = fx.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), url, "text")
    problem = validation.input_problem(F.col("url"), F.col("text"), longest_url=2048, longest_text=10_000)
    return samples.union(documents).select("id", F.coalesce(problem, F.lit("valid")).alias("outcome"))


# --- content indicators --------------------------------------------------------------------------------


def _match(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {fx.literal(pattern)})"


def _hits(subject: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({subject}, {fx.literal(pattern)})) AS INTEGER)"


def _sql_patterns() -> dict[str, str]:
    parts = {n: _match(p.subject, p.regex) for n, p in ind.FLAGS.items()}
    parts.update({n: _hits(p.subject, p.regex) for n, p in ind.COUNTS.items()})
    return parts


_P = _sql_patterns()
_ALL_BRANDS = "[" + ", ".join(fx.literal(b) for b in sorted(ind.BRANDS)) + "]"
_FOLDED = "translate(lower({0}), '01345', 'oleas')"
_ASCII_DOMAIN = "regexp_replace(" + _FOLDED.format("domain") + ", '[^\\x00-\\x7F]', '*', 'g')"
_NAMES = "list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: regexp_extract(p, '(?s)^([^=]*)', 1))"
_DUPLICATES = f"len({_NAMES}) > len(list_distinct({_NAMES}))"
_TOKENS_OF = f"list_transform(regexp_extract_all(text, {fx.literal(ind.JWT_HEADER)}, 1), lambda t: translate(t, '-_', '+/'))"
_HEADERS = f"list_transform({_TOKENS_OF}, lambda t: decode(TRY(from_base64(t || repeat('=', CAST((4 - length(t) % 4) % 4 AS INTEGER))))))"
_SPOOFED = r"(^|[.])(" + "|".join(sorted(ind.BRANDS)) + r")[.](com|net|org)([.]|$)"

# The composed indicators; plain patterns come straight from the pattern table.
_COMPOSED = {
    "typo_score": f"""CASE WHEN domain IN (SELECT unnest({_ALL_BRANDS})) THEN 0.0 ELSE coalesce(round(list_max(list_transform({_ALL_BRANDS},
        lambda b: 1.0 - levenshtein({_ASCII_DOMAIN}, b) / CAST(greatest(length(domain), length(b)) AS DOUBLE))), 6), 0.0) END""",
    "impersonated_brand": f"list_filter({_ALL_BRANDS}, lambda b: CASE WHEN length(b) >= 5 THEN contains({_FOLDED.format('host')}, b)"
    f" ELSE regexp_matches({_FOLDED.format('host')}, '(^|[.-])' || b || '([.-]|$)') END AND domain <> b)[1]",
    "supply_chain_risk": f"{_P['package_registry']} AND {_P['package_words']}",
    "business_email_compromise": f"{_P['executive_impersonation']} AND {_P['money_movement']}",
    "protocol_anomaly": f"{_P['request_smuggling']} OR {_DUPLICATES}",
    "cacheable_sensitive_data": f"{_P['account_path']} AND query <> ''",
    "domain_fronting": f"""contains(path, '/.well-known/') AND len(list_filter({_ALL_BRANDS},
        lambda b: contains(lower(path), b) AND NOT contains(coalesce(domain, ''), b))) > 0""",
    "sri_failure": f"{_P['integrity_values']} > {_P['sound_integrity_values']}",
    "inline_scripts": f"{_P['data_scripts']} + {_P['bare_scripts']}",
    "webshell_indicators": f"{_P['php_tag']} AND {_P['shell_call']}",
    "parameter_anomaly": _DUPLICATES,
    "path_traversal_score": f"round(least(1.0, {_P['parent_steps']} / 3.0), 6)",
    "sensitive_webhook": f"{_P['webhook_path']} AND {_P['absolute_parameter']}",
    "jwt_tampering": f"len(list_filter({_HEADERS}, lambda h: coalesce(regexp_matches(h, {fx.literal(ind.UNSIGNED_ALGORITHM)}), false))) > 0",
    "cryptojacking": f"{_P['wasm_use']} AND {_P['mine_call']}",
    "graphql_injection": f"{_P['graphql_path']} AND {_P['graphql_body']}",
    "pdf_annotation_risk": f"{_P['pdf_path']} AND fragment <> ''",
    "websocket_exfiltration": f"{_P['websocket_use']} AND {_P['websocket_flow']}",
    "oauth_security": f"CAST(CASE WHEN {_P['oauth_request']} AND NOT {_P['oauth_state']} THEN 0 ELSE 1 END AS DOUBLE)",
    "dns_tunneling": f"{_P['embedded_ipv4']} AND length(host) - length(replace(host, '.', '')) >= 5",
    "credential_stuffing": f"{_P['user_parameter']} AND {_P['password_parameter']}",
    "clickjacking": f"{_P['iframe']} AND {_P['transparent']}",
    "browser_in_browser": f"{_P['fake_chrome']} AND {_P['iframe']}",
    "mobile_deeplink_risk": "scheme NOT IN ('', 'http', 'https', 'ftp', 'mailto', 'hxxp', 'hxxps')",
    "fake_login_form": f"{_P['form']} AND {_P['password_input']}",
    "userinfo_trick": "scheme IN ('hxxp', 'hxxps') OR contains(netloc, '@')",
    "subdomain_spoofing": f"coalesce(regexp_matches(subdomain, {fx.literal(_SPOOFED)}), false)",
    "sector_risk": "CASE " + " ".join(f"WHEN {_match("whole", p)} THEN '{n}'" for n, p in ind.SECTORS) + " ELSE 'none' END",
}
_SUBJECTS = f"""{fx.RAW}, subjects AS (SELECT sample_id, url, text, coalesce(host, '') AS host, netloc, path, query, fragment, scheme,
  domain, subdomain, url || ' ' || text AS whole FROM names)"""


def indicator_sql(name: str) -> str:
    return _COMPOSED.get(name) or _P[name]


GROUPS: dict[str, tuple[str, ...]] = {
    "indicators_of_disguise": (
        "zero_width", "hidden_text", "punycode_detected", "idn_homograph", "encoding_obfuscation", "hex_encoded_host",
        "padding_attack", "userinfo_trick", "subdomain_spoofing", "null_byte_injection", "typo_score", "impersonated_brand",
    ),
    "indicators_in_query": (
        "redirect_target", "open_redirect_attempt", "parameter_anomaly", "credential_stuffing", "ssrf_attempt", "oauth_security",
        "ssti_indicators", "sensitive_webhook", "graphql_injection", "js_prototype_abuse", "cacheable_sensitive_data",
    ),
    "indicators_in_path": (
        "path_traversal_score", "sensitive_file_access", "domain_fronting", "pdf_annotation_risk", "type_spoofing", "polyglot",
        "macro_risk", "dns_tunneling", "mobile_deeplink_risk",
    ),
    "indicators_of_script": (
        "script_tags", "inline_scripts", "sri_failure", "webshell_indicators", "cryptojacking", "websocket_exfiltration", "svg_onload",
        "web_worker_risk", "spectre_indicators", "cookie_theft", "cross_origin_fetch", "client_redirect", "jwt_tampering",
    ),
    "indicators_of_markup": (
        "clickjacking", "browser_in_browser", "fake_login_form", "meta_refresh", "manifest_risk", "internal_resource_access",
        "protocol_anomaly", "smtp_injection",
    ),
    "indicators_of_persuasion": (
        "redirect_chain", "password_reset_keywords", "ransom_keywords", "urgency_words", "executive_impersonation",
        "business_email_compromise", "supply_chain_risk", "crypto_phishing", "voice_video_lure", "sector_risk", "rogue_wifi",
    ),
}


def _register_group(name: str, members: tuple[str, ...]) -> None:
    columns = ",\n  ".join(f"{indicator_sql(m)} AS {m}" for m in members)

    @query(name, f"WITH {_SUBJECTS} SELECT sample_id,\n  {columns}\nFROM subjects")
    def build(spark, sf):
        return ind.content_indicators(fx.samples(spark, sf), keep=["sample_id"], names=members)


for _name, _members in GROUPS.items():
    _register_group(_name, _members)


@query(
    "indicators_in_documents",
    "WITH subjects AS (SELECT doc_id, text, text AS whole FROM documents) SELECT doc_id, "
    + ", ".join(f"{indicator_sql(m)} AS {m}" for m in ("encoding_obfuscation", "executive_impersonation", "ransom_keywords", "urgency_words", "internal_resource_access", "smtp_injection"))
    + " FROM subjects",
)
def indicators_in_documents(spark, sf):
    names = ("encoding_obfuscation", "executive_impersonation", "ransom_keywords", "urgency_words", "internal_resource_access", "smtp_injection")
    documents = fx.table(spark, sf, "documents").withColumn("url", F.lit(""))
    return ind.content_indicators(documents, keep=["doc_id"], names=names)


@query(
    "host_header_injection",
    f"""WITH {fx.RAW} SELECT sample_id, CASE sample_id % 4 WHEN 0 THEN false WHEN 1 THEN coalesce(host <> 'legit-bank.example', false) ELSE false END AS host_header_injection
    FROM names""",
)
def host_header_injection(spark, sf):
    # A quarter of the samples has no headers, a quarter a foreign Host, the others their own in capitals.
    samples = fx.samples(spark, sf).withColumn("host", urls.url_parts(F.col("url"))["host"])
    turn = F.col("sample_id") % 4
    headers = (
        F.when(turn == 0, F.create_map().cast("map<string,string>"))
        .when(turn == 1, F.create_map(F.lit("hOST"), F.lit("Legit-Bank.example")))
        .otherwise(F.create_map(F.lit("Host"), F.upper("host")))
    )
    return samples.select("sample_id", ind.host_header_injection(headers, F.col("host")).alias("host_header_injection"))


@query(
    "rule_scores",
    f"""WITH {_SUBJECTS} SELECT sample_id, round(least(1.0, """
    + " + ".join(f"{weight} * CAST({indicator_sql(name)} AS INTEGER)" for name, weight in ind.RULE_WEIGHTS.items())
    + "), 6) AS rule_score FROM subjects",
)
def rule_scores(spark, sf):
    flagged = ind.content_indicators(fx.samples(spark, sf), keep=["sample_id"], names=list(ind.RULE_WEIGHTS))
    return flagged.select("sample_id", ind.rule_score().alias("rule_score"))
