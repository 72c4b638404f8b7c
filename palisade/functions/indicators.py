"""Content indicators over a URL and the text that came with it.

All indicators are one projection: the URL is split once, the text is lower-cased once, and most text
patterns are guarded by a literal that has to occur, so a page is only handed to the regex engine when
the cheap byte search found something. Patterns stay within what Java, RE2 and Python agree on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import urls
from palisade.functions.binding import bound

# Reference table of brand names; callers may bring their own.
BRANDS = (
    "adobe", "amazon", "apple", "azure", "dropbox", "facebook", "github", "google", "instagram", "linkedin",
    "live", "microsoft", "netflix", "outlook", "paypal", "whatsapp",
)
_END = r"(?:[^A-Za-z0-9_]|$)"
_START = r"(?:^|[^A-Za-z0-9_])"
_PRIVATE = r"127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\."


@dataclass(frozen=True)
class Pattern:
    """A regex over one subject; ``guard`` lists lower-case literals of which one must be present."""

    subject: str
    regex: str
    guard: tuple[str, ...] = ()


# Flags: does the subject match?
FLAGS: dict[str, Pattern] = {
    "zero_width": Pattern("url", r"[\x{200B}-\x{200D}\x{FEFF}]"),
    "hidden_text": Pattern("text", r"(?i)display\s*:\s*none", ("display",)),
    "punycode_detected": Pattern("host", r"(^|[.])xn--"),
    "idn_homograph": Pattern("host", r"[^\x00-\x7F]"),
    "macro_risk": Pattern("whole", r"(?i)\.(docm|xlsm|pptm)" + _END, (".docm", ".xlsm", ".pptm")),
    "encoding_obfuscation": Pattern("text", r"(=[0-9A-F]{2}){4,}", ("=",)),
    "internal_resource_access": Pattern(
        "text", r"(?i)https?://(?:localhost|" + _PRIVATE + r"|[a-z0-9-]+(?:[:/\"'\s>]|$))", ("http",)
    ),
    "redirect_target": Pattern("query", r"(^|&)(target|url|next|redirect)="),
    "executive_impersonation": Pattern("text", _START + r"(CEO|CFO|COO|CTO)" + _END, ("ceo", "cfo", "coo", "cto")),
    "money_movement": Pattern("text", r"(?i)wire|transfer|funds", ("wire", "transfer", "funds")),
    "request_smuggling": Pattern(
        "text", r"(?s)(?i:transfer-encoding:\s*chunked)|HTTP/1\.[01].*HTTP/1\.[01]", ("transfer-encoding", "http/1.")
    ),
    "account_path": Pattern("path", r"(?i)profile|account"),
    "php_tag": Pattern("text", r"(?i)<\?php", ("<?php",)),
    "shell_call": Pattern("text", r"(?i)(system|exec|passthru|shell_exec|eval)\s*\(", ("(",)),
    "sensitive_file_access": Pattern("path", r"/etc/(passwd|shadow)"),
    "open_redirect_attempt": Pattern("query", r"(?i)(^|&)(redirect_uri|return|next)=https?(:|%3A)"),
    "ssti_indicators": Pattern("url", r"\{\{.+\}\}"),
    "null_byte_injection": Pattern("url", r"%00"),
    "webhook_path": Pattern("path", r"(?i)webhook"),
    "absolute_parameter": Pattern("query", r"(?i)=https?(:|%3A)"),
    "wasm_use": Pattern("text", r"WebAssembly", ("webassembly",)),
    "mine_call": Pattern("text", r"mine\(", ("mine(",)),
    "graphql_path": Pattern("path", r"graphql"),
    "graphql_body": Pattern("query", r"(?s)query\s*=?.*\{"),
    "pdf_path": Pattern("path", r"(?i)\.pdf$"),
    "websocket_use": Pattern("text", r"new WebSocket\(", ("new websocket(",)),
    "websocket_flow": Pattern("text", r"send|onmessage", ("send", "onmessage")),
    "js_prototype_abuse": Pattern("whole", r"__proto__", ("__proto__",)),
    "svg_onload": Pattern("text", r"(?i)<svg[^>]*onload", ("<svg",)),
    "oauth_request": Pattern("query", r"(^|&)response_type="),
    "oauth_state": Pattern("query", r"(^|&)state="),
    "type_spoofing": Pattern("path", r"(?i)\.(iso|img|vhd)$"),
    "embedded_ipv4": Pattern("host", r"(^|[.])([0-9]{1,3}[.]){4}"),
    "manifest_risk": Pattern(
        "text", r"(?i)<link[^>]*rel\s*=\s*[\"']manifest[\"'][^>]*href\s*=\s*[\"']https?://", ("manifest",)
    ),
    "polyglot": Pattern(
        "whole",
        r"(?i)\.(php|exe|js|jsp|asp)\.(png|jpg|jpeg|gif|pdf)" + _END
        + r"|\.(pdf|doc|docx|png|jpg|jpeg|gif)\.(php|exe|js|jsp|asp|scr)" + _END,
    ),
    "smtp_injection": Pattern("text", r"(?s)From:.*\nTo:.*\nSubject:.*\n\n", ("subject:",)),
    "user_parameter": Pattern("query", r"(?i)(^|&)(user|username|login)="),
    "password_parameter": Pattern("query", r"(?i)(^|&)(pass|password|pwd)="),
    "ssrf_attempt": Pattern(
        "query",
        r"(?i)=(?:https?://)?(?:localhost|internal" + _END + "|" + _PRIVATE + r"|[a-z0-9.-]+:[0-9]{1,5}(?:[/&]|$))",
    ),
    "iframe": Pattern("text", r"(?i)<iframe", ("<iframe",)),
    "transparent": Pattern("text", r"(?i)opacity\s*:\s*0(?:\.0+)?\s*[;}\"']", ("opacity",)),
    "fake_chrome": Pattern("text", r"(?i)class\s*=\s*\"[^\"]*(browser-chrome|url-bar)", ("browser-chrome", "url-bar")),
    "web_worker_risk": Pattern("text", r"new Worker\(", ("new worker(",)),
    "crypto_phishing": Pattern("whole", r"(?i)wallet|metamask|contract=0x", ("wallet", "metamask", "contract=0x")),
    "spectre_indicators": Pattern("text", r"SharedArrayBuffer", ("sharedarraybuffer",)),
    "meta_refresh": Pattern("text", r"(?i)http-equiv\s*=\s*[\"']?refresh", ("http-equiv",)),
    "form": Pattern("text", r"(?i)<form", ("<form",)),
    "password_input": Pattern("text", r"(?i)type\s*=\s*[\"']?password", ("password",)),
    "cookie_theft": Pattern("text", r"document\.cookie", ("document.cookie",)),
    "cross_origin_fetch": Pattern("text", r"credentials:\s*['\"]include['\"]", ("credentials:",)),
    "hex_encoded_host": Pattern("netloc", r"%[0-9A-Fa-f]{2}"),
    "padding_attack": Pattern("url", r"(%20){10,}"),
    "voice_video_lure": Pattern(
        "whole", r"(?i)voice.?(?:message|verification)|\.mp[34]" + _END, ("voice", ".mp3", ".mp4")
    ),
    "client_redirect": Pattern("text", r"window\.location|navigator\.userAgent", ("window.", "navigator.")),
    "rogue_wifi": Pattern("whole", r"(?i)wi-?fi.*login", ("wifi", "wi-fi")),
    "package_registry": Pattern("host", r"npm|pypi|maven|nuget|rubygems|docker"),
    "package_words": Pattern("whole", r"(?i)update|package", ("update", "package")),
}

# Counts: how often does the subject match?
COUNTS: dict[str, Pattern] = {
    "redirect_chain": Pattern(
        "whole", r"(?i)//(?:bit\.ly|goo\.gl|tinyurl\.com|t\.co)(?:[/?#\s]|$)", ("bit.ly", "goo.gl", "tinyurl.com", "t.co")
    ),
    "script_tags": Pattern("text", r"(?i)<script", ("<script",)),
    "password_reset_keywords": Pattern("whole", r"(?i)reset|password|verify|account"),
    "ransom_keywords": Pattern("text", r"(?i)encrypt|decrypt|btc|bitcoin|pay|recover"),
    "integrity_values": Pattern("text", r"(?i)integrity\s*=", ("integrity",)),
    "sound_integrity_values": Pattern(
        "text", r"(?i)integrity\s*=\s*[\"']?sha(?:256|384|512)-[A-Za-z0-9+/]{43,}={0,2}", ("integrity",)
    ),
    "data_scripts": Pattern("text", r"(?i)src\s*=\s*[\"']data:", ("data:",)),
    "bare_scripts": Pattern("text", r"(?i)<script>", ("<script>",)),
    "parent_steps": Pattern("url", r"\.\./"),
    "urgency_words": Pattern("text", r"(?i)urgent|suspend|immediate|verify|within|24 hours"),
}

# Sector by key word, first match wins.
SECTORS: tuple[tuple[str, str], ...] = (
    ("healthcare", r"(?i)medicare|covid|hospital|patient"),
    ("finance", r"(?i)bank|paypal|invoice|tax refund|wire transfer"),
    ("technology", r"(?i)microsoft|google|github|npm|pypi"),
)
JWT_HEADER = r"(eyJ[A-Za-z0-9_-]+)[.]"
UNSIGNED_ALGORITHM = r"(?i)\"alg\"\s*:\s*\"none\""
WEB_SCHEMES = ("", "http", "https", "ftp", "mailto", "hxxp", "hxxps")

# Weights of the rule score; a count contributes its weight per hit.
RULE_WEIGHTS: dict[str, float] = {
    "zero_width": 0.9, "hidden_text": 0.4, "punycode_detected": 0.7, "idn_homograph": 0.9, "macro_risk": 0.7,
    "encoding_obfuscation": 0.5, "internal_resource_access": 0.6, "open_redirect_attempt": 0.7,
    "business_email_compromise": 0.8, "protocol_anomaly": 0.5, "sri_failure": 0.5, "webshell_indicators": 1.0,
    "parameter_anomaly": 0.5, "sensitive_file_access": 0.9, "ssti_indicators": 0.8, "null_byte_injection": 0.9,
    "sensitive_webhook": 0.6, "jwt_tampering": 0.8, "cryptojacking": 0.8, "websocket_exfiltration": 0.6,
    "js_prototype_abuse": 0.7, "svg_onload": 0.8, "dns_tunneling": 0.8, "polyglot": 0.85, "smtp_injection": 0.7,
    "credential_stuffing": 0.7, "ssrf_attempt": 0.7, "clickjacking": 0.8, "browser_in_browser": 0.9,
    "meta_refresh": 0.75, "fake_login_form": 1.0, "cookie_theft": 0.7, "userinfo_trick": 0.9,
    "subdomain_spoofing": 0.95, "hex_encoded_host": 0.9, "padding_attack": 0.7, "urgency_words": 0.2,
    "script_tags": 0.02,
}


def _guarded(pattern: Pattern, hit: Column, miss: Column) -> Column:
    if not pattern.guard:
        return hit
    haystack = {"text": "lower_text", "whole": "lower_whole"}[pattern.subject]
    present = F.col(haystack).contains(pattern.guard[0])
    for literal in pattern.guard[1:]:
        present = present | F.col(haystack).contains(literal)
    return F.when(present, hit).otherwise(miss)


def _flag(name: str) -> Column:
    p = FLAGS[name]
    return _guarded(p, F.col(p.subject).rlike(p.regex), F.lit(False))


def _count(name: str) -> Column:
    p = COUNTS[name]
    return _guarded(p, F.regexp_count(F.col(p.subject), F.lit(p.regex)).cast("int"), F.lit(0))


def _duplicate_parameters() -> Column:
    return bound(urls.parameter_names(F.col("query")), lambda names: F.size(names) > F.size(F.array_distinct(names)))


def _unsigned_token() -> Column:
    """Does any token of the text have a header that asks for no signature?"""

    def unsigned(found: Column) -> Column:
        token = F.translate(found, "-_", "+/")
        padded = F.concat(token, F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))))
        header = F.try_to_binary(padded, F.lit("base64")).cast("string")
        return F.coalesce(header.rlike(UNSIGNED_ALGORITHM), F.lit(False))

    tokens = F.regexp_extract_all(F.col("text"), F.lit(JWT_HEADER), F.lit(1))
    return F.when(F.col("text").contains("eyJ"), F.exists(tokens, unsigned)).otherwise(False)


def _impersonated(brands: Sequence[str]) -> Column:
    """First brand inside the leet-folded host although the registered name is not the brand's.

    A name of fewer than five letters counts only as a whole label or between hyphens: it is part of too many words.
    """
    names = F.array(*[F.lit(b) for b in sorted(set(brands))])
    whole = lambda host, b: F.rlike(host, F.concat(F.lit("(^|[.-])"), b, F.lit("([.-]|$)")))
    named = lambda host, b: F.when(F.length(b) >= 5, F.contains(host, b)).otherwise(F.contains(host, b) & whole(host, b))
    inside = lambda host: F.filter(names, lambda b: named(host, b) & (F.col("names.domain") != b))
    return F.get(bound(urls.leet_folded(F.col("host")), inside), F.lit(0))


def _fronted(brands: Sequence[str]) -> Column:
    choices = F.array(*[F.lit(b) for b in sorted(set(brands))])
    own = F.coalesce(F.col("names.domain"), F.lit(""))
    foreign = bound(F.lower("path"), lambda path: F.exists(choices, lambda b: F.contains(path, b) & ~F.contains(own, b)))
    return F.col("path").contains("/.well-known/") & foreign


def _typo_score(brands: Sequence[str]) -> Column:
    score = urls.brand_similarity(F.col("names.domain"), brands)
    return F.when(F.col("names.domain").isin(*brands), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def _sector() -> Column:
    column = F.when(F.col("whole").rlike(SECTORS[0][1]), SECTORS[0][0])
    for name, regex in SECTORS[1:]:
        column = column.when(F.col("whole").rlike(regex), name)
    return column.otherwise("none")


def indicator_columns(brands: Sequence[str] = BRANDS) -> dict[str, Column]:
    """Indicator name to expression over the subject columns of ``with_subjects``."""
    spoofed = r"(^|[.])(" + "|".join(sorted(set(brands))) + r")[.](com|net|org)([.]|$)"
    plain = (
        "zero_width", "hidden_text", "punycode_detected", "idn_homograph", "macro_risk", "encoding_obfuscation",
        "internal_resource_access", "redirect_target", "executive_impersonation", "sensitive_file_access",
        "open_redirect_attempt", "ssti_indicators", "null_byte_injection", "js_prototype_abuse", "svg_onload",
        "type_spoofing", "manifest_risk", "polyglot", "smtp_injection", "ssrf_attempt", "web_worker_risk",
        "crypto_phishing", "spectre_indicators", "meta_refresh", "cookie_theft", "cross_origin_fetch",
        "hex_encoded_host", "padding_attack", "voice_video_lure", "client_redirect", "rogue_wifi",
    )
    columns = {name: _flag(name) for name in plain}
    for name in ("redirect_chain", "script_tags", "password_reset_keywords", "ransom_keywords", "urgency_words"):
        columns[name] = _count(name)
    impersonated = _impersonated(brands)
    columns.update(
        typo_score=_typo_score(brands),
        impersonated_brand=impersonated,
        supply_chain_risk=_flag("package_registry") & _flag("package_words"),
        business_email_compromise=_flag("executive_impersonation") & _flag("money_movement"),
        protocol_anomaly=_flag("request_smuggling") | _duplicate_parameters(),
        cacheable_sensitive_data=_flag("account_path") & (F.col("query") != ""),
        domain_fronting=_fronted(brands),
        sri_failure=_count("integrity_values") > _count("sound_integrity_values"),
        inline_scripts=_count("data_scripts") + _count("bare_scripts"),
        webshell_indicators=_flag("php_tag") & _flag("shell_call"),
        parameter_anomaly=_duplicate_parameters(),
        path_traversal_score=F.least(F.lit(1.0), _count("parent_steps") / F.lit(3.0)),
        sensitive_webhook=_flag("webhook_path") & _flag("absolute_parameter"),
        jwt_tampering=_unsigned_token(),
        cryptojacking=_flag("wasm_use") & _flag("mine_call"),
        graphql_injection=_flag("graphql_path") & _flag("graphql_body"),
        pdf_annotation_risk=_flag("pdf_path") & (F.col("fragment") != ""),
        websocket_exfiltration=_flag("websocket_use") & _flag("websocket_flow"),
        oauth_security=F.when(_flag("oauth_request") & ~_flag("oauth_state"), F.lit(0.0)).otherwise(F.lit(1.0)),
        dns_tunneling=_flag("embedded_ipv4") & (urls.count_of(F.col("host"), ".") >= 5),
        credential_stuffing=_flag("user_parameter") & _flag("password_parameter"),
        clickjacking=_flag("iframe") & _flag("transparent"),
        browser_in_browser=_flag("fake_chrome") & _flag("iframe"),
        mobile_deeplink_risk=~F.col("scheme").isin(*WEB_SCHEMES),
        fake_login_form=_flag("form") & _flag("password_input"),
        userinfo_trick=F.col("scheme").isin("hxxp", "hxxps") | F.col("netloc").contains("@"),
        subdomain_spoofing=F.coalesce(F.col("names.subdomain").rlike(spoofed), F.lit(False)),
        sector_risk=_sector(),
    )
    return columns


def host_header_injection(headers: Column, host: Column) -> Column:
    """The Host header names another host than the URL; false when there is none."""
    named = F.map_filter(headers, lambda name, _: F.lower(name) == "host")  # header names have no case
    return F.coalesce(F.exists(F.map_values(named), lambda value: F.lower(value) != host), F.lit(False))


def with_subjects(
    df: DataFrame, url: str = "url", text: str = "text", suffixes: Iterable[str] = urls.SUFFIXES
) -> DataFrame:
    """Add the columns the indicators look at; the URL is split once and kept as columns."""
    split = df.withColumns({"url": F.coalesce(F.col(url), F.lit("")), "text": F.coalesce(F.col(text), F.lit(""))})
    split = split.withColumn("parts", urls.url_parts(F.col("url")))
    fields = {f: F.coalesce(F.col(f"parts.{f}"), F.lit("")) for f in ("host", "netloc", "path", "query", "fragment", "scheme")}
    split = split.withColumns({**fields, "whole": F.concat_ws(" ", "url", "text")})
    return split.withColumns(
        {
            "names": urls.domain_parts(F.col("parts.host"), suffixes),
            "lower_text": F.lower("text"),
            "lower_whole": F.lower("whole"),
        }
    )


def content_indicators(
    df: DataFrame,
    url: str = "url",
    text: str = "text",
    keep: Sequence[str] = (),
    names: Sequence[str] | None = None,
    brands: Sequence[str] = BRANDS,
    headers: str | None = None,
) -> DataFrame:
    """Columns ``keep`` and the indicators ``names`` (all by default); the others are pruned from the plan."""
    columns = indicator_columns(brands)
    if headers:
        columns["host_header_injection"] = host_header_injection(F.col(headers), F.col("host"))
    chosen = names or list(columns)
    return with_subjects(df, url, text).select(*keep, *[columns[n].alias(n) for n in chosen])


def rule_score() -> Column:
    """Weighted sum of the indicators in ``RULE_WEIGHTS``, held within [0, 1]."""
    total = F.lit(0.0)
    for name, weight in RULE_WEIGHTS.items():
        total = total + F.coalesce(F.col(name).cast("int"), F.lit(0)) * F.lit(weight)
    return F.least(F.lit(1.0), total)
