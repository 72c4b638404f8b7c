"""URL expressions. Everything stays in built-in functions, so it runs inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.binding import bound

# Results must equal these lists and patterns.
SHORTENERS = ("bit.ly", "goo.gl")
SUSPICIOUS_PARAMETER = r"(token|auth|session)"
ORDINARY_CHARACTERS = r"[^a-zA-Z0-9/:.?=&-]"
PERCENT_ESCAPE = r"%[0-9a-fA-F]{2}"
DOTTED_QUAD = r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$"
UNSAFE_CHARACTERS = r"[^A-Za-z0-9_.~:/?#\[\]@!$&'()*+,;=-]"
# RFC 3986, appendix B.
URI = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Public suffixes used when the caller brings no list of their own.
SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "dev", "app", "info", "biz", "xyz", "co", "me",
    "uk", "co.uk", "org.uk", "gov.uk", "ac.uk", "de", "fr", "es", "it", "nl", "eu", "ru", "cn", "com.cn",
    "jp", "co.jp", "au", "com.au", "br", "com.br", "in", "co.in", "ca", "us", "workers.dev",
)
KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


def percent_decode(url: Column) -> Column:
    """Decode ``%XX``; malformed escapes and ``+`` stay as they are."""
    guarded = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), url)


def url_parts(url: Column) -> Column:
    """Struct of scheme, netloc, host, port, path, query, fragment, userinfo."""
    netloc = F.regexp_extract(url, URI, 4)
    hostport = F.regexp_replace(netloc, r"(?s)^.*@", "")
    bracketed = F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(hostport, r"^([^:]*)", 1)
    host = F.lower(F.when(hostport.startswith("["), bracketed).otherwise(plain))
    return F.struct(
        F.lower(F.regexp_extract(url, URI, 2)).alias("scheme"),
        netloc.alias("netloc"),
        F.when(host != "", host).alias("host"),
        F.regexp_extract(hostport, r":([0-9]{1,5})$", 1).try_cast("int").alias("port"),
        F.regexp_extract(url, URI, 5).alias("path"),
        F.regexp_extract(url, URI, 7).alias("query"),
        F.regexp_extract(url, URI, 9).alias("fragment"),
        F.when(netloc.contains("@"), F.regexp_extract(netloc, r"(?s)^(.*)@", 1)).alias("userinfo"),
    )


def is_dotted_quad(text: Column) -> Column:
    return text.rlike(DOTTED_QUAD)


def domain_parts(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """Struct of suffix, domain, subdomain, registered_domain by longest public suffix.

    An unlisted host falls back to its last label; an IP address has no suffix. A large list
    becomes a hash set in the plan, so its length does not matter per row.
    """
    known = sorted(set(suffixes))
    numeric = is_dotted_quad(host) | host.contains(":")

    def split_at(labels: Column, count: Column, start: Column) -> Column:
        tail = lambda i: F.array_join(F.slice(labels, i, count), ".")
        head = F.array_join(F.slice(labels, F.lit(1), F.greatest(start - 2, F.lit(0))), ".")
        return F.struct(
            F.when(numeric, F.lit("")).otherwise(tail(start)).alias("suffix"),
            F.when(numeric, host).when(start > 1, F.get(labels, start - 2)).otherwise(F.lit("")).alias("domain"),
            F.when(~numeric & (start > 2), head).otherwise(F.lit("")).alias("subdomain"),
            F.when(~numeric & (start > 1), tail(start - 1)).otherwise(F.lit("")).alias("registered_domain"),
        )

    def of_labels(labels: Column) -> Column:
        count = F.size(labels)
        tail = lambda i: F.array_join(F.slice(labels, i, count), ".")
        first = F.array_min(F.filter(F.sequence(F.lit(1), count), lambda i: tail(i).isin(known)))
        return bound(F.coalesce(first, count), lambda start: split_at(labels, count, start))

    return F.when(host.isNotNull(), bound(F.split(host, "[.]"), of_labels))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def character_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a short string; NULL on empty."""
    chars = F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))

    def bits(letters: Column) -> Column:
        counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double"))
        total = F.size(letters).cast("double")
        return F.log2(total) - F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n * F.log2(n)) / total

    return F.when(F.length(text) > 0, bound(chars, bits))


def special_character_ratio(text: Column) -> Column:
    hits = F.regexp_count(text, F.lit(ORDINARY_CHARACTERS))
    return F.try_divide(hits.cast("double"), F.length(text).cast("double"))


def percent_escapes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PERCENT_ESCAPE)).cast("int")


def file_extension(path: Column) -> Column:
    """Lower-cased suffix of the last path segment, or ``none``; dot-files have none."""
    found = F.lower(F.regexp_extract(path, r"(?:^|/)[^/]*[^/.][^/]*?(\.[^./]+)/?$", 1))
    return F.when(found != "", found).otherwise(F.lit("none"))


def parameter_count(query: Column) -> Column:
    return F.when(query != "", F.size(F.split(query, "&"))).otherwise(F.lit(0))


def parameter_names(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1))


def obfuscation_score(url: Column, parts: Column) -> Column:
    """Share of six tricks present: userinfo, many escapes, zero-width, punycode, non-ASCII host, ``//`` in path."""
    host = F.coalesce(parts["host"], F.lit(""))
    tricks = (
        parts["netloc"].contains("@"),
        percent_escapes(url) >= 3,
        url.rlike(r"[\x{200B}-\x{200D}\x{FEFF}]"),
        host.rlike(r"(^|[.])xn--"),
        host.rlike(r"[^\x00-\x7F]"),
        parts["path"].contains("//"),
    )
    total = sum((t.cast("int") for t in tricks[1:]), tricks[0].cast("int"))
    return total / F.lit(6.0)


def canonical_url(url: Column) -> Column:
    """Same URL with the authority in lower case."""
    head = F.regexp_extract(url, r"(?s)^(([^:/?#]+:)?//)", 1)
    authority = F.regexp_extract(url, URI, 4)
    rest = F.substring(url, F.length(head) + F.length(authority) + 1, F.length(url))
    scheme_lower = F.lower(head)
    return F.when(F.regexp_extract(url, URI, 3) != "", F.concat(scheme_lower, F.lower(authority), rest)).otherwise(url)


def stripped_url(url: Column) -> Column:
    """Characters outside the URL alphabet removed."""
    return F.regexp_replace(url, UNSAFE_CHARACTERS, "")


def reverse_labels(host: Column, zone: str) -> Column:
    """``a.b.c`` to ``c.b.a.<zone>``, the query name of a DNS block list."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("." + zone))


def nearest_brand(domain: Column, brands: Sequence[str]) -> Column:
    """Struct of the smallest edit distance to a brand and that brand (ties by name).

    The brands are literals of the expression, so there is no join and no pair is shuffled.
    """
    choices = F.array(*[F.lit(b) for b in sorted(set(brands))])
    scored = F.transform(choices, lambda b: F.struct(F.levenshtein(domain, b).alias("distance"), b.alias("brand")))
    return F.array_min(scored)


def leet_folded(text: Column) -> Column:
    return F.translate(F.lower(text), "01345", "oleas")


def brand_similarity(domain: Column, brands: Sequence[str]) -> Column:
    """Best ``1 - distance / longer length`` over the brands, after folding digits that imitate letters."""
    choices = F.array(*[F.lit(b) for b in sorted(set(brands))])
    longer = lambda d, b: F.greatest(F.length(d), F.length(b)).cast("double")
    best = lambda d: F.array_max(F.transform(choices, lambda b: 1.0 - F.levenshtein(d, b) / longer(d, b)))
    return bound(leet_folded(domain), best)


def _keyboard_table() -> tuple[str, str]:
    return "".join(KEYBOARD_ROWS), "".join(str(n) * len(row) for n, row in enumerate(KEYBOARD_ROWS, 1))


def keyboard_code(text: Column) -> Column:
    """Each character replaced by its keyboard row number; others are kept."""
    return F.translate(F.lower(text), *_keyboard_table())


def keyboard_distance(domain: Column, brands: Sequence[str]) -> Column:
    """Smallest edit distance to a brand between keyboard-row codes."""
    codes = sorted({b.lower().translate(str.maketrans(*_keyboard_table())) for b in brands})
    choices = F.array(*[F.lit(c) for c in codes])
    return bound(keyboard_code(domain), lambda d: F.array_min(F.transform(choices, lambda c: F.levenshtein(d, c))))


def with_url_parts(df: DataFrame, url: str = "url", suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """Add ``decoded``, ``parts`` (of the decoded URL) and ``names`` (domain split), each computed once."""
    return (
        df.withColumn("decoded", percent_decode(F.col(url)))
        .withColumn("parts", url_parts(F.col("decoded")))
        .withColumn("names", domain_parts(F.col("parts.host"), suffixes))
    )


def url_features(df: DataFrame, url: str = "url", suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """The input columns plus one column per URL feature that needs no look-up."""
    parsed = with_url_parts(df, url, suffixes)
    p, n, decoded, raw = F.col("parts"), F.col("names"), F.col("decoded"), F.col(url)
    https = p["scheme"] == "https"
    flag = lambda c: c.cast("int")
    return parsed.select(
        *df.columns,
        flag(https).alias("uses_https"),
        F.when(https, F.coalesce(p["port"], F.lit(443))).otherwise(F.lit(80)).alias("port_number"),
        p["port"].alias("explicit_port"),
        flag(is_dotted_quad(p["host"])).alias("has_ipv4"),
        flag(p["host"].contains(":")).alias("has_ipv6"),
        flag(p["netloc"].isin(*SHORTENERS)).alias("is_shortened"),
        n["suffix"].alias("tld"),
        (count_of(n["subdomain"], ".") + 1).alias("subdomain_count"),
        F.length(n["domain"]).alias("domain_length"),
        flag(p["netloc"].startswith("xn--")).alias("is_idn"),
        n["registered_domain"].alias("registered_domain"),
        count_of(p["path"], "/").alias("path_depth"),
        parameter_count(p["query"]).alias("num_params"),
        flag(p["query"].rlike(SUSPICIOUS_PARAMETER)).alias("has_suspicious_param"),
        file_extension(p["path"]).alias("file_extension"),
        character_entropy(decoded).alias("entropy"),
        special_character_ratio(decoded).alias("special_char_ratio"),
        percent_escapes(decoded).alias("hex_char_count"),
        percent_escapes(raw).alias("raw_hex_char_count"),
        obfuscation_score(raw, p).alias("obfuscation_score"),
    )
