"""Rule feeds, suffix rules, address ranges: against plain Python."""

import ipaddress
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.operators import addresses, feeds, rules, suffixes


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("^/(en|fr)/728([.]html|/)?$", "/728"), ("(^|[.])order-17[.]example[.](com|net)$", "order-17.example."), ("(?i)^SPAM[.]Example$", "spam.example"),
        ("^[a-z]{5}[.]", None), ("utm_source=|ref=x", None), ("abc+de", "abc"), ("abc?de", None), ("ab{0}cdef", "cdef"), ("ab{2,}cdef", "cdef"),
        (r"\.exe\b", ".exe"), (r"\x41bcd", None), (r"a\Qbcd\E", None), ("[]a]bcd", None), ("(?x)ab c d", None), ("(?iu)abcd", None), ("a(b(c)d)efgh", "efgh"),
        (r"\[abc\]", "[abc]"), ("[^a]bcd", "bcd"), (r"foo\1bar", None), ("(?:abc)+defg", "defg"), ("(?i:abc)defg", "defg"), ("abc)d", None), ("(abc", None),
        ("Ünï-CODE", "Ünï-code"), ("", None), (None, None), ("ab", None),
    ],
)
def test_required_literals(pattern, literal):
    assert feeds.required_literal(pattern) == literal


_ATOMS = st.sampled_from(["a", "b", "ab", "abc", "[.]", "x+", "b?", "(ab|ba)", "[ab]", ".", "c{2}", "a{0,2}", r"\.", "^", "$", "(?:ca)*"])


@settings(max_examples=500, deadline=None)
@given(st.lists(_ATOMS, min_size=1, max_size=7), st.text("abcx.AB", max_size=14))
def test_every_match_holds_the_literal(atoms, text):
    pattern = "".join(atoms)
    literal = feeds.required_literal(pattern, 1)
    if literal and re.search(pattern, text):
        assert literal in feeds.folded(text)


RULES = [
    ("domain", "evil", "evil[.]example$"), ("domain", "evil", "^bad[.]"), ("domain", "any", "^[a-z]{3}[.]"), ("file", "exe", r"[.](exe|scr)$"), ("file", "backup", "/backup/"),
    ("file", "case", "(?i)SECRET"), ("file", "exact", "Secret"), ("domain", "never", None), ("file", "either", "a.zip|b.zip"),
]
ROWS = [(1, "www.evil.example", "/a/x.exe"), (2, "bad.host", "/backup/secret.txt"), (3, "abc.evil.example.org", "/Secret"), (4, None, None), (5, "", ""), (6, "WWW.EVIL.EXAMPLE", "/b.zip"), (7, "x" * 100_000 + "evil.example", "/backup/" * 1000), (1, "bad.host", "/none")]


@pytest.mark.parametrize("shard", [100_000, 2])
def test_feed_hits_like_trying_everything(spark, monkeypatch, shard):
    monkeypatch.setattr(feeds, "APART", 2)
    table = spark.createDataFrame(RULES + RULES[:2], "type string, name string, pattern string")
    rows = spark.createDataFrame([(*r, "t", 1) for r in ROWS], "id long, host string, path string, type string, key int").repartition(3)
    feed = feeds.prepare_feed(table, shard=shard)
    wanted = {(k, kind, name) for k, host, path in ROWS for kind, name, p in RULES for s in [host if kind == "domain" else path] if p and s is not None and re.search(p, s)}
    found = feed.hits(rows, "id", {"domain": F.col("host"), "file": F.col("path")}).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert feed.n_apart == 2 + 1 and feed.n_anchored == len(RULES) - 1 - 3  # "[.](exe|scr)$" has one certain character only
    assert shard > 2 or len(feed.shards) > 2


def test_a_feed_beyond_the_automata_is_joined(spark, monkeypatch):
    monkeypatch.setattr(feeds, "HELD", 1)
    monkeypatch.setattr(feeds, "PIECES", 1000)
    table = spark.createDataFrame(RULES + RULES[:2], "type string, name string, pattern string")
    rows = spark.createDataFrame([(*r, "t") for r in [*ROWS, (8, "Ünï.evil.example", "/\U0001f600backup/")]], "id long, host string, path string, subject string").repartition(3)
    feed = feeds.prepare_feed(table, shard=2)
    assert not feed.shards and feed.n_anchored
    wanted = {(r[0], kind, name) for r in [*ROWS, (8, "Ünï.evil.example", "")] for kind, name, p in RULES for s in [r[1 if kind == "domain" else 2]] if p and s is not None and re.search(p, s)}
    found = feed.hits(rows, "id", {"domain": F.col("host"), "file": F.col("path")}).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert feed.hits(rows, "id", {"other": F.col("host")}).count() == 0


def test_feeds_of_nothing(spark):
    none = spark.createDataFrame([], "type string, name string, pattern string")
    rows = spark.createDataFrame([(1, "a")], "id long, host string")
    assert feeds.prepare_feed(none).hits(rows, "id", {"domain": F.col("host")}).count() == 0
    some = spark.createDataFrame([("domain", "n", "abcd"), ("other", "n", "abcd")], none.schema)
    assert feeds.prepare_feed(some).hits(rows.limit(0), "id", {"domain": F.col("host")}).count() == 0


def test_a_large_feed_is_in_no_plan(spark):
    """A hundred thousand expressions: the plan stays as short as for a few, one scan, and hits are those of the literals."""
    many = spark.range(100_000).select(F.lit("file").alias("type"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("^/report-"), "id", F.lit("[.](pdf|doc)$")).alias("pattern"))
    rows = spark.range(0, 2000).select("id", F.concat(F.lit("/report-"), F.col("id") * 97, F.lit(".pdf")).alias("path"))
    subject = {"file": F.col("path")}
    hits = feeds.prepare_feed(many).hits(rows, "id", subject)
    few = feeds.prepare_feed(many.limit(10)).hits(rows, "id", subject)
    plans = [h._jdf.queryExecution().optimizedPlan().toString() for h in (hits, few)]
    assert len(plans[0]) < 1.2 * len(plans[1]) and "report-5" not in plans[0]
    assert sorted((r["id"], r["name"]) for r in hits.collect()) == sorted((i, f"n{i * 97}") for i in range(2000) if i * 97 < 100_000)


def test_feed_rule_hits_like_the_small_form(spark):
    table = spark.createDataFrame([(*r, n != "any") for r, n in zip(RULES, [r[1] for r in RULES])] + [("hash", "digest", "ABC", True)], "type string, name string, pattern string, active boolean")
    table = table.filter("pattern IS NOT NULL")
    rows = spark.createDataFrame([(k, h, p, "abc" if k == 2 else None) for k, h, p in ROWS[:7]], "id long, host string, path string, digest string")
    subjects = {"domain": F.col("host"), "file": F.col("path"), "hash": F.col("digest")}
    small, large = rules.rule_hits(rows, "id", subjects, table), feeds.feed_rule_hits(rows, "id", subjects, table)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


# --- suffixes

SUFFIX_RULES = ["// comment", "", "com", "mx", "com.mx  trailing words", "*.ck", "!www.ck", "co.uk", "UK", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io", "io"]
HOSTS = {
    "a.b.com.mx": ("com.mx", "b", "a", "b.com.mx"), "com.mx": ("com.mx", "", "", ""), "x.mx": ("mx", "x", "", "x.mx"), "shop.anything.ck": ("anything.ck", "shop", "", "shop.anything.ck"),
    "anything.ck": ("anything.ck", "", "", ""), "www.ck": ("ck", "www", "", "www.ck"), "a.www.ck": ("ck", "www", "a", "www.ck"), "ck": ("ck", "", "", ""),
    "bbc.co.uk": ("co.uk", "bbc", "", "bbc.co.uk"), "uk": ("uk", "", "", ""), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a", "", "a.b.kawasaki.jp"), "city.kawasaki.jp": ("kawasaki.jp", "city", "", "city.kawasaki.jp"),
    "x.city.kawasaki.jp": ("kawasaki.jp", "city", "x", "city.kawasaki.jp"), "me.github.io": ("github.io", "me", "", "me.github.io"), "un.known": ("known", "un", "", "un.known"),
    "localhost": ("localhost", "", "", ""), "10.0.0.1": ("", "10.0.0.1", "", ""), "2001:db8::1": ("", "2001:db8::1", "", ""),
}


def test_suffix_rules(spark):
    rules_table = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    hosts = spark.createDataFrame([(h, 1, "x") for h in [*HOSTS, *list(HOSTS)[:3], None]], "host string, n int, tail string")
    found = suffixes.with_names(hosts, "host", rules_table).select("host", "names.*").collect()
    assert len(found) == len(HOSTS) + 4
    assert {r["host"]: tuple(r)[1:] for r in found} == {**HOSTS, None: (None,) * 4}
    bare = suffixes.with_names(hosts, "host", rules_table.limit(0)).filter("host = 'a.b.com.mx'").select("names.suffix").first()
    assert bare[0] == "mx"


# --- addresses


def test_address_halves_like_the_standard_library(spark):
    r = random.Random(5)
    texts = ["::", "::1", "1::", "fe80::1", "2001:db8::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "10.0.0.1", "255.255.255.255", "0.0.0.0"]
    texts += ["", ":", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "::1.2.3", "::1.2.3.256", "10.0.0.256", "10.0.0", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "1:2:3:4:5:6:7:", "fe80::1%eth0", "::1:2:3:4:5:6:7:8", "1.2.3.4::", None]
    for _ in range(200):
        value = ipaddress.IPv6Address(r.getrandbits(128) & r.getrandbits(128) & ~(0xFFFF << 16 * r.randrange(8)))
        texts += [str(value), value.exploded.upper()]
    found = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", addresses.address_halves(F.col("ip")).alias("a")).collect()
    for row in found:
        try:
            value = ipaddress.ip_address(row["ip"] or "")
            number = int(value) + (0xFFFF << 32 if value.version == 4 else 0)
        except ValueError:
            number = None
        own = None if row["a"] is None else (row["a"]["high"] % 2**64) << 64 | row["a"]["low"] % 2**64
        if row["ip"] and "%" in row["ip"]:
            number = None  # zones are no part of an address here
        assert own == number, row["ip"]


def test_locations_like_comparing_bounds(spark):
    r = random.Random(6)
    ranges = [("10.0.0.0", "10.255.255.255", "A"), ("10.0.0.5", "10.0.1.7", "B"), ("10.0.0.5", "10.0.1.7", "C"), ("0.0.0.0", "255.255.255.255", "W"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "D")]
    ranges += [("2001:db8::5", "2001:db8::1:0", "E"), ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "Z"), ("10.0.0.9", "10.0.0.8", "wrong"), ("10.0.0.1", "::1", "mixed"), (None, "10.0.0.1", "none"), ("fe80::", "fe80::ffff", None)]
    for _ in range(30):
        low = r.randrange(2**32)
        ranges.append((str(ipaddress.IPv4Address(low)), str(ipaddress.IPv4Address(min(2**32 - 1, low + r.randrange(1, 2 ** r.randrange(1, 32))))), f"r{r.randrange(9)}"))
    texts = [str(ipaddress.IPv4Address(r.randrange(2**32))) for _ in range(150)] + [f"10.0.{r.randrange(3)}.{r.randrange(12)}" for _ in range(30)]
    texts += [f"2001:db8::{r.randrange(2**17):x}"[:16] for _ in range(20)] + ["2001:db8::1:0", "2001:db8::1:1", "fe80::3", "::1", "no address", None]
    bounds = []
    for a, b, value in ranges:
        try:
            x, y = ipaddress.ip_address(a or ""), ipaddress.ip_address(b or "")
        except ValueError:
            continue
        if x.version == y.version and x <= y:
            bounds.append((x, y, value))

    def narrowest(text):
        try:
            ip = ipaddress.ip_address(text or "")
        except ValueError:
            return None
        found = [(int(y) - int(x), value is not None, value or "") for x, y, value in bounds if x.version == ip.version and x <= ip <= y]
        return min(found)[2] or None if found else None

    table = spark.createDataFrame(ranges, "first string, last string, country string")
    rows = spark.createDataFrame([(t, 1, "x") for t in texts], "ip string, size int, value string")
    found = addresses.locate(rows, "ip", table, "country", "where").collect()
    assert len(found) == len(texts)
    for row in found:
        assert row["where"] == narrowest(row["ip"]), row["ip"]
