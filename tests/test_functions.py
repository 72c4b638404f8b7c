"""Column functions on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import indicators as ind
from palisade.functions import numeric, templates, text, urls
from palisade.plans import fixtures as fx


def one(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("r")).first()["r"]


def test_plain_url_features(spark):
    df = spark.createDataFrame([("http://phish.com",)], "url string")
    row = urls.url_features(df).first()
    assert (row.subdomain_count, row.has_ipv4, row.uses_https, row.port_number) == (1, 0, 0, 80)
    row = urls.url_features(spark.createDataFrame([("http://192.168.1.1:8080/reset",)], "url string")).first()
    assert (row.has_ipv4, row.port_number, row.explicit_port) == (1, 80, 8080)


def test_url_of_nothing_gives_nulls(spark):
    rows = urls.url_features(spark.createDataFrame([(None,), ("",)], "url string")).collect()
    assert all(r.has_ipv4 is None and r.special_char_ratio is None for r in rows)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("<script>alert(1)</script>", "scriptalert1script"),
        ("../../etc/passwd", "etcpasswd"),
        ("' OR 1=1;--", "OR11"),
        ("\x00\x1f\\|", ""),
        ("valid-input_123", "valid-input_123"),
    ],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, text.sanitize_input(F.col("t")), t=raw) == clean


@pytest.mark.parametrize("plain", ["192.168.1.1", "bad.domain.xyz", "<?php run(); ?>", "A" * 1_000_000, ""])
def test_encryption_round_trip_and_tampering(spark, plain):
    key = F.lit(b"k" * 32)
    cipher = one(spark, text.encrypt_text(F.col("t"), key), t=plain)
    assert cipher != plain and "\n" not in cipher
    assert one(spark, text.decrypt_text(F.col("t"), key), t=cipher) == plain
    assert one(spark, text.decrypt_text(F.col("t"), key), t=cipher[:-10] + "x" * 10) is None


def test_only_present_fields_are_encrypted(spark):
    row = text.encrypt_fields(spark.createDataFrame([("192.168.1.1", 6)], "src_ip string, protocol int"), ["src_ip", "nope"], F.lit(b"k" * 16)).first()
    assert row.src_ip != "192.168.1.1" and row.protocol == 6


def test_redaction(spark):
    clean = one(spark, text.redact_pii(F.col("t")), t="id 078-05-1120, call (212) 555-0187 or +1 212 555 0187")
    assert "078" not in clean and "0187" not in clean and clean.count("[REDACTED]") == 3


@pytest.mark.parametrize(
    "template, filled",
    [
        ("{a}", "1"), ("x{a}y{b}", "x1y{a}"), ("{{a}}", "{a}"), ("{missing}", None), ("open {a", None), ("plain", "plain"), ("", ""), ("{b}{a}", "{a}1"),
    ],
)
def test_templates_are_filled_in_one_pass(spark, template, filled):
    context = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("{a}"))
    assert one(spark, templates.fill_template(F.col("t"), context), t=template) == filled


@pytest.mark.parametrize("value, inside", [(float("nan"), 0.0), (1e100, 1.0), (0.0, 0.0), (-1e50, 0.0), (None, 0.0), (0.4, 0.4)])
def test_scores_are_clipped(spark, value, inside):
    assert spark.createDataFrame([(value,)], "v double").select(numeric.clipped(F.col("v"))).first()[0] == inside


def test_every_indicator_has_a_hit_and_a_miss(spark, small):
    table = ind.content_indicators(fx.samples(spark, small), keep=["sample_id"])
    quiet = {"typo_score": 0.0, "oauth_security": 1.0, "impersonated_brand": None, "sector_risk": "none"}
    aggregates = []
    for name, kind in table.dtypes:
        if name == "sample_id":
            continue
        loud = F.col(name).isNotNull() if name == "impersonated_brand" else F.col(name) != F.lit(quiet.get(name, False if kind == "boolean" else 0))
        aggregates += [F.count_if(loud).alias(name), F.count_if(~loud).alias(f"no_{name}")]
    counts = table.agg(*aggregates).first().asDict()
    assert [n for n, c in counts.items() if c == 0] == []


def test_examples_score_above_plain_pages(spark, small):
    flagged = ind.content_indicators(fx.samples(spark, small), keep=["sample_id", "url"], names=list(ind.RULE_WEIGHTS))
    scores = flagged.select("sample_id", "url", ind.rule_score().alias("s"))
    pages = scores.filter("sample_id < 9000000000").agg(F.max("s")).first()[0]
    strong = scores.filter(F.col("url").isin("https://form.example/5", "https://form.example/7", "https://page.example/6", "https://page.example/12"))
    assert strong.count() == 4 and strong.agg(F.min("s")).first()[0] > max(pages, 0.7)
