"""Rule and black-list feeds that grow with the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import urls
from palisade.operators import feeds
from palisade.plans import fixtures as fx
from palisade.plans.registry import query

# A rule per order and page, and expressions without a literal; ``need`` only spares the SQL most of its comparisons.
_RULES = """rules AS (
  SELECT 'file' AS type, 'path-' || o_orderkey AS name, '^/(en|fr|de|es)/' || o_orderkey || '([.]html|/)?$' AS pattern, '/' || o_orderkey AS need FROM orders
  UNION ALL SELECT 'domain', 'order-host-' || o_orderkey, '(^|[.])order-' || o_orderkey || '[.]example[.](com|net)$', 'order-' || o_orderkey FROM orders
  UNION ALL SELECT 'domain', 'host-' || page_id % 50, '(?i)^' || upper(replace(host, '.', '[.]')) || '$', host FROM page_hosts WHERE page_id % 5 = 0
  UNION ALL SELECT 'domain', 'labels-' || r_regionkey, '^[a-z]{' || (r_regionkey + 4) || '}[.]', '' FROM region)"""
_PAGE_HOSTS = "page_hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages)"


def rule_feed(spark, sf):
    """Rules made of orders, pages and regions."""
    text = lambda c: F.col(c).cast("string")
    orders, region = fx.table(spark, sf, "orders"), fx.table(spark, sf, "region")
    order = text("o_orderkey")
    hosts = fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).where("page_id % 5 = 0")
    rule = lambda kind, name, pattern: (F.lit(kind).alias("type"), name.alias("name"), pattern.alias("pattern"))
    made = orders.select(*rule("file", F.concat(F.lit("path-"), order), F.concat(F.lit("^/(en|fr|de|es)/"), order, F.lit("([.]html|/)?$"))))
    made = made.union(orders.select(*rule("domain", F.concat(F.lit("order-host-"), order), F.concat(F.lit("(^|[.])order-"), order, F.lit("[.]example[.](com|net)$")))))
    exact = F.concat(F.lit("(?i)^"), F.upper(F.replace("host", F.lit("."), F.lit("[.]"))), F.lit("$"))
    made = made.union(hosts.select(*rule("domain", F.concat(F.lit("host-"), (F.col("page_id") % 50).cast("string")), exact)))
    long_label = F.concat(F.lit("^[a-z]{"), (F.col("r_regionkey") + 4).cast("string"), F.lit("}[.]"))
    return made.union(region.select(*rule("domain", F.concat(F.lit("labels-"), text("r_regionkey")), long_label))).withColumn("active", F.lit(True))


@query(
    "feed_rule_hits",
    f"""WITH {fx.DECODED}, {_PAGE_HOSTS}, {_RULES}
    SELECT DISTINCT sample_id, name FROM names JOIN rules ON type = 'domain' AND contains(host, need) AND regexp_matches(host, pattern)
    UNION SELECT DISTINCT sample_id, name FROM names JOIN rules ON type = 'file' AND contains(path, need) AND regexp_matches(path, pattern)""",
)
def feed_rule_hits(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf))
    return feeds.feed_rule_hits(parsed, "sample_id", {"domain": F.col("parts.host"), "file": F.col("parts.path")}, rule_feed(spark, sf))


_LIST = """blacklist AS (
  SELECT 'domain' AS kind, upper(host) AS value, '' AS need FROM page_hosts WHERE page_id % 7 = 0
  UNION ALL SELECT 'ip', '10.0.0.' || (c_custkey % 250), '' FROM customer
  UNION ALL SELECT 'pattern', '[?&]part=' || p_partkey || '(&|$)', 'part=' || p_partkey FROM part
  UNION ALL SELECT 'pattern', '^https?://([a-z]+[.])*' || replace(host, '.', '[.]') || '/.*[.]html$', host FROM page_hosts WHERE page_id % 3 = 0
  UNION ALL SELECT 'pattern', 'utm_source=|ref=' || repeat('x', CAST(r_regionkey AS INTEGER)), '' FROM region)"""


def blacklist_feed(spark, sf):
    """Black list made of pages, customers, parts and regions."""
    hosts = fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"))
    entry = lambda kind, value: (F.lit(kind).alias("kind"), value.alias("value"))
    made = hosts.where("page_id % 7 = 0").select(*entry("domain", F.upper("host")))
    made = made.union(fx.table(spark, sf, "customer").select(*entry("ip", F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 250).cast("string")))))
    made = made.union(fx.table(spark, sf, "part").select(*entry("pattern", F.concat(F.lit("[?&]part="), F.col("p_partkey").cast("string"), F.lit("(&|$)")))))
    page = F.concat(F.lit("^https?://([a-z]+[.])*"), F.replace("host", F.lit("."), F.lit("[.]")), F.lit("/.*[.]html$"))
    made = made.union(hosts.where("page_id % 3 = 0").select(*entry("pattern", page)))
    return made.union(fx.table(spark, sf, "region").select(*entry("pattern", F.concat(F.lit("utm_source=|ref="), F.expr("repeat('x', CAST(r_regionkey AS INT))")))))


@query(
    "feed_blacklist_matches",
    f"""WITH {fx.DECODED}, {_PAGE_HOSTS}, {_LIST}
    SELECT sample_id, kind, lower(value) AS value FROM names JOIN blacklist ON kind = 'domain' AND (lower(value) = host OR lower(value) = registered_domain)
    UNION SELECT sample_id, kind, value FROM names JOIN blacklist ON kind = 'ip' AND value = host
    UNION SELECT sample_id, kind, value FROM names JOIN blacklist ON kind = 'pattern' AND contains(lower(url), need) AND regexp_matches(url, value)""",
)
def feed_blacklist_matches(spark, sf):
    parsed = urls.with_url_parts(fx.samples(spark, sf))
    return feeds.feed_blacklist_matches(parsed, "sample_id", blacklist_feed(spark, sf), "url", F.col("parts"), F.col("names"))
