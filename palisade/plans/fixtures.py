"""Security-shaped views over the given tables, in DataFrame form and as SQL for the checks."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.urls import SUFFIXES, URI
from palisade.operators.ranking import group_positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    """SQL literal, DuckDB quoting."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: Sequence[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def inline(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """Small table from literals without backslashes; its size is known to the planner."""
    return spark.sql(f"SELECT * FROM ({values(rows)}) AS t({columns})")


def cte(name: str, columns: str, rows: Sequence[tuple]) -> str:
    return f"{name}({columns}) AS ({values(rows)})"


# --- traffic -------------------------------------------------------------------------------------------

TRAFFIC = """traffic AS (
  SELECT event_id, ts, '10.0.0.' || (user_id % 250) AS src_ip, '198.51.100.' || (event_id % 250) AS dst_ip,
    CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS protocol,
    CAST(floor(value) AS INTEGER) + 64 AS length,
    CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 445 WHEN 3 THEN 3389 ELSE 22 END AS dport,
    event_type = 'click' AS syn_only, event_type, user_id, value
  FROM events)"""


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ports = F.array(*[F.lit(p) for p in (80, 443, 445, 3389, 22)])
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("198.51.100."), (F.col("event_id") % 250).cast("string")).alias("dst_ip"),
        F.when(kind == "signup", 17).when(kind == "error", 1).otherwise(6).alias("protocol"),
        (F.floor("value") + 64).cast("int").alias("length"),
        F.get(ports, (F.col("event_id") % 5).cast("int")).alias("dport"),
        (kind == "click").alias("syn_only"),
        "event_type",
        "user_id",
        "value",
    )


INCIDENTS = """incidents AS (
  SELECT event_id AS id, event_type AS type, ts, user_id, value,
    CASE WHEN value >= 70 THEN 'critical' WHEN value >= 35 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS severity
  FROM events)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    severity = F.when(value >= 70, "critical").when(value >= 35, "high").when(value >= 15, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), "ts", "user_id", "value", severity.alias("severity")
    )


FLOWS = """flows AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS duration, l_extendedprice AS tx_bytes,
    l_extendedprice * (1 - l_discount) AS rx_bytes, l_linenumber * 10 AS tx_packets, l_quantity AS rx_packets,
    l_returnflag || l_linestatus AS protocol, l_tax AS tls_ratio, l_discount AS dns_query_freq,
    CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("duration"),
        F.col("l_extendedprice").alias("tx_bytes"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rx_bytes"),
        (F.col("l_linenumber") * 10).alias("tx_packets"),
        F.col("l_quantity").alias("rx_packets"),
        F.concat("l_returnflag", "l_linestatus").alias("protocol"),
        F.col("l_tax").alias("tls_ratio"),
        F.col("l_discount").alias("dns_query_freq"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


# --- URLs and text -------------------------------------------------------------------------------------

_UNSIGNED = "eyJhbGciOiJub25lIiwidHlwIjoiSldUIn0.eyJpZCI6MX0."
_SIGNED = "eyJhbGciOiJIUzI1NiJ9.eyJpZCI6MX0.c2ln"
# Own samples, written from the definition of each indicator: inputs it must see, and inputs that only come near.
EXAMPLES: tuple[tuple[int, str, str], ...] = tuple(
    (9_000_000_000 + n, url, text)
    for n, (url, text) in enumerate(
        (
            # characters and encodings
            ("https://harbour\u200btickets.example/seat", "A zero-width space stands in the host"),
            ("https://harbour-tickets.example/seat", "A hyphen stands in the host"),
            ("https://kiosk.example/day", "<div style=\"color:red;DISPLAY :none\">ghost line</div>"),
            ("https://kiosk.example/night", "<div style=\"display:block\">plain line</div>"),
            ("https://shop.xn--bcher-kva.example/", "An encoded label below another one"),
            ("https://axn--b.example/", "The letters, but not at the start of a label"),
            ("https://b\u00fccherstube.example/", "A letter beyond ASCII in the host"),
            ("https://garden.example/\u00fcber", "A letter beyond ASCII in the path"),
            ("https://post.example/", "Body: =41=42=43=44=45 end"),
            ("https://post.example/two", "Body: =41=42 a=1 end"),
            ("https://%6Daple%2Eexample/leaf", "Escapes in the host"),
            ("https://maple.example/%6Deaf", "Escapes in the path"),
            ("https://wide.example/" + "%20" * 11 + "z", "Eleven escaped spaces in a row"),
            ("https://wide.example/" + "%20" * 9 + "z", "Nine escaped spaces in a row"),
            ("https://park:lot@orchard.example/", "Somebody in front of the host"),
            ("hxxp://orchard.example/", "A scheme written to be harmless"),
            ("https://orchard.example/a@b", "The sign in the path"),
            ("https://files.example/shell.php%00.gif", "An escaped zero byte"),
            ("https://files.example/shell.php%30.gif", "An escaped digit"),
            # imitated names
            ("https://g1thub.com/", "One digit in a known name"),
            ("https://gardenhub.com/", "A longer name of one's own"),
            ("https://netflix-billing.example/", "A known name in a longer label"),
            ("https://netflix.com/billing", "The name itself"),
            ("https://live-support.example/", "A short name between hyphens"),
            ("https://olives.example/", "A short name inside a word"),
            ("https://login.adobe.com.parcel-desk.net/x", "A known host in front of another one"),
            ("https://parcel-desk.net/adobe.com", "A known host in the path"),
            ("https://edge.example/.well-known/whatsapp/file", "A foreign name below the well-known path"),
            ("https://edge.example/.well-known/security.txt", "No foreign name"),
            # queries
            ("https://hub.example/out?next=/home&a=1", "Where to go next"),
            ("https://hub.example/out?nextday=1", "Another parameter"),
            ("https://hub.example/out?return=https%3A//far.example", "An absolute place to return to"),
            ("https://hub.example/out?return=/near", "A relative place to return to"),
            ("https://hub.example/list?id=4&sort=up&id=5", "A name twice"),
            ("https://hub.example/list?id=4&ids=5", "Two names"),
            ("https://hub.example/door?login=ann&pwd=b", "Name and pass word in the query"),
            ("https://hub.example/door?login=ann", "Only a name"),
            ("https://hub.example/fetch?src=http://192.168.7.9/", "A private address asked for"),
            ("https://hub.example/fetch?src=http://192.0.2.9/", "A public address asked for"),
            ("https://sign.example/o?response_type=token&scope=a", "A grant without state"),
            ("https://sign.example/o?response_type=token&scope=a&state=q8", "A grant with state"),
            ("https://card.example/hello?name={{ 3 * 3 }}", "A template in the query"),
            ("https://card.example/hello?name={3}", "Single braces"),
            ("https://card.example/webhook/add?to=https://far.example/in", "A hook to elsewhere"),
            ("https://card.example/webhook/add?to=inbox", "A hook to the inside"),
            ("https://data.example/graphql?query={ staff { salary } }", "A question in the query"),
            ("https://data.example/graphql", "No question"),
            ("https://data.example/set?__proto__.level=9", "A parent object in the query"),
            ("https://data.example/set?proto=9", "A plain name"),
            ("https://club.example/account/7?tab=pay", "An own page with a query"),
            ("https://club.example/account/7", "An own page without one"),
            # paths
            ("https://disk.example/a/../../b/../c", "Three steps up"),
            ("https://disk.example/a..b/c", "Dots that climb nowhere"),
            ("https://disk.example/x/etc/shadow", "A system file"),
            ("https://disk.example/etcetera", "A word that begins alike"),
            ("https://disk.example/paper.pdf#annot=4", "A part of a paper"),
            ("https://disk.example/paper.pdf", "The whole paper"),
            ("https://disk.example/tools.vhd", "A disk image"),
            ("https://disk.example/tools.vhd.txt", "Its description"),
            ("https://disk.example/cat.asp.jpeg", "Two endings"),
            ("https://disk.example/cat.jpeg", "One ending"),
            ("https://disk.example/", "Open the sheet budget.xlsm first"),
            ("https://disk.example/sheets", "Open the sheet budget.xlsx first"),
            ("https://198.51.100.7.deep.cave.example/", "An address in front of a name"),
            ("https://198.51.cave.example/", "Half an address in front of a name"),
            ("walletapp://pair/4", "A scheme of an app"),
            ("ftp://disk.example/pair/4", "A scheme of the web"),
            # scripts
            ("https://page.example/1", "<script>a()</script><SCRIPT src='b.js'></SCRIPT>"),
            ("https://page.example/2", "The word script, no tag"),
            ("https://page.example/3", "<script src=\"data:text/javascript;base64,YQ==\"></script>"),
            ("https://page.example/4", "<script src=\"/a.js\" integrity=\"sha384-tooshort\"></script>"),
            ("https://page.example/5", "<script src=\"/a.js\" integrity=\"sha256-" + "Q" * 43 + "=\"></script>"),
            ("https://page.example/6", "<?PHP passthru ($x); ?>"),
            ("https://page.example/7", "<?php print(1); ?>"),
            ("https://page.example/8", "m = WebAssembly.instantiate(c); coin.mine(m)"),
            ("https://page.example/9", "m = WebAssembly.instantiate(c)"),
            ("https://page.example/10", "s = new WebSocket(u); s.onmessage = f"),
            ("https://page.example/11", "s = new WebSocket(u)"),
            ("https://page.example/12", "<svg viewBox='0 0 1 1' onload=draw()>"),
            ("https://page.example/13", "<svg viewBox='0 0 1 1'></svg> onload"),
            ("https://page.example/14", "q = new Worker(blob)"),
            ("https://page.example/15", "q = new SharedArrayBuffer(8)"),
            ("https://page.example/16", "send(document.cookie)"),
            ("https://page.example/17", "send(document.title)"),
            ("https://page.example/18", "fetch(u, {credentials: \"include\"})"),
            ("https://page.example/19", "fetch(u, {credentials: \"omit\"})"),
            ("https://page.example/20", "window.location.replace(u)"),
            ("https://page.example/21", "Key: " + _SIGNED + " and then " + _UNSIGNED),
            ("https://page.example/22", "Key: " + _SIGNED),
            # markup
            ("https://form.example/1", "<iframe src=/pay></iframe><style>iframe { opacity : 0 }</style>"),
            ("https://form.example/2", "<iframe src=/pay></iframe><style>iframe { opacity : 0.5 }</style>"),
            ("https://form.example/3", "<div class=\"top url-bar\"></div><iframe src=/pay></iframe>"),
            ("https://form.example/4", "<div class=\"top\"></div><iframe src=/pay></iframe>"),
            ("https://form.example/5", "<FORM method=post><input name=p type=password></FORM>"),
            ("https://form.example/6", "<FORM method=post><input name=p type=text></FORM>"),
            ("https://form.example/7", "<meta http-equiv='Refresh' content='3;url=/b'>"),
            ("https://form.example/8", "<meta http-equiv='Content-Type' content='text/html'>"),
            ("https://form.example/9", "<link type=a rel='manifest' href='https://far.example/app.json'>"),
            ("https://form.example/10", "<link type=a rel='manifest' href='/app.json'>"),
            ("https://form.example/11", "See http://printer:631/ and http://172.20.0.5/x"),
            ("https://form.example/12", "See http://printer.example:631/ and http://172.40.0.5/x"),
            ("https://form.example/13", "GET /a HTTP/1.1\nHost: q\n\nGET /b HTTP/1.0\n"),
            ("https://form.example/14", "GET /a HTTP/1.1\nHost: q\n"),
            ("https://form.example/15", "From: q@r.example\nTo: s@t.example\nSubject: lunch\n\nSoup"),
            ("https://form.example/16", "From: q@r.example\nSubject: lunch\n\nSoup"),
            # persuasion
            ("https://goo.gl/Qx", "Then on by https://t.co/9 and https://bit.ly/8"),
            ("https://letter.example/1", "Verify the account, then choose a new password"),
            ("https://letter.example/2", "All drives are encrypted: pay bitcoin, and we decrypt and recover them"),
            ("https://letter.example/3", "URGENT, act within 24 hours or we suspend the card"),
            ("https://letter.example/4", "The COO asks you to transfer it today"),
            ("https://letter.example/5", "The COO asks you to lunch today"),
            ("https://letter.example/6", "The cook asks you to transfer the soup"),
            ("https://get-rubygems.example/", "A package with an update"),
            ("https://get-gems.example/", "A package with an update"),
            ("https://coin.example/?contract=0x9f", "Sign it"),
            ("https://coin.example/?contract=9f", "Sign it"),
            ("https://letter.example/7", "You have a voice message, play hello.mp4"),
            ("https://letter.example/8", "Wi-Fi in the lounge: open the page and login"),
            ("https://letter.example/9", "Wi-Fi in the lounge is free"),
            ("https://ward.example/", "Your hospital bill"),
            ("https://branch.example/", "Your invoice from the bank"),
            # forms of URLs
            ("http://192.168.1.1:8080/panel", "an address with a port"),
            ("http://[2001:db8::5]:8443/y", "the other kind of address"),
            ("https://market.co.uk:444/a/b.HTML?x=1&y=2#z", "Mr. Grey, order 212-555-0143 or 219-09-9999"),
            ("https://Guest@Press.Example.ORG/Path%2Fx+y?session=1", "SGVsbG8="),
            ("http://com/", "deadbeef"),
            ("plainword", "say \\u0041"),
            ("https://odd.example/100%", ""),
        )
    )
)
SAMPLE_COLUMNS = "sample_id, url, text"
SAMPLES = f"""samples AS (
  SELECT page_id AS sample_id, url, html AS text FROM pages
  UNION ALL SELECT * FROM ({values(EXAMPLES)}) AS e({SAMPLE_COLUMNS}))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("sample_id"), "url", F.col("html").alias("text"))
    return pages.union(spark.createDataFrame(list(EXAMPLES), "sample_id long, url string, text string"))


def parts_sql(source: str, url: str) -> str:
    """SELECT adding decoded URL parts to a source relation."""
    at = lambda group: f"regexp_extract({url}, {literal(URI)}, {group})"
    return f"""SELECT *,
    NULLIF(lower(CASE WHEN hostport LIKE '[%' THEN regexp_extract(hostport, '^\\[([^\\]]*)\\]', 1)
      ELSE regexp_extract(hostport, '^([^:]*)', 1) END), '') AS host,
    TRY_CAST(regexp_extract(hostport, ':([0-9]{{1,5}})$', 1) AS INTEGER) AS port
  FROM (SELECT *, regexp_replace(netloc, '(?s)^.*@', '') AS hostport FROM (
    SELECT *, lower({at(2)}) AS scheme, {at(4)} AS netloc, {at(5)} AS path, {at(7)} AS query, {at(9)} AS fragment
    FROM {source}))"""


_SUFFIX_LIST = ", ".join(literal(s) for s in SUFFIXES)


def names_sql(source: str) -> str:
    """SELECT adding suffix, domain, subdomain and registered_domain of ``host``."""
    tail = lambda start: f"array_to_string(labels[{start}:n], '.')"
    return f"""SELECT *,
    CASE WHEN host IS NULL THEN NULL WHEN numeric THEN '' ELSE {tail('first')} END AS suffix,
    CASE WHEN host IS NULL THEN NULL WHEN numeric THEN host WHEN first > 1 THEN labels[first - 1] ELSE '' END AS domain,
    CASE WHEN host IS NULL THEN NULL WHEN NOT numeric AND first > 2 THEN array_to_string(labels[1:first - 2], '.') ELSE '' END AS subdomain,
    CASE WHEN host IS NULL THEN NULL WHEN NOT numeric AND first > 1 THEN {tail('first - 1')} ELSE '' END AS registered_domain
  FROM (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: array_to_string(labels[i:n], '.') IN ({_SUFFIX_LIST}))), n) AS first
    FROM (SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n,
        regexp_matches(host, '^[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}$') OR contains(host, ':') AS numeric
      FROM {source}))"""


# Samples with the URL decoded first, as the URL features see it.
DECODED = f"""{SAMPLES},
decoded_samples AS (SELECT *, url_decode(url) AS decoded FROM samples),
parts AS ({parts_sql('decoded_samples', 'decoded')}),
names AS ({names_sql('parts')})"""
# Samples with the URL as it came, as the indicators see it.
RAW = f"""{SAMPLES},
parts AS ({parts_sql('samples', 'url')}),
names AS ({names_sql('parts')})"""


def entropy_sql(text: str) -> str:
    """Character entropy of a column."""
    chars = f"regexp_extract_all({text}, '(?s).')"
    share = f"(len(list_filter({chars}, lambda y: y = c)) / CAST(length({text}) AS DOUBLE))"
    return f"CASE WHEN length({text}) > 0 THEN list_sum(list_transform(list_distinct({chars}), lambda c: -{share} * log2({share}))) END"


MAILS = """mails AS (
  SELECT d.doc_id, p.url, d.text, l.toxic AS label
  FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages) p ON p.place = d.doc_id % (SELECT count(*) FROM pages))"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    size = pages.agg(F.count(F.lit(1))).scalar()
    labelled = documents.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("place", F.col("doc_id") % size)
    placed = labelled.join(by_place(pages, "page_id"), "place").join(pages.select("page_id", "url"), "page_id")
    return placed.select("doc_id", "url", "text", F.col("toxic").alias("label"))


def by_place(rows: DataFrame, key: str) -> DataFrame:
    """``(key, place)``: the place of each id among all, so that nothing depends on ids without gaps."""
    placed = group_positions(rows.select(key).withColumn("_all", F.lit(0)), "_all", [key], "place")
    return placed.select(key, "place")


# --- processes -----------------------------------------------------------------------------------------

PROCESSES = """processes AS (
  SELECT e.event_id, e.ts, e.user_id AS process_id, CAST(json_extract(e.props, '$.k') AS BIGINT) AS api_call_count,
    e.value AS process_duration, d.doc_id,
    CASE WHEN e.event_id % 7 = 0 THEN 'a.locky|README_decrypt.txt' ELSE 'b.txt' END AS files,
    CAST(e.value >= 70 AS INTEGER) AS is_ransomware
  FROM events e JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) d ON d.place = e.event_id % (SELECT count(*) FROM documents))"""


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    size = documents.agg(F.count(F.lit(1))).scalar()
    files = F.when(F.col("event_id") % 7 == 0, "a.locky|README_decrypt.txt").otherwise("b.txt")
    events = table(spark, sf_dir, "events").withColumn("place", F.col("event_id") % size).join(by_place(documents, "doc_id"), "place")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("process_id"),
        F.get_json_object("props", "$.k").cast("long").alias("api_call_count"),
        F.col("value").alias("process_duration"),
        "doc_id",
        F.split(files, "[|]").alias("created_files"),
        (F.col("value") >= 70).cast("int").alias("is_ransomware"),
    )


# --- control tables ------------------------------------------------------------------------------------

INDICATORS = (
    ("ip", "10.0.0.7", "c2_server", 0.95), ("ip", "10.0.0.7", "scanner", 0.4), ("ip", "10.0.0.9", "botnet", 0.8),
    ("ip", "198.51.100.3", "phishing", 0.7), ("domain", "spam-farm.example.org", "spam", 0.99),
)
INDICATOR_COLUMNS = "type, value, threat_type, confidence"
BRAND_NAMES = ("paypal", "google", "dropbox", "tionthan", "spam-farm", "theres")
RULE_COLUMNS = "name, type, pattern, severity, description, mitigations, active"
RULES = (
    ("Org_Host", "domain", ".*[.]example[.]org$", "medium", "hosts of one zone", "Ask the zone's owner|Watch the zone", True),
    ("Spam_Farm", "domain", "spam-farm", "critical", "link farm", "Drop its links|Watch the zone", True),
    ("Org_Host", "domain", "^press[.]", "medium", "a second pattern of the same name", "Ask the zone's owner", True),
    ("Html_File", "file", "[.](html|crypt)$", "high", "file endings", "Open it in a viewer", True),
    ("Known_Digest", "hash", sha256(b'{"k": 7}').hexdigest().upper(), "critical", "one event body, in capitals", "Take the sender off line", True),
    ("Retired", "domain", ".*", "critical", "switched off", "Nothing", False),
)
PLAYBOOK_COLUMNS = "playbook, triggers"
PLAYBOOKS = (
    ("Locked files", "mass_file_encryption"),
    ("First hour", "ransomware_detected|mass_file_encryption|lateral_movement"),
)
# playbook, step, action, type, priority, parameters as JSON
ACTION_COLUMNS = "playbook, step, action, action_type, priority, parameters"
ACTIONS = (
    ("First hour", 1, "alert_soc", "notification", "high", '{"severity":"high","recipients":"[\\"night-desk@example.net\\",\\"lead@example.net\\"]"}'),
    ("First hour", 2, "block_ioc", "firewall", "high", '{"iocs":"[\\"{c2_server}\\",\\"{malicious_hash}\\",\\"{source_ip}\\"]"}'),
    ("First hour", 3, "isolate_host", "network", None, '{"ip_address":"{source_ip}","quarantine_duration":"900"}'),
    ("Locked files", 1, "stop_backups", "storage", "critical", '{"host":"{source_ip}"}'),
    ("Locked files", 2, "collect_forensic_data", "investigation", None, '{"artifacts":"[\\"open_files\\"]"}'),
    ("Locked files", 3, "isolate_host", "network", None, '{"ip_address":"{source_ip}"}'),
)


def indicators(spark: SparkSession) -> DataFrame:
    return inline(spark, INDICATOR_COLUMNS, INDICATORS).withColumn("confidence", F.col("confidence").cast("double"))


def rules(spark: SparkSession) -> DataFrame:
    return inline(spark, RULE_COLUMNS, RULES).withColumn("mitigation", F.split("mitigations", "[|]")).drop("mitigations")


def playbooks(spark: SparkSession) -> DataFrame:
    """Playbook table with nested actions, from the two flat lists."""
    names = spark.createDataFrame(list(PLAYBOOKS), "name string, triggers string").withColumn("triggers", F.split("triggers", "[|]"))
    flat = spark.createDataFrame(
        list(ACTIONS), "name string, step int, action string, action_type string, priority string, parameters string"
    )
    steps = F.array_sort(F.collect_list(F.struct("step", "action", "action_type", "parameters", "priority")))
    action = lambda s: F.struct(
        s["action"].alias("name"),
        s["action_type"].alias("type"),
        F.from_json(s["parameters"], "map<string,string>").alias("parameters"),
        s["priority"].alias("priority"),
    )
    nested = flat.groupBy("name").agg(steps.alias("steps")).select("name", F.transform("steps", action).alias("actions"))
    return names.join(nested, "name")


ALERTS = """alerts AS (
  SELECT event_id AS alert_id,
    CASE k % 3 WHEN 0 THEN ['ransomware_detected'] WHEN 1 THEN ['mass_file_encryption', 'ransomware_detected'] ELSE ['port_scan'] END AS triggers,
    '10.0.0.' || (user_id % 250) AS source_ip, sha256(props) AS malicious_hash,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'c2-' || k || '.example' END AS c2_server
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error')"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    triggers = (
        F.when(F.col("k") % 3 == 0, F.array(F.lit("ransomware_detected")))
        .when(F.col("k") % 3 == 1, F.array(F.lit("mass_file_encryption"), F.lit("ransomware_detected")))
        .otherwise(F.array(F.lit("port_scan")))
    )
    context = F.map_filter(
        F.create_map(
            F.lit("source_ip"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
            F.lit("malicious_hash"), F.sha2("props", 256),
            F.lit("c2_server"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("c2-"), F.col("k").cast("string"), F.lit(".example"))),
        ),
        lambda k, v: v.isNotNull(),
    )
    return errors.select(F.col("event_id").alias("alert_id"), triggers.alias("triggers"), context.alias("context"))
