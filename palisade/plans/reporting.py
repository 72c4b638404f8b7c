"""Validation, searches, counts, series, ranks and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import numeric
from palisade.operators import features as fe
from palisade.operators import ranking, reports, validation
from palisade.plans import fixtures as fx
from palisade.plans.registry import query

# --- validation ----------------------------------------------------------------------------------------

_RAW = """raw AS (SELECT event_id,
    CASE WHEN event_id % 11 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE '10.0.0.' || user_id END AS src_ip, '8.8.8.8' AS dst_ip,
    CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN '6' WHEN 'signup' THEN 'UDP' WHEN 'purchase' THEN 'ICMP' ELSE 'SCTP?' END AS protocol,
    CASE WHEN user_id % 17 = 0 THEN 'long' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS length,
    CASE WHEN user_id % 5 = 0 THEN 'x' WHEN user_id % 5 = 1 THEN NULL ELSE '0.5' END AS confidence FROM events)"""


def raw_records(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    return fx.table(spark, sf, "events").select(
        "event_id",
        F.when(event % 11 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(event % 13 != 0, F.concat(F.lit("10.0.0."), user.cast("string"))).alias("src_ip"),
        F.lit("8.8.8.8").alias("dst_ip"),
        F.when(kind == "click", "tcp").when(kind == "view", "6").when(kind == "signup", "UDP").when(kind == "purchase", "ICMP").otherwise("SCTP?").alias("protocol"),
        F.when(user % 17 == 0, "long").otherwise(F.floor("value").cast("int").cast("string")).alias("length"),
        F.when(user % 5 == 0, "x").when(user % 5 == 1, F.lit(None).cast("string")).otherwise("0.5").alias("confidence"),
    )


_CHECKED = f"""{_RAW}, checked AS (SELECT event_id, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, src_ip, dst_ip,
    CASE upper(protocol) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE TRY_CAST(protocol AS INTEGER) END AS protocol,
    TRY_CAST(length AS INTEGER) AS length, confidence IS NOT NULL AND TRY_CAST(confidence AS DOUBLE) IS NULL AS odd_confidence FROM raw),
reasoned AS (SELECT *, concat_ws('|', CASE WHEN ts IS NULL THEN 'timestamp' END, CASE WHEN src_ip IS NULL THEN 'src_ip' END, CASE WHEN protocol IS NULL THEN 'protocol' END,
    CASE WHEN length IS NULL THEN 'length' END, CASE WHEN odd_confidence THEN 'confidence' END) AS reasons FROM checked)"""


@query(
    "record_validation",
    f"WITH {_CHECKED} SELECT event_id, epoch_us(ts) AS micros, src_ip, protocol, length FROM reasoned WHERE reasons = ''",
)
def record_validation(spark, sf):
    good = validation.valid_records(validation.validate_records(raw_records(spark, sf)))
    return good.select("event_id", F.unix_micros("timestamp").alias("micros"), "src_ip", "protocol", "length")


@query("record_quarantine", f"WITH {_CHECKED} SELECT event_id, reasons FROM reasoned WHERE reasons <> ''")
def record_quarantine(spark, sf):
    bad = validation.rejected_records(validation.validate_records(raw_records(spark, sf)))
    return bad.select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "saved_and_skipped",
    f"WITH {_CHECKED} SELECT count(*) FILTER (WHERE reasons = '') AS saved, count(*) FILTER (WHERE reasons <> '') AS skipped FROM reasoned",
)
def saved_and_skipped(spark, sf):
    """The counters come from an observation that fills in while the valid rows are written.

    It has a session of its own: once a session has observed something, ML models of that session can no
    longer ship their closures (the observation manager is not serializable).
    """
    apart = spark.newSession()
    apart.conf.set("spark.sql.session.timeZone", "UTC")
    checked = validation.validate_records(raw_records(apart, sf))
    watched, seen = reports.counted(checked, F.col("reasons"))
    validation.valid_records(watched).write.format("noop").mode("overwrite").save()
    counts = seen.get
    return fx.inline(spark, "saved, skipped", ((counts["saved"], counts["skipped"]),)).select(F.col("saved").cast("long"), F.col("skipped").cast("long"))


@query(
    "ipv4_shape",
    f"""WITH {fx.DECODED} SELECT sample_id, coalesce(regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'), false) AS ipv4 FROM parts
    UNION ALL SELECT -1 - event_id, true FROM events""",
)
def ipv4_shape(spark, sf):
    from palisade.functions import urls

    hosts = urls.with_url_parts(fx.samples(spark, sf)).select("sample_id", validation.ipv4_shaped(F.col("parts.host")).alias("ipv4"))
    addresses = fx.traffic(spark, sf).select(-1 - F.col("event_id"), validation.ipv4_shaped(F.col("src_ip")))
    return hosts.union(addresses)


@query(
    "training_schema_check",
    f"""WITH {fx.MAILS}, damaged AS (SELECT CASE WHEN doc_id % 10 = 1 THEN NULL WHEN doc_id % 10 = 2 THEN 'no scheme' ELSE url END AS url, CASE WHEN doc_id % 7 <> 3 THEN text END AS text,
        CASE WHEN doc_id % 9 = 4 THEN 2 WHEN doc_id % 9 <> 5 THEN label END AS label FROM mails)
    SELECT count(*) AS rows, count(*) FILTER (WHERE url IS NULL) AS url_missing, count(*) FILTER (WHERE NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS url_not_uri,
      count(*) FILTER (WHERE text IS NULL) AS text_missing, count(*) FILTER (WHERE label IS NULL) AS label_missing, count(*) FILTER (WHERE label NOT IN (0, 1)) AS label_out_of_range FROM damaged""",
)
def training_schema_check(spark, sf):
    doc = F.col("doc_id")
    damaged = fx.mails(spark, sf).select(
        F.when(doc % 10 == 1, F.lit(None).cast("string")).when(doc % 10 == 2, "no scheme").otherwise(F.col("url")).alias("url"),
        F.when(doc % 7 != 3, F.col("text")).alias("text"),
        F.when(doc % 9 == 4, 2).when(doc % 9 != 5, F.col("label")).alias("label"),
    )
    return validation.training_violations(damaged)


@query("term_search", f"WITH {fx.INCIDENTS} SELECT id, type, severity FROM incidents WHERE severity = 'critical'")
def term_search(spark, sf):
    return validation.term_search(fx.incidents(spark, sf), "severity", "critical").select("id", "type", "severity")


@query("term_search_first_ten", f"WITH {fx.INCIDENTS} SELECT id, type, severity FROM incidents WHERE severity = 'critical' ORDER BY id LIMIT 10")
def term_search_first_ten(spark, sf):
    return validation.term_search(fx.incidents(spark, sf), "severity", "critical", "id", 10).select("id", "type", "severity")


@query("recent_events", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_events(spark, sf):
    return validation.recent(fx.table(spark, sf, "events"), "ts").select("event_id", "event_type")


@query("severity_threshold", f"WITH {fx.INCIDENTS} SELECT id, severity FROM incidents WHERE severity IN ('high', 'critical')")
def severity_threshold(spark, sf):
    return validation.at_least(fx.incidents(spark, sf), "severity").select("id", "severity")


@query("score_threshold", "SELECT event_id, round(value / 500.0, 6) AS score FROM events WHERE value / 500.0 > 0.2")
def score_threshold(spark, sf):
    scored = fx.table(spark, sf, "events").withColumn("score", F.col("value") / F.lit(500.0))
    return validation.above(scored, "score", 0.2).select("event_id", "score")


# --- counts and series ---------------------------------------------------------------------------------


@query(
    "packet_totals",
    f"""WITH {fx.TRAFFIC} SELECT count(*) AS total_packets, count(protocol) AS ip_packets, count(*) FILTER (WHERE protocol = 6 AND syn_only) AS syn_only_packets,
      count(*) FILTER (WHERE protocol = 6 AND dport IN (3389, 445, 1433)) AS ransomware_port_packets FROM traffic""",
)
def packet_totals(spark, sf):
    return reports.packet_totals(fx.traffic(spark, sf))


@query(
    "protocol_counts",
    f"""WITH {fx.TRAFFIC} SELECT protocol, count(*) AS packets, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS protocol_name FROM traffic GROUP BY protocol""",
)
def protocol_counts(spark, sf):
    return reports.protocol_counts(fx.traffic(spark, sf))


@query(
    "protocol_distribution",
    f"""WITH {fx.TRAFFIC}, latest AS (SELECT * FROM traffic WHERE ts >= (SELECT max(ts) FROM traffic) - INTERVAL 24 HOUR)
    SELECT protocol, count(*) AS packets, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS protocol_name,
      round(count(*) * 100.0 / (SELECT count(*) FROM latest), 6) AS percent FROM latest GROUP BY protocol""",
)
def protocol_distribution(spark, sf):
    return reports.protocol_distribution(validation.recent(fx.traffic(spark, sf), "ts"))


@query(
    "scan_sources",
    f"WITH {fx.TRAFFIC} SELECT src_ip, count(*) AS syn_packets, count(DISTINCT dport) AS distinct_ports FROM traffic WHERE syn_only GROUP BY src_ip",
)
def scan_sources(spark, sf):
    return reports.scan_sources(fx.traffic(spark, sf))


@query("threat_counts", "SELECT event_type, count(*) AS threats FROM events GROUP BY event_type")
def threat_counts(spark, sf):
    return reports.threat_counts(fx.table(spark, sf, "events"), "event_type")


@query(
    "traffic_series",
    f"WITH {fx.TRAFFIC} SELECT epoch_us(time_bucket(INTERVAL 4 HOUR, ts)) AS bucket_micros, CAST(sum(length) AS BIGINT) AS traffic FROM traffic GROUP BY 1",
)
def traffic_series(spark, sf):
    series = reports.traffic_series(fx.traffic(spark, sf), "ts", "length")
    return series.select(F.unix_micros(F.col("time").cast("timestamp")).alias("bucket_micros"), "traffic")


@query(
    "class_weights",
    "SELECT toxic, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY toxic",
)
def class_weights(spark, sf):
    return reports.class_weights(fx.table(spark, sf, "labels"), "toxic")


_JUDGED = """judged AS (SELECT doc_id, toxic, CAST(n_chars % 5 < 2 AS INTEGER) AS guess, (n_chars % 97) / 97.0 AS score FROM labels JOIN documents USING (doc_id))"""


def judged(spark, sf):
    joined = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", "toxic", (F.col("n_chars") % 5 < 2).cast("int").alias("guess"), ((F.col("n_chars") % 97) / 97.0).alias("score"))


@query("confusion_matrix", f"WITH {_JUDGED} SELECT toxic, guess, count(*) AS n FROM judged GROUP BY toxic, guess")
def confusion_matrix(spark, sf):
    return reports.confusion_matrix(judged(spark, sf), "toxic", "guess")


@query(
    "classification_report",
    f"""WITH {_JUDGED}, classes AS (SELECT unnest([0, 1]) AS class), counts AS (SELECT class, count(*) FILTER (WHERE toxic = class AND guess = class) AS hits,
        count(*) FILTER (WHERE guess = class) AS guessed, count(*) FILTER (WHERE toxic = class) AS support FROM judged, classes GROUP BY class)
    SELECT class, round(hits / CAST(guessed AS DOUBLE), 6) AS precision, round(hits / CAST(support AS DOUBLE), 6) AS recall,
      round(2.0 * hits / (guessed + support), 6) AS f1, support FROM counts""",
)
def classification_report(spark, sf):
    return reports.classification_report(judged(spark, sf), "toxic", "guess")


@query(
    "ranking_quality",
    f"""WITH {_JUDGED}, ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM judged),
      sums AS (SELECT sum(toxic) AS p, count(*) - sum(toxic) AS n FROM judged),
      cuts AS (SELECT score, sum(sum(toxic)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS flagged FROM judged GROUP BY score)
    SELECT round((SELECT (sum(r) FILTER (WHERE toxic = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(n)) FROM ranked, sums), 6) AS auc,
      round((SELECT max(tp / CAST(flagged AS DOUBLE)) FROM cuts, sums WHERE tp / p >= 0.9), 6) AS precision_at_recall""",
)
def ranking_quality(spark, sf):
    return ranking.ranking_quality(judged(spark, sf), "score", "toxic")


@query(
    "feature_quantiles",
    f"""WITH {fx.FLOWS}, long AS (UNPIVOT (SELECT duration, tx_bytes, rx_bytes, tls_ratio FROM flows) ON COLUMNS(*) INTO NAME feature VALUE v)
    SELECT feature, share, round(CASE share WHEN 0.25 THEN quantile_cont(v, 0.25) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.75) END, 6) AS quantile
    FROM long, (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS share) GROUP BY feature, share""",
)
def feature_quantiles(spark, sf):
    return ranking.quantiles(fx.flows(spark, sf), ("duration", "tx_bytes", "rx_bytes", "tls_ratio"))


_FEATURES = f"""{fx.FLOWS}, features AS (SELECT *, tx_bytes / NULLIF(duration, 0) AS bytes_per_second, (tx_packets - rx_packets) * (tx_packets - rx_packets) / 2.0 AS packet_size_var,
  {fx.entropy_sql('protocol')} AS protocol_entropy FROM flows)"""


@query(
    "flow_features",
    f"""WITH {_FEATURES} SELECT l_orderkey, l_linenumber, round(tx_bytes, 9) AS tx_bytes, round(bytes_per_second, 9) AS bytes_per_second,
      round(packet_size_var, 9) AS packet_size_var, round(protocol_entropy, 9) AS protocol_entropy FROM features""",
    places=9,
)
def flow_features(spark, sf):
    return fe.traffic_features(fx.flows(spark, sf)).select(
        "l_orderkey", "l_linenumber", "tx_bytes", "bytes_per_second", "packet_size_var", "protocol_entropy"
    )


@query(
    "feature_variances",
    f"WITH {_FEATURES} SELECT " + ", ".join(f"round(var_pop({c}), 5) AS {c}" for c in ("duration", "protocol_entropy", "tls_ratio", "dns_query_freq")) + " FROM features",
)
def feature_variances(spark, sf):
    found = fe.variances(fe.traffic_features(fx.flows(spark, sf)), ("duration", "protocol_entropy", "tls_ratio", "dns_query_freq"))
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@query(
    "selected_features",
    f"""WITH {_FEATURES}, found AS (UNPIVOT (SELECT {", ".join(f"var_pop({c}) AS {c}" for c in fe.CANDIDATES)} FROM features) ON COLUMNS(*) INTO NAME feature VALUE v)
    SELECT feature, v > 0.01 OR feature IN ('bytes_per_second', 'protocol_entropy') AS selected FROM found""",
)
def selected_features(spark, sf):
    selected, removed = fe.select_features(fe.traffic_features(fx.flows(spark, sf)))
    return fx.inline(spark, "feature, selected", [(n, True) for n in selected] + [(n, False) for n in removed])


@query(
    "robust_scaled_flows",
    f"""WITH {fx.FLOWS}, fit AS (SELECT quantile_cont(duration, 0.5) AS dm, quantile_cont(duration, 0.75) - quantile_cont(duration, 0.25) AS dr,
        quantile_cont(tx_bytes, 0.5) AS tm, quantile_cont(tx_bytes, 0.75) - quantile_cont(tx_bytes, 0.25) AS tr FROM flows)
    SELECT l_orderkey, l_linenumber, round((duration - dm) / CASE dr WHEN 0 THEN 1 ELSE dr END, 6) AS duration, round((tx_bytes - tm) / CASE tr WHEN 0 THEN 1 ELSE tr END, 6) AS tx_bytes FROM flows, fit""",
)
def robust_scaled_flows(spark, sf):
    flows = fx.flows(spark, sf)
    scaled = fe.scale(flows, fe.robust_parameters(flows, ("duration", "tx_bytes")))
    return scaled.select("l_orderkey", "l_linenumber", "duration", "tx_bytes")


@query(
    "standard_scaled_flows",
    f"""WITH {fx.FLOWS}, fit AS (SELECT avg(duration) AS dm, stddev_pop(duration) AS ds, avg(tls_ratio) AS tm, stddev_pop(tls_ratio) AS ts FROM flows)
    SELECT l_orderkey, l_linenumber, round((duration - dm) / ds, 6) AS duration, round((tls_ratio - tm) / ts, 6) AS tls_ratio FROM flows, fit""",
)
def standard_scaled_flows(spark, sf):
    flows = fx.flows(spark, sf)
    scaled = fe.scale(flows, fe.standard_parameters(flows, ("duration", "tls_ratio")))
    return scaled.select("l_orderkey", "l_linenumber", "duration", "tls_ratio")


_HALVES = "early AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), late AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')"
_EDGES = "[" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10)) + "]"


def halves(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("user_id", F.col("user_id").cast("double"))
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return events.filter(F.col("ts") < middle), events.filter(F.col("ts") >= middle)


@query(
    "data_drift",
    f"""WITH {_HALVES}, edges AS (SELECT {_EDGES} AS e FROM early),
      expected AS (SELECT len(list_filter(e, lambda x: x < value)) AS bin, count(*) / CAST((SELECT count(*) FROM early) AS DOUBLE) AS p FROM early, edges GROUP BY 1),
      actual AS (SELECT len(list_filter(e, lambda x: x < value)) AS bin, count(*) / CAST((SELECT count(*) FROM late) AS DOUBLE) AS p FROM late, edges GROUP BY 1)
    SELECT 'value' AS feature, round(sum((greatest(coalesce(a.p, 0), 1e-4) - greatest(coalesce(b.p, 0), 1e-4)) * ln(greatest(coalesce(a.p, 0), 1e-4) / greatest(coalesce(b.p, 0), 1e-4))), 6) AS stability_index
    FROM actual a FULL JOIN expected b USING (bin)""",
)
def data_drift(spark, sf):
    return fe.stability_index(*halves(spark, sf), ["value"])


@query(
    "data_statistics",
    """SELECT feature, count(v) AS rows, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM (
      SELECT 'value' AS feature, value AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events) GROUP BY feature""",
)
def data_statistics(spark, sf):
    return fe.statistics(fx.table(spark, sf, "events"), ["value", "user_id"])


@query("group_variance", "SELECT event_id, round(coalesce(var_samp(value) OVER (PARTITION BY user_id), -1), 5) AS variance FROM events")
def group_variance(spark, sf):
    spread = fe.group_variance(fx.table(spark, sf, "events"), "user_id", "value", "variance")
    return spread.select("event_id", F.round(F.coalesce("variance", F.lit(-1.0)), 5).alias("variance"))


@query(
    "behavior_sequences",
    """WITH ranked AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
      kept AS (SELECT user_id, count(*) AS n, string_agg(printf('%.2f', value), ' ' ORDER BY ts, event_id) AS s FROM ranked WHERE r <= 80 GROUP BY user_id)
    SELECT user_id, trim(repeat('0.00 ', CAST(80 - n AS INTEGER)) || s) AS sequence FROM kept""",
)
def behavior_sequences(spark, sf):
    rows = fe.behavior_sequences(fx.table(spark, sf, "events"), "user_id", "ts", "event_id", "value", 80, "steps")
    shown = F.transform("steps", lambda x: F.format_string("%.2f", x))
    return rows.select("user_id", F.array_join(shown, " ").alias("sequence"))


@query(
    "api_call_rates",
    f"WITH {fx.PROCESSES} SELECT event_id, round(api_call_count / NULLIF(process_duration, 0), 6) AS calls_per_second FROM processes",
)
def api_call_rates(spark, sf):
    rate = numeric.per_second(F.col("api_call_count"), F.col("process_duration"))
    return fx.processes(spark, sf).select("event_id", rate.alias("calls_per_second"))


@query(
    "stratified_folds",
    "SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS INTEGER) AS fold FROM events",
)
def stratified_folds(spark, sf):
    return ranking.stratified_folds(fx.table(spark, sf, "events"), "event_id", "event_type").select("event_id", "event_type", "fold")


@query("newest_incidents", f"WITH {fx.INCIDENTS} SELECT id, type, severity, epoch_us(ts) AS micros FROM incidents ORDER BY ts DESC, id LIMIT 20")
def newest_incidents(spark, sf):
    top = reports.newest(fx.incidents(spark, sf), "ts", "id", 20)
    return top.select("id", "type", "severity", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query(
    "alert_cards",
    f"WITH {fx.INCIDENTS} SELECT severity, type AS title, 'user ' || user_id AS description, epoch_us(ts) AS micros FROM incidents ORDER BY severity",
)
def alert_cards(spark, sf):
    cards = reports.by_severity(fx.incidents(spark, sf), "severity", "ts", "id")
    description = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return cards.select("severity", F.col("type").alias("title"), description.alias("description"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
