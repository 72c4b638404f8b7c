"""Anomaly forest, classifiers and score arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import indicators as ind
from palisade.functions import text as tx
from palisade.functions import urls
from palisade.functions.text import byte_entropy
from palisade.operators import enrichment, features, models, ranking, reports, response, scoring, sequences, validation
from palisade.operators.forest import IsolationForest
from palisade.plans import fixtures as fx
from palisade.plans.content import demo_key
from palisade.plans.intel import INTELLIGENCE_SQL, dns_records, reference_time, registrations, url_intelligence_of, url_intelligence_table
from palisade.plans.registry import query
from palisade.storage import materialize, scratch_path
from palisade.sources import sinks
from palisade.streaming import detection

# --- score arithmetic ----------------------------------------------------------------------------------


@query("ensemble_scores", "SELECT event_id, round(user_id / 150.0 * (1 - (value / 1000.0 - 0.2)), 6) AS score FROM events")
def ensemble_scores(spark, sf):
    combined = scoring.ensemble_score(F.col("user_id") / F.lit(150.0), F.col("value") / F.lit(1000.0) - F.lit(0.2))
    return fx.table(spark, sf, "events").select("event_id", combined.alias("score"))


def member_scores(spark, sf, members: int = 5):
    """Repeated predictions of each document, spread by its size."""
    documents = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return [documents.select("doc_id", ((F.col("n_chars") * (m + 3) % 101) / 100.0).alias("ml_score")) for m in range(members)]


_MEMBERS = """members AS (SELECT doc_id, (n_chars * (m + 3) % 101) / 100.0 AS ml_score FROM documents, (SELECT unnest(range(5)) AS m)),
uncertain AS (SELECT doc_id, avg(ml_score) AS mean_score, stddev_pop(ml_score) AS uncertainty FROM members GROUP BY doc_id)"""


@query(
    "prediction_uncertainty",
    f"WITH {_MEMBERS} SELECT doc_id, round(mean_score, 6) AS mean_score, round(uncertainty, 6) AS uncertainty FROM uncertain",
)
def prediction_uncertainty(spark, sf):
    return scoring.uncertainty(member_scores(spark, sf), "doc_id", "ml_score")


@query(
    "fused_verdicts",
    f"""WITH {INTELLIGENCE_SQL}, scored AS (SELECT sample_id, browsing_malicious OR blacklisted OR dbl_listed AS hit, (length(url) % 11) / 10.0 AS ml, (length(url) % 7) / 6.0 AS rule,
      (length(url) % 3) / 10.0 AS uncertainty FROM intelligence)
    SELECT sample_id, hit OR 0.6 * ml + 0.4 * rule > 0.5 + 0.1 * uncertainty AS verdict FROM scored""",
)
def fused_verdicts(spark, sf):
    size = F.length("url")
    share = lambda n, of: (size % n) / F.lit(of)
    verdict = scoring.fused_verdict(share(11, 10.0), share(7, 6.0), share(3, 10.0), enrichment.intelligence_hit(F.col("intel")))
    return url_intelligence_table(spark, sf).select("sample_id", verdict.alias("verdict"))


@query(
    "tamed_scores",
    """SELECT event_id, round(0.6 * least(1, greatest(0, coalesce(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1e100 WHEN 3 THEN -1e50 ELSE value / 500 END, 0)))
      + 0.25 * (user_id % 6) / 5.0 + 0.15 * least(1, (user_id % 120) / 92.0), 6) AS threat_score FROM events""",
)
def tamed_scores(spark, sf):
    turn = F.col("event_id") % 5
    confidence = (
        F.when(turn == 0, F.lit(None).cast("double"))
        .when(turn == 1, F.lit(float("nan")))
        .when(turn == 2, F.lit(1e100))
        .when(turn == 3, F.lit(-1e50))
        .otherwise(F.col("value") / 500)
    )
    score = scoring.threat_score(confidence, F.col("user_id") % 6, F.col("user_id") % 120)
    return fx.table(spark, sf, "events").select("event_id", score.alias("threat_score"))


# --- isolation forest ----------------------------------------------------------------------------------


def anomaly_vectors(spark, sf):
    """Embeddings as sixteen features; each hundredth row is pushed out by a factor of five."""
    planted = F.col("vec_id") % 100 == 0
    stretch = F.when(planted, 5.0).otherwise(1.0)
    parts = [(F.get("embedding", F.lit(i)).cast("double") * stretch).alias(f"f{i}") for i in range(16)]
    return fx.table(spark, sf, "embeddings").select("vec_id", planted.alias("planted"), *parts)


VECTOR_COLUMNS = [f"f{i}" for i in range(16)]


@query("anomaly_scores")
def anomaly_scores(spark, sf):
    vectors = anomaly_vectors(spark, sf)
    forest = IsolationForest.fit(vectors, "vec_id", VECTOR_COLUMNS)
    return forest.training.join(vectors.select("vec_id", "planted"), "vec_id")


@query("flow_anomalies")
def flow_anomalies(spark, sf):
    """Features chosen by variance, robust scaling, forest, and the rows below the contamination quantile."""
    flows = features.traffic_features(fx.flows(spark, sf)).withColumn("flow_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "tx_bytes"))
    selected, _ = features.select_features(flows)
    flows = materialize(flows.select("flow_id", *selected), "flow-features")
    scaled = materialize(features.scale(flows, features.robust_parameters(flows, selected)), "scaled-flows")
    forest = IsolationForest.fit(scaled, "flow_id", selected)
    return forest.training.select("flow_id", "anomaly", "decision").filter(F.col("decision") < 0)


@query("poisoning_signal")
def poisoning_signal(spark, sf):
    vectors = anomaly_vectors(spark, sf)
    forest = IsolationForest.fit(vectors, "vec_id", VECTOR_COLUMNS, contamination=0.1)
    return reports.mean_score(forest.training)


@query("forest_reloaded", "SELECT vec_id, true AS same FROM embeddings")
def forest_reloaded(spark, sf):
    vectors = anomaly_vectors(spark, sf)
    forest = IsolationForest.fit(vectors, "vec_id", VECTOR_COLUMNS)
    path = scratch_path(spark, "forest")
    forest.save(path)
    again = IsolationForest.load(spark, path)
    before = forest.score(vectors, keep=["vec_id"]).withColumnRenamed("decision", "first")
    after = again.score(vectors, keep=["vec_id"]).withColumnRenamed("decision", "second")
    return before.join(after, "vec_id").select("vec_id", (F.col("first") == F.col("second")).alias("same"))


# --- classifiers ---------------------------------------------------------------------------------------


def labelled_flows(spark, sf):
    return fx.flows(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "duration",
        F.when(F.col("protocol").endswith("O"), 6).otherwise(17).alias("proto"),
        F.col("tx_bytes").alias("src_bytes"),
        F.col("rx_bytes").alias("dst_bytes"),
        F.col("tx_packets").alias("packets"),
        (F.col("tx_bytes") / F.col("duration")).alias("bytes_per_sec"),
        F.col("l_linenumber").alias("dst_host_srv_count"),
        "label",
        F.when(F.col("protocol").startswith("R"), 2).when(F.col("protocol").startswith("A"), 1).otherwise(0).alias("class"),
    )


def flow_split(spark, sf):
    """Labelled flows, written once, with a stratified fold; fold 0 is the held-out fifth."""
    keyed = labelled_flows(spark, sf).withColumn("flow_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "src_bytes"))
    return materialize(ranking.stratified_folds(keyed, "flow_id", "class"), "flow-split")


@query("flow_classification")
def flow_classification(spark, sf):
    """Normal, suspicious or malicious (0, 1, 2): learnt from four folds, told for the fifth."""
    split = flow_split(spark, sf)
    model = models.train_flow_classifier(split.filter("fold <> 0"), "class")
    return models.classify_flows(model, split.filter("fold = 0")).select("l_orderkey", "l_linenumber", "class", "verdict", "confidence")


@query("flow_feature_importance")
def flow_feature_importance(spark, sf):
    flows = materialize(labelled_flows(spark, sf), "flows")
    return models.feature_importance(models.train_flow_classifier(flows), flows)


def mail_split(spark, sf):
    return materialize(ranking.stratified_folds(fx.mails(spark, sf), "doc_id", "label"), "mail-split")


@query("phishing_scores")
def phishing_scores(spark, sf):
    """Scores of the mails of fold 0 by a model of the others."""
    split = mail_split(spark, sf)
    parsed = urls.with_url_parts(split)
    facts = materialize(enrichment.domain_facts(registrations(parsed), dns_records(parsed)[0], reference_time()), "domain-facts")
    return models.score_phishing(models.train_phishing(split.filter("fold <> 0"), facts=facts), split.filter("fold = 0"), ["doc_id", "label"], facts)


@query("phishing_cross_validation")
def phishing_cross_validation(spark, sf):
    return models.cross_validate(fx.mails(spark, sf), "doc_id")


@query("bootstrap_uncertainty")
def bootstrap_uncertainty(spark, sf):
    members = models.bootstrap_scores(fx.mails(spark, sf), "doc_id")
    return scoring.uncertainty(members, "doc_id", "ml_score")


@query("phishing_verdicts")
def phishing_verdicts(spark, sf):
    """Mails from input check to a hashed verdict: canonical URL, intelligence, model with uncertainty, rules, fusion.

    A mail that the check refuses keeps its reason and gets no prediction.
    """
    mails = fx.mails(spark, sf).withColumns({"problem": validation.input_problem(F.col("url"), F.col("text")), "canonical": urls.canonical_url(F.col("url"))})
    mails = materialize(mails, "mails")
    good = mails.filter("problem IS NULL")
    scores = scoring.uncertainty(models.bootstrap_scores(good, "doc_id"), "doc_id", "ml_score")
    flags = ind.content_indicators(good, keep=["doc_id"], names=list(ind.RULE_WEIGHTS)).select("doc_id", ind.rule_score().alias("rule_score"))
    links = good.select("canonical").distinct().select(F.xxhash64("canonical").alias("sample_id"), F.col("canonical").alias("url"))
    intel = url_intelligence_of(spark, sf, links).select(F.col("url").alias("canonical"), enrichment.intelligence_hit(F.col("intel")).alias("hit"))
    found = mails.join(scores, "doc_id", "left").join(flags, "doc_id", "left").join(intel, "canonical", "left")
    fused = scoring.fused_verdict(F.col("mean_score"), F.col("rule_score"), F.col("uncertainty"), F.col("hit"))
    return found.withColumn("prediction", F.when(F.col("problem").isNull(), fused)).select(
        "doc_id", F.sha2("canonical", 256).alias("url_hash"), "problem", "hit", "rule_score", "prediction", F.col("mean_score").alias("risk_score"), "uncertainty"
    )


_SCORED = "scored AS (SELECT doc_id, toxic AS label, (n_chars % 97) / 97.0 AS score FROM labels JOIN documents USING (doc_id))"


def scored_labels(spark, sf):
    joined = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", F.col("toxic").alias("label"), ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"))


_DECILES = "[" + ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10)) + "]"


@query(
    "score_reliability",
    f"""WITH {_SCORED}, edges AS (SELECT {_DECILES} AS e FROM scored)
    SELECT CAST(len(list_filter(e, lambda x: x < score)) AS INTEGER) AS bin, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed, count(*) AS rows FROM scored, edges GROUP BY 1""",
)
def score_reliability(spark, sf):
    return models.reliability(scored_labels(spark, sf), "score", "label")


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    """A mail model of three folds, its scores mapped to observed rates by a fourth, applied to the fifth."""
    split = mail_split(spark, sf)
    model = models.train_phishing(split.filter("fold > 1"))
    scored = materialize(models.score_phishing(model, split.filter("fold < 2"), ["doc_id", "label", "fold"]).withColumnRenamed("ml_score", "score"), "scored-split")
    mapping = models.calibrate(scored.filter("fold = 1"), "score", "label")
    return models.apply_calibration(mapping, scored.filter("fold = 0"), "score").select("doc_id", "label", "score", "calibrated")


def measured_processes(spark, sf):
    """Processes with the entropy of their document, measured once per document: no text goes with an event."""
    documents = fx.table(spark, sf, "documents").select("doc_id", byte_entropy(F.col("text")).alias("entropy"))
    return fx.processes(spark, sf).join(documents, "doc_id").filter(F.col("process_id").isNotNull())


def process_samples(spark, sf):
    """Measured processes with the summary of their behaviour sequence, made once per process."""
    sequences = features.behavior_sequences(fx.processes(spark, sf), "process_id", "ts", "event_id", "api_call_count")
    return measured_processes(spark, sf).join(models.sequence_summary(sequences), "process_id")


@query(
    "process_features",
    f"""WITH {fx.PROCESSES}, bytes AS (SELECT doc_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents),
      counts AS (SELECT doc_id, b, CAST(count(*) AS DOUBLE) AS n FROM bytes WHERE b <> '' GROUP BY doc_id, b),
      shares AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM counts),
      entropies AS (SELECT doc_id, -sum(p * log2(p + 1e-9)) AS entropy FROM shares GROUP BY doc_id)
    SELECT event_id, process_id, round(entropy, 6) AS entropy, round(api_call_count / NULLIF(process_duration, 0), 6) AS api_calls_per_sec,
      round(coalesce(var_samp(entropy) OVER (PARTITION BY process_id), -1), 6) AS file_entropy_variance FROM processes JOIN entropies USING (doc_id)""",
)
def process_features(spark, sf):
    rated = features.process_features(measured_processes(spark, sf)).fillna(-1.0, ["file_entropy_variance"])
    return rated.select("event_id", "process_id", "entropy", "api_calls_per_sec", "file_entropy_variance")


def ransomware_split(spark, sf):
    """Process inputs, written once, with a stratified fold; fold 0 is the held-out fifth."""
    inputs = models.process_inputs(process_samples(spark, sf)).select("event_id", "process_id", "is_ransomware", *models.PROCESS_NUMBERS)
    return materialize(ranking.stratified_folds(inputs, "event_id", "is_ransomware"), "process-inputs")


@query("ransomware_report")
def ransomware_report(spark, sf):
    split = ransomware_split(spark, sf)
    model = models.train_ransomware(split.filter("fold <> 0"))
    held_out = models.score_ransomware(model, split.filter("fold = 0"), ["event_id", "is_ransomware"])
    return reports.classification_report(held_out, "is_ransomware", "predicted")


@query("ransomware_ensemble")
def ransomware_ensemble(spark, sf):
    """Boosted-tree score weighted by the anomaly decision of a forest over three static features."""
    split = ransomware_split(spark, sf)
    model = models.train_ransomware(split.filter("fold <> 0"))
    columns = ["entropy", "api_calls_per_sec", "file_entropy_variance"]
    forest = IsolationForest.fit(split.filter("fold <> 0"), "event_id", columns, contamination=0.1)
    scored = models.score_ransomware(model, forest.score(split), ["event_id", "decision"])
    return scored.select("event_id", scoring.ensemble_score(F.col("score"), F.col("decision")).alias("score"))


EDGES = (20.0, 40.0, 60.0, 80.0)  # of calls per event, where a step changes its symbol


def timeline_samples(spark, sf):
    """Processes with the arrays of their latest steps and entropies at each event, written once without the content."""
    documents = fx.table(spark, sf, "documents").select("doc_id", byte_entropy(F.col("text")).alias("entropy"))
    rows = fx.processes(spark, sf).withColumn("timestamp", F.col("ts").cast("timestamp")).join(documents, "doc_id").drop("created_files", "ts")
    windows = sequences.trailing_windows(rows, "process_id", "timestamp", "event_id", {"steps": "api_call_count", "entropies": "entropy"})
    return materialize(windows, "timeline")


def step_samples(spark, sf):
    """Events with their label and the latest steps of their process."""
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("process_id"), "ts", F.get_json_object("props", "$.k").cast("long").alias("step"), (F.col("value") >= 70).cast("int").alias("label")
    )
    return sequences.trailing_windows(rows, "process_id", "ts", "event_id", {"steps": "step"}, length=STEPS)


STEPS, ORDER = 8, 2
_STEPS = f"""steps AS (SELECT event_id, user_id, ts, CAST(value >= 70 AS INTEGER) AS label, CAST(floor(least(CAST(json_extract(props, '$.k') AS DOUBLE), 99) / 20) AS INTEGER) AS sym FROM events),
windows AS (SELECT event_id, label, array_agg(sym) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS {STEPS - 1} PRECEDING) AS s FROM steps),
placed AS (SELECT event_id, label, s, unnest(range(1, len(s) + 1)) AS t FROM windows),
transitions AS (SELECT label, array_to_string(s[t - k:t - 1], ',') AS context, s[t] AS symbol, count(*) AS n
  FROM placed, (VALUES (0), (1), (2)) AS o(k) WHERE event_id % 5 <> 0 AND t > k GROUP BY ALL)"""
_ODDS = f"""{_STEPS}, totals AS (SELECT label, context, sum(n) AS total, count(*) AS kinds FROM transitions GROUP BY ALL),
symbols AS (SELECT unnest(range(5)) AS symbol), labels_of AS (SELECT unnest([0, 1]) AS label),
order0 AS (SELECT label, '' AS context, symbol, (coalesce(n, 0) + coalesce(kinds, 0) * 0.2::DOUBLE) / (coalesce(total, 0) + coalesce(kinds, 0)) AS p
  FROM symbols CROSS JOIN labels_of LEFT JOIN (SELECT * FROM transitions WHERE context = '') USING (label, symbol) LEFT JOIN (SELECT * FROM totals WHERE context = '') USING (label)),
order1 AS (SELECT b.label, c.symbol::VARCHAR AS context, b.symbol, CASE WHEN total IS NULL THEN p ELSE (coalesce(n, 0) + kinds * p) / (total + kinds) END AS p
  FROM order0 b CROSS JOIN symbols c LEFT JOIN transitions x ON x.label = b.label AND x.context = c.symbol::VARCHAR AND x.symbol = b.symbol LEFT JOIN totals y ON y.label = b.label AND y.context = c.symbol::VARCHAR),
order2 AS (SELECT b.label, c.symbol || ',' || b.context AS context, b.symbol, CASE WHEN total IS NULL THEN p ELSE (coalesce(n, 0) + kinds * p) / (total + kinds) END AS p
  FROM order1 b CROSS JOIN symbols c LEFT JOIN transitions x ON x.label = b.label AND x.context = c.symbol || ',' || b.context AND x.symbol = b.symbol
  LEFT JOIN totals y ON y.label = b.label AND y.context = c.symbol || ',' || b.context),
odds AS (SELECT context, symbol, ln(max(p) FILTER (label = 1) / max(p) FILTER (label = 0)) AS log_odds FROM (SELECT * FROM order0 UNION ALL SELECT * FROM order1 UNION ALL SELECT * FROM order2) GROUP BY ALL)"""
_SCORES = f"""{_ODDS}, sequence_scored AS (SELECT event_id, sum(log_odds) AS log_odds FROM placed JOIN odds
  ON odds.symbol = s[t] AND odds.context = array_to_string(s[greatest(t - 2, 1):t - 1], ',') GROUP BY event_id)"""


@query("sequence_transitions", f"WITH {_STEPS} SELECT label, context, symbol, n FROM transitions")
def sequence_transitions(spark, sf):
    """How often each step followed its contexts of up to two steps, by class, over the events that train."""
    samples = step_samples(spark, sf).filter("event_id % 5 <> 0").select("label", sequences.symbols(F.col("steps"), EDGES).alias("found"))
    return sequences.transition_counts(samples, "label", "found", ORDER)


@query("sequence_log_odds", f"WITH {_ODDS} SELECT context, symbol, round(log_odds, 6) AS log_odds FROM odds")
def sequence_log_odds(spark, sf):
    return sequences.log_odds_table(sequence_transitions(spark, sf), len(EDGES) + 1, ORDER).select("context", "symbol", "log_odds")


def sequence_scored(spark, sf):
    samples = materialize(step_samples(spark, sf), "step-samples")
    model = sequences.SequenceModel.fit(samples.filter("event_id % 5 <> 0"), "label", "steps", EDGES, ORDER)
    return samples.select("event_id", "label", model.score(F.col("steps")).alias("log_odds"))


@query("sequence_scores", f"WITH {_SCORES} SELECT event_id, round(log_odds, 6) AS log_odds FROM sequence_scored")
def sequence_scores(spark, sf):
    return sequence_scored(spark, sf).select("event_id", "log_odds")


@query(
    "batch_projection",
    f"""WITH {_SCORES} SELECT sha256('event:' || event_id) AS url_hash, round(log_odds, 6) > 0 AS prediction, round(1 / (1 + exp(-log_odds)), 6) AS risk_score FROM sequence_scored""",
)
def batch_projection(spark, sf):
    """The sequence model's predictions as they leave a batch."""
    score = F.col("log_odds")
    scored = sequence_scored(spark, sf).select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("url"), (F.round(score, 6) > 0).alias("prediction"), (1 / (1 + F.exp(-score))).alias("share")
    )
    return validation.batch_projection(scored, "url", "prediction", "share")


@query("encrypted_predictions", f"WITH {_SCORES} SELECT sha256(event_id::VARCHAR) AS event_hash, round(log_odds, 6) > 0 AS prediction FROM sequence_scored")
def encrypted_predictions(spark, sf):
    """The same predictions, stored encrypted and read back."""
    results = sequence_scored(spark, sf).select(F.sha2(F.col("event_id").cast("string"), 256).alias("event_hash"), (F.round("log_odds", 6) > 0).alias("prediction"))
    path = scratch_path(spark, "predictions")
    sinks.encrypted_rows(results, demo_key()).write.text(path)
    plain = tx.decrypt_text(F.col("value"), demo_key())
    return spark.read.text(path).select(F.from_json(plain, "event_hash string, prediction boolean").alias("r")).select("r.*")


_SUSPICION = 0.1  # log-odds of the alerts below


@query(
    "detection_responses",
    f"""WITH {_SCORES} SELECT event_id AS alert_id, 'First hour' AS playbook, CAST(step AS INTEGER) AS step, action, CASE WHEN action = 'alert_soc' THEN 'completed' ELSE 'failed' END AS status
    FROM sequence_scored, (VALUES (1, 'alert_soc'), (2, 'block_ioc'), (3, 'isolate_host')) AS s(step, action) WHERE round(log_odds, 6) > {_SUSPICION}""",
)
def detection_responses(spark, sf):
    """Events whose sequence the model finds suspicious, turned into planned actions."""
    scored = sequence_scored(spark, sf).select("event_id", F.round("log_odds", 6).alias("score"))
    alerts = models.detection_alerts(scored, "event_id", _SUSPICION)
    return response.response_plan(alerts, fx.playbooks(spark)).select("alert_id", "playbook", "step", "action", "status")


@query("model_reloaded", "SELECT true AS same, count(*) AS flows FROM lineitem")
def model_reloaded(spark, sf):
    """Verdicts of a flow model before and after it was saved, row by row."""
    flows = materialize(labelled_flows(spark, sf), "flows")
    path = scratch_path(spark, "flow-model")
    model = models.train_flow_classifier(flows)
    models.save_model(model, path)
    again = models.classify_flows(models.load_model(path), models.classify_flows(model, flows).withColumnsRenamed({"verdict": "first", "confidence": "sure"}))
    same = F.col("verdict").eqNullSafe(F.col("first")) & F.col("confidence").eqNullSafe(F.col("sure"))
    return again.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("flows"))


@query("phishing_reloaded", f"WITH {fx.MAILS} SELECT true AS same, count(*) AS mails FROM mails")
def phishing_reloaded(spark, sf):
    """Scores of a mail model before and after it was saved, row by row."""
    inputs = materialize(models.phishing_inputs(models.weighted(fx.mails(spark, sf), "label")), "phishing-inputs")
    path = scratch_path(spark, "phishing-model")
    model = models.PhishingModel.fit(inputs)
    model.save(path)
    before = model.score(inputs, ["doc_id"], "first")
    again = models.PhishingModel.load(path).score(inputs, ["doc_id"], "second")
    return before.join(again, "doc_id").groupBy((F.col("first") == F.col("second")).alias("same")).agg(F.count(F.lit(1)).alias("mails"))


ALERT_SCORE = 0.5  # of the alerts below: the given labels are random, so few scores come near the models' own threshold


def timeline_scores(spark, sf):
    """Scores of a timeline model, fitted on four folds and applied to all events."""
    windows = timeline_samples(spark, sf)
    split = ranking.stratified_folds(windows.select("event_id", "is_ransomware"), "event_id", "is_ransomware").select("event_id", "fold")
    model = models.TimelineModel.fit(windows.join(split, "event_id").filter("fold <> 0"), EDGES)
    return model, windows, split


@query("ransomware_sequence_report")
def ransomware_sequence_report(spark, sf):
    """Ranking quality on the held-out fold: boosted trees with and without the sequence model, and that model alone."""
    windows = timeline_samples(spark, sf)
    split = ranking.stratified_folds(windows.select("event_id", "is_ransomware"), "event_id", "is_ransomware").select("event_id", "fold")
    windows = materialize(windows.join(split, "event_id"), "timeline-split")
    model = models.TimelineModel.fit(windows.filter("fold <> 0"), EDGES)
    inputs = materialize(models.timeline_inputs(windows, model.sequence), "timeline-inputs")
    plain = models.train_ransomware(inputs.filter("fold <> 0"))
    held_out = inputs.filter("fold = 0")
    both = models.score_ransomware(model.trees, held_out, ["is_ransomware"]).select(F.lit("trees and sequence").alias("model"), "is_ransomware", "score")
    trees = models.score_ransomware(plain, held_out, ["is_ransomware"]).select(F.lit("trees").alias("model"), "is_ransomware", "score")
    alone = held_out.select(F.lit("sequence").alias("model"), "is_ransomware", F.col("sequence_log_odds").alias("score"))
    return ranking.ranking_quality(both.union(trees).union(alone), "score", "is_ransomware", by=["model"])


@query("ransomware_detections")
def ransomware_detections(spark, sf):
    """Alerts of the timeline model, one per process and ten minutes, turned into planned actions."""
    model, windows, _ = timeline_scores(spark, sf)
    scored = model.score(windows, ["event_id", "process_id", "timestamp"])
    alerts = materialize(detection.quiet_alerts(scored, "process_id", "timestamp", "event_id", ALERT_SCORE), "alerts")
    return response.response_plan(models.detection_alerts(alerts, "event_id", ALERT_SCORE), fx.playbooks(spark)).select("alert_id", "playbook", "step", "action", "status")
