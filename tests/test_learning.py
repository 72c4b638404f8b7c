"""Learning queries and operators: complete rows, bounds, and quality on rows the model has not seen."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import features, forest, models, ranking
from palisade.operators.forest import tree_samples
from palisade.plans import fixtures as fx
from palisade.plans import learning, queries
from palisade.streaming import jobs


def test_held_out_flows_get_one_of_three_classes(spark, small):
    found = queries()["flow_classification"](spark, small).toPandas()
    total = fx.table(spark, small, "lineitem").count()
    assert abs(len(found) - total / 5) <= 3 and set(found.verdict) <= {0, 1, 2}
    assert found.confidence.between(1 / 3, 1).all()
    assert (found.verdict == found["class"]).mean() > 0.25  # the classes are dealt at random, so there is nothing to learn


def test_a_class_that_can_be_told_is_told(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(c * 3)), 6, float(rng.normal()), 5.0, 3, 1.0, 2, c) for i, c in enumerate(int(x) for x in rng.integers(0, 3, 600))]
    flows = spark.createDataFrame(rows, "id long, duration double, proto int, src_bytes double, dst_bytes double, packets int, bytes_per_sec double, dst_host_srv_count int, kind int")
    model = models.train_flow_classifier(flows.filter("id < 400"), "kind", trees=20)
    found = models.classify_flows(model, flows.filter("id >= 400")).toPandas()
    assert (found.verdict == found.kind).mean() > 0.8


def test_rows_with_missing_features_keep_their_row(spark):
    rows = [(i, float(i % 5), 6, 10.0 * i, 5.0, 3, 1.0, 2, i % 2) for i in range(40)] + [(99, None, 6, 1.0, 5.0, 3, 1.0, 2, 0)]
    flows = spark.createDataFrame(rows, "id long, duration double, proto int, src_bytes double, dst_bytes double, packets int, bytes_per_sec double, dst_host_srv_count int, label int")
    found = {r.id: (r.verdict, r.confidence) for r in models.classify_flows(models.train_flow_classifier(flows, trees=5), flows).collect()}
    assert len(found) == 41 and found[99] == (None, None) and all(v is not None for k, (v, _) in found.items() if k != 99)


def test_importances_are_shares(spark, small):
    found = queries()["flow_feature_importance"](spark, small).toPandas()
    assert set(found.feature) == set(models.FLOW_FEATURES) and abs(found.importance.sum() - 1) < 1e-9


def test_held_out_mails_are_ranked(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    scored = queries()["phishing_scores"](spark, big)
    rows = scored.toPandas()
    assert abs(len(rows) - fx.mails(spark, big).count() / 5) <= 2 and rows.ml_score.between(0, 1).all()
    assert ranking.ranking_quality(scored, "ml_score", "label").first().auc > 0.6


def test_every_fold_is_judged(spark, small):
    found = queries()["phishing_cross_validation"](spark, small).toPandas()
    assert sorted(found.fold) == [0, 1, 2, 3, 4] and found.auc.dropna().between(0, 1).all()


def test_uncertainty_of_every_mail(spark, small):
    found = queries()["bootstrap_uncertainty"](spark, small).toPandas()
    assert len(found) == fx.mails(spark, small).count()
    assert found.mean_score.between(0, 1).all() and found.uncertainty.between(0, 0.5).all() and (found.uncertainty > 0).any()


def test_poisson_draws_have_mean_one():
    steps = np.array(models._poisson_steps())
    assert abs((1 - steps).sum() - 1) < 1e-12 and len(steps) > 12


def test_verdicts_carry_every_step(spark, small):
    found = queries()["phishing_verdicts"](spark, small).toPandas()
    assert len(found) == fx.mails(spark, small).count() and found.problem.isna().all()
    assert found[["hit", "rule_score", "prediction", "risk_score", "uncertainty"]].notna().all().all()
    blend = 0.6 * found.risk_score + 0.4 * found.rule_score > 0.5 + 0.1 * found.uncertainty
    assert (found.prediction == (found.hit.astype(bool) | blend)).all()


def pooled(points):
    """Rates of ascending (score, rate, weight) with neighbours pooled until none falls."""
    blocks = []
    for _, rate, weight in sorted(points):
        blocks.append([rate, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (r, w, n), (r2, w2, n2) = blocks[-2], blocks.pop()
            blocks[-1] = [(r * w + r2 * w2) / (w + w2), w + w2, n + n2]
    return [rate for rate, _, n in blocks for _ in range(n)]


def test_calibration_pools_all_distinct_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s) / 500, int(rng.random() < (s / 500) ** 2)) for s in rng.integers(0, 500, 3000)] + [(None, 1), (0.5, None)]
    table = spark.createDataFrame(rows, "score double, label int").repartition(5)
    points = {}
    for s, y in rows:
        if s is not None and y is not None:
            points.setdefault(s, []).append(y)
    scores = sorted(points)
    wanted = pooled([(s, sum(points[s]) / len(points[s]), len(points[s])) for s in scores])
    model = models.calibrate(table, "score", "label")
    found = models.apply_calibration(model, spark.createDataFrame([(s,) for s in scores], "score double"), "score").orderBy("score").collect()
    assert [r["calibrated"] for r in found] == pytest.approx(wanted, abs=1e-9)
    assert len(set(wanted)) > 12  # more levels than ten means could have


def test_calibration_is_monotone(spark, small):
    found = queries()["calibrated_scores"](spark, small.replace("sf0.001", "sf0.01")).toPandas().sort_values("score")
    assert found.calibrated.between(0, 1).all() and (np.diff(found.calibrated) >= -1e-12).all()


def test_planted_vectors_are_found(spark, small):
    found = queries()["anomaly_scores"](spark, small.replace("sf0.001", "sf0.01")).toPandas()
    assert found.anomaly.between(0, 1).all()
    assert found.nlargest(int(found.planted.sum()), "anomaly").planted.mean() > 0.7
    assert abs((found.decision < 0).mean() - 0.05) < 0.02


def test_flow_anomalies_are_the_contaminated_share(spark, small):
    found = queries()["flow_anomalies"](spark, small).toPandas()
    assert abs(len(found) / fx.table(spark, small, "lineitem").count() - 0.05) < 0.01 and (found.decision < 0).all()


def test_poisoning_signal_is_one_number(spark, small):
    assert queries()["poisoning_signal"](spark, small).count() == 1


def test_no_tree_gets_more_rows_than_asked(spark):
    df = spark.range(3000).select(F.col("id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    sizes = tree_samples(df, "id", ["a", "b"], 40, 64, 7).groupBy("tree").count().toPandas()
    assert len(sizes) == 40 and (sizes["count"] == 64).all()


def test_ransomware_chain(spark, small):
    report = queries()["ransomware_report"](spark, small).toPandas()
    assert len(report) >= 2
    ensemble = queries()["ransomware_ensemble"](spark, small).toPandas()
    assert len(ensemble) == fx.table(spark, small, "events").count() and ensemble.score.notna().all()
    planned = queries()["ransomware_detections"](spark, small).toPandas()
    assert set(planned.action) <= {"alert_soc", "block_ioc", "isolate_host"}


def test_an_empty_behaviour_sequence_is_scored(spark):
    rows = [(1, "text", 4, 2.0, ["a"], [], 0), (2, "more text", 4, 2.0, ["a.locky"], [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "process_id long, file_content string, api_call_count long, process_duration double, created_files array<string>, behavior_sequence array<double>, is_ransomware int")
    found = models.process_inputs(table).select("process_id", *models.PROCESS_NUMBERS).toPandas()
    assert found.notna().all().all()


def test_stream_scores_like_batch(spark, small, tmp_path):
    split = learning.ransomware_split(spark, small)
    path = str(tmp_path / "model")
    models.save_model(models.train_ransomware(split.filter("fold <> 0"), rounds=3), path)
    loaded = models.load_model(path)
    columns = ["event_id", *models.PROCESS_NUMBERS]
    split.select(*columns).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(split.select(*columns).schema).parquet(str(tmp_path / "in"))
    score = lambda batch: models.score_ransomware(loaded, batch, ["event_id"])
    respond = lambda scored: models.detection_alerts(scored, "event_id", 0.5)
    jobs.score_stream(rows, score, respond, f"{tmp_path}/scores", f"{tmp_path}/alerts", f"{tmp_path}/checkpoint").awaitTermination()
    batch = {r.event_id: r.score for r in score(split).collect()}
    stream = {r.event_id: r.score for r in spark.read.parquet(f"{tmp_path}/scores").collect()}
    assert stream == pytest.approx(batch)
    alerts = spark.read.schema("alert_id long").json(f"{tmp_path}/alerts").count()
    assert alerts == sum(s > 0.5 for s in batch.values())


def test_a_forest_grows_on_cells_whatever_the_rows(spark):
    rows = spark.range(40_000).select(
        "id", (F.col("id") % 50).cast("double").alias("duration"), F.lit(6).alias("proto"), F.rand(1).alias("src_bytes"), F.lit(5.0).alias("dst_bytes"),
        (F.col("id") % 7).alias("packets"), F.lit(1.0).alias("bytes_per_sec"), F.lit(2).alias("dst_host_srv_count"), (F.col("id") % 50 > 24).cast("int").alias("label"),
    )
    once, twice = models.flow_cells(rows, "label", 8, 2)[1], models.flow_cells(rows.union(rows), "label", 8, 2)[1]
    assert once.agg(F.sum("weight")).first()[0] == 40_000 and twice.agg(F.sum("weight")).first()[0] == 80_000
    assert twice.count() <= 1.1 * once.count() < 8 * 8 * 7 * 2 * 2
    found = models.classify_flows(models.train_flow_classifier(rows, trees=10), rows).filter("verdict = label").count()
    assert found > 38_000


def test_contents_are_measured_once_and_go_with_no_event(spark, small):
    samples = learning.process_samples(spark, small)
    assert not {"file_content", "text", "behavior_sequence"} & set(samples.columns)
    text = fx.table(spark, small, "documents").select("doc_id", F.col("text").alias("file_content"))
    sequences = features.behavior_sequences(fx.processes(spark, small), "process_id", "ts", "event_id", "api_call_count")
    whole = fx.processes(spark, small).join(text, "doc_id").join(sequences, "process_id")
    shown = ["event_id", "process_id", *models.PROCESS_NUMBERS]
    found, wanted = (sorted(map(tuple, models.process_inputs(rows).select(shown).collect())) for rows in (samples, whole))
    assert len(found) == fx.table(spark, small, "events").count() and np.allclose(found, wanted, rtol=1e-9)


def test_points_walk_down_every_tree_like_one_by_one():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(700, 3))
    points[5, 1], points[6, 2] = np.inf, -np.inf
    trees = [forest._grow(points[10 + n : 10 + 3 * n], n, 1) for n in (1, 2, 9, 128)]

    def walk(tree, point):
        nodes, at = tree.set_index("node"), 0
        while nodes.feature[at] >= 0:
            at = nodes.right[at] if point[nodes.feature[at]] > nodes.threshold[at] else nodes.left[at]
        return nodes.depth[at] + forest.path_constant(nodes["size"][at])

    table = pd.concat(trees).sort_values(["tree", "node"]).reset_index(drop=True)
    packed = forest._packed(table)
    assert all(packed[4][i] == i or packed[4][i] >= len(trees) for i in range(len(table)))  # children stand in pairs behind the roots
    wanted = [np.mean([walk(tree, p) for tree in trees]) for p in points]
    assert np.allclose(forest._mean_path(points, packed), wanted, rtol=1e-12)
