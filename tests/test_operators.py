"""Operators against brute force on small, skewed inputs, and checks of their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import enrichment, features, ranking, response, rules, scoring, tokens
from palisade.operators.forest import IsolationForest
from palisade.plans import fixtures as fx
from palisade.plans import queries


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, one key and one label."""
    rng = np.random.default_rng(3)
    rows = [(i, 7.0 if i % 3 == 0 else float(np.round(rng.normal(), 3)), "hot" if i % 3 == 0 else f"k{i % 50}", int(rng.random() < 0.3)) for i in range(6000)]
    return spark.createDataFrame(rows, "id long, value double, key string, label int")


def test_quantiles_match_numpy(skewed):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = {r.share: r["quantile"] for r in ranking.quantiles(skewed, ["value"], shares).collect()}
    values = np.array([r.value for r in skewed.select("value").collect()])
    assert all(found[s] == pytest.approx(np.quantile(values, s)) for s in shares)


def test_quantiles_of_odd_columns(spark):
    """Hot, constant, signed, tiny and huge values, several columns at a time, against a sort."""
    rng = np.random.default_rng(5)
    columns = {
        "hot": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000)), "constant": np.full(4000, -2.5), "zeros": np.where(rng.random(4000) < 0.5, -0.0, 0.0),
        "wide": np.sign(rng.normal(size=4000)) * 10.0 ** rng.uniform(-300, 300, 4000), "ends": np.where(rng.random(4000) < 0.1, np.inf, rng.normal(size=4000)), "none": [None] * 4000,
    }
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()]))
    rows += [(None,) * 6, (None, None, None, 1.0, None, None)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)
    shares = (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)
    found = {(r["feature"], r["share"]): r["quantile"] for r in ranking.quantiles(table, list(columns), shares).collect()}
    columns["wide"] = np.append(columns["wide"], 1.0)
    assert set(found) == {(c, s) for c in columns if c != "none" for s in shares}
    for (c, s), q in found.items():
        own = np.sort(np.asarray(columns[c], float) + 0.0)
        at = (len(own) - 1) * s
        low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
        assert q == (low if low == high else low + (high - low) * (at - np.floor(at))), (c, s)
    assert np.isnan(ranking.quantiles(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"), ["v"], [1.0]).first()["quantile"])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 101])
def test_quantiles_of_few_rows(spark, n):
    shares = [0.0, 0.1, 0.25, 0.33, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
    found = {r.share: r["quantile"] for r in ranking.quantiles(df, ["v"], shares).collect()}
    assert all(found[s] == pytest.approx(np.quantile([i * i for i in range(n)], s)) for s in shares)


def test_ranking_quality_matches_pairs(skewed):
    row = ranking.ranking_quality(skewed, "value", "label").first()
    data = skewed.select("value", "label").toPandas()
    p, n = data.value[data.label == 1].to_numpy(), data.value[data.label == 0].to_numpy()
    assert row.auc == pytest.approx((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean())
    best = max((data.label[data.value >= t].mean() for t in np.unique(data.value) if (p >= t).mean() >= 0.9))
    assert row.precision_at_recall == pytest.approx(best)


def test_folds_are_even_within_each_label(skewed):
    sizes = ranking.stratified_folds(skewed, "id", "label").groupBy("label", "fold").count().toPandas()
    assert len(sizes) == 10 and (sizes.groupby("label")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


def test_group_variance_of_a_single_row_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 1.0)], "k string, v double")
    assert {(r.k, r.s) for r in features.group_variance(df, "k", "v", "s").collect()} == {("a", 2.0), ("b", None), (None, None)}


def test_sequences_of_a_hot_key(skewed):
    rows = {r.key: r.s for r in features.behavior_sequences(skewed, "key", "id", "id", "value", 16, "s").collect()}
    assert all(len(s) == 16 for s in rows.values()) and rows["hot"] == [7.0] * 16


def test_feature_choice():
    assert features.choose_features({"a": 1.0, "b": 0.0, "c": 5.0}, core=("b",)) == (["a", "c", "b"], [])
    with pytest.raises(ValueError):
        features.choose_features({"a": 0.0}, core=("x", "y"))


def test_vocabulary_and_windows(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c B"), (4, None), (1, "a a b c a c b")], "id long, t string")
    words = tokens.vocabulary(df, "t")
    assert {r.token: (r.n, r.token_id) for r in words.collect()} == {"b": (5, 2), "a": (4, 3), "c": (3, 4)}
    assert sorted(r.token for r in tokens.vocabulary(df, "t", 2).collect()) == ["a", "b"]
    rows = sorted((r.id, r.window, r.sequence) for r in tokens.token_sequences(df, "id", "t", tokens.vocabulary(df, "t", 2), 4).collect())
    assert rows == [(1, 0, [2, 3, 2, 0]), (1, 0, [3, 3, 2, 1]), (1, 1, [3, 1, 2, 0]), (2, 0, [0] * 4), (3, 0, [1, 2, 0, 0]), (4, 0, [0] * 4)]


def test_vocabulary_ranks_like_a_sort(spark):
    rng = np.random.default_rng(9)
    text = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 50)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "id long, t string")
    found = sorted((r.token_id, r.token, r.n) for r in tokens.vocabulary(df, "t").collect())
    assert [(t, n) for _, t, n in found] == sorted(((t, n) for _, t, n in found), key=lambda p: (-p[1], p[0]))
    assert [i for i, _, _ in found] == list(range(2, len(found) + 2))


def test_rule_blocks_miss_nothing(spark, small, monkeypatch):
    df = fx.samples(spark, small)
    patterns = spark.createDataFrame([(f"r{i}", f"{i}$") for i in range(10)] + [("all", "http"), ("all", "example"), ("twice", r"(.)\1")], "name string, pattern string")
    whole = sorted(map(tuple, rules.regex_matches(df, F.col("url"), patterns, ["sample_id"]).collect()))
    monkeypatch.setattr(rules, "BLOCK", 3)
    assert sorted(map(tuple, rules.regex_matches(df, F.col("url"), patterns, ["sample_id"]).collect())) == whole
    assert len(whole) == len(set(whole)) > 0


def test_rules_of_all_types_read_their_input_once(spark, small):
    plan = queries()["ioc_rule_verdicts"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1
    rows = spark.createDataFrame([("1", "domain", "a.b"), ("2", "hash", "ABcd"), ("3", "file", None)], "key string, type string, value string")
    table = spark.createDataFrame([("n", "domain", "a", True), ("n", "domain", "b$", True), ("h", "hash", "abCD", True), ("off", "domain", ".", False)], "name string, type string, pattern string, active boolean")
    subjects = {t: F.when(F.col("type") == t, F.col("value")) for t in ("domain", "file", "hash")}
    assert sorted(map(tuple, rules.rule_hits(rows, "key", subjects, table).collect())) == [("1", "n"), ("2", "h")]


def test_no_rules_give_no_hits(spark, small):
    none = spark.createDataFrame([], "name string, pattern string")
    assert rules.regex_matches(fx.samples(spark, small), F.col("url"), none, ["sample_id"]).count() == 0


def test_enrichment_takes_the_surest_entry_and_keeps_rows(spark):
    traffic = spark.createDataFrame([("1", "2"), ("3", "1"), ("4", "5")], "src_ip string, dst_ip string")
    known = spark.createDataFrame([("1", "low", 0.1), ("1", "high", 0.9), ("2", "other", 0.5)], "value string, threat_type string, confidence double")
    rows = sorted((r.src_ip, r.threat_type) for r in enrichment.enrich_traffic(traffic, known).collect())
    assert rows == [("1", "high"), ("3", "high"), ("4", None)]


def test_look_ups_keep_every_row_once(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "b"), (3, None), (4, "zz"), (5, "A")], "n long, k string")
    snapshot = spark.createDataFrame([("a", 5), ("a", 3), ("A", 9), ("B", None), (None, 7), ("b", 8)], "k2 string, v int")
    found = enrichment.lookup(rows, "k", snapshot, "k2", {"v": F.col("v")}, fold=True)
    assert found.columns == ["n", "k", "v"]
    assert sorted(map(tuple, found.select("n", "v").collect())) == [(1, 3), (2, None), (3, None), (4, None), (5, 3)]
    exact = {r.n: r.v for r in enrichment.lookup(rows, "k", snapshot, "k2", {"v": F.col("v")}).collect()}
    assert exact == {1: 9, 2: 8, 3: None, 4: None, 5: 9}


def test_file_digests_have_no_case(spark):
    files = spark.createDataFrame([("ABCD",), ("abce",)], "digest string")
    bad = spark.createDataFrame([("abcD", "worm", 0.4), ("ABCD", "worm", 0.9)], "hash string, threat_type string, confidence double")
    assert {r.digest: r.confidence for r in enrichment.file_verdicts(files, "digest", bad).collect()} == {"ABCD": 0.9, "abce": None}


def test_a_group_of_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([("a", 0.5, 0), ("a", 0.7, 0), ("b", 0.2, 1), ("b", 0.1, 0)], "g string, s double, label int")
    rows = {r.g: (r.auc, r.precision_at_recall) for r in ranking.ranking_quality(df, "s", "label", by=["g"]).collect()}
    assert rows == {"a": (None, None), "b": (1.0, 1.0)}


def playbook(spark):
    return spark.createDataFrame(
        [("p", ["ransomware"], [("block_ioc", "f", {"iocs": '["{ioc}","{src_ip}"]'}, None), ("isolate_host", "n", {"ip_address": "{src_ip}"}, None), ("dance", "x", {}, None)])],
        "name string, triggers array<string>, actions array<struct<name string, type string, parameters map<string,string>, priority string>>",
    )


def test_response_plan(spark):
    alerts = spark.createDataFrame(
        [(1, ["ransomware", "ransomware"], {"src_ip": "10.0.0.5", "ioc": "{src_ip}"}), (2, ["ransomware"], {"src_ip": "10.0.0.6"}), (3, ["other"], {}), (4, None, {})],
        "alert_id long, triggers array<string>, context map<string,string>",
    )
    rows = response.response_plan(alerts, playbook(spark)).orderBy("alert_id", "step").collect()
    assert [(r.alert_id, r.action, r.status) for r in rows] == [
        (1, "block_ioc", "completed"), (1, "isolate_host", "failed"), (1, "dance", "unknown"),
        (2, "block_ioc", "failed"), (2, "isolate_host", "failed"), (2, "dance", "unknown"),
    ]
    assert rows[0].resolved["iocs"] == '["{src_ip}","10.0.0.5"]' and rows[0].had_list_template
    assert sorted(r.alert_id for r in response.unmatched_alerts(alerts, playbook(spark)).collect()) == [3, 4]


def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(rng.normal(size=4) * (8 if i % 100 == 0 else 1)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    forest = IsolationForest.fit(df, "id", ["a", "b", "c", "d"], contamination=0.05)
    scored = forest.score(df, keep=["id"]).toPandas()
    assert scored.anomaly.between(0, 1).all() and abs((scored.decision < 0).mean() - 0.05) < 0.01
    top = scored.nlargest(30, "anomaly")["id"]
    assert (top % 100 == 0).mean() > 0.8
    again = IsolationForest.fit(df, "id", ["a", "b", "c", "d"], contamination=None).score(df, keep=["id"]).toPandas()
    assert again.set_index("id").anomaly.equals(scored.set_index("id").anomaly)


def test_rows_with_missing_features_get_no_score(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(300)] + [(999, None, 1.0)], "id long, a double, b double")
    rows = {r.id: r.anomaly for r in IsolationForest.fit(df, "id", ["a", "b"], trees=10).score(df).collect()}
    assert rows[999] is None and all(v is not None for k, v in rows.items() if k != 999)


def test_threat_scores_stay_in_bounds(spark):
    rows = [(float("nan"), 5, 0), (1e100, 5, 200), (None, None, None), (-1e50, 0, 0)]
    df = spark.createDataFrame(rows, "c double, l int, p int")
    scored = scoring.score_threats(df, "c", "l", "p").collect()
    assert [r.threat_level for r in scored] == [2, 5, 1, 1] and all(0 <= r.threat_score <= 1 for r in scored)


LAZY = (
    "url_verdict_report", "brand_distance", "typosquat_scores", "blacklist_matches", "traffic_enrichment", "ioc_rule_verdicts", "country_risk",
    "url_intelligence", "ioc_threat_scores", "ranking_quality", "stratified_folds", "group_variance", "alert_playbook_matches", "action_status",
    "token_sequences", "protocol_distribution", "class_weights", "feature_quantiles", "data_drift",
)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, small, name):
    plan = queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = queries()["threat_counts"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = queries()["alert_playbook_matches"](spark, small)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,error)" in plan


def test_hot_groups_are_cut_before_the_shuffle(spark, small):
    plan = queries()["behavior_sequences"](spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_python_gets_few_megabytes_of_text_at_a_time(spark, small):
    import pyarrow as pa

    queries()["byte_entropy"](spark, small)
    long_texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = long_texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 40 and max(r["n"] for r in sizes) < 20
