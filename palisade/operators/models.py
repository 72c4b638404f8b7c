"""Classifiers over flows, URL/text samples and process behaviour, all Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from math import exp

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import IDF, Bucketizer, HashingTF, OneHotEncoder, QuantileDiscretizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import numeric
from palisade.functions.urls import url_features
from palisade.operators.enrichment import url_record
from palisade.operators.features import process_features
from palisade.operators.ranking import bin_index, quantiles, ranking_quality, stratified_folds
from palisade.operators.reports import class_weights
from palisade.operators.sequences import SequenceModel
from palisade.storage import materialize

# Feature order of the flow model, class weights and thresholds, and the feature names below.
FLOW_FEATURES = ("duration", "proto", "src_bytes", "dst_bytes", "packets", "bytes_per_sec", "dst_host_srv_count")
RANSOMWARE_WEIGHTS = {0: 1.0, 1: 5.0}
RANSOMWARE_THRESHOLD = 0.7
ALERT_THRESHOLD = 0.85
SEED = 42

URL_NUMBERS = (
    "uses_https", "port_number", "has_ipv4", "has_ipv6", "is_shortened", "subdomain_count", "domain_length", "is_idn",
    "path_depth", "num_params", "has_suspicious_param", "entropy", "special_char_ratio", "hex_char_count",
    "obfuscation_score", "days_since_registration", "dnssec_enabled",
)
URL_CATEGORIES = ("tld", "file_extension")
PROCESS_NUMBERS = (
    "entropy", "api_calls_per_sec", "file_entropy_variance", "sequence_mean", "sequence_deviation", "sequence_max",
    "sequence_last",
)


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


# --- flows ---------------------------------------------------------------------------------------------


BINS = 32  # of a feature: as many as the forest tries
PARTS = 8  # of a cell, so that a tree's draw leaves out single parts and seldom whole cells


def flow_cells(flows: DataFrame, label: str, bins: int = BINS, parts: int = PARTS) -> tuple[Bucketizer, DataFrame]:
    """The features' quantile bins, and ``(bins, label, weight)``: the rows of each cell of bins and class, counted.

    Trees that split between bins can't tell the rows of a cell apart, so nothing is lost to them; a large cell is dealt into
    ``parts`` by a hash of its features. The cells are bounded by the bins, whatever the number of rows.
    """
    names = [f"{c}_bin" for c in FLOW_FEATURES]
    cut = QuantileDiscretizer(inputCols=list(FLOW_FEATURES), outputCols=names, numBuckets=bins, handleInvalid="keep").fit(flows)
    part = F.pmod(F.xxhash64(*FLOW_FEATURES), F.lit(parts)).alias("part")
    counted = cut.transform(flows).groupBy(*names, label, part).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    plain = [F.col(n).alias(n, metadata={"kind": "dropped"}) for n in names]  # bins are numbers in order, not categories
    return cut, materialize(counted.select(*plain, label, "weight"), "flow-cells")


def train_flow_classifier(flows: DataFrame, label: str = "label", trees: int = 100, depth: int = 8) -> PipelineModel:
    """Forest over the flow features; ``label`` holds two or more classes. Rows with a missing feature teach nothing.

    Every other row counts, as part of its cell: what the trees' passes read and keep doesn't grow with the rows.
    """
    cut, cells = flow_cells(flows.filter(_complete()), label)
    assemble = VectorAssembler(inputCols=cut.getOutputCols(), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED)
    return PipelineModel([cut, assemble, forest.fit(assemble.transform(cells))])


def _complete() -> Column:
    """Rows in which every flow feature is a number."""
    usable = F.lit(True)
    for name in FLOW_FEATURES:
        usable = usable & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    return F.coalesce(usable, F.lit(False))


def classify_flows(model: PipelineModel, flows: DataFrame) -> DataFrame:
    """Flow columns with ``verdict`` and ``confidence``, the largest class probability; NULL where a feature is missing."""
    scored = model.transform(flows)
    return scored.select(
        *flows.columns,
        F.when(_complete(), F.col("prediction").cast("int")).alias("verdict"),
        F.when(_complete(), F.array_max(vector_to_array("probability"))).alias("confidence"),
    )


def feature_importance(model: PipelineModel, flows: DataFrame, names: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """``(feature, importance)``, most important first."""
    rows = [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    return flows.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


# --- URL and text --------------------------------------------------------------------------------------


def phishing_inputs(samples: DataFrame, url: str = "url", facts: DataFrame | None = None) -> DataFrame:
    """Samples with the whole URL record; unknown numbers are 0, unknown categories ``none``.

    ``facts`` are the ``domain_facts`` of the registered domains; without them age and keys are unknown (-1 and 0).
    """
    if facts is None:
        record = url_features(samples, url).withColumns({"days_since_registration": F.lit(-1), "dnssec_enabled": F.lit(0)})
    else:
        record = url_record(samples, facts, url)
    return record.fillna(0, subset=list(URL_NUMBERS)).fillna("none", subset=list(URL_CATEGORIES))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """``weight`` balances the classes. The weights are a number per class, read once and put into the projection."""
    weight = F.lit(None).cast("double")
    for row in class_weights(df, label).select(label, "weight").collect():
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
    return df.filter(F.col(label).isNotNull()).withColumn("weight", weight)


WORDS = 1 << 15  # hashed slots of a text's words


def phishing_stages(words: int = WORDS) -> list:
    """Stages up to the feature vector."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_at", handleInvalid="keep") for c in URL_CATEGORIES]
    one_hot = OneHotEncoder(inputCols=[f"{c}_at" for c in URL_CATEGORIES], outputCols=[f"{c}_hot" for c in URL_CATEGORIES])
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern="[^a-z0-9]+"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=words),
        IDF(inputCol="counts", outputCol="terms"),
        *indexers,
        one_hot,
        VectorAssembler(inputCols=[*URL_NUMBERS, *[f"{c}_hot" for c in URL_CATEGORIES], "terms"], outputCol="features"),
    ]


@dataclass(frozen=True)
class PhishingModel:
    """Fitted feature stages and the classifier on top."""

    stages: PipelineModel
    classifier: LogisticRegressionModel

    @classmethod
    def fit(cls, inputs: DataFrame, label: str = "label", words: int = WORDS) -> PhishingModel:
        """Fit on prepared inputs. The vectors are written once: every iteration then starts from a plain scan
        instead of carrying the whole feature plan in its tasks, and a lost executor re-reads a file."""
        stages = Pipeline(stages=phishing_stages(words)).fit(inputs)
        vectors = materialize(cls._vectors(stages, inputs).select(label, "weight", "features"), "phishing-vectors")
        return cls(stages, cls.regression(label).fit(vectors))

    @staticmethod
    def regression(label: str, weight: str = "weight") -> LogisticRegression:
        return LogisticRegression(labelCol=label, weightCol=weight, maxIter=50, regParam=0.01)

    @staticmethod
    def _vectors(stages: PipelineModel, inputs: DataFrame) -> DataFrame:
        """Inputs with the vector column, without the names of its hashed slots: they would travel in
        every task of every iteration."""
        rows = stages.transform(inputs)
        return rows.withColumn("features", F.col("features").alias("features", metadata={"names": "dropped"}))

    def score(self, inputs: DataFrame, keep: Sequence[str], name: str = "ml_score") -> DataFrame:
        scored = self.classifier.transform(self._vectors(self.stages, inputs))
        return scored.select(*keep, positive_probability().alias(name))

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        self.classifier.write().overwrite().save(f"{path}/classifier")

    @classmethod
    def load(cls, path: str) -> PhishingModel:
        return cls(PipelineModel.load(f"{path}/stages"), LogisticRegressionModel.load(f"{path}/classifier"))


def train_phishing(samples: DataFrame, label: str = "label", facts: DataFrame | None = None, words: int = WORDS) -> PhishingModel:
    """Logistic model over URL features and hashed text in ``words`` slots, classes balanced by weight.

    The URL features are written once, since several stages are fitted on them.
    """
    return PhishingModel.fit(materialize(weighted(phishing_inputs(samples, facts=facts), label), "phishing-inputs"), label, words)


def score_phishing(model: PhishingModel, samples: DataFrame, keep: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    return model.score(phishing_inputs(samples, facts=facts), keep)


def _written_vectors(inputs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Feature vectors of prepared inputs, from stages fitted once on all of them, written once.

    The stages see no labels: they number suffixes and file endings and weigh words by the texts that hold them.
    """
    stages = Pipeline(stages=phishing_stages()).fit(inputs)
    return materialize(PhishingModel._vectors(stages, inputs).select(*keep, "weight", "features"), "phishing-vectors")


def _at_once(jobs: Sequence[Callable[[], DataFrame]], threads: int = 4) -> list[DataFrame]:
    """Results of jobs that the driver starts side by side; Spark shares the executors among them."""
    with ThreadPoolExecutor(threads) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def cross_validate(samples: DataFrame, key: str, label: str = "label", folds: int = 5) -> DataFrame:
    """``(fold, auc, precision_at_recall)`` of stratified cross-validation.

    Vectors and folds are computed once, the folds' models are fitted side by side, each on the others' rows, and the metrics
    of all folds come from one ranking pass.
    """
    inputs = materialize(stratified_folds(weighted(phishing_inputs(samples), label), key, label, folds), "phishing-folds")
    vectors = _written_vectors(inputs, ["fold", label])

    def scored(fold: int) -> DataFrame:
        model = PhishingModel.regression(label).fit(vectors.filter(F.col("fold") != fold))
        return model.transform(vectors.filter(F.col("fold") == fold)).select("fold", label, positive_probability().alias("score"))

    parts = _at_once([partial(scored, fold) for fold in range(folds)])
    return ranking_quality(reduce(DataFrame.unionByName, parts), "score", label, by=["fold"])


def _poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities, as far as a double tells them from one."""
    steps, term, count = [], exp(-1), 0
    total = term
    while total < 1 and (not steps or total > steps[-1]):
        steps.append(total)
        count += 1
        term /= count
        total += term
    return steps


def bootstrap_scores(samples: DataFrame, key: str, label: str = "label", members: int = 5) -> list[DataFrame]:
    """Scores of models fitted on Poisson re-weightings of the rows, keyed by a hash so they repeat.

    Vectors are computed once, and the members are fitted side by side.
    """
    inputs = materialize(weighted(phishing_inputs(samples), label), "phishing-inputs")
    vectors = _written_vectors(inputs, [key, label])

    def scored(member: int) -> DataFrame:
        u = F.xxhash64(F.lit(SEED), F.lit(member), F.col(key)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
        copies = F.lit(0)
        for count, below in enumerate(_poisson_steps()):
            copies = F.when(u >= below, count + 1).otherwise(copies)
        drawn = vectors.withColumn("weight", F.col("weight") * copies).filter(F.col("weight") > 0)
        return PhishingModel.regression(label).fit(drawn).transform(vectors).select(key, positive_probability().alias("ml_score"))

    return _at_once([partial(scored, member) for member in range(members)])


def reliability(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score, observed rate and rows per score decile; the input of the calibration."""
    edges = quantiles(scored, [score], [i / bins for i in range(1, bins)])
    edges = edges.agg(F.array_sort(F.collect_list("quantile"))).scalar()
    binned = scored.withColumn("_edges", edges).withColumn("bin", bin_index(F.col(score), F.col("_edges"), bins))
    return binned.groupBy("bin").agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("rows")
    )


def calibrate(scored: DataFrame, score: str, label: str) -> IsotonicRegression:
    """Monotone mapping of scores to observed rates, fitted on every distinct score with the number of its rows as weight."""
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(F.col(score).cast("double").alias("mean_score")).agg(F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="mean_score", labelCol="observed", weightCol="weight").fit(points)


def apply_calibration(model, scored: DataFrame, score: str) -> DataFrame:
    return (
        model.transform(scored.withColumn("mean_score", F.col(score)))
        .withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))
        .drop("mean_score", "prediction")
    )


# --- process behaviour ---------------------------------------------------------------------------------


def sequence_summary(sequences: DataFrame) -> DataFrame:
    """``behavior_sequence`` replaced by its mean, deviation, largest and last step; all NULL for an empty one."""
    steps = F.col("behavior_sequence")
    n = F.size(steps).cast("double")
    mean = F.try_divide(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), n)
    squares = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x * x)
    found = sequences.withColumns({"sequence_mean": mean, "sequence_max": F.array_max(steps)})
    return found.withColumns(
        {
            "sequence_deviation": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares, n) - F.col("sequence_mean") ** 2)),
            "sequence_last": F.try_element_at(steps, F.lit(-1)),
        }
    ).drop("behavior_sequence")


def process_inputs(processes: DataFrame) -> DataFrame:
    """Process features plus summary numbers of the behaviour sequence; NULL numbers become 0.

    Rows bring the sequence, or its summary, which is best made once per process and joined.
    """
    summed = sequence_summary(processes) if "behavior_sequence" in processes.columns else processes
    return process_features(summed).fillna(0.0, subset=list(PROCESS_NUMBERS))


def train_ransomware(inputs: DataFrame, label: str = "is_ransomware", rounds: int = 20, numbers: Sequence[str] = PROCESS_NUMBERS) -> PipelineModel:
    """Boosted trees over process inputs; positives weigh five times as much."""
    weight = F.when(F.col(label) == 1, RANSOMWARE_WEIGHTS[1]).otherwise(RANSOMWARE_WEIGHTS[0])
    assemble = VectorAssembler(inputCols=list(numbers), outputCol="features")
    trees = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=4, seed=SEED)
    return Pipeline(stages=[assemble, trees]).fit(inputs.withColumn("weight", weight))


def score_ransomware(model: PipelineModel, inputs: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(inputs).select(*keep, positive_probability().alias("score"))
    return scored.withColumn("predicted", (F.col("score") > RANSOMWARE_THRESHOLD).cast("int"))


def detection_alerts(scored: DataFrame, key: str, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Scores above the alert threshold as alerts for the response operators."""
    return scored.filter(F.col("score") > threshold).select(
        F.col(key).alias("alert_id"),
        F.array(F.lit("ransomware_detected")).alias("triggers"),
        F.create_map(F.lit("process_id"), F.col(key).cast("string"), F.lit("score"), F.col("score").cast("string")).alias("context"),
    )


TIMELINE_NUMBERS = (*PROCESS_NUMBERS, "sequence_log_odds")


def timeline_inputs(windows: DataFrame, sequence: SequenceModel) -> DataFrame:
    """Model inputs of rows with the arrays ``steps`` and ``entropies`` of their latest events; NULL numbers become 0.

    Every number comes from the row alone, so a batch and a stream give the same.
    """
    steps, entropies = F.col("steps"), F.col("entropies")
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    total = lambda a, f: F.aggregate(known(a), F.lit(0.0), lambda s, x: s + f(x))
    count = lambda a: F.size(known(a)).cast("double")
    mean = lambda a: F.try_divide(total(a, lambda x: x), count(a))
    means = windows.withColumns({"sequence_mean": mean(steps), "_entropy_mean": mean(entropies)})
    spread = lambda a, m: total(a, lambda x: (x - F.col(m)) * (x - F.col(m)))
    return means.withColumns(
        {
            "entropy": F.try_element_at(entropies, F.lit(-1)),
            "api_calls_per_sec": numeric.per_second(F.col("api_call_count"), F.col("process_duration")),
            "file_entropy_variance": F.try_divide(spread(entropies, "_entropy_mean"), count(entropies) - 1),
            "sequence_deviation": F.sqrt(F.try_divide(spread(steps, "sequence_mean"), count(steps))),
            "sequence_max": F.array_max(steps),
            "sequence_last": F.try_element_at(steps, F.lit(-1)),
            "sequence_log_odds": sequence.score(steps),
        }
    ).drop("_entropy_mean").fillna(0.0, subset=list(TIMELINE_NUMBERS))


@dataclass(frozen=True)
class TimelineModel:
    """A sequence model and boosted trees over behaviour as it stood at each event."""

    sequence: SequenceModel
    trees: PipelineModel

    @classmethod
    def fit(cls, windows: DataFrame, edges: Sequence[float], label: str = "is_ransomware", rounds: int = 20) -> TimelineModel:
        """Fit both on labelled windows; the inputs are written once for the rounds of the trees."""
        sequence = SequenceModel.fit(windows, label, "steps", edges)
        inputs = materialize(timeline_inputs(windows, sequence).select(label, *TIMELINE_NUMBERS), "timeline-inputs")
        return cls(sequence, train_ransomware(inputs, label, rounds, TIMELINE_NUMBERS))

    def score(self, windows: DataFrame, keep: Sequence[str]) -> DataFrame:
        return score_ransomware(self.trees, timeline_inputs(windows, self.sequence), keep)

    def save(self, spark: SparkSession, path: str) -> None:
        self.sequence.save(spark, f"{path}/sequence")
        save_model(self.trees, f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TimelineModel:
        return cls(SequenceModel.load(spark, f"{path}/sequence"), load_model(f"{path}/trees"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
