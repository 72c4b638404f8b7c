"""Document classifier from weak labels: label model by expectation-maximisation, then a hashed linear scorer.

Two properties are learned, low quality and toxicity. For each, overlapping heuristics vote bad, good or abstain; a table
of human labels, where there is one, is one more voter. The label model estimates each voter's accuracy on either class, and
the share of bad documents, from the counts of vote patterns over all documents: at most three to the number of voters, so
the whole corpus takes part and only these counts reach the driver. The posterior of a document's pattern is its soft label.
A linear scorer over hashed words is trained on a bounded sample of soft labels and then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import texts
from palisade.llm.registry import query

ABSTAIN, GOOD, BAD = 0, 1, 2
SLOTS = 1 << 20  # hashed features of the scorer
SAMPLE = 20_000  # documents that the scorer is trained on, about; a hash of the id chooses them
TRUST = 0.99  # probability that a human label is right
LEAST_SEEN = 5  # documents of the sample that must hold a feature
STEMS = (4, 5)  # letters of a word's beginning that count as a feature, so that inflected forms are known
PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&-_/\\"
SYMBOLS = re.compile(r"[#*$%&|<>]")

# General insults; word lists of the heuristics, not taken from any data set.
INTELLECT = ("idiot", "moron", "stupid", "imbecile", "dimwit", "dumb", "fool", "halfwit", "clown", "brainless")
WORTH = ("scum", "trash", "worthless", "pathetic", "loser", "vermin", "filth", "disgusting", "garbage", "parasite", "subhuman")

QUALITY_VOTERS = ("symbols", "repetition", "capitals", "exclamations", "line copies", "length", "human")
TOXIC_VOTERS = ("intellect", "worth", "several insults", "no insult", "human")
NO_INSULT = TOXIC_VOTERS.index("no insult")
SILENT = 0.1  # what a document counts in training for toxicity if nothing but the lack of known insults speaks about it


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def _matcher(words: tuple[str, ...]):
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(words)})s?(?!\w)")

    def find(lower: str) -> list[str]:
        for word in words:
            if word in lower:
                return pattern.findall(lower)
        return []

    return find


_INTELLECT, _WORTH = _matcher(INTELLECT), _matcher(WORTH)


@dataclass
class Signals:
    """What the heuristics say of a text, and its hashed features."""

    quality: int  # votes as digits of base three, the first voter lowest
    toxic: int
    shape: list[str]
    words: set[str]


def signals(text: str) -> Signals:
    """Votes and features of one whole text."""
    lower = text.lower()
    words = lower.split()
    n = len(words)
    symbols = len(SYMBOLS.findall(text)) / max(n, 1)
    if len(lower) == len(text):
        changed = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        capitals = np.count_nonzero(changed) / max(1, len(text) - text.count(" "))
    else:
        capitals = sum(map(str.isupper, text)) / max(1, len(text) - text.count(" "))
    loud = text.count("!") / max(n, 1)
    distinct = set(words)
    same = sum(map(eq, words, words[1:])) / max(n, 1)
    lines = [line for line in text.split("\n") if line.strip()]
    copies = 1 - len(set(lines)) / len(lines) if lines else 0.0
    first, second = _INTELLECT(lower), _WORTH(lower)
    insults = len(first) + len(second)
    quality = (
        _vote(symbols > 0.3, symbols < 0.05),
        _vote(same > 0.2, same < 0.05),
        _vote(capitals > 0.5, capitals < 0.2),
        _vote(loud > 0.2, loud < 0.05),
        _vote(copies > 0.3, copies < 0.1),
        _vote(n < 3, n >= 50),
    )
    toxic = (_vote(bool(first), False), _vote(bool(second), False), _vote(insults > 1, False), _vote(False, not insults and n >= 5))
    shape = [f"\n{name} {min(5, int(10 * value))}" for name, value in (("symbols", symbols), ("capitals", capitals), ("loud", loud), ("same", same), ("copies", copies))]
    return Signals(_digits(quality), _digits(toxic), [*shape, f"\nlength {min(n, 3)}"], distinct)


def _digits(votes: tuple[int, ...]) -> int:
    return sum(vote * 3**place for place, vote in enumerate(votes))


def features(found: Signals) -> np.ndarray:
    """Distinct slots of a text's words without punctuation around them, of their first letters, and of its shape."""
    stripped = {w.strip(PUNCTUATION) for w in found.words}
    stripped.discard("")
    names = [*stripped, *{"^" + w[:k] for k in STEMS for w in stripped if len(w) > k}, *found.shape]
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS for w in names), np.int32, len(names)))


@dataclass
class LabelModel:
    """Share of bad documents, and how often each voter abstains, says good and says bad about good and bad documents."""

    share: float
    says: np.ndarray  # class (0 good, 1 bad) x voter x vote

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds that a document with these votes (a row each) is bad."""
        gain = np.log(self.says[1]) - np.log(self.says[0])
        gain[:, ABSTAIN] = 0  # silence says nothing: voters that look at the same words fall silent together
        return np.log(self.share) - np.log1p(-self.share) + gain[np.arange(votes.shape[1]), votes].sum(axis=1)

    def posterior(self, pattern: int) -> float:
        """Probability that a document with this vote pattern is bad."""
        return float(1 / (1 + np.exp(-np.clip(self.odds(_votes(np.array([pattern]), self.says.shape[1])), -500, 500)))[0])


def _votes(patterns: np.ndarray, voters: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(voters) % 3


def label_model(counts: dict[int, int], voters: int, rounds: int = 200, weight: float = 20.0, trusted: float | None = TRUST) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns.

    Votes are taken as independent given the class; how often a voter speaks up is estimated with what it says, as some
    only ever speak up for one class. Each estimate carries ``weight`` made-up votes in favour of a voter that is better than chance, so that
    a class nobody saw doesn't turn the voters round. The last voter is the human one: what it says is right with the given
    probability ``trusted`` (None: estimated as the others), and whether it speaks tells nothing.
    """
    patterns = np.array(sorted(counts), np.int64)
    numbers = np.array([counts[p] for p in patterns], float)
    votes = _votes(patterns, voters)
    cast = np.stack([votes == v for v in (ABSTAIN, GOOD, BAD)], axis=2).astype(float)  # pattern x voter x vote
    prior = np.array([[0.5, 0.45, 0.05], [0.5, 0.05, 0.45]])[:, None, :].repeat(voters, axis=1)
    model = LabelModel(0.1, prior)
    for _ in range(rounds):
        bad = numbers / (1 + np.exp(-np.clip(model.odds(votes), -500, 500)))
        weights = np.stack([numbers - bad, bad])
        says = (np.einsum("cp,pvk->cvk", weights, cast) + weight * prior) / (weights.sum(axis=1)[:, None, None] + weight)
        if trusted is not None:
            silent = (numbers @ cast[:, -1, ABSTAIN] + weight / 2) / (numbers.sum() + weight)
            for kind, right in ((0, GOOD), (1, BAD)):
                says[kind, -1] = (1 - silent) * (1 - trusted)
                says[kind, -1, right] = (1 - silent) * trusted
                says[kind, -1, ABSTAIN] = silent
        share = (bad.sum() + 0.1 * weight) / (numbers.sum() + weight)
        still = abs(share - model.share) + np.abs(says - model.says).max() < 1e-9
        model = LabelModel(share, says)
        if still:
            break
    return model


def fit_scorer(rows: list[np.ndarray], targets: np.ndarray, trust: np.ndarray, rounds: int = 400, rate: float = 0.5, clear: float = 5.0) -> tuple[np.ndarray, float]:
    """Weights of all slots and the intercept: logistic regression on soft labels over the whole sample, each counted by ``trust``.

    Only features whose share of bad documents differs from the overall share by ``clear`` standard errors take part, so
    that words of little evidence weigh nothing however many of them a long document holds. AdaGrad steps with shrinkage.
    """
    weights = np.zeros(SLOTS)
    if not rows:
        return weights, -5.0
    n = trust.sum()
    share = (trust @ targets) / n
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, trust[owner], SLOTS)
    excess = np.bincount(flat, (trust * (targets - share))[owner], SLOTS)
    chosen = (seen >= LEAST_SEEN) & (np.abs(excess) > clear * np.sqrt(np.maximum(seen, 1) * max(share * (1 - share), 1 / n)))
    used = chosen[flat]
    kept, place = np.unique(flat[used], return_inverse=True)
    owner = owner[used]
    w, bias = np.zeros(len(kept)), np.log(max(share, 1 / n)) - np.log(max(1 - share, 1 / n))
    squares, bias_square = np.full(len(kept), 1e-12), 1e-12
    for _ in range(rounds):
        score = np.bincount(owner, w[place], len(rows)) + bias
        error = trust * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - targets) / n
        slope = np.bincount(place, error[owner], len(kept))
        squares += slope**2
        bias_square += error.sum() ** 2
        step = rate / np.sqrt(squares)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step / n, 0)
        bias -= rate * error.sum() / np.sqrt(bias_square)
    weights[kept] = w
    return weights, bias


@dataclass
class Scorer:
    """Weights and intercepts for low quality and toxicity, and the label models behind them."""

    weights: np.ndarray  # float32, two rows
    bias: np.ndarray
    quality: LabelModel
    toxic: LabelModel

    def score(self, text: str) -> tuple[float, float]:
        slots = features(signals(text))
        odds = self.weights[:, slots].sum(axis=1, dtype=float) + self.bias
        low, toxic = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return float(low), float(toxic)


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Label models from the votes on all of ``docs``, scorer from about ``sample`` of them.

    ``labels`` (doc_id, quality, toxic: 1 or 0) may cover some documents; of repeated labels the worst counts, null says
    nothing. Null text is an empty text, documents with a null id have no human label. Without documents the scorer keeps all.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    human = _human(labels) if labels is not None else docs.sparkSession.createDataFrame([], "id long, human_quality int, human_toxic int")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s.quality, s.toxic) for s in map(signals, texts(batch["text"]))]  # a text's words are dropped before the next one
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array([f[k] for f in found], pa.int32()) for k in range(2))], ["id", "quality", "toxic"])

    votes = _with_human(base.mapInArrow(vote, "id long, quality int, toxic int"), human)
    counts = votes.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # vote patterns: a number that no corpus exceeds
    by_quality: dict[int, int] = {}
    by_toxic: dict[int, int] = {}
    for row in counts:
        by_quality[row["quality"]] = by_quality.get(row["quality"], 0) + row["n"]
        by_toxic[row["toxic"]] = by_toxic.get(row["toxic"], 0) + row["n"]
    quality, toxic = label_model(by_quality, len(QUALITY_VOTERS)), label_model(by_toxic, len(TOXIC_VOTERS))
    total = sum(row["n"] for row in counts)
    share = min(1.0, sample / max(total, 1))
    chosen = base.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s.quality, s.toxic, features(s)) for s in map(signals, texts(batch["text"]))]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()))
            columns = [batch["id"], *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "quality", "toxic", "slots"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: list[np.ndarray] = []
        targets: list[tuple[float, float]] = []
        spoken: list[bool] = []
        for batch in batches:
            slots += [np.array(s, np.int32) for s in batch["slots"].to_pylist()]
            targets += [(quality.posterior(q), toxic.posterior(t)) for q, t in zip(batch["quality"].to_pylist(), batch["toxic"].to_pylist())]
            spoken += [t not in (0, GOOD * 3**NO_INSULT) for t in batch["toxic"].to_pylist()]
        goals = np.array(targets).reshape(-1, 2)
        spoken = np.array(spoken, bool)
        for head, trust in enumerate((np.ones(len(slots)), np.where(spoken, 1.0, SILENT))):
            weights, bias = fit_scorer(slots, goals[:, head], trust)
            yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], ["head", "weights", "bias"])

    sampled = _with_human(chosen.mapInArrow(featured, "id long, quality int, toxic int, slots array<int>"), human, "slots")
    heads = sorted(sampled.repartition(1).mapInArrow(train, "head long, weights binary, bias double").collect())
    if not heads:
        return Scorer(np.zeros((2, SLOTS), np.float32), np.full(2, -5.0), quality, toxic)
    return Scorer(np.stack([np.frombuffer(h["weights"], "<f4") for h in heads]), np.array([h["bias"] for h in heads]), quality, toxic)


def _human(labels: DataFrame) -> DataFrame:
    worst = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select(
        "id",
        F.when(F.col("q").isNull(), ABSTAIN).when(F.col("q") == 0, BAD).otherwise(GOOD).alias("human_quality"),
        F.when(F.col("t").isNull(), ABSTAIN).when(F.col("t") == 0, GOOD).otherwise(BAD).alias("human_toxic"),
    )


def _with_human(votes: DataFrame, human: DataFrame, *more: str) -> DataFrame:
    def last(votes_col: str, voters: tuple[str, ...]) -> Column:
        return (F.col(votes_col) + F.coalesce(f"human_{votes_col}", F.lit(ABSTAIN)) * 3 ** (len(voters) - 1)).cast("int").alias(votes_col)

    return votes.join(human, "id", "left").select(last("quality", QUALITY_VOTERS), last("toxic", TOXIC_VOTERS), *more)


def score_column(spark: SparkSession, scorer: Scorer, text: Column) -> Column:
    """Struct ``(low_quality, toxic)`` of probabilities for a text column; the weights have a fixed size and are broadcast.

    Null text scores as empty; texts of any length are read whole, and equal texts score alike.
    """
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf("low_quality double, toxic double")
    def score(column: pa.Array) -> pa.Array:
        found = np.array([shared.value.score(t) for t in texts(column)]).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["low_quality", "toxic"])

    return score(text)


def classify(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, low_quality, toxic, kept)`` of every row of ``docs``; kept where neither probability reaches one half.

    Null text scores as empty. Null and repeated ids keep a row each, an empty table gives none, other columns are ignored.
    """
    scored = docs.select(F.col(id_col).alias("id"), score_column(docs.sparkSession, scorer, F.col(text_col)).alias("s"))
    return scored.select("id", "s.low_quality", "s.toxic", ((F.col("s.low_quality") < 0.5) & (F.col("s.toxic") < 0.5)).alias("kept"))


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the scorer keeps, with the columns of ``docs`` as they are.

    Null text scores as empty. Repeated rows are judged alike; an empty table stays empty; columns of any names come through.
    """
    s = score_column(docs.sparkSession, scorer, F.col(text_col))
    return docs.where(F.greatest(s["low_quality"], s["toxic"]) < 0.5)


@query("op9_weak_label_scorer")
def op9_weak_label_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.withColumnRenamed("id", "doc_id")
