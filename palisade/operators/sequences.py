"""Behaviour sequences as they stood at each event, and a sequence model over them.

The model counts, for each class, which step followed which steps before (contexts of up to ``order`` steps) and smooths every
context by the shorter one inside it (Witten and Bell's estimate). A sequence's score is the sum over its steps of the
logarithm of the two classes' probabilities for that step. All contexts are in the model, seen or not, so its size is set by
the number of symbols and the order alone: scoring is a look-up in one array inside the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.ranking import group_positions
from palisade.storage import materialize

LENGTH = 32  # steps of a window
BLOCK = 4096  # events of a key that one window task sorts
ORDER = 2


def trailing_windows(
    df: DataFrame, key: str, time: str, tie: str, columns: Mapping[str, str], length: int = LENGTH, block: int = BLOCK
) -> DataFrame:
    """``df`` with arrays of the latest ``length`` values up to and with each row, in the order of ``time`` and ``tie``.

    ``columns`` maps the array's name to the column it gathers. A key's events are cut into blocks, and the last rows of a
    block also stand in front of the next one, so a hot key is spread over many tasks.
    """
    if length > block:
        raise ValueError("a window must fit into a block")
    placed = group_positions(df, key, [time, tie], "_position")
    own = F.floor(F.col("_position") / block)
    edge = F.col("_position") % block >= block - (length - 1)
    blocks = F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_block", F.explode(blocks))
    window = Window.partitionBy(key, "_block").orderBy("_position").rowsBetween(-(length - 1), 0)
    gathered = spread.withColumns({name: F.collect_list(F.struct(F.col(c).alias("v"))).over(window) for name, c in columns.items()})
    kept = gathered.filter(F.col("_block") == own)
    return kept.withColumns({name: F.transform(name, lambda x: x["v"]) for name in columns}).drop("_position", "_block")


def symbols(steps: Column, edges: Sequence[float]) -> Column:
    """Steps as numbers of the ascending ``edges`` they reach; a null or NaN step reaches none."""
    reached = lambda x: sum((F.coalesce((x >= float(e)) & ~F.isnan(x), F.lit(False)).cast("int") for e in edges), F.lit(0))
    return F.transform(steps, lambda x: reached(x.cast("double")))


def transition_counts(samples: DataFrame, label: str, found: str, order: int = ORDER) -> DataFrame:
    """``(label, context, symbol, n)`` over all steps of the symbol arrays ``found``, for contexts of 0 to ``order`` symbols.

    Contexts are texts of symbols with commas. Only the longest context of each step is counted over the rows; the shorter
    ones are sums of these counts.
    """
    usable = samples.filter(F.col(label).isNotNull() & (F.size(found) > 0))
    steps = usable.select(F.col(label).cast("int").alias("label"), F.col(found).alias("s"), F.explode(F.sequence(F.lit(0), F.size(found) - 1)).alias("t"))
    back = F.least("t", F.lit(order))
    longest = F.slice("s", F.col("t") - back + 1, back)
    counted = steps.select("label", longest.alias("c"), F.get("s", F.col("t")).alias("symbol")).groupBy("label", "c", "symbol").agg(F.count(F.lit(1)).alias("n"))
    shorter = F.transform(F.sequence(F.lit(0), F.size("c")), lambda k: F.array_join(F.slice("c", F.size("c") - k + 1, k).cast("array<string>"), ","))
    return counted.select("label", F.explode(shorter).alias("context"), "symbol", "n").groupBy("label", "context", "symbol").agg(F.sum("n").alias("n"))


def log_odds_table(counts: DataFrame, n_symbols: int, order: int = ORDER) -> DataFrame:
    """``(place, context, symbol, log_odds)`` for every context and symbol, from counts of the classes 0 and 1.

    ``p(s | c) = (n(c, s) + T(c) p(s | c')) / (N(c) + T(c))``: T counts the different symbols after ``c``, ``c'`` is ``c``
    without its first symbol, and below the empty context all symbols are alike. ``place`` is the row's index in the array.
    """
    spark = counts.sparkSession
    width = n_symbols
    grid = [
        (sum(width ** (j + 1) for j in range(k)) + symbol + sum(c * width ** (k - i) for i, c in enumerate(context)), k, ",".join(map(str, context)), ",".join(map(str, context[1:])), symbol)
        for k in range(order + 1)
        for context in product(range(width), repeat=k)
        for symbol in range(width)
    ]
    table = spark.createDataFrame(grid, "place long, k int, context string, shorter string, symbol int")
    counted = materialize(counts, "transitions")
    totals = counted.groupBy("label", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    for label in (0, 1):
        seen = counted.filter(F.col("label") == label).select("context", "symbol", F.col("n").alias(f"n{label}"))
        around = totals.filter(F.col("label") == label).select("context", F.col("total").alias(f"total{label}"), F.col("kinds").alias(f"kinds{label}"))
        table = table.join(seen, ["context", "symbol"], "left").join(around, "context", "left")
    table = materialize(table.fillna(0), "contexts")
    below = table.filter("k = 0").select("symbol", F.col("context").alias("shorter"), *[F.lit(1.0 / width).alias(f"q{y}") for y in (0, 1)])
    levels = None
    for k in range(order + 1):
        at = table.filter(F.col("k") == k).join(below, ["symbol", "shorter"])
        smooth = lambda y: F.when(F.col(f"total{y}") == 0, F.col(f"q{y}")).otherwise(
            (F.col(f"n{y}") + F.col(f"kinds{y}") * F.col(f"q{y}")) / (F.col(f"total{y}") + F.col(f"kinds{y}")))
        level = at.select("place", "context", "symbol", smooth(0).alias("p0"), smooth(1).alias("p1"))
        below = level.select("symbol", F.col("context").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        levels = level if levels is None else levels.union(level)
    return materialize(levels.select("place", "context", "symbol", F.ln(F.col("p1") / F.col("p0")).alias("log_odds")), "log-odds")


@dataclass(frozen=True)
class SequenceModel:
    """Log-odds of every context and symbol, and how steps become symbols."""

    edges: tuple[float, ...]
    order: int
    log_odds: tuple[float, ...]

    @classmethod
    def fit(cls, samples: DataFrame, label: str, steps: str, edges: Sequence[float], order: int = ORDER) -> SequenceModel:
        """Fit on the step arrays of labelled samples. The model has a number for each context and symbol, whatever the input."""
        found = samples.select(label, symbols(F.col(steps), edges).alias("_symbols"))
        table = log_odds_table(transition_counts(found, label, "_symbols", order), len(edges) + 1, order)
        return cls(tuple(map(float, edges)), order, tuple(r["log_odds"] for r in table.orderBy("place").collect()))

    def score(self, steps: Column) -> Column:
        """Sum of the log-odds of all steps; positive sequences look like class 1, an empty one scores 0."""
        width = len(self.edges) + 1
        known = F.array(*[F.lit(v) for v in self.log_odds])

        def over(s: Column) -> Column:
            def at(t: Column) -> Column:
                k = F.least(t, F.lit(self.order))
                offset = F.element_at(F.array(*[F.lit(sum(width ** (j + 1) for j in range(n))) for n in range(self.order + 1)]), k + 1)
                place = F.get(s, t) + offset
                for j in range(1, self.order + 1):
                    place = place + F.when(t >= j, F.get(s, t - j) * width**j).otherwise(0)
                return F.get(known, place.cast("int"))

            return F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), F.lit(0.0), lambda a, t: a + at(t))

        bound = F.transform(F.array(symbols(steps, self.edges)), lambda s: F.when(F.size(s) > 0, over(s)).otherwise(F.lit(0.0)))
        return F.coalesce(F.get(bound, F.lit(0)), F.lit(0.0))

    def save(self, spark, path: str) -> None:
        rows = [(list(self.edges), self.order, list(self.log_odds))]
        spark.createDataFrame(rows, "edges array<double>, order int, log_odds array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> SequenceModel:
        row = spark.read.parquet(path).first()
        return cls(tuple(row["edges"]), row["order"], tuple(row["log_odds"]))
