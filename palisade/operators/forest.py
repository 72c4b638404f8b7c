"""Isolation forest whose trees grow in parallel tasks and whose nodes are a DataFrame.

Sampling is keyed by a hash of the row id, so a lost task repeats it exactly. One pass keeps a pool of a
few times ``trees * sample`` rows however large the table is; each tree then takes the ``sample`` rows
of the pool with the smallest tree-specific hash. Sub-sampling is part of the algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.ranking import quantiles
from palisade.storage import materialize

# Forest sizes and default contamination.
TREES = 150
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.05

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
WALK = 256  # points that go down the trees together: their places stay in a core's cache
_HASH_SPAN = 2.0**63
_SURPLUS = 2.0


def path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """Nodes of one isolation tree over at most ``SAMPLE`` rows."""
    random = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[list] = []
    waiting = [(np.arange(len(rows)), 0)]
    links: list[tuple[int, int]] = [(-1, 0)]
    while waiting:
        members, depth = waiting.pop()
        parent, side = links.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = at
        part = rows[members]
        spread = np.flatnonzero(part.min(axis=0) < part.max(axis=0)) if len(part) > 1 else np.array([], dtype=int)
        if depth >= limit or len(spread) == 0:
            nodes.append([at, -1, 0.0, -1, -1, len(members), depth])
            continue
        feature = int(random.choice(spread))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(random.uniform(low, high))
        below = part[:, feature] <= threshold
        nodes.append([at, feature, threshold, -1, -1, len(members), depth])
        waiting += [(members[~below], depth + 1), (members[below], depth + 1)]
        links += [(at, 1), (at, 0)]
    frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    frame.insert(0, "tree", tree)
    return frame


def tree_samples(df: DataFrame, key: str, columns: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``(tree, row_key, values)`` with at most ``sample`` rows per tree."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(key).alias("row_key"), values.alias("values")).filter(~F.exists("values", lambda v: v.isNull() | F.isnan(v)))
    uniform = lambda *parts: F.abs(F.xxhash64(*parts)).cast("double") / _HASH_SPAN
    total = max(1, rows.count())
    wanted = float(trees * sample)
    pool = rows.filter(uniform(F.lit(seed), F.col("row_key")) < _SURPLUS * wanted / total)
    pool_size = min(total, _SURPLUS * wanted)
    draw = lambda tree: F.xxhash64(F.lit(seed), tree, F.col("row_key"))
    # Twice the wanted share of the pool reaches a tree, chosen inside the row before it is exploded; the rank then
    # cuts to exactly ``sample`` rows.
    share = F.lit(_SURPLUS * sample / pool_size)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.abs(draw(tree)).cast("double") / _HASH_SPAN < share)
    near = pool.withColumn("tree", F.explode(drawn)).withColumn("draw", draw(F.col("tree")))
    order = Window.partitionBy("tree").orderBy("draw", "row_key")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).drop("rank", "draw")


@dataclass(frozen=True)
class IsolationForest:
    """Fitted forest: feature names, node table, sample size used, decision offset, scores of the training rows."""

    columns: tuple[str, ...]
    nodes: DataFrame
    sample: int
    offset: float | None = None
    training: DataFrame | None = None

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        key: str,
        columns: Sequence[str],
        trees: int = TREES,
        sample: int = SAMPLE,
        seed: int = SEED,
        contamination: float | None = CONTAMINATION,
    ) -> IsolationForest:
        """Grow the trees and set the offset to the contamination quantile of the training scores.

        Every row is scored for the offset, and these scores are kept as ``training`` (key, anomaly, decision),
        so nobody has to score the training rows again. The quantile is exact. ``sample`` rows a tree are part of the method:
        a bound on the rows that a tree grows from, whatever the size of the table.
        """
        samples = tree_samples(df, key, columns, trees, sample, seed)

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            ordered = group.sort_values("row_key")
            return _grow(np.stack(ordered["values"].to_numpy()), int(ordered["tree"].iloc[0]), seed)

        nodes = materialize(samples.groupBy("tree").applyInPandas(grow, NODES), "forest-nodes")
        used = nodes.agg(F.max(F.when(F.col("node") == 0, F.col("size")))).first()[0]
        if not used:
            raise ValueError("no usable rows to fit on")
        forest = cls(tuple(columns), nodes, int(used))
        if contamination is None:
            return forest
        scores = materialize(forest.score(df, keep=[key]), "training-scores")
        negative = scores.select((-F.col("anomaly")).alias("negative"))
        offset = float(quantiles(negative, ["negative"], [contamination]).first()["quantile"])
        decided = scores.withColumn("decision", -F.col("anomaly") - F.lit(offset))
        return cls(forest.columns, nodes, forest.sample, offset, decided)

    def score(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Adds ``anomaly`` in (0, 1], and ``decision`` (negative for anomalies) once an offset is known.

        A row with a missing feature gets NULL. The node table is bounded by trees times twice the sample,
        so it is shipped to the executors once.
        """
        columns, sample, offset = list(self.columns), self.sample, self.offset
        table = self.nodes.orderBy("tree", "node").toPandas()
        shipped = df.sparkSession.sparkContext.broadcast(_packed(table))
        mean_depth = path_constant(sample) or 1.0

        width = len(columns)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = shipped.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                lists = table.column("_values").combine_chunks()
                points = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                found = np.full(len(points), np.nan)
                usable = ~np.isnan(points).any(axis=1)
                found[usable] = 2.0 ** (-_mean_path(points[usable], forest) / mean_depth)
                column = pa.array(found, type=pa.float64(), from_pandas=True)
                yield from table.drop_columns(["_values"]).append_column("anomaly", column).to_batches()

        kept = list(df.columns if keep is None else keep)
        values = F.array(*[F.col(c).cast("double") for c in columns])
        rows = df.select(*kept, values.alias("_values"))
        schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("anomaly", T.DoubleType())])
        scored = rows.mapInArrow(walk, schema)
        if offset is not None:
            scored = scored.withColumn("decision", -F.col("anomaly") - F.lit(offset))
        return scored

    def save(self, path: str) -> None:
        """Nodes as Parquet with the scalars as columns."""
        settings = self.nodes.withColumns(
            {
                "columns": F.array(*[F.lit(c) for c in self.columns]),
                "sample": F.lit(self.sample),
                "offset": F.lit(self.offset).cast("double"),
            }
        )
        settings.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        stored = spark.read.parquet(path)
        head = stored.select("columns", "sample", "offset").first()
        return cls(tuple(head["columns"]), stored.drop("columns", "sample", "offset"), head["sample"], head["offset"])


def _packed(table: pd.DataFrame) -> tuple:
    """All trees in one set of arrays, roots first, then children in pairs, so that one number leads to both.

    A leaf leads back to itself and nothing exceeds its threshold, so a walk needs no case for it.
    """
    first = table.groupby("tree")["node"].transform("size").groupby(table["tree"]).first().cumsum().shift(fill_value=0)
    base = table["tree"].map(first).to_numpy(np.int64)
    leaf = table["feature"].to_numpy() < 0
    left, right = (base + table[side].to_numpy(np.int64) for side in ("left", "right"))
    inner = np.flatnonzero(~leaf)
    place = np.empty(len(table), np.int64)
    place[first.to_numpy(np.int64)] = np.arange(len(first))
    place[left[inner]] = len(first) + 2 * np.arange(len(inner))
    place[right[inner]] = place[left[inner]] + 1
    order = np.argsort(place)
    feature = np.where(leaf, 0, table["feature"].to_numpy(np.int64))
    threshold = np.where(leaf, np.inf, table["threshold"].to_numpy())
    children = np.where(leaf, place, place[np.where(leaf, 0, left)])
    length = table["depth"].to_numpy() + np.array([path_constant(n) for n in table["size"]])
    return len(first), int(table["depth"].max()), feature[order], threshold[order], children[order], length[order]


def _mean_path(points: np.ndarray, forest: tuple) -> np.ndarray:
    """Mean path length of each point: some points at a time go down tree after tree, one level at a time."""
    trees, depth, feature, threshold, children, length = forest
    total = np.empty(len(points))
    for start in range(0, len(points), WALK):
        part = np.ascontiguousarray(points[start : start + WALK].T)
        flat, count = part.ravel(), part.shape[1]
        column, row = feature * count, np.arange(count)
        at = np.repeat(np.arange(trees), count).reshape(trees, count)
        for _ in range(depth):
            beyond = flat.take(column.take(at) + row) > threshold.take(at)
            at = children.take(at) + beyond
        total[start : start + WALK] = np.ascontiguousarray(length.take(at).T).mean(axis=1)
    return total
