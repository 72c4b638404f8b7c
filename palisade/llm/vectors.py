"""Near-duplicate vectors: sign hashing against random hyperplanes in several tables, exact cosines, connected components.

Two vectors at cosine 0.98 fall on the same side of a random hyperplane with probability 0.936. With ``BITS`` planes a table
and ``TABLES`` tables a pair at the very threshold meets with probability 1 - (1 - 0.936 ** 12) ** 16 = 0.9999; closer pairs
nearly always. Every pair that meets is compared in double precision, so no link below the threshold is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import whole_groups
from palisade.llm.registry import query
from palisade.llm.simhash import _group_bounds, pieces
from palisade.llm.unions import connected_components, join_sets
from palisade.storage import materialize

BITS = 12
TABLES = 16
BUCKET_ROWS = 1024
SEED = 20240501


def usable(label: Column, vector: Column) -> Column:
    """True for rows that may link: a label, and a vector of finite components that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & some, F.lit(False))


def hyperplanes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Normal vectors of the planes, a column each; the same on every worker."""
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, bits * tables))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Signs against the planes of each table, packed: one number per vector and table."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    bits: int = BITS,
    tables: int = TABLES,
    seed: int = SEED,
) -> DataFrame:
    """One row ``(id, n_links, component)`` per row of ``rows``; vectors are compared only within a label and dimension.

    Equal vectors of a label form one class that is compared once and counted with its size, so copies are never expanded to
    pairs. A pair counts in the first table where it meets, decided from both vectors alone, so counts need no duplicate
    removal. Hot buckets are cut into pieces that meet two at a time. A null label or a vector that is null, empty, zero or
    not finite links with nothing: no links, and its component is its own id. Repeated rows count as other vectors. A null id
    is never a component unless all ids of the component are null. An empty table gives no rows; other columns are ignored.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.withColumn("ok", usable(F.col("label"), F.col("vector")))
    grouped = base.where("ok").groupBy("label", "vector").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sized = classes.select("node", "label", F.size("vector").alias("width"), "vector")

    def hash_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                found = signatures(_matrix(part["vector"], int(width)), bits, tables, seed)
                yield pa.RecordBatch.from_arrays([part["node"], pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), pa.array(found.ravel()))], ["node", "signs"])

    hashed = sized.select("node", "width", "vector").mapInArrow(hash_signs, "node long, signs array<long>")
    placed = hashed.join(sized.select("node", "label", "width"), "node")
    members = placed.select("node", F.xxhash64("label", "width").alias("kind"), F.posexplode("signs").alias("t", "bucket"))
    keys = ["kind", "t", "bucket", "lo", "hi"]
    met = pieces(members, ["kind", "t", "bucket"], F.col("node"), BUCKET_ROWS)
    full = met.join(classes.select("node", "label", "n", "vector"), "node").select("node", "n", "piece", *keys, F.size("vector").alias("width"), "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 2048):
            first, end = _group_bounds(table, keys)
            nodes, sizes, piece, turn, width = (table[c].to_numpy() for c in ("node", "n", "piece", "t", "width"))
            across = table["lo"].to_numpy() != table["hi"].to_numpy()
            parent, others = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for start in np.unique(first):
                stop = end[start]
                if stop - start < 2:
                    continue
                vectors = _matrix(table["vector"].slice(start, stop - start), int(width[start]))
                lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                close = (vectors @ vectors.T) / np.outer(lengths, lengths) >= threshold
                np.fill_diagonal(close, False)
                if across[start]:
                    close &= piece[start:stop, None] != piece[None, start:stop]
                if not close.any():
                    continue
                if turn[start]:
                    signs = signatures(vectors, bits, tables, seed)
                    for earlier in range(int(turn[start])):
                        close &= signs[:, earlier][:, None] != signs[:, earlier][None, :]
                others[start:stop] += close @ sizes[start:stop]
                i, j = np.nonzero(np.triu(close))
                parent = join_sets(parent, i + start, j + start)
            linked = np.flatnonzero(others)
            moved = np.flatnonzero(parent != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nodes[linked], nodes[moved]])),
                    pa.array(np.concatenate([others[linked], np.zeros(len(moved), np.int64)])),
                    pa.array(np.concatenate([nodes[linked], nodes[parent[moved]]])),
                ],
                ["node", "others", "root"],
            )

    found = materialize(full.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(compare, "node long, others long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("others").alias("others"))
    nodes = connected_components(found.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    rooted = classes.join(nodes, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    answers = rooted.join(least, "root").join(counts, "node", "left").select("label", "vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    alone = base.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return base.where("ok").join(answers, ["label", "vector"]).select("id", "n_links", "component").union(alone)


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached(src, dst) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.src, l.dst FROM reached r JOIN links l ON r.dst = l.src
), least AS (SELECT src, min(dst) AS component_id FROM reached GROUP BY src),
counts AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.src = e.vec_id LEFT JOIN counts c ON c.src = e.vec_id
"""


@query("op3_hyperplane_near_vectors", ORACLE)
def op3_hyperplane_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
