"""Vocabulary and windows of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.ranking import group_positions
from palisade.storage import materialize, scratch_path

# Sequence length and the two reserved ids.
LENGTH = 1024
PADDING, UNKNOWN = 0, 1

SHARD = 1 << 19  # tokens of a shard of the vocabulary
HELD_SHARDS = 2
SPAN = 16 << 20  # bytes of tokens that meet the shards together


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def vocabulary(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """``(token, n, token_id)`` of all tokens, the most frequent first, ties by token; ids follow padding and unknown.

    Counting combines map-side. The distinct tokens are numbered where a sort by range left them, so no task holds the
    vocabulary. With ``size`` only the first so many tokens get a row.
    """
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "token-counts").withColumns({"_all": F.lit(0), "_less": -F.col("n")})
    placed = group_positions(counts, "_all", ["_less", "token"], "_place")
    numbered = placed.select("token", "n", (F.col("_place") + 1 + UNKNOWN).cast("int").alias("token_id"))
    return numbered if size is None else numbered.filter(F.col("token_id") <= size + UNKNOWN)


@lru_cache(maxsize=HELD_SHARDS)
def _shard(path: str, shard: int) -> dict[str, int]:
    """Ids by token of one shard, read by a Python worker when it is asked for."""
    system, inner = fs.FileSystem.from_uri(path)
    place = f"{inner}/shard={shard}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return {}
    found = pq.read_table(place, filesystem=system, columns=["token", "token_id"], partitioning=None)
    return dict(zip(found["token"].to_pylist(), found["token_id"].to_pylist()))


def _ids(tokens: list[str], path: str, shards: int) -> np.ndarray:
    """Ids of distinct tokens; shard by shard, so that a worker holds few of them."""
    found = np.full(len(tokens), UNKNOWN, np.int32)
    asked = [zlib.crc32(t.encode()) % shards for t in tokens] if shards > 1 else [0] * len(tokens)
    for shard in sorted(set(asked)):
        known = _shard(path, shard)
        for i, token in enumerate(tokens):
            if asked[i] == shard:
                found[i] = known.get(token, UNKNOWN)
    return found


def token_sequences(df: DataFrame, key: str, text: str, vocabulary_table: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key, window, sequence)``: all token ids of a text in windows of ``length``, the last one padded with zeros behind.

    Every token is in exactly one window, and a text without tokens has one window of padding. Rows that share a key keep
    windows of their own. The vocabulary is written once in shards; tasks look up the distinct tokens of some megabytes of
    text, so no token is shuffled, and a vocabulary of any size is read in parts of bounded size.
    """
    spark = df.sparkSession
    table = vocabulary_table.select("token", "token_id")
    shards = max(1, -(-table.count() // SHARD))
    path = scratch_path(spark, "vocabulary")
    table.withColumn("shard", F.crc32("token") % shards).repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    rows = df.select(F.col(key).alias("key"), words(F.col(text)).alias("tokens"))
    out = T.StructType([rows.schema["key"], *T.StructType.fromDDL("window int, sequence array<int>")])

    def windows(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(waiting).combine_chunks()
        lists = whole["tokens"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = _ids(coded.dictionary.to_pylist(), path, shards)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
        counts = np.maximum(1, -(-sizes // length))
        owner = np.repeat(np.arange(len(sizes)), counts)
        window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = np.repeat(np.cumsum(counts) - counts, sizes) * length + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded = np.full(len(owner) * length, PADDING, np.int32)
        padded[places] = ids
        for start in range(0, len(owner), 1024):
            stop = min(start + 1024, len(owner))
            edges = pa.array(np.arange(0, (stop - start + 1) * length, length, dtype=np.int32))
            sequences = pa.ListArray.from_arrays(edges, pa.array(padded[start * length : stop * length]))
            keys = whole["key"].take(pa.array(owner[start:stop])).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(window[start:stop].astype(np.int32)), sequences], ["key", "window", "sequence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.nbytes
            if held >= SPAN:
                yield from windows(waiting)
                waiting, held = [], 0
        if waiting and sum(b.num_rows for b in waiting):
            yield from windows(waiting)

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)
