"""Language-model scores by prediction by partial matching over byte contexts.

The model is a trie of byte contexts up to ``ORDER`` bytes long, learnt from all training documents: for each context the
bytes seen after it. A byte is predicted from the longest known context; if it was not seen there, the model escapes to the
next shorter one, and bytes that the longer context has seen are excluded there. Escapes are estimated by method D: half a
count of every distinct byte of a context goes to the escape. As a context's bytes
are always among those of its suffix, the excluded mass of a context is one number, kept with the context, and the code
length of a byte follows from the counts along one path of the trie. Texts are read with A-Z in lower case and words joined
by single spaces, then an end mark, which is the event that the word model scores too.

Scale: a pass counts six-byte strings and words per task, the sums are combined by key; shorter contexts are sums of longer
ones, and every string stays. The trie is cut into shards by the last two bytes of the context: all that a byte's code length
takes from contexts of two bytes and more is in one shard, the at most 65,792 shorter strings are in each. Tasks build the
shards and put them into the shared folder. A scoring task takes some megabytes of strings at a time, and the shards in turn,
of which it keeps a few; so its memory depends on neither the corpus nor its texts. Words: the ``HEAVY_WORDS`` most frequent, about, are looked up in the worker; all others of a document meet their counts in a join.
"""

from __future__ import annotations

import io
import logging
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import filesystem, texts
from palisade.llm.registry import query
from palisade.storage import materialize, scratch_path

log = logging.getLogger(__name__)

ORDER = 5
START, END = 0xFF, 0xFE  # bytes that UTF-8 text never holds
SYMBOLS = 255  # all bytes but the start mark
END_WORD = b"\n"  # the end as a word; words hold no white space
CHUNK = 1 << 20  # bytes of text whose strings are sorted together
KEPT_KEYS = 1 << 20  # strings a task keeps before it hands its counts on
KEPT_WORDS = 1 << 18
SHARD_ROWS = 2 << 20  # strings of a shard, unless a single pair of bytes has more
HELD_SHARDS = 2
SPAN = 4  # chunks of strings that meet the shards together
HEAVY_WORDS = 1 << 18


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; only ASCII white space splits."""
    return text.encode().lower().split()


def strings(datas: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(keys, owners)``: the ``order`` + 1 bytes that end at each byte of each data, packed, and the data's number; in bounded chunks."""
    pad = bytes([START]) * order
    parts: list[tuple[int, bytes]] = []
    held = 0

    def keyed() -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b"".join(p for _, p in parts), np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for _, p in parts])
        keys = np.zeros(len(joined) - order, np.uint64)
        for shift in range(order + 1):
            keys = (keys << np.uint64(8)) | joined[shift : len(joined) - order + shift]
        first = np.cumsum(sizes) - sizes
        real = np.ones(len(keys), bool)  # a key whose last byte is one of the leading context bytes of a part isn't one
        for back in range(order):
            places = first - 1 - back
            real[places[places >= 0]] = False
        return keys[real], np.repeat([d for d, _ in parts], sizes - order)

    for number, data in enumerate(datas):
        for start in range(0, len(data), CHUNK):
            lead = data[max(0, start - order) : start]
            parts.append((number, pad[len(lead) :] + lead + data[start : start + CHUNK]))
            held += len(parts[-1][1])
            if held >= CHUNK:
                yield keyed()
                parts, held = [], 0
    if parts:
        yield keyed()


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key of several tables of counts."""
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count_strings(training: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, word, n)`` over all rows of ``training(text)``: counts of byte strings (word null) and of words (gram null)."""
    schema = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def grams(found: list) -> pa.RecordBatch:
        keys, counts = merged(found)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(counts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            datas = []
            for text in texts(batch["text"]):
                own = words_of(text)
                words.update(own)
                words[END_WORD] += 1
                datas.append(b" ".join(own) + bytes([END]))
            for keys, _ in strings(datas, order):
                found.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in found) > KEPT_KEYS:
                    found = [merged(found)]
                    if len(found[0][0]) > KEPT_KEYS // 2:
                        yield grams(found)
                        found = []
            if len(words) > KEPT_WORDS:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], schema=schema)
                words.clear()
        if found:
            yield grams(found)
        if words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], schema=schema)

    parts = training.select("text").mapInArrow(run, "gram long, word binary, n long")
    return parts.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _least_count(table: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` counts of ``table(n)`` reach."""
    levels = {row["level"]: row["rows"] for row in table.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    level = 0
    while sum(rows for at, rows in levels.items() if at >= level) > most:
        level += 1
    return 1 << level


class Model:
    """The trie as sorted arrays, an order each: strings with counts; contexts with totals, distinct bytes and excluded mass."""

    def __init__(self, orders: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int) -> None:
        self.order = order
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            mine = orders == k
            place = np.argsort(keys[mine])
            own, n = keys[mine][place].astype(np.uint64), counts[mine][place].astype(float)
            heads = own >> np.uint64(8)
            starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(own) else np.zeros(0, int)
            if not len(own):
                self.strings.append((own, n))
                self.contexts.append((heads, n, n, n))
                continue
            total, distinct = np.add.reduceat(n, starts), np.diff(np.append(starts, len(own))).astype(float)
            if k:
                shorter, below = self.strings[k - 1]
                excluded = np.add.reduceat(below[np.searchsorted(shorter, own & _mask(k))], starts)
            else:
                excluded = np.zeros(len(starts))
            self.strings.append((own, n))
            self.contexts.append((heads[starts], total, distinct, excluded))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each string after the bytes before it."""
        result = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        higher = np.full(len(keys), -1)  # place of the context one longer, if it is known
        for k in range(self.order, -1, -1):
            now = keys[open_]
            heads, total, distinct, _ = self.contexts[k]
            place = _find(heads, (now & _mask(k + 1)) >> np.uint64(8))
            known = place >= 0
            full, kinds = np.zeros(len(now)), np.zeros(len(now))
            full[known], kinds[known] = total[place[known]], distinct[place[known]]
            if k < self.order:
                _, _, above, excluded = self.contexts[k + 1]
                came = higher >= 0
                full[came] -= excluded[higher[came]]
                kinds[came] -= above[higher[came]]
            own, counts = self.strings[k]
            hit = _find(own, now & _mask(k + 1))
            seen = hit >= 0
            result[open_[seen]] += np.log10(counts[hit[seen]] - 0.5) - np.log10(full[seen])
            escaped = ~seen & (kinds > 0)
            result[open_[escaped]] += np.log10(0.5 * kinds[escaped]) - np.log10(full[escaped])
            open_, higher = open_[~seen], place[~seen]
        left = SYMBOLS - (self.contexts[0][2][0] if len(self.contexts[0][0]) else 0)
        result[open_] -= np.log10(max(left, 1))
        return result

    def dump(self) -> bytes:
        """The arrays as one file."""
        out = io.BytesIO()
        parts = {f"s{k}_{i}": a for k, found in enumerate(self.strings) for i, a in enumerate(found)}
        parts |= {f"c{k}_{i}": a for k, found in enumerate(self.contexts) for i, a in enumerate(found)}
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def read(cls, path: str, order: int) -> Model:
        model = cls.__new__(cls)
        system, inner = filesystem(path)
        with system.open_input_stream(inner) as file, np.load(io.BytesIO(file.read())) as parts:
            model.order = order
            model.strings = [tuple(parts[f"s{k}_{i}"] for i in range(2)) for k in range(order + 1)]
            model.contexts = [tuple(parts[f"c{k}_{i}"] for i in range(4)) for k in range(order + 1)]
        return model


def _mask(count: int) -> np.uint64:
    return np.uint64((1 << 8 * count) - 1)


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[place] == wanted, place, -1)


@dataclass(frozen=True)
class Trie:
    """Where the shards of a trie lie: shard i holds the pairs of context bytes from ``edges[i]`` up to the next edge."""

    paths: tuple[str, ...]
    edges: tuple[int, ...]
    order: int
    n_strings: int

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64), side="right") - 1

    def log10(self, chunks: list[np.ndarray], backwards: bool = False) -> list[np.ndarray]:
        """Log probabilities of the strings of each chunk; the shards are read one after the other."""
        places = [self.shard_of(keys) for keys in chunks]
        found = [np.zeros(len(keys)) for keys in chunks]
        turns = range(len(self.paths))
        for shard in reversed(turns) if backwards else turns:
            asked = [np.flatnonzero(p == shard) for p in places]
            if any(map(len, asked)):
                model = _shard(self.paths[shard], self.order)
                for keys, own, costs in zip(chunks, asked, found):
                    costs[own] = model.log10(keys[own])
        return found


@lru_cache(maxsize=HELD_SHARDS)
def _shard(path: str, order: int) -> Model:
    """A shard, read by a Python worker when it is asked for."""
    return Model.read(path, order)


@lru_cache(maxsize=1)
def _heavy_words(path: str, divisor: float) -> dict[bytes, float]:
    """The frequent words' log10 probabilities, read once per Python worker."""
    system, inner = filesystem(path)
    heavy = pq.read_table(inner, filesystem=system, columns=["word", "n"])
    return dict(zip(heavy["word"].to_pylist(), np.log10((heavy["n"].to_numpy() + 0.5) / divisor).tolist()))


def write_trie(counts: DataFrame, folder: str, order: int = ORDER, most: int | None = None) -> Trie:
    """Write the trie of ``count_strings`` below ``folder``, in shards of about ``most`` strings.

    Every string counted is in it. The pairs of bytes, at most 65,536, are counted and cut into shards; a task builds a shard.
    An empty table of counts gives a trie that knows nothing.
    """
    spark = counts.sparkSession
    top = counts.where("gram IS NOT NULL").select(F.col("gram").alias("key"), "n")
    levels = None
    for k in range(order, -1, -1):
        own = top if k == order else top.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        own = own.select(F.lit(k).alias("level"), "key", "n")
        levels = own if levels is None else levels.union(own)
    strings_path = f"{folder}/strings"
    levels.write.partitionBy("level").parquet(strings_path)
    levels = spark.read.schema("level int, key long, n long").parquet(strings_path)
    pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = sorted((r["pair"], r["rows"]) for r in levels.where("level > 1").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("rows")).collect())
    edges, held = [0], 0
    for code, rows in sizes:
        if held and held + rows > (most or SHARD_ROWS):
            edges.append(code)
            held = 0
        held += rows
    n_strings = sum(rows for _, rows in sizes) + levels.where("level < 2").count()
    log.info("the trie holds %d strings in %d shards", n_strings, len(edges))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        system, inner = filesystem(folder)
        parts = [rows[rows["level"] > 1]]
        for level in (0, 1):
            base = f"{inner}/strings/level={level}"
            if system.get_file_info(base).type != fs.FileType.NotFound:
                parts.append(pq.read_table(base, filesystem=system, columns=["key", "n"], partitioning=None).to_pandas().assign(level=level))
        whole = pd.concat(parts)
        model = Model(whole["level"].to_numpy(), whole["key"].to_numpy(), whole["n"].to_numpy(), order)
        name = f"{folder}/{uuid.uuid4().hex}.npz"  # of this attempt; the table of shards names those that count
        with system.open_output_stream(inner + name[len(folder) :]) as file:
            file.write(model.dump())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "path": [name]})

    starts = F.array(*[F.lit(e) for e in edges])
    shard = F.size(F.filter(starts, lambda e: e <= pair)) - 1
    rows = levels.where("level > 1").select(shard.alias("shard"), "level", "key", "n")
    rows = rows.union(spark.range(len(edges)).select(F.col("id").cast("int").alias("shard"), F.lit(-1), F.lit(0).cast("long"), F.lit(0).cast("long")))
    built = materialize(rows.groupBy("shard").applyInPandas(build, "shard int, path string"), "shards")
    return Trie(tuple(r["path"] for r in built.orderBy("shard").collect()), tuple(edges), order, n_strings)


def held_out(key: Column) -> Column:
    """True for the fifth of documents that nothing is learnt from. A null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row of ``docs``; scores are log10 probabilities.

    Learns from all rows that aren't held out. ``base_score`` is the add-half unigram word model, ``score`` the byte model.
    Null text counts as empty: its end mark alone is scored. Null and repeated ids keep a row each, an empty table gives no
    rows, with nothing to learn from all bytes are equally likely. Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("held_out", held_out(F.col("id")))
    counts = materialize(count_strings(base.where("NOT held_out"), order), "counts")
    trie = write_trie(counts, scratch_path(spark, "trie"), order)
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = _least_count(words, HEAVY_WORDS)
    words_path = scratch_path(spark, "words")
    words.where(F.col("n") >= heavy).write.parquet(words_path)
    divisor = total + 0.5 * (vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _heavy_words(words_path, divisor)
        row, turn = TaskContext.get().partitionId() << 40, False
        for batch in batches:
            datas, sizes, known, sums, rare = [], [], [], [], []
            for text in texts(batch["text"]):
                own = words_of(text)
                datas.append(b" ".join(own) + bytes([END]))
                sizes.append(len(own) + 1)
                seen = Counter(own)
                seen[END_WORD] = 1
                score, hits, others = 0.0, 0, []
                for word, n in seen.items():
                    term = terms.get(word)
                    if term is None:
                        others.append((word, n))
                    else:
                        score += n * term
                        hits += n
                known.append(hits)
                sums.append(score)
                rare.append(others)
            scores = np.zeros(len(datas))
            chunks = strings(datas, order)
            while span := list(islice(chunks, SPAN)):
                owners = [own.astype(np.int32) for _, own in span]  # rows of a batch, and places of a chunk: small numbers
                found = []
                for i, (keys, _) in enumerate(span):
                    span[i] = (None, None)
                    own, place = np.unique(keys, return_inverse=True)
                    found.append((own, place.astype(np.int32)))
                    del keys, place
                del span
                turn = not turn
                for costs, (_, place), own in zip(trie.log10([keys for keys, _ in found], turn), found, owners):
                    scores += np.bincount(own, costs[place], len(datas))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(datas))), batch["id"], batch["held_out"], pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(scores), _pairs(rare)],
                ["row", "id", "held_out", "n_tokens", "known", "sum", "score", "rare"],
            )
            row += len(datas)

    schema = "row long, id long, held_out boolean, n_tokens long, known long, sum double, score double, rare array<struct<word: binary, n: long>>"
    scored = materialize(base.mapInArrow(run, schema), "scores")
    each = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    met = each.join(words.where(F.col("n") < heavy), "word", "left").select(
        "row",
        (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / divisor)).alias("term"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("hits"),
    )
    rest = met.groupBy("row").agg(F.sum("term").alias("term"), F.sum("hits").alias("hits"))
    return scored.drop("rare").join(rest, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("term", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _pairs(rows: list[list[tuple[bytes, int]]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = [p for r in rows for p in r]
    pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


@query("op8_partial_matching")
def op8_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
