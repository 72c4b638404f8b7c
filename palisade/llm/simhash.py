"""Near-duplicate documents by SimHash fingerprints, compared on vertical bit planes.

A fingerprint holds 64 majority bits over the hashes of a document's word shingles. Fingerprints within ``radius`` bits must
agree on at least ``BLOCKS - radius`` of ``BLOCKS`` blocks of bits, so every close pair meets in the bucket of some choice of
agreeing blocks: the search is exact. Buckets are compared on bit planes: plane j holds bit j of 64 fingerprints in a word, a
fingerprint is compared with 64 others per step, distances are kept in carry-save counters, and a word is abandoned when all
its lanes are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import overlap
from palisade.llm.batches import texts, whole_groups
from palisade.llm.marks import flagged
from palisade.llm.registry import query
from palisade.llm.unions import connected_components, join_sets
from palisade.storage import materialize

BITS = 64
BLOCKS = 5  # bits are cut into this many blocks; a bucket fixes BLOCKS - radius of them
BUCKET_ROWS = 2048  # larger buckets are cut into pieces of about this size, and every two pieces meet
CELLS = 1 << 14  # words compared at a time
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of word shingles; zero for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    total = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, total))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, extra: Column | None = None
) -> DataFrame:
    """``(id, extra, fp)``: the fingerprint of every row's whole text as a signed 64-bit number. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in texts(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["extra"], pa.array(found)], ["id", "extra", "fp"])

    kept = F.lit(0).cast("long") if extra is None else extra.cast("long")
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), kept.alias("extra"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, extra long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of all choices of blocks that a close pair may agree on."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(blocks, BLOCKS - radius)]


def close_pairs(prints: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs ``(i, j)``, i < j, of one group with at most ``radius`` differing bits.

    Row i belongs to the group of rows ``first[i]`` to ``end[i]`` (exclusive). Rows are lanes of 64-bit words.
    """
    count = len(prints)
    words = -(-count // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:count] = prints
    lanes = ((padded[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    planes = np.ascontiguousarray(np.packbits(lanes, axis=0, bitorder="little").T).view(np.uint64)
    rows = np.arange(count)
    spans = (end - 1) // 64 - rows // 64 + 1  # words with later rows of the group
    stops = np.cumsum(spans)
    counters = max(1, int(radius).bit_length())
    spare = (1 << counters) - 1 - radius  # start value, so that the first overflow means a distance beyond the radius
    for low in range(0, int(stops[-1]) if count else 0, CELLS):
        cells = np.arange(low, min(low + CELLS, int(stops[-1])))
        mine = np.searchsorted(stops, cells, side="right")
        word = mine // 64 + cells - (stops[mine] - spans[mine])
        lane = (mine % 64).astype(np.uint64)
        wanted = np.where(word == mine // 64, (FULL << lane) & ~(np.uint64(1) << lane), FULL)
        left = np.minimum(end[mine] - word * 64, 64)
        wanted &= np.where(left >= 64, FULL, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        beyond = ~wanted
        sums = [np.full(len(cells), FULL if spare >> k & 1 else 0, np.uint64) for k in range(counters)]
        for bit in range(BITS):
            if bit % 8 == 0:
                alive = beyond != FULL
                if not alive.all():
                    mine, word, beyond = mine[alive], word[alive], beyond[alive]
                    sums = [s[alive] for s in sums]
                if not len(mine):
                    break
            same = np.uint64(0) - ((prints[mine] >> np.uint64(bit)) & np.uint64(1))
            carry = planes[bit][word] ^ same
            for k in range(counters):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            beyond |= carry
        near = ~beyond
        hit = near != 0
        if not hit.any():
            continue
        cell, place = np.nonzero(np.unpackbits(near[hit].view(np.uint8), bitorder="little").reshape(-1, 64))
        yield mine[hit][cell], word[hit][cell] * 64 + place


def _group_bounds(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and end row of the group of each row."""
    count = table.num_rows
    new = np.zeros(count, bool)
    new[0] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return starts[group], np.append(starts[1:], count)[group]


def pieces(members: DataFrame, keys: list[str], item: Column, rows: int) -> DataFrame:
    """Members of buckets with at least two rows, with ``lo`` and ``hi``: the two pieces of the bucket that meet.

    A bucket of up to ``rows`` rows is one piece. A larger one is cut by a hash of ``item``; each row goes to its own piece's
    meetings with every piece, so that no task gets more than two pieces of any bucket and every two rows meet.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / rows).cast("int")
    placed = members.join(sizes, keys).withColumn("piece", F.pmod(F.xxhash64(item, F.lit(7)), cut).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    return met.select(
        *members.columns, "piece", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi")
    )


def links(distinct_prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``(src, dst)`` that join exactly the fingerprints ``fp`` linked, directly or by way of others, at ``radius`` bits.

    ``distinct_prints`` has one row per fingerprint. Each task reduces what it finds to a forest, so a dense group of n
    fingerprints yields about n edges per choice of blocks, never all pairs.
    """
    masks = F.array(*[F.struct(F.lit(t).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(block_masks(radius))])
    members = distinct_prints.select("fp", F.explode(masks).alias("m")).select("fp", "m.mask", "m.bits")
    keys = ["mask", "bits", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            prints = table["fp"].to_numpy().view(np.uint64)
            first, end = _group_bounds(table, keys)
            parent = np.arange(len(prints))
            for i, j in close_pairs(prints, first, end, radius):
                parent = join_sets(parent, i, j)
            moved = np.flatnonzero(parent != np.arange(len(prints)))
            signed = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[parent[moved]])], ["src", "dst"])

    met = pieces(members, ["mask", "bits"], F.col("fp"), BUCKET_ROWS)
    return met.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "src long, dst long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row ``(id, fp, component)`` per row of ``docs``; component is the smallest id linked, directly or through others.

    Null text counts as empty; all texts without words share the fingerprint zero. A null id takes part, but is never a
    component unless all ids of the component are null. Repeated ids keep a row each. An empty table gives no rows. Other
    columns, whatever their names, are ignored. Equal fingerprints are collapsed before anything is compared.
    """
    found = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = _rooted(found.groupBy("fp").agg(F.min("id").alias("first_id")), radius)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return found.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """``(fp, first_id, root)`` of classes of equal fingerprints; root is the smallest fingerprint of the component."""
    return _rooted_by(classes, links(classes.select("fp"), radius))


def _rooted_by(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, first_id, root)`` of classes linked by ``edges``; root is the smallest class of the component."""
    nodes = connected_components(edges)
    return classes.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))


def close_sets(found: DataFrame, radius: int = 3) -> DataFrame:
    """Candidates ``(src, dst)`` of ``overlap.shingle_sets``: sets whose majority bits the bit planes link, each with the least of them.

    Equal fingerprints are one; the empty set has no candidates, and an empty table gives none.
    """
    known = materialize(found.where("n > 0").select("fp", "bits").distinct(), "prints")
    linked = connected_components(links(known.select(F.col("bits").alias("fp")).distinct(), radius))
    rooted = known.join(linked, F.col("bits") == F.col("node"), "left").select("fp", F.coalesce("component", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("fp").alias("dst"))
    return rooted.join(least, "root").where("fp <> dst").select(F.col("fp").alias("src"), "dst")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, with the columns of ``docs`` as they are.

    Two rows are linked if the sets of their shingles of ``width`` words have a Jaccard similarity of ``similarity`` at least;
    a group is linked directly or through others. Candidates come from the bit planes, over fingerprints of these sets, and what
    is similar beyond their radius from chained prefixes (``palisade.llm.overlap``); all are confirmed by whole sets, so the
    result is exact. A row is known by its id and a hash of its text. Rows that stay and are the only ones under their id and hash
    pass by without a shuffle; all others, and the few whose marks can't be told from theirs, are looked up. If the smallest id has several texts, the smallest hash stays; of rows that repeat both, one stays. Groups without
    any id keep the row with the smallest hash. Null text and text without words have the empty set and are copies of each
    other. An empty table stays empty; other columns, whatever their names, come through untouched.
    """
    spare = [f"{_unused(docs.columns)}{k}" for k in range(3)]
    marked = docs.withColumns({spare[0]: F.col(id_col).cast("long"), spare[1]: F.xxhash64(text_col)})
    chosen_texts = marked.select(F.col(spare[0]).alias("id"), F.col(spare[1]).alias("extra"), F.col(text_col).alias("text"))
    found = materialize(overlap.shingle_sets(chosen_texts, width, similarity), "sets")
    classes = found.groupBy("fp").agg(F.min(_row_order()).alias("first_id"))
    near = close_sets(found).union(overlap.chains(found, similarity))
    rooted = _rooted_by(classes, overlap.links(chosen_texts, near, classes, width, similarity))
    chosen = rooted.groupBy("root").agg(F.min("first_id").alias("r")).select(F.col("r.id").alias(spare[0]), F.col("r.extra").alias(spare[1]))
    copies = found.groupBy("id", "extra").agg(F.count(F.lit(1)).alias("n"))
    same = F.col(spare[0]).eqNullSafe(F.col("id")) & (F.col(spare[1]) == F.col("extra"))
    known = materialize(copies.join(chosen, same, "left").select("id", "extra", "n", F.col(spare[1]).isNotNull().alias("kept")), "known")
    unsure = known.where("n > 1 OR NOT kept").select(F.xxhash64("id", "extra"))
    told = flagged(marked, F.xxhash64(*spare[:2]), unsure, spare[2])
    keyed = known.where("kept").select(F.col("id").alias(f"{spare[0]}k"), F.col("extra").alias(f"{spare[1]}k"), "n")
    a, b = told.where(spare[2]).alias("a"), keyed.alias("b")
    match = F.col(f"a.{spare[0]}").eqNullSafe(F.col(f"b.{spare[0]}k")) & (F.col(f"a.{spare[1]}") == F.col(f"b.{spare[1]}k"))
    once = a.join(b.where("n = 1"), match, "left_semi")
    again = a.join(b.where("n > 1"), match, "left_semi").dropDuplicates(spare[:2])
    return told.where(~F.col(spare[2])).union(once).union(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def _row_order() -> Column:
    """Orders rows by id, null last, then by the hash of the text."""
    return F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("extra"))


def _unused(names: list[str]) -> str:
    """A prefix that no column name starts with."""
    prefix = "row_"
    while any(n.lower().startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix


def hexadecimal(column: str) -> Column:
    """16 lower-case hexadecimal digits of a signed 64-bit number."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


@query("op5_simhash_bit_planes")
def op5_simhash_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))
