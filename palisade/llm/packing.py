"""Hierarchical packing of token sequences into windows of several lengths.

Documents are routed to the smallest tier (context size, a power of two) that holds them; what exceeds the longest tier is
cut into full windows and its rest routed. Each tier packs its own documents, longest first, and fills the gaps of its windows
with documents of shorter tiers, cutting the last one so that the window is full. Whatever can't fill a window is laid out
in windows of smaller powers of two, so every sequence has a length that needs no padding. Sequences are dealt to step
groups that hold equal numbers of tokens. All of it works on a bounded buffer of a partition's documents, in one narrow
pass: nothing is shuffled and no task sees more than its own rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.registry import query
from palisade.llm.wordtokens import word_encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 15  # tokens of a step group
BUFFER_TOKENS = 1 << 21  # tokens of documents that are packed together
PIECES = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, context long, step_group long, ids binary"


@dataclass
class Piece:
    """A span of a document's ids."""

    doc: int  # place in the buffer
    start: int
    length: int


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces; every id of every document lies in exactly one piece and every sequence's length is a power of two."""
    full: list[list[Piece]] = []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # per tier, sorted (length, doc, start)

    def route(doc: int, start: int, length: int) -> None:
        if length:
            tier = next(k for k, size in enumerate(tiers) if length <= size)
            insort(waiting[tier], (length, doc, start))

    for doc, length in enumerate(lengths):
        whole = length // tiers[-1] * tiers[-1]
        full += [[Piece(doc, at, tiers[-1])] for at in range(0, whole, tiers[-1])]
        route(doc, whole, length - whole)

    def longest(most: int, below: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of at most ``most`` ids from tier ``below`` and shorter ones."""
        for tier in range(below, -1, -1):
            place = bisect_right(waiting[tier], (most, 1 << 62, 1 << 62))
            if place:
                return waiting[tier].pop(place - 1)
        return None

    for tier in range(len(tiers) - 1, -1, -1):
        size = tiers[tier]
        total = sum(length for row in waiting[: tier + 1] for length, _, _ in row)
        while waiting[tier] and total >= size:
            sequence, room = [], size
            while room:
                found = longest(room, tier)
                if found is None:  # nothing fits whole: cut the shortest that waits
                    source = next(row for row in waiting[: tier + 1] if row)
                    length, doc, start = source.pop(0)
                    sequence.append(Piece(doc, start, room))
                    total -= room
                    route(doc, start + room, length - room)
                    room = 0
                else:
                    length, doc, start = found
                    sequence.append(Piece(doc, start, length))
                    total -= length
                    room -= length
            full.append(sequence)
    rest = sorted((piece for row in waiting for piece in row), reverse=True)
    left = sum(length for length, _, _ in rest)
    while left:  # less than a window of some tier: smaller powers of two
        size = 1 << left.bit_length() - 1
        sequence, room = [], size
        while room:
            length, doc, start = rest[0]
            taken = min(length, room)
            sequence.append(Piece(doc, start, taken))
            room -= taken
            rest[0] = (length - taken, doc, start + taken)
            if not rest[0][0]:
                rest.pop(0)
        full.append(sequence)
        left -= size
    return full


def step_groups(sizes: list[int], budget: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence. Longest first into the open group: sizes are powers of two, so every group but the last is exactly full."""
    groups = [0] * len(sizes)
    group = held = 0
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if held and held + sizes[place] > budget:
            group, held = group + 1, 0
        groups[place] = group
        held += sizes[place]
    return groups


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """A row per piece: ``id``, its place ``start`` in the document, ``length``, ``doc_tokens`` (with the end id), its sequence and
    place ``offset`` there, the sequence's ``context`` length, a ``step_group`` and the ``ids`` (little-endian, 4 bytes each).

    Null text counts as empty and gives the end id alone. Null and repeated ids are packed row by row; an empty table gives no
    rows; other columns are ignored. A document above the buffer is packed with those before it. Sequence and group numbers
    start with the partition's number, so they are unique and the same when a task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        part = TaskContext.get().partitionId() << 40
        sequences = groups = held = 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            found = pack([len(i) // 4 for i in ids], tiers)
            sizes = [sum(p.length for p in sequence) for sequence in found]
            steps = step_groups(sizes, step_tokens)
            rows: list[tuple] = []
            for number, (sequence, size, step) in enumerate(zip(found, sizes, steps)):
                offset = 0
                for p in sequence:
                    data = ids[p.doc]
                    rows.append((keys[p.doc], p.start, p.length, len(data) // 4, part + sequences + number, offset, size, part + groups + step, data[4 * p.start : 4 * (p.start + p.length)]))
                    offset += p.length
            sequences += len(found)
            groups += max(steps, default=-1) + 1
            names = [f.split()[0] for f in PIECES.split(", ")]
            for low in range(0, len(rows), 10_000):
                columns = zip(*rows[low : low + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names)

        for batch in batches:
            for key, found in zip(batch["id"].to_pylist(), encoder.encode_all(batch["text"], end_id)):
                keys.append(key)
                ids.append(found)
                held += len(ids[-1]) // 4
                if held >= buffer_tokens:
                    yield from packed()
                    keys, ids, held = [], [], 0
        if ids:
            yield from packed()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids; null and repeated document ids keep their pieces, no pieces give no rows."""
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group"
    )


@query("op7_hierarchical_packing")
def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))
