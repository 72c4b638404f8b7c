"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary itself.

Every byte is written as one letter, so every token of a rank file is a string of letters. These strings become the pieces of
a sentencepiece BPE model, scored by their negative rank, behind a normaliser that changes nothing: merging the best-scored
neighbours first is merging by rank. Texts are split into pre-tokens, each is encoded by the model, and ids are decoded by
mapping the letters of their pieces back to bytes. Nothing is trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import texts
from palisade.llm.bpe import KEPT, LONGEST_KEPT, byte_letters
from palisade.llm.classes import Splitter
from palisade.llm.registry import query

# Field numbers and values of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3  # of a model
PIECE, SCORE, KIND = 1, 2, 3  # of a piece
NORMAL, UNKNOWN = 1, 2  # kinds of pieces
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 4, 40, 41, 42, 43, 45  # of a trainer's settings
BPE = 2  # a model type
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5  # of a normaliser's settings

NO_PIECE = "⁇"  # the piece for what no other covers; no byte is written with this letter


def _number(value: int) -> bytes:
    """A whole number in seven-bit groups, negative ones as 64 bits."""
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(place: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, float):
        return _number(place << 3 | 5) + pack("<f", value)
    if isinstance(value, int):
        return _number(place << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(place << 3 | 2) + _number(len(data)) + data


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the ranks; piece i is the token with the i-th smallest rank, the last one stands for unknowns."""
    letter_of = {b: c for c, b in byte_letters().items()}
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    pieces = [
        _field(PIECES, _field(PIECE, token.decode("latin-1").translate(letter_of)) + _field(SCORE, float(-rank)) + _field(KIND, NORMAL))
        for token, rank in ordered
    ]
    pieces.append(_field(PIECES, _field(PIECE, NO_PIECE) + _field(SCORE, 0.0) + _field(KIND, UNKNOWN)))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces)) + _field(UNK_ID, len(ordered))
    trainer += b"".join(_field(place, -1) for place in (BOS_ID, EOS_ID, PAD_ID)) + _field(UNK_PIECE, NO_PIECE)
    normalizer = _field(NAME, "identity") + b"".join(_field(place, 0) for place in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join(pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


class PieceModel:
    """Encoder and decoder of a rank file, as the tiktoken library would, by a sentencepiece model."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.letter_of = {b: c for c, b in byte_letters().items()}
        byte_of = byte_letters()
        self.ranks = np.array(sorted(ranks.values()), "<i4")
        self.whole = {token.decode("latin-1").translate(self.letter_of): pack("<i", rank) for token, rank in ranks.items()}
        self.bytes_of = {int(rank): bytes(byte_of[c] for c in self.model.id_to_piece(i)) for i, rank in enumerate(self.ranks)}
        self.table = pa.array([*(self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)), b""], pa.large_binary())
        self.split = Splitter(pattern).split
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, 4 bytes each: a token of the vocabulary is itself, others are merged by the model."""
        letters = [part.encode().decode("latin-1").translate(self.letter_of) for part in parts]
        found = [self.whole.get(word) for word in letters]
        open_places = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(open_places, self.model.encode([letters[i] for i in open_places], out_type=int, num_threads=1)):
            found[i] = self.ranks[ids].tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens are ordinary text."""
        parts = self.split(text)
        known = self.known
        new = [part for part in set(parts) if part not in known]
        if not new:
            return np.frombuffer(b"".join(map(known.__getitem__, parts)), "<i4")
        here = dict(zip(new, self._ids(new)))
        flat = b"".join([known[part] if part in known else here[part] for part in parts])
        if len(known) + len(here) > KEPT:
            known.clear()
        known.update((part, ids) for part, ids in here.items() if len(part) <= LONGEST_KEPT)
        return np.frombuffer(flat, "<i4")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of consecutive spans of ids, from each end to the next; ids outside the vocabulary give none."""
        if not len(ids):
            return [b""] * (len(ends) - 1)
        known = np.where((ids >= 0) & (ids < len(self.table) - 1), ids, len(self.table) - 1)
        gathered = self.table.take(pa.array(known))
        places = np.frombuffer(gathered.buffers()[1], np.int64, len(ids) + 1)
        data = memoryview(gathered.buffers()[2] or b"")
        return [bytes(data[places[a] : places[b]]) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def piece_model(path: str, pattern: str) -> PieceModel:
    """One model per file, pattern and Python worker."""
    return PieceModel(path, pattern)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: token ids of every row's whole text, as an array of integers, in one narrow pass.

    ``path`` is a rank file, ``pattern`` splits texts and must leave no character out; both must be the same on every worker.
    Null text counts as empty and gives an empty array. Null and repeated ids keep their rows, an empty table gives none,
    other columns are ignored whatever their names. Texts may be of any length; the table of known pre-tokens is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, pattern)
        for batch in batches:
            found = [model.encode(t) for t in texts(batch["text"])]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(id, ids, data)`` from rows of ``encode``: the decoded bytes; null ids give none, unknown ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, pattern)
        for batch in batches:
            found = model.decode_all(*_spans(batch["ids"]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(found, pa.binary())], ["id", "ids", "data"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, data binary")


@query("op13_piece_model_bpe")
def op13_piece_model_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern), path, pattern)
    return back.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
