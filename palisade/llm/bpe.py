"""Byte-pair encoding with forced boundaries, and decoding.

Two neighbouring bytes that stand together in no token of the vocabulary can never end up in one token: between them lies a
certain cut. The pieces that the vocabulary's own pre-tokenizer yields are cut there, every fragment is merged independently,
and the results are concatenated. As no merge crosses a certain cut and merges act by rank inside their own neighbourhood,
the result is the one that merging whole pieces gives. The library's BPE model merges a fragment. Fragments and pieces repeat,
so their ids are kept in bounded tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.batches import texts
from palisade.llm.classes import Splitter
from palisade.llm.registry import query

# Fixed value: how byte-level vocabularies of this family split a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 1 << 18  # entries of a table of known pieces; a full table is emptied
LONGEST_KEPT = 64  # characters of a piece worth keeping


def byte_letters() -> dict[str, int]:
    """The letter of the vocabulary file for each byte, inverted: printable bytes stand for themselves, the others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    return letters


class Vocabulary:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.merge = tokenizer.model.tokenize  # the library's merges, on one fragment
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = {i: bytes(letters[c] for c in word) for word, i in tokenizer.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.table = pa.array([*(self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)), b""], pa.large_binary())
        self.letter_of = {b: c for c, b in letters.items()}
        self.meets = np.zeros((256, 256), bool)  # pairs of bytes that some token holds side by side
        for value in self.bytes_of.values():
            for a, b in zip(value, value[1:]):
                self.meets[a, b] = True
        self.together = {bytes(pair) for pair in np.argwhere(self.meets).tolist()}
        self.split = Splitter(PIECES).split  # the library's classes: its tables and those of ``regex`` may differ
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.stops = regex.compile(marks).split if marks else None
        self.markers = regex.compile(marks).findall if marks else None
        self.lone_space = re.compile(r"(?<=\S) (?=\S)").split
        self.wide_space = re.compile(r" \s|\s ").search
        self.chunks, self.pieces, self.fragments = Known(self.encode_chunk), Known(self.encode_piece), Known(self.merge_fragment)

    def cuts(self, data: bytes) -> list[int]:
        """Offsets of the certain cuts inside ``data``."""
        if len(data) < 64:
            together = self.together
            return [i for i in range(1, len(data)) if data[i - 1 : i + 1] not in together]
        values = np.frombuffer(data, np.uint8)
        return (np.flatnonzero(~self.meets[values[:-1], values[1:]]) + 1).tolist()

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        edges = self.cuts(data)
        if not edges:
            plain = piece.isascii() and piece.isprintable()  # such letters stand for themselves, but the space
            return self._merged(piece.replace(" ", self.letter_of[32])) if plain else self.merge_fragment(data)
        edges = [0, *edges, len(data)]
        return b"".join([self.fragments[data[a:b]] for a, b in zip(edges, edges[1:])])

    def merge_fragment(self, data: bytes) -> bytes:
        """Ids of a fragment, 4 bytes each."""
        return self._merged(data.decode("latin-1").translate(self.letter_of))  # a letter per byte

    def _merged(self, letters: str) -> bytes:
        ids = [t.id for t in self.merge(letters)]
        return pack(f"<{len(ids)}i", *ids)

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(" " + chunk)))

    def _plain(self, text: str) -> bytes:
        """Ids without special tokens. A space between two characters that aren't white space always starts a piece, so what
        stands between such spaces is encoded on its own; the first part has no space in front."""
        parts = self.lone_space(text) if self.wide_space(text) else text.split(" ")
        first = map(self.pieces.__getitem__, self.split(parts[0]))
        return b"".join([*first, *map(self.chunks.__getitem__, parts[1:])])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens give their ids, as in the library."""
        parts = self.stops(text) if self.stops and any(s in text for s in self.special) else [text]
        marks = [pack("<i", self.special[m]) for m in self.markers(text)] if len(parts) > 1 else []
        return np.frombuffer(b"".join(self._plain(part) + mark for part, mark in zip(parts, [*marks, b""])), "<i4")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive spans of ids, from each end to the next, special tokens included.

        The bytes of all ids are gathered at once. Ids outside the vocabulary are left out, broken UTF-8 is replaced.
        """
        known = np.where((ids >= 0) & (ids < len(self.table) - 1), ids, len(self.table) - 1)
        gathered = self.table.take(pa.array(known))
        places = np.frombuffer(gathered.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        data = memoryview(gathered.buffers()[2]) if len(ids) else memoryview(b"")
        return [str(data[places[a] : places[b]], "utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


class Known(dict):
    """Results by key, computed on demand; long keys are not kept and a full table is emptied."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per file and Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: token ids of every row's whole text, as an array of integers.

    Null text counts as empty and gives an empty array. Null and repeated ids keep their rows, an empty table gives none,
    other columns are ignored. ``path`` must exist on every worker, as the vocabularies of an installed package do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = [words.encode(t) for t in texts(batch["text"])]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, ids, text)`` from rows of ``encode``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            column = batch["ids"]
            lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            found = words.decode_all(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(found, pa.string())], ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, text string")


@query("op4_forced_boundary_bpe")
def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return back.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
