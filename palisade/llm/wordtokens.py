"""Token ids of the lower-casing word vocabulary, as little-endian unsigned 32-bit numbers.

Texts are cut at spaces, which no word holds. Chunks of long-standing characters are lower-cased and split by the word pattern; all others
go through the library's normaliser and pre-tokenizer. The library's BPE model encodes each word once: words and chunks repeat, so their
ids are kept in bounded tables. A column of texts is cut as a whole, some megabytes at a time, and each of its distinct chunks is looked
up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from palisade.llm.bpe import KEPT, LONGEST_KEPT, byte_letters

# Fixed value: the word pattern of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# Characters that have been what they are since early Unicode versions, that no normalisation changes or joins, and that are lower-cased
# alike everywhere: Latin, Cyrillic, dashes and quotes, kana, the common ideographs. tests/llm compares all characters.
LASTING = re.compile("[\\x00-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u2038\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*").fullmatch


ENDS = ".,;:!?"
SLICE = 1 << 23  # bytes of texts that are cut together
MERGED = 4096  # words that are merged together
# The same characters but one, whose lower case is two characters; letters among them are lower-cased one by one in whole columns.
PLAIN = "^[\\x00-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u2038\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*$"


class Generations:
    """Results by key, computed on demand for many keys at once, in two tables: when the newer one is full it becomes the older, so
    frequent keys stay. Long keys are not kept."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]]) -> None:
        self.compute = compute
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes]:
        """The results of ``keys``, which may repeat."""
        found = list(map(self.newer.get, keys))
        missing = list(dict.fromkeys(key for key, value in zip(keys, found) if value is None))
        if not missing:
            return found
        fresh = dict(zip(missing, map(self.older.get, missing)))
        lost = [key for key, value in fresh.items() if value is None]
        fresh.update(zip(lost, self.compute(lost)))
        found = [fresh[key] if value is None else value for key, value in zip(keys, found)]
        if len(self.newer) + len(fresh) > KEPT:
            self.older, self.newer = self.newer, {}
        self.newer.update(islice(((key, value) for key, value in fresh.items() if len(key) <= LONGEST_KEPT), KEPT))
        return found


class WordEncoder:
    """Encoder of a word-level BPE file of the tokenizers library with NFC, lower case and word ends."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.merge = tokenizer.model.tokenize
        self.letter_of = {b: c for c, b in byte_letters().items()}
        self.special = {t.content: pack("<I", i) for i, t in tokenizer.get_added_tokens_decoder().items()}
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.stops, self.markers = regex.compile(marks).split, regex.compile(marks).findall
        self.split = regex.compile(WORDS).findall
        self.normalize, self.pieces = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.words, self.chunks = Generations(self._words), Generations(self._chunks)
        self.ends = pa.array([*self._words([*ENDS]), b""], pa.large_binary())
        self.end_at = np.zeros(256, np.int64)
        self.end_at[list(ENDS.encode())] = np.arange(len(ENDS))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. What is a letter, a digit or a capital in those outside ``LASTING`` is the library's own affair: its tables
        may be of another Unicode version."""
        pieces = [self.split(c.lower()) if LASTING(c) else [p for p, _ in self.pieces(self.normalize(c))] for c in chunks]
        own = list(map(bool, map(LASTING, chunks)))
        words = iter(self.words.find([w for ws, o in zip(pieces, own) if o for w in ws]))
        letters = iter(self._merged([w for ws, o in zip(pieces, own) if not o for w in ws]))
        return [b"".join(islice(words if o else letters, len(ws))) for ws, o in zip(pieces, own)]

    def _words(self, words: list[str]) -> list[bytes]:
        letter_of = self.letter_of  # ASCII letters stand for themselves
        return self._merged([w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letter_of) for w in words])

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words in the letters of the vocabulary, some thousands at a time."""
        found: list[bytes] = []
        for low in range(0, len(words), MERGED):
            tokens = list(map(self.merge, words[low : low + MERGED]))
            data = np.fromiter((t.id for word in tokens for t in word), "<u4").tobytes()
            ends = [0, *accumulate(4 * len(word) for word in tokens)]
            found += [data[a:b] for a, b in zip(ends, ends[1:])]
        return found

    def _plain(self, text: str) -> bytes:
        return b"".join(self.chunks.find(text.replace("\n", " ").split(" ")))  # no word holds white space

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, 4 bytes each; strings of special tokens give their ids, as in the library."""
        parts = self.stops(text) if any(s in text for s in self.special) else [text]
        if len(parts) == 1:
            return self._plain(text)
        marks = [*map(self.special.__getitem__, self.markers(text)), b""]
        return b"".join(self._plain(part) + mark for part, mark in zip(parts, marks))

    def encode_all(self, column: pa.Array, end_id: int) -> Iterator[bytes]:
        """Ids of every text of a column and ``end_id`` behind them; null counts as empty. A text of any length is cut whole."""
        column, end = pc.fill_null(column.cast(pa.string()), ""), pack("<I", end_id)
        ends = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(column):
            begin = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
            yield from self._together(column.slice(at, stop - at), end)
            at = stop

    def _together(self, column: pa.Array, end: bytes) -> Iterator[bytes]:
        marked = np.zeros(len(column), bool)
        for mark in self.special:
            marked |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", column) if marked.any() else column
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")  # as in ``_plain``
        chunks = parts.flatten().dictionary_encode()
        known, rows = self._distinct(chunks.dictionary)
        ids = known.take(pa.array(rows[chunks.indices.to_numpy()]))
        places = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[parts.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for text, (low, high) in enumerate(zip(places, places[1:])):
            yield (self.encode(column[text].as_py()) if marked[text] else bytes(data[low:high])) + end

    def _distinct(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct chunks, and each chunk's row there. Words with at most one mark behind them are lower-cased, trimmed and
        found together; all others go through ``_chunks``."""
        low = pc.utf8_lower(chunks)
        core = pc.utf8_rtrim(low, characters=ENDS)
        marks = pc.subtract(pc.binary_length(low), pc.binary_length(core)).to_numpy()
        plain = pc.and_(pc.utf8_is_alpha(core), pc.match_substring_regex(chunks, PLAIN)).to_numpy(zero_copy_only=False) & (marks <= 1)
        words = core.filter(pa.array(plain)).dictionary_encode()
        found = pa.array(self.words.find(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        last = np.frombuffer(low.buffers()[2] or b"\0", np.uint8)[np.frombuffer(low.buffers()[1], np.int32, len(low) + 1)[1:][plain] - 1]
        behind = np.where(marks[plain] > 0, self.end_at[last], len(ENDS))
        found = pc.binary_join_element_wise(found, self.ends.take(pa.array(behind)), pa.scalar(b"", pa.large_binary()))
        others = pa.array(self.chunks.find(chunks.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        rows = np.empty(len(chunks), np.int64)
        rows[plain], rows[~plain] = np.arange(len(found)), np.arange(len(found), len(chunks))
        return pa.concat_arrays([found, others]), rows


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    return WordEncoder(path)
