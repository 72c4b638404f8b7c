"""Splitting texts by the libraries' own character tables.

The ``regex`` module may know another Unicode version than the tokenizer libraries, so that it takes a character for a letter
which they don't, or the other way round.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
import tiktoken


@lru_cache(maxsize=1)
def class_changes() -> dict[int, str]:
    """Stand-ins for characters that this process's ``regex`` classes otherwise than the tiktoken library does.

    The library's tables of letters, digits and white space may be of another Unicode version. It is asked for the class of
    every character once; a character it sees otherwise is mapped to a plain one of the class it sees.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = np.zeros(0x110000, np.int8), np.zeros(0x110000, np.int8)
    for kind, (name, found) in enumerate((("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")), 1):
        asked = tiktoken.Encoding(name, pat_str=found, mergeable_ranks=single, special_tokens={})
        theirs[np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
        ours[np.frombuffer("".join(regex.findall(found, every)).encode("utf-32-le"), "<u4")] = kind
    stand_ins = "!a1 "
    return {int(c): stand_ins[theirs[c]] for c in np.flatnonzero(theirs != ours)}


class Splitter:
    """Matches of a pattern that leaves no character out, with letters, digits and white space as the libraries see them."""

    def __init__(self, pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.changes = class_changes()

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        alike = text.translate(self.changes)  # as long as the text
        found = self.find(alike)
        if alike == text:
            return found
        ends = np.cumsum([0, *map(len, found)]).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]
