"""Many words looked up in many texts at once, over the bytes of a whole Arrow batch.

A place where some word may begin is told by its first bytes in a table; only such places are compared with words.  So a text costs its
bytes and its candidates, however many words there are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are searched at a time.
SLICE = 1 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r_-"))
_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


class Words:
    """Words of at least two bytes with the numbers that each stands for."""

    def __init__(self, words: dict[str, list[int]], width: int) -> None:
        self.width = width
        self.words = [(np.frombuffer(w.encode(), np.uint8), numbers) for w, numbers in words.items()]
        heads: dict[int, list[int]] = {}
        for i, (w, _) in enumerate(self.words):
            heads.setdefault(int.from_bytes(w[:width].tobytes(), "little"), []).append(i)
        self.heads = np.array(sorted(heads), np.uint32)
        self.of_head = [heads[int(h)] for h in self.heads]
        self.table = np.zeros(1 << 16, bool)
        self.table[self._slot(self.heads)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint32(2654435761)) >> np.uint32(16)

    def find(self, data: np.ndarray, ends: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, int, list[int]]]:
        """(rows, places, length, numbers) of each word; data: the bytes of all rows, ends: where each row ends."""
        if len(data) < self.width or not self.words:
            return
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        head = np.ndarray(len(data), f"<u{self.width}", padded.tobytes(), strides=(1,)).astype(np.uint32)
        at = np.flatnonzero(self.table[self._slot(head)])
        which = np.searchsorted(self.heads, head[at])
        same = (which < len(self.heads)) & (self.heads[np.minimum(which, len(self.heads) - 1)] == head[at])
        at, which = at[same], which[same]
        rows = np.searchsorted(ends, at, "right")
        order = np.argsort(which, kind="stable")
        at, which, rows = at[order], which[order], rows[order]
        bounds = np.searchsorted(which, np.arange(len(self.heads) + 1))
        for h, indices in enumerate(self.of_head):
            here, row = at[bounds[h] : bounds[h + 1]], rows[bounds[h] : bounds[h + 1]]
            if not len(here):
                continue
            for i in indices:
                word, numbers = self.words[i]
                fits = here + len(word) <= ends[row]
                places, of = here[fits], row[fits]
                for k in range(self.width, len(word)):
                    if not len(places):
                        break
                    equal = data[places + k] == word[k]
                    places, of = places[equal], of[equal]
                if len(places):
                    yield of, places, len(word), numbers


def _letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN"


def _apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether no letter or digit stands beside each place."""
    after = places + length
    first, last = places == starts[rows], after == ends[rows]
    before_byte, after_byte = data[places - 1], data[np.minimum(after, len(data) - 1)]
    good = (first | ~_ALNUM[before_byte]) & (last | ~_ALNUM[after_byte])
    unsure = good & ((~first & (before_byte >= 0x80)) | (~last & (after_byte >= 0x80)))
    for j in np.flatnonzero(unsure):
        left = bytes(data[max(starts[rows[j]], places[j] - 4) : places[j]]).decode("utf-8", "ignore")
        right = bytes(data[after[j] : min(ends[rows[j]], after[j] + 4)]).decode("utf-8", "ignore")
        good[j] = not (left and _letter(left[-1])) and not (right and _letter(right[0]))
    return good


def numbers_met(plain: pa.Array, long: Words, short: Words) -> pa.Array:
    """The numbers of the words that each text holds, in order: long ones anywhere in the text without blanks, _ and -, short ones as whole words."""
    offsets = np.frombuffer(plain.buffers()[1], np.int64 if pa.types.is_large_string(plain.type) else np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    whole = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
    row_parts, number_parts = [], []

    def keep(rows: np.ndarray, numbers: list[int], lo: int) -> None:
        for n in numbers:
            row_parts.append(rows + lo)
            number_parts.append(np.full(len(rows), n, np.int64))

    lo = 0
    while lo < len(plain):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        data = whole[offsets[lo] : offsets[hi]]
        starts, ends = offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo]
        for rows, places, length, numbers in short.find(data, ends):
            keep(rows[_apart(data, starts, ends, rows, places, length)], numbers, lo)
        full = ~_BLANK[data]
        kept = np.concatenate([[0], np.cumsum(full)])
        for rows, _, _, numbers in long.find(data[full], kept[ends]):
            keep(rows, numbers, lo)
        lo = hi
    top = 1 + max((int(n.max()) for n in number_parts if len(n)), default=0)
    pairs = np.unique(np.concatenate([r * top + n for r, n in zip(row_parts, number_parts, strict=True)])) if row_parts else np.zeros(0, np.int64)
    list_offsets = np.searchsorted(pairs, np.arange(len(plain) + 1) * top)
    return pa.ListArray.from_arrays(pa.array(list_offsets, pa.int32()), pa.array(pairs % top, pa.int32()))


def met(plain: Column, long: dict[str, list[int]], short: dict[str, list[int]]) -> Column:
    """array<int>: numbers_met() of a column without nulls.  long: words of four bytes or more, without blanks, _ and -; short: words of letters and digits, two bytes or more."""

    def run(texts: pa.Array) -> pa.Array:
        global _BUILT
        if _BUILT is None or _BUILT[0] != (long, short):
            _BUILT = ((long, short), Words(long, 4), Words(short, 2))
        return numbers_met(texts, _BUILT[1], _BUILT[2])

    return F.arrow_udf(run, "array<int>")(plain)


#: The words that a worker searched for last, as tables.
_BUILT: tuple | None = None
