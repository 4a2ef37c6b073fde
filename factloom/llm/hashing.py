"""Vectorised word and word-window hashing over Arrow string batches.

A word's hash takes its bytes eight at a time through a bijective mixer, so two words of one length up to eight
bytes never share it; words over LONG bytes are hashed by BLAKE2.  A window's hash joins the hashes of its two
halves, which are those of shorter windows, so a window of k words costs about log2(k) numpy passes.  Memory is a
few times the text at hand and is given back with it; nothing is kept between texts.

Words are runs of bytes outside the separator class.  All separators used by the operators are ASCII,
so splitting the UTF-8 bytes splits the characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 2 << 20
#: Bytes from which a word is hashed by BLAKE2.
LONG = 256

WHITESPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The first n bytes of eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for each run of bytes starts[i]:ends[i]; another seed gives a hash apart."""
    size = ends - starts
    eight = octets(data)
    h = mix(size.astype(np.uint64) + np.uint64(1 + (seed << 40)))
    h = mix(h ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        h[at] = mix(h[at] ^ (eight[starts[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * np.uint64(0x9E3779B97F4A7C15)
    t += b
    t ^= t >> np.uint64(32)
    t *= np.uint64(0xD6E8FEB86659FD93)
    return t


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values, in order."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    half, size, out, done, left = h, 1, None, 0, k
    while left:
        if left & 1:
            n = len(h) - done - size + 1
            out = half if out is None else _join(out[:n], half[done : done + n])
            done += size
        left >>= 1
        if left:
            half = _join(half[:-size], half[size:])
            size *= 2
    return mix(out)


@dataclass
class Words:
    """The words of some texts, in order: hash and byte span of each, and the first word of each text."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every run of k words that lies in one text."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        owner = self.owner()
        at = np.flatnonzero(owner[k - 1 :] == owner[: n - k + 1])
        return at, runs(self.hashes, k)[at]


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool) -> Words:
    """data: the texts' bytes one after another; offsets: where each begins, and the end."""
    inside = ~separator[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    del inside, begin, end
    if lower:
        data = _LOWER[data]
    return Words(data, hash_spans(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string array; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, separator: np.ndarray = WHITESPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, last text + 1, their words), about CHUNK_BYTES at a time; every text is whole."""
    data, offsets = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        part = offsets[i : j + 1]
        yield i, j, words_of(data[part[0] : part[-1]], part - part[0], separator, lower)
        i = j
