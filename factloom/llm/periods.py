"""Periodic runs of words, found by probing a harmonic grid.

A run of period p and at least 3p words covers three neighbouring multiples of p.  So for every p the words at
jp, (j+1)p and (j+2)p are compared, n ln n comparisons in all; what agrees is compared at a few more places that a
run must cover, and survivors are extended to both sides, a chunk of the text at a time.  Periods are taken in
ascending order: a grid point within a run already found whose period divides p would only find that run again, so
it is passed over.

Every text is worked on alone, in the task that reads it: nothing is shuffled, and memory is a few times one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The least length of a run: in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts of so many words have their grid looked up; longer ones have it built, GRID_BLOCK points at a time.
GRID_WORDS, GRID_BLOCK = 4096, 1 << 20
#: Places beside the grid that a survivor is compared at.
PROBES = 5
#: Words compared by the first chunk of an extension; every further chunk is twice as long.
CHUNK = 32

SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]  # start, length, period


def grid(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(jp, p) for each period first..last-1 and each j with (j+2)p < n, by period and then by place."""
    periods = np.arange(first, last)
    points = np.maximum((n - 1) // periods - 1, 0)
    p = np.repeat(periods, points)
    j = np.arange(len(p)) - np.repeat(np.cumsum(points) - points, points)
    return j * p, p


def _short_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of GRID_WORDS words by the place of its third point: a text of n words uses the part below n."""
    at, p = grid(GRID_WORDS, 1, GRID_WORDS // LEAST_PERIODS + 1)
    order = np.argsort(at + 2 * p, kind="stable")
    return at[order], p[order], (at + 2 * p)[order]


_AT, _PERIOD, _THIRD = _short_grid()


def _agree(ids: np.ndarray, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid points that may lie in a run: words agree there, at the next two points and at PROBES places between them."""
    same = np.flatnonzero(ids[at] == ids[at + p])
    at, p = at[same], p[same]
    same = np.flatnonzero(ids[at + p] == ids[at + 2 * p])
    at, p = at[same], p[same]
    # The first grid point of a run lies in its first period, so this many places from there on have their word again p later.
    sure = np.maximum(LEAST_WORDS - p, (LEAST_PERIODS - 1) * p) - p
    for k in range(1, PROBES + 1):
        x = at + sure * k // PROBES
        fits = np.flatnonzero(x + p < len(ids))
        same = fits[ids[x[fits]] == ids[(x + p)[fits]]]
        at, p, sure = at[same], p[same], sure[same]
    return at, p


def _survivors(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(ids)
    if n <= GRID_WORDS:
        k = int(np.searchsorted(_THIRD, n))
        at, p = _agree(ids, _AT[:k], _PERIOD[:k])
        order = np.lexsort([at, p])
        yield at[order], p[order]
        return
    first, most = 1, n // LEAST_PERIODS
    while first <= most:
        last = first + max(1, GRID_BLOCK * first // (n + GRID_BLOCK // 16))  # n/first points for the first of them
        last = min(last, most + 1)
        yield _agree(ids, *grid(n, first, last))
        first = last


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start, compared by chunks."""
    n, done, chunk = min(len(a), len(b)), 0, CHUNK
    while done < n:
        upto = min(n, done + chunk)
        unlike = np.flatnonzero(a[done:upto] != b[done:upto])
        if len(unlike):
            return done + int(unlike[0])
        done, chunk = upto, chunk * 2
    return n


def find_runs(ids: np.ndarray) -> list[Run]:
    """Every run of the sequence, by start and then by period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    found: dict[tuple[int, int], int] = {}
    inside, upto = np.ones(n, np.int64), np.zeros(n, np.int64)  # period and end of the run found last at each place
    for at, period in _survivors(ids):
        cuts = np.flatnonzero(np.diff(period)) + 1
        for points in np.split(np.arange(len(at)), cuts) if len(at) else ():
            p, end = int(period[points[0]]), 0
            places = at[points]
            places = places[(p % inside[places] != 0) | (places + 2 * p >= upto[places])]
            for i in places.tolist():
                if i + p < end:  # in the stretch just extended
                    continue
                right = _matching(ids[i:], ids[i + p :])
                left = _matching(ids[:i][::-1], ids[p : i + p][::-1])
                start, end = i - left, i + p + right
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p) and (start, end) not in found:
                    found[start, end] = p
                    inside[start:end], upto[start:end] = p, end
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document by its hash, made periodic from some place on; a document without an id stays as it is."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]]


def longest(runs: list[Run]) -> Run | None:
    """The run with the most periods, compared exactly; of equals the first, then that with the smaller period."""
    best: Run | None = None
    for run in runs:  # ascending, so an equal one comes after
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_runs, the run of most periods, and digests of all runs and of the text without repeats.

    One row for each row of docs, repeated doc_ids too.  plant: first make every tenth document periodic, for a check.
    Null and empty texts have no words and no runs; a null doc_id is never planted.  Very long texts are searched
    whole.  Other columns are ignored; no rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, words = doc_id.as_py(), (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D
                words = planted(words, doc_id) if plant else words
                runs = find_runs(word_ids(words))
                best = longest(runs) or (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                out.append(
                    {
                        "doc_id": doc_id,
                        "n_runs": len(runs),
                        "start": best[0],
                        "length": best[1],
                        "period": best[2],
                        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                        "runs_sha256": hashlib.sha256(listed).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])
