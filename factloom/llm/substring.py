"""Repeated passages of WINDOW words or more, by difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two positions some shift below PERIOD takes both
into the cover.  So two equal windows of WINDOW words have, at a common shift, a cover position each, and the
ANCHOR = WINDOW - PERIOD + 1 words from there lie in both windows: they share an aligned anchor.

1. Anchors are hashed at cover positions only.  Those met once are dropped.
2. Around the anchors that repeat, the windows that hold one are hashed whole, on 128 bits from two hashes of the
   bytes that have nothing in common: the extension of an anchor to either side.  A window that also starts earlier is
   one that repeats.
3. The words that repeated windows cover are removed.

Both hashings send compressed blocks of sorted entries to buckets by hash.  Each chunk of text sends a hash once,
with its first position: a passage that stands in every document weighs one entry for each chunk and not for each
document, and no bucket or task grows with it.  A chunk sends FANOUT blocks at most.  If there are more buckets, blocks
go to groups of buckets first, and are merged to chunks and sent on from there, until each bucket has its own; so the
blocks sent grow with the text and not with its square.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import hashing
from factloom.llm.common import stage

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Text whose entries a bucket gets, on average.
BUCKET_BYTES = 6 << 20
#: Blocks that a chunk sends at most: buckets, or groups of buckets that are divided again.
FANOUT = 1024
#: Tasks of an exchange at most; each takes its buckets one after another.
TASKS = 1 << 15
#: Binary digits of doc_id that are left out in a slot: results travel by slots of neighbouring documents.
SLOT = 8
#: Text that is sorted together before it is sent.
CHUNK = 16 << 20

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ENTRY = "bucket bigint, entries binary, slot bigint, starts binary"
_NAMES = ["bucket", "entries", "slot", "starts"]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as byte planes, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // sum(widths)
    out, at = [], 0
    for w in widths:
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(f"<u{w}").reshape(-1))
        at += n * w
    return out


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with each text compressed, as texts travel: Spark's own blocks of them are half as large again."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [squeeze(x.as_buffer()) if x.is_valid else None for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], batch.schema.names)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of their second column as they were, about CHUNK of text at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        upto = np.cumsum([zstandard.frame_content_size(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
            part = batch.slice(i, j - i)
            texts = pa.array([expand(x.as_buffer()) if x.is_valid else None for x in part.column(1)], pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[2:]], part.schema.names)
            i = j


def _by_slot(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Rows (slot, packed positions): those of 1 << SLOT neighbouring doc_ids together."""
    slots = docs >> SLOT
    order = np.argsort(slots, kind="stable")
    slots, docs, starts = slots[order], docs[order], starts[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.empty(0, np.int64)
    blobs = [_pack(d.astype("<i8"), p.astype("<u4")) for d, p in zip(np.split(docs, first[1:]), np.split(starts, first[1:]), strict=True)] if len(slots) else []
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(slots[first], pa.int64()), pa.array(blobs, pa.binary())], _NAMES)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted entries without repeated ones: a row that stands twice is one document."""
    if not len(columns[0]):
        return columns
    keep = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    return tuple(c[keep] for c in columns)


@dataclass(frozen=True)
class _Way:
    """How entries travel: FANOUT ** levels buckets at most, a level of groups after another."""

    fan: int
    levels: int
    second: bool  # entries carry a second hash
    all_repeats: bool  # every position of a repeated hash is wanted, not all but the first

    @property
    def widths(self) -> tuple[int, ...]:
        return (8, 8, 8, 4) if self.second else (8, 8, 4)

    @property
    def tasks(self) -> int:
        """Of an exchange: two buckets each while there are TASKS or fewer."""
        return max(1, min(self.fan**self.levels // 2, TASKS))

    def bucket(self, h: np.ndarray, level: int) -> np.ndarray:
        """The group of each hash after so many levels; sorted as the hashes are."""
        return ((h >> np.uint64(32)) * np.uint64(self.fan**level)) >> np.uint64(32)


def _sorted(parts: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(hash, second hash, document, position), sorted and distinct, and where a new hash begins."""
    h, g, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort([pos, doc, g, h])
    h, g, doc, pos = _distinct(h[order], g[order], doc[order], pos[order])
    new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])) if len(h) else np.empty(0, bool)
    return (h, g, doc, pos), new


def _repeats(way: _Way, new: np.ndarray) -> np.ndarray:
    repeat = ~new
    if way.all_repeats:  # the first of them is wanted too
        repeat = repeat | np.append(~new[1:], False)
    return repeat


class _Sender:
    """Collects entries of a chunk; gives rows for the groups of a level, and of what the chunk itself decides."""

    def __init__(self, way: _Way, level: int) -> None:
        self.way, self.level = way, level
        self.held: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, size: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.bytes += size
        if self.bytes >= CHUNK:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        (h, g, doc, pos), new = _sorted(self.held)
        self.held, self.bytes = [], 0
        if not new.all():
            repeat = _repeats(self.way, new)
            yield _by_slot(doc[repeat], pos[repeat])
        h, g, doc, pos = h[new], g[new], doc[new], pos[new]
        bucket = self.way.bucket(h, self.level)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        cuts = [*first.tolist(), len(bucket)]
        blobs = [_pack(h[i:j], *((g[i:j],) if self.way.second else ()), doc[i:j].astype("<i8"), pos[i:j].astype("<u4")) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(first)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _NAMES)


def _entries(way: _Way, blob: bytes) -> tuple[np.ndarray, ...]:
    h, *g, doc, pos = _unpack(blob, way.widths)
    return h, g[0] if g else np.zeros(len(h), np.uint64), doc.view(np.int64), pos


def _divide(way: _Way, level: int):
    """Blocks of groups -> merged blocks of the next level's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sender = None, _Sender(way, level)
        for batch in batches:
            decided = batch.column(1).is_null()
            if pc.any(decided).as_py():
                yield batch.filter(decided).select(_NAMES)
                batch = batch.filter(pc.invert(decided))
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at:
                    yield from sender.send()
                    at = bucket
                entries = _entries(way, blob.as_buffer())
                yield from sender.add(sum(way.widths) * len(entries[0]), *entries)
        yield from sender.send()

    return run


def _receive(way: _Way):
    """Per bucket: the positions whose hash stands in several chunks; all of them, or all but the first."""

    def decide(blobs: list) -> pa.RecordBatch:
        (_, _, doc, pos), new = _sorted([_entries(way, b.as_buffer()) for b in blobs])
        repeat = _repeats(way, new)
        return _by_slot(doc[repeat], pos[repeat])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            decided = batch.column(1).is_null()
            if pc.any(decided).as_py():
                yield batch.filter(decided).select(["slot", "starts"])
                batch = batch.filter(pc.invert(decided))
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at and held:
                    yield decide(held).select(["slot", "starts"])
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield decide(held).select(["slot", "starts"])

    return run


def _repeated(sent: DataFrame, way: _Way) -> DataFrame:
    """(slot, packed positions) of what repeats: decided within chunks, and by bucket."""
    anywhere = F.coalesce("bucket", F.pmod(F.xxhash64("slot"), F.lit(way.fan)))
    for level in range(2, way.levels + 1):
        part = F.pmod(F.xxhash64(F.coalesce("entries", "starts")), F.lit(way.fan))  # a group is divided by as many tasks as it has parts
        rows = sent.withColumn("place", anywhere).withColumn("part", part)
        sent = rows.repartition(way.tasks, "place", "part").sortWithinPartitions("place", "part").select(_NAMES).mapInArrow(_divide(way, level), _ENTRY)
    return sent.withColumn("place", anywhere).repartition(way.tasks, "place").sortWithinPartitions("place").select(_NAMES).mapInArrow(_receive(way), "slot bigint, starts binary")


def _collected(rows: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, its positions as 32-bit integers)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0):
                docs, starts = (np.concatenate(c) for c in zip(*(_unpack(b, (8, 4)) for b in parts.as_py()), strict=True))
                docs = docs.view(np.int64)
                order = np.lexsort([starts, docs])
                docs, starts = docs[order], starts[order]
                first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array([x.tobytes() for x in np.split(starts, first[1:])], pa.binary())], ["doc_id", "starts"])

    return rows.groupBy("slot").agg(F.collect_list("starts").alias("parts")).select("parts").mapInArrow(expand, "doc_id bigint, starts binary")


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, starts of windows that also start earlier, as 32-bit integers), and the (doc_id, compressed text, ...) that can have any."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    levels = next(k for k in itertools.count(1) if FANOUT**k >= buckets)
    fan = next(f for f in itertools.count(max(2, int(buckets ** (1 / levels)))) if f**levels >= buckets)
    by_anchor = _Way(fan, levels, second=False, all_repeats=True)
    by_window = _Way(fan, levels, second=True, all_repeats=False)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(by_anchor, 1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, words in hashing.chunks(batch.column(1)):
                at, h = words.windows(ANCHOR)
                owner = words.owner()[at]
                pos = at - words.first[owner]
                keep = _IN_COVER[pos % PERIOD] & (words.counts()[owner] >= WINDOW)
                h, owner, pos = h[keep], owner[keep], pos[keep]
                yield from sender.add(len(words.data), h, np.zeros(len(h), np.uint64), ids[i + owner], pos)
        yield from sender.send()

    sent = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(anchors, _ENTRY)
    squeezed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_squeezed, "doc_id bigint, text binary")
    candidates = stage(squeezed.join(_collected(_repeated(sent, by_anchor)), "doc_id"), "candidates")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(by_window, 1)
        for batch in _expanded(batches):
            ids, starts = batch.column(0).to_numpy(), batch.column(2)
            for i, j, words in hashing.chunks(batch.column(1)):
                n = len(words.hashes)
                marks = np.zeros(n + 1, np.int64)
                for k in range(i, j):
                    at = np.frombuffer(starts[k].as_buffer(), "<u4").astype(np.int64)
                    base, size = words.first[k - i], words.first[k - i + 1] - words.first[k - i]
                    lo, hi = np.maximum(at - (WINDOW - ANCHOR), 0), np.minimum(at, size - WINDOW)  # windows that hold the anchor
                    ok = lo <= hi
                    np.add.at(marks, base + lo[ok], 1)
                    np.add.at(marks, base + hi[ok] + 1, -1)
                wanted = np.cumsum(marks[:-1]) > 0
                at, h = words.windows(WINDOW)
                keep = wanted[at]
                at, h = at[keep], h[keep]
                owner = words.owner()[at]
                second = hashing.runs(hashing.hash_spans(words.data, words.starts, words.ends, seed=1), WINDOW)[at] if len(at) else h
                yield from sender.add(len(words.data), h, second, ids[i + owner], at - words.first[owner])
        yield from sender.send()

    sent = candidates.select("doc_id", "text", "starts").mapInArrow(windows, _ENTRY)
    return _collected(_repeated(sent, by_window)), candidates


def _kept_words(text: str | None, starts: bytes | None) -> tuple[int, list[bytes]]:
    words = (text or "").encode().split()
    if not starts:
        return len(words), words
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    at = at[at + WINDOW <= len(words)]
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    keep = np.cumsum(marks[:-1]) == 0
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256[, kept_text]; one row for each row of docs.

    Words are runs outside ASCII white space.  A word is removed if a window of WINDOW words that covers it also
    starts earlier: in a smaller doc_id, or before it in the same document.  Windows are judged on the input.
    Null and empty texts have no words.  Rows without doc_id keep all words and are no one's earlier copy; rows that
    share a doc_id count as one document: if they differ, a window of one goes if it starts where a repeated window of any of
    them does.  Other columns are ignored.  No rows give no rows.
    """
    kind = "doc_id bigint, own_sha256 string, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    names = [k.split()[0] for k in kind.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, left, own, sha, texts = [], [], [], [], []
                starts = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
                for text, at in zip(part.column(1).to_pylist(), starts, strict=True):
                    count, kept = _kept_words(text, at)
                    joined = b" ".join(kept)
                    own.append(hashlib.sha256(b" ".join((text or "").encode().split()) if len(kept) < count else joined).hexdigest())
                    n.append(count)
                    left.append(count - len(kept))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.string()), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names)

    repeats, candidates = repeated_windows(docs)
    changed = candidates.select("doc_id", "text").join(repeats, "doc_id").mapInArrow(lambda batches: digest(_expanded(batches)), kind).dropDuplicates(["doc_id", "own_sha256"])
    changed = changed.select(F.col("doc_id").alias("changed_id"), F.col("own_sha256").alias("changed_sha"), *(F.col(c).alias(f"new_{c}") for c in ("n_removed", "kept_sha256", "kept_text")))
    whole = docs.select("doc_id", "text").mapInArrow(digest, kind)
    columns = ["doc_id", "n_words", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("n_removed", "kept_sha256", *(["kept_text"] if with_text else [])))]
    return whole.join(changed, (F.col("doc_id") == F.col("changed_id")) & (F.col("own_sha256") == F.col("changed_sha")), "left").select(*columns)
