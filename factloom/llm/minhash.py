"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct runs of SHINGLE words.  One hash of every shingle fills BINS bins with
their minima; an empty bin borrows from a bin drawn by a hash of (bin, attempt), the same for all documents
(optimal densification).  Bands of ROWS bins are bucket keys.  At a similarity of 0.75 two documents share
no bucket with probability (1 - 0.75**4)**32, about 5 in a million.

Candidates are stars: in each bucket a pivot, drawn anew per bucket, is paired with every other member, so
pairs grow with the rows and not with the square of a group.  Pairs are confirmed on the full sets of both
texts.  What a star leaves open loses nothing, as the distance 1 - similarity obeys the triangle inequality: if x is
linked with the pivot and y with x, each at a distance of at most d = 1 - threshold, then y is within 2 d of the pivot.

- Pairs within 2 d ("near") join documents to families.  A family whose links don't make it one component is searched
  whole: its texts are dealt to blocks of BLOCK_BYTES x BLOCK_BYTES, each pair of blocks counts all intersections at once
  by an index of its shingles, and gives a spanning forest of the links between components, never the pairs.
- Members of a bucket that aren't linked with its pivot may be linked with each other.  If any of them is not near the
  pivot, they are compared with each other by their bins, in blocks too; those that share SHARED bins or more join one
  family.  Two texts of similarity 0.75 share fewer with a probability under 10**-15 (binomial, large sets).

Documents with equal sets form one class, represented by its smallest doc_id; only representatives enter
buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import hashing
from factloom.llm.common import arrow_batches, released, scratch, stage
from factloom.llm.components import connected_components

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Text of a family that is compared with as much at a time, on average.
BLOCK_BYTES = 6 << 20
#: Members of a bucket whose bins are compared with as many others at a time.
BLOCK = 1024
#: Equal bins from which two members of a bucket join one family.
SHARED = 51

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
#: The bin that an empty bin tries at each attempt.  With one full bin, 4096 attempts fail once in 10**14 times.
_DONORS = (hashing.mix(np.arange(4096 * BINS, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(4096, BINS)


def shingle_sets(words: hashing.Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than SHINGLE words are one shingle, none are none."""
    at, hashes = words.windows(SHINGLE)
    cuts = np.searchsorted(at, words.first)
    out = []
    for k, n in enumerate(words.counts().tolist()):
        if n >= SHINGLE:
            out.append(np.unique(hashes[cuts[k] : cuts[k + 1]]))
        else:
            own = words.hashes[words.first[k] : words.first[k + 1]]
            out.append(np.array([_sequence_hash(own)], np.uint64) if n else np.empty(0, np.uint64))
    return out


def _sequence_hash(own: np.ndarray) -> np.uint64:
    """Of a short text's whole sequence, apart from every longer shingle."""
    return hashing.mix(hashing.runs(own, len(own)) + np.uint64(len(own)))[0]


def signature(own: np.ndarray) -> np.ndarray:
    """The minima of BINS bins, as 32 bits each, of a set of sorted hashes that isn't empty."""
    at = np.searchsorted(own, _EDGES)
    full = at < np.append(at[1:], len(own))
    source = np.where(full, np.arange(BINS), -1)
    for k in range(0, len(_DONORS), 64):
        empty = np.flatnonzero(source < 0)
        if not len(empty):
            break
        tried = _DONORS[k : k + 64, empty]
        good = full[tried]
        first = good.argmax(axis=0)
        source[empty] = np.where(good.any(axis=0), tried[first, np.arange(len(empty))], -1)
    source[source < 0] = np.flatnonzero(full)[0]
    return ((own[np.minimum(at, len(own) - 1)] >> np.uint64(25)) & np.uint64(0xFFFFFFFF)).astype("<u4")[source]


def signatures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, set_a, set_b (together the set's fingerprint), bins."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, words in hashing.chunks(texts, lower=True):
                sets = shingle_sets(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([hashing.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bins"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(sign), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bins binary")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets are within 2 d, linked within d: d = 1 - threshold / 100."""

    least = max(1, 2 * threshold - 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}  # sets of texts met just before: the pairs of one document come together
        for batch in batches:
            near, linked = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sides = []
                for column in (part.column(2), part.column(3)):
                    raw = column.to_pylist()
                    new = [x for x in dict.fromkeys(raw) if x not in kept]
                    for i, j, words in hashing.chunks(pa.array(new, pa.large_string()), lower=True):
                        kept.update(zip(new[i:j], shingle_sets(words), strict=True))
                    sides.append([kept[x] for x in raw])
                for k, (x, y) in enumerate(zip(*sides, strict=True), lo):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    either = len(x) + len(y) - both
                    near[k], linked[k] = 0 < 100 * both >= least * either, 0 < 100 * both >= threshold * either
                if len(kept) > 256:
                    kept.clear()
            mask = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(linked).filter(mask)], ["a", "b", "linked"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # Both sides grow with the corpus: the plan is the same at every size.
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(released(compare), "a bigint, b bigint, linked boolean")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set on the left, the sizes of its intersections with all on the right, by an index of the right's hashes."""
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    hashes = np.concatenate(right) if right else np.empty(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for s in left:
        lo, hi = np.searchsorted(hashes, s), np.searchsorted(hashes, s, "right")
        n = hi - lo
        yield np.bincount(owner[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)], minlength=len(right))


class _Forest:
    """Edges that join what wasn't joined before."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, c: int) -> int:
        root = self.root
        root.setdefault(c, c)
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.edges.append((a, b))


def searched(members: DataFrame, blocks: Column, columns: list[str], within: Callable[[pa.Table, np.ndarray, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """members (family, id, columns), compared with all of their family in pairs of blocks -> (src, dst) that `within` gives for each.

    blocks is an aggregate: the number of blocks of a family.  within gets the rows of two blocks, and the places of
    those on the left and on the right (the same for a block with itself).
    """
    numbers = members.groupBy("family").agg(blocks.cast("int").alias("blocks"))
    dealt = (
        members.join(numbers, "family")
        .withColumn("own", F.pmod(F.xxhash64("id", "family"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", *columns)
    )

    def pair(rows: pa.Table) -> list[tuple[int, int]]:
        x, y, own = (rows.column(c).to_numpy() for c in ("x", "y", "own"))
        return within(rows, np.flatnonzero(own == x), np.flatnonzero(own == y))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            keys = np.stack([rows.column(c).to_numpy() for c in ("family", "x", "y")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
            found = [p for a, b in zip(cuts[:-2], cuts[1:-1], strict=True) for p in pair(rows.slice(a, b - a))]
            held = rows.slice(cuts[-2]).to_batches()
            yield _edges(found)
        if held:
            yield _edges(pair(pa.Table.from_batches(held)))

    return dealt.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(released(search), "src bigint, dst bigint")


def family_links(members: DataFrame, threshold: int) -> DataFrame:
    """members (family, id, component, text) -> (src, dst): pairs of components that a link joins, a few for each pair of blocks."""

    def within(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        component = rows.column("component").to_numpy()
        sets: list[np.ndarray] = []
        for _, _, words in hashing.chunks(rows.column("text").combine_chunks(), lower=True):
            sets += shingle_sets(words)
        sizes = np.array([len(s) for s in sets])
        forest = _Forest()
        for i, both in zip(left.tolist(), intersections([sets[i] for i in left], [sets[j] for j in right]), strict=True):
            hit = (100 * both >= threshold * (sizes[i] + sizes[right] - both)) & (component[right] != component[i])
            for c in np.unique(component[right[hit]]).tolist():
                forest.join(component[i].item(), c)
        return forest.edges

    return searched(members, F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), ["component", "text"], within)


def open_links(rows: DataFrame, reps: DataFrame, near: DataFrame) -> DataFrame:
    """rows (band, id, pivot) of all buckets -> (src, dst): members not linked with their pivot that share SHARED bins, as a spanning forest of each pair of blocks."""

    def within(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        ids = rows.column("id").to_numpy()
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), "<u4").reshape(len(ids), BINS)
        others = bins[right]
        forest = _Forest()
        for i in left.tolist():
            for j in right[(others == bins[i]).sum(1) >= SHARED].tolist():
                forest.join(ids[i].item(), ids[j].item())
        return forest.edges

    pairs = rows.select("band", "id", F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    left = pairs.join(near.hint("merge"), ["a", "b"], "left").where("coalesce(not linked, true)").select("band", "id", F.col("linked").isNull().alias("far"))
    kept = left.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).where("n > 1 and far").select("band")
    members = left.join(kept.hint("merge"), "band", "left_semi").join(reps.select("id", "bins").hint("merge"), "id").select(F.col("band").alias("family"), "id", "bins")
    return searched(members, F.ceil(F.count(F.lit(1)) / BLOCK), ["bins"], within)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Words are runs outside ASCII white space, with A-Z in lower case.  Documents are linked where 100 *
    intersection >= threshold * union of their sets; component_id is the smallest doc_id reachable by links.
    Documents without words (null and empty texts too) and rows without doc_id are linked with nothing; the
    latter's component is null and they are kept.  Rows that share a doc_id are one document, with the text of
    any of them.  Other columns are ignored.  No rows give no rows.
    """
    with scratch(docs.sparkSession) as keep, arrow_batches(docs.sparkSession):
        signed = stage(signatures(docs), "signed")
        key = ["set_a", "set_b", "n_shingles"]
        named = F.col("doc_id").isNotNull()
        classes = signed.where(named & (F.col("n_shingles") > 0)).groupBy(*key).agg(F.min("doc_id").alias("rep"))
        members = stage(
            signed.drop("bins").join(classes, key, "left").select("doc_id", "n_shingles", F.when(named, F.coalesce("rep", "doc_id")).alias("rep")),
            "members",
        )
        reps = stage(
            signed.join(classes, key).where("doc_id = rep").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bins").dropDuplicates(["id", "n"]),
            "reps",
        )
        band_keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("bins", k * (4 * ROWS) + 1, F.lit(4 * ROWS))))
        rows = reps.select("id", "n", F.explode(band_keys).alias("band"))
        # The pivot is the smallest id after a bijection that differs from bucket to bucket.
        buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("id").bitwiseXOR(F.col("band"))).bitwiseXOR(F.col("band")).alias("pivot")).where("size > 1")
        pivots = stage(rows.join(buckets, "band").where("id <> pivot").select("band", "id", "pivot", "size"), "pivots")
        stars = stage(pivots.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "stars")
        wanted = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = stage(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
        near = stage(confirm(stars, texts, threshold), "near")
        ends = [F.col("a").alias("src"), F.col("b").alias("dst")]
        linked = connected_components(near.where("linked").select(*ends))
        open_rows = open_links(pivots.where("size > 2"), reps, near)
        families = connected_components(near.select(*ends).unionAll(open_rows)).withColumnRenamed("component", "family")
        placed = stage(families.join(linked, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component")), "placed")
        apart = placed.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("family")
        open_texts = placed.join(apart, "family", "left_semi").join(texts.withColumnRenamed("doc_id", "id"), "id")
        merged = connected_components(family_links(open_texts, threshold)).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        found = placed.join(merged, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
        final = members.join(found, members["rep"] == found["id"], "left")
        component = F.coalesce("component", "rep")
        return keep(final.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
