"""Near-duplicate vectors by product quantisation, within labels.

Vectors of length 1 are coded: the nearest of the coarse centroids names the inverted list, and the residual
is cut into SUBSPACES parts, each replaced by the nearest of CODES centroids.  A query looks up distances to
list members by adding table entries per subspace (asymmetric distance), over as many lists as can hold a
link, and what passes is compared exactly, by cosine in double precision.

A cosine of at least c means a distance of at most t = sqrt(2 - 2 c).  Both steps before the exact one lose nothing:

- Of a pair in the cells of centroids a and b, each vector lies on its own side of the plane between a and b, so their
  distances to this plane add up to the pair's distance at most.  One of the two is therefore within t / 2 of the plane,
  and a vector probes all lists whose border is that near, whatever directions the differences take.  A pair that both
  sides find counts from the one with the smaller uid.
- The distance to a coded vector differs from the true one by at most that vector's coding error e, so a looked-up
  distance over t + e rules a pair out.

Work is dealt by label and group of lists, so that a vector travels once for all lists of a group that it probes.
Groups hold about half a block of members; larger ones are cut in blocks of members, their queries likewise, and every
pair of blocks is a unit.  Units give each vector's number of links and a spanning forest of the links found, never
the pairs.  Training uses a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import scratch, stage
from factloom.llm.components import connected_components

SUBSPACES, CODES = 16, 16
#: Members or queries in a block at most, and components of vectors in it at most (but 256 vectors always).
BLOCK, COMPONENTS = 4096, 2**20
#: Queries looked up at once.
QUERIES = 256
#: Vectors that centroids and codes are fitted on, at most.
SAMPLE = 20_000
#: Vectors that centroids are fitted on, for each list: there are half the square root of the number of vectors lists, and more vectors are drawn for them.
PER_LIST = 8


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centers.T - (centers**2).sum(1) / 2, 1)
        n = np.bincount(near, minlength=len(centers))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        centers[full] = sums / n[full, None]
    return centers


@dataclass
class Codec:
    coarse: np.ndarray  # lists x dimensions
    codes: np.ndarray  # subspaces x codes x dimensions / subspaces

    def parts(self, residual: np.ndarray) -> np.ndarray:
        return residual.reshape(len(residual), len(self.codes), -1)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        parts = self.parts(residual)
        return np.stack([np.argmax(parts[:, m] @ c.T - (c**2).sum(1) / 2, 1) for m, c in enumerate(self.codes)], 1).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([c[code[:, m]] for m, c in enumerate(self.codes)], 1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's part with each code: queries x subspaces x codes."""
        parts = self.parts(queries)
        return np.stack([parts[:, m] @ c.T for m, c in enumerate(self.codes)], 1)


def fit(sample: np.ndarray, lists: int, seed: int = 11) -> Codec:
    """sample: unit vectors, at least one."""
    rng = np.random.default_rng(seed)
    coarse = kmeans(sample, lists, 12, rng)
    residual = sample - coarse[np.argmax(sample @ coarse.T - (coarse**2).sum(1) / 2, 1)]
    dims = sample.shape[1]
    subspaces = next(m for m in range(min(SUBSPACES, dims), 0, -1) if dims % m == 0)
    step = dims // subspaces
    codes = [kmeans(residual[:, m * step : (m + 1) * step], CODES, 10, rng) for m in range(subspaces)]
    return Codec(coarse, np.stack(codes))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column that has no nulls and one length."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unpacked(blobs: list[bytes], kind: str) -> np.ndarray:
    """Rows of vectors that travel as their bytes."""
    return np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no length overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (left, right) connect: at most one for each id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def search_unit(codec: Codec, members: tuple, queries: tuple, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of the queries with the members of lists that they probe, but not those that count from the member's side.

    members: uid, id, vector, list, lists probed (booleans), code, coding error; queries: the first five of these.
    The result is the number of links for each member and each query, and spanning edges.
    """
    m_uid, m_id, m_vec, m_home, m_probes, m_code, m_error = members
    q_uid, q_id, q_vec, q_home, q_probes = queries
    t = np.sqrt(2 - 2 * cosine)
    m_scaled, q_scaled = (x / np.abs(x).max(1, keepdims=True) for x in (m_vec, q_vec))
    m_square, q_square = (m_scaled * m_scaled).sum(1), (q_scaled * q_scaled).sum(1)
    u = unit(q_vec)
    coded = codec.coarse[m_home] + codec.decode(m_code)
    # |u - coded| ** 2 <= (t + error) ** 2, as a bound on the product of u and coded
    least = (1 + (coded * coded).sum(1) - (t + m_error + 1e-6) ** 2) / 2
    m_n, q_n = np.zeros(len(m_uid), np.int64), np.zeros(len(q_uid), np.int64)
    edges: list[tuple[int, int]] = []
    step = max(1, 2**22 // m_vec.shape[1])
    by_list = np.argsort(m_home, kind="stable")
    for lo in range(0, len(q_uid), QUERIES):
        tables = codec.tables(u[lo : lo + QUERIES])
        for at in np.split(by_list, np.flatnonzero(np.diff(m_home[by_list])) + 1):
            which = m_home[at[0]]
            asks = np.flatnonzero(q_probes[lo : lo + QUERIES, which])
            if not len(asks):
                continue
            looked_up = np.repeat((u[lo + asks] @ codec.coarse[which])[:, None], len(at), 1)
            own = tables[asks]
            for m in range(m_code.shape[1]):
                looked_up += own[:, m, :][:, m_code[at, m]]
            i, j = np.nonzero(looked_up >= least[at][None, :])
            i, j = lo + asks[i], at[j]
            once = (q_uid[i] != m_uid[j]) & ((q_uid[i] < m_uid[j]) | ~m_probes[j, q_home[i]])
            i, j = i[once], j[once]
            found = [np.zeros(0, bool)]
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                found.append((q_scaled[a] * m_scaled[b]).sum(1) / np.sqrt(q_square[a] * m_square[b]) >= cosine)
            hit = np.concatenate(found)
            i, j = i[hit], j[hit]
            q_n += np.bincount(i, minlength=len(q_n))
            m_n += np.bincount(j, minlength=len(m_n))
            other = q_id[i] != m_id[j]
            edges += forest(q_id[i][other], m_id[j][other])
    return m_n, q_n, forest(*np.array(edges, np.int64).reshape(-1, 2).T)


def links(sound: DataFrame, dims: int, n: int, cosine: float, sample: int, lists: int | None) -> DataFrame:
    """Vectors of one length, n of them, none null, zero or not finite -> uid and n, a part of its links, or src and dst, an edge of a spanning forest."""
    lists = lists or max(4, round(np.sqrt(n) / 2))
    drawn = sound.orderBy(F.xxhash64("vec_id"), "uid").select("embedding").limit(max(sample, PER_LIST * lists)).toArrow()
    codec = fit(unit(matrix(drawn.column(0).combine_chunks())), lists)
    gaps = np.sqrt(((codec.coarse[:, None, :] - codec.coarse[None, :, :]) ** 2).sum(2)) if len(codec.coarse) <= 512 else None
    reach = float(np.sqrt(2 - 2 * cosine)) / 2 + 1e-6
    block = int(max(256, min(BLOCK, COMPONENTS // dims)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The list of each vector, the lists that it probes, as numbers and as bits, and its code."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                u = unit(matrix(part.column(3)))
                d2 = 1 + (codec.coarse**2).sum(1) - 2 * u @ codec.coarse.T
                home = np.argmin(d2, 1)
                own = d2[np.arange(len(u)), home]
                probes = np.arange(len(codec.coarse)) == home[:, None]
                for at in range(0, len(u), 16):
                    h = home[at : at + 16]
                    between = gaps[h] if gaps is not None else np.sqrt(((codec.coarse[h][:, None, :] - codec.coarse[None, :, :]) ** 2).sum(2))
                    probes[at : at + 16] |= d2[at : at + 16] - own[at : at + 16, None] <= 2 * reach * between + 1e-12
                residual = u - codec.coarse[home]
                code = codec.encode(residual)
                error = np.sqrt(((residual - codec.decode(code)) ** 2).sum(1))
                vectors_as_bytes = np.asarray(part.column(3).flatten()).astype(kind).reshape(len(u), -1)
                starts = np.concatenate([[0], np.cumsum(probes.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array([r.tobytes() for r in vectors_as_bytes], pa.binary()),
                        pa.array(home.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(np.nonzero(probes)[1].astype(np.int32))),
                        pa.array([r.tobytes() for r in np.packbits(probes, axis=1)], pa.binary()),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(error),
                    ],
                    ["uid", "vec_id", "label", "embedding", "home", "probes", "bits", "code", "error"],
                )

    kind = "<f4" if sound.schema["embedding"].dataType == T.ArrayType(T.FloatType(), sound.schema["embedding"].dataType.containsNull) else "<f8"
    kinds = {f.name: f.dataType.simpleString() for f in sound.schema.fields}
    indexed = stage(
        sound.select("uid", "vec_id", "label", "embedding").mapInArrow(
            index, f"uid bigint, vec_id bigint, label {kinds['label']}, embedding binary, home int, probes array<int>, bits binary, code binary, error double"
        ),
        "index",
    )
    sizes = indexed.groupBy("label").agg(F.ceil(F.count(F.lit(1)) * 2 / block).cast("int").alias("groups"))
    place = lambda role, group: F.struct(F.lit(role).cast("tinyint").alias("role"), group.alias("group"))
    asked = F.array_distinct(F.transform("probes", lambda x: x % F.col("groups")))
    placed = indexed.join(sizes, "label").withColumn(
        "place", F.explode(F.concat(F.array(place(0, F.col("home") % F.col("groups"))), F.transform(asked, lambda g: place(1, g))))
    ).select("label", "place.*", "uid", "vec_id", "embedding", "home", "bits", F.when(F.col("place.role") == 0, F.col("code")).alias("code"), "error")
    cells = placed.groupBy("label", "group").agg(*(F.ceil(F.count_if(F.col("role") == r) / block).cast("int").alias(c) for r, c in ((0, "mb"), (1, "qb"))))
    own = lambda c: F.pmod(F.xxhash64("uid", F.lit(7)), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = (
        placed.join(cells.where("mb > 0 and qb > 0"), ["label", "group"])
        .withColumn("m", F.explode(F.when(F.col("role") == 0, F.array(own("mb"))).otherwise(every("mb"))))
        .withColumn("q", F.explode(F.when(F.col("role") == 1, F.array(own("qb"))).otherwise(every("qb"))))
        .select("group", "m", "q", "role", F.col("label").cast("string").alias("label"), "uid", "vec_id", "embedding", "home", "bits", "code", "error")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def within(group: pa.Table) -> pa.RecordBatch:
            group = group.combine_chunks()
            role = group.column("role").to_numpy()
            take = lambda r, *names: [group.column(c).to_numpy()[role == r] for c in names]
            vec = unpacked(group.column("embedding").to_pylist(), kind)
            codes = np.frombuffer(b"".join(x for x in group.column("code").to_pylist() if x is not None), np.uint8).reshape(-1, len(codec.codes))
            probes = np.unpackbits(np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(role), -1), axis=1, count=len(codec.coarse)).astype(bool)
            (m_uid, m_id, m_home, m_error), (q_uid, q_id, q_home) = take(0, "uid", "vec_id", "home", "error"), take(1, "uid", "vec_id", "home")
            edges: list[tuple[int, int]] = []
            uid, n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(m_uid) and len(q_uid):
                m_n, q_n, edges = search_unit(
                    codec, (m_uid, m_id, vec[role == 0], m_home, probes[role == 0], codes, m_error), (q_uid, q_id, vec[role == 1], q_home, probes[role == 1]), cosine
                )
                uid, n_links = np.concatenate([m_uid, q_uid]), np.concatenate([m_n, q_n])
            hit = n_links > 0
            k = int(hit.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*uid[hit].tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*n_links[hit].tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*[None] * k, *(a for a, _ in edges)], pa.int64()),
                    pa.array([*[None] * k, *(b for _, b in edges)], pa.int64()),
                ],
                ["uid", "n", "src", "dst"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            key = np.stack([table.column(c).to_numpy() for c in ("group", "m", "q")])
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0) | (label[1:] != label[:-1])) + 1
            cuts = [0, *edges.tolist(), table.num_rows]
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield within(table.slice(a, b - a))
            held = table.slice(cuts[-2]).to_batches()
        if held:
            yield within(pa.Table.from_batches(held))

    unit_key = ["label", "group", "m", "q"]
    return stage(dealt.repartition(*unit_key).sortWithinPartitions(*unit_key).mapInArrow(search, "uid bigint, n bigint, src bigint, dst bigint"), "found")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding: array of numbers, label) -> vec_id, n_links, component_id, kept; one row for each row.

    Linked are vectors of one label that isn't null with a cosine of at least `cosine`.  Vectors that are null, empty,
    zero, or hold a component that is null or not finite link with nothing, and vectors of two lengths don't link; each length
that two or more vectors have is searched on its own.
    Rows that share a vec_id are counted as links apart and connect what they link with; a null vec_id links with
    nothing, its component is null and it is kept.  Other columns are ignored.  No rows give no rows.
    """
    with scratch(vectors.sparkSession) as keep:
        x = F.col("embedding")
        clean = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
        rows = stage(
            vectors.select("vec_id", "label", x.alias("embedding")).withColumn("ok", F.coalesce(clean & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("uid", F.monotonically_increasing_id()),
            "vectors",
        )
        sound = rows.where("ok")
        lengths = sound.groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy(F.desc("count"), "d").collect()
        alone = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        if not lengths:
            return keep(alone)
        found = reduce(DataFrame.unionByName, (links(sound.where(F.size("embedding") == dims), dims, n, cosine, sample, lists) for dims, n in lengths))
        counts = found.where("uid is not null").groupBy("uid").agg(F.sum("n").alias("n"))
        groups = connected_components(found.where("src is not null").select("src", "dst"))
        out = rows.select("uid", "vec_id").join(counts, "uid", "left").join(groups, F.col("vec_id") == F.col("id"), "left")
        component = F.coalesce("component", "vec_id")
        return keep(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))
