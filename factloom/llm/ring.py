"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key (doc_id) is hashed to one of RING slots.  Every shard owns several slots, its virtual
nodes; a document belongs to the next virtual node clockwise.  A shard takes no more than its capacity;
documents that find it full continue clockwise to the next shard that is not.  Which documents continue
is fixed by their order on the ring (slot, hash, doc_id), so the result depends on the rows alone.

All decisions need only the number of documents in each slot: RING counts, whatever the input.  The driver
turns these into pieces (slot, range of ranks -> shard, first place in the shard), at most RING plus
arcs x shards rows, which are broadcast; each document then needs its rank within its slot.  The only
shuffle is of (doc_id, size, crc) by slot.  All of it is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots of the ring: the bound of what reaches the driver and of what is broadcast.
RING = 1 << 14
VIRTUAL_NODES = 48


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def virtual_nodes(shards: int, each: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes in clockwise order; two never share a slot."""
    if shards * each > RING // 2:
        each = max(1, RING // 2 // shards)
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(each):
            slot = _mixed(shard * 1_000_003 + k) % RING
            while slot in taken:
                slot = (slot + 1) % RING
            taken[slot] = shard
    return sorted(taken.items())


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Documents that each shard takes at most: shares one apart if slack is 0, else (1 + slack) times the mean."""
    if slack > 0:
        return [-(-int(n * (1 + slack)) // shards) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, slack: float, each: int = VIRTUAL_NODES) -> list[dict[str, int]]:
    """Pieces of slots: documents of ranks lo to hi - 1 of the slot go to the shard, at places from base on."""
    nodes = virtual_nodes(shards, each)
    left = capacities(sum(counts.values()), shards, slack)
    arc_slots: list[list[int]] = [[] for _ in nodes]
    at = 0
    for slot in range(RING):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        if slot in counts:
            arc_slots[at % len(nodes)].append(slot)
    owners = [shard for _, shard in nodes]
    clockwise = []  # the distinct shards from each arc on
    for a in range(len(nodes)):
        clockwise.append(list(dict.fromkeys(owners[a:] + owners[:a])))
    waiting = [sum(counts[s] for s in slots) for slots in arc_slots]
    parts: list[list[tuple[int, int, int]]] = [[] for _ in nodes]  # of each arc: (shard, documents, base)
    used = [0] * shards
    for step in range(shards):
        for a in range(len(nodes)):
            shard = clockwise[a][step]
            if took := min(waiting[a], left[shard]):
                parts[a].append((shard, took, used[shard]))
                waiting[a] -= took
                left[shard] -= took
                used[shard] += took
    pieces = []
    for slots, own in zip(arc_slots, parts, strict=True):
        own = list(own)
        for slot in slots:
            lo = 0
            while lo < counts[slot]:
                shard, n, base = own[0]
                took = min(n, counts[slot] - lo)
                pieces.append({"slot": slot, "lo": lo, "hi": lo + took, "shard": shard, "base": base})
                lo += took
                own[0] = (shard, n - took, base + took)
                if n == took:
                    own.pop(0)
    return pieces


def assign(docs: DataFrame, shards: int, slack: float = 0.0, each: int = VIRTUAL_NODES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot, home_shard; one row for each row of docs.

    size is the UTF-8 bytes of the text plus 1, slot the document's place in its shard, gapless from 0, and
    home_shard the shard whose arc the document lies on.  With slack 0 the shards' counts differ by one at
    most; with more, a shard may hold (1 + slack) times the mean and fewer documents move when shards change.
    A null doc_id is a key as any other; rows that share a doc_id are neighbours on the ring, and equal rows
    are interchangeable.  A null text counts as empty.  Other columns are ignored.  No rows give no rows.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id")
    slot = F.pmod(key, F.lit(RING)).cast("int").alias("ring_slot")
    counts = {r[0]: r[1] for r in docs.groupBy(slot).count().collect()}  # RING rows at most
    pieces = plan(counts, shards, slack, each)
    table = (
        spark.range(1)
        .select(F.inline(F.from_json(F.lit(json.dumps(pieces)), "array<struct<slot:int,lo:bigint,hi:bigint,shard:int,base:bigint>>")))
        .withColumnRenamed("slot", "ring_slot")
    )
    nodes = virtual_nodes(shards, each)
    homes, at = [], 0
    for s in range(RING):
        while at < len(nodes) and nodes[at][0] < s:
            at += 1
        homes.append(nodes[at % len(nodes)][1])
    order = Window.partitionBy("ring_slot").orderBy("key", "doc_id", "size", "text_crc32")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").__add__(1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("key"),
        slot,
    ).withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    near = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return rows.join(F.broadcast(table), "ring_slot").where(near).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
        F.element_at(F.from_json(F.lit(json.dumps(homes)), "array<int>"), F.col("ring_slot") + 1).alias("home_shard"),
    )
