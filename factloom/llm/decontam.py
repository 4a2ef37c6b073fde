"""Benchmark decontamination with a set of normalised test n-grams.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].  An item's windows are its runs of
WINDOW words; a shorter item that has words is one window.  Every document position is hashed over the
next words and looked up in the set of the windows' hashes; positions that pass carry their exact words and are
verified against the windows by an equi-join, so hash clashes don't count.  The text is read once and never shuffled:
only hits are.

The set is a bit map with two bits for each window, part of the expression, so Spark broadcasts it with the stage.  It
has BITS bits for each window, and MOST_BITS at most (16 MB): with more windows more positions pass that the join then
turns down, by broadcast while the windows are JOINED or fewer, else by a shuffle of the positions that passed.
Only DataFrame functions are used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bits of the map for each window, and in all.
BITS, MOST_BITS = 32, 1 << 27
#: Windows that are broadcast to be joined with hits at most (some 100 bytes each).
JOINED = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """benchmark (item_id, text) -> gram, n (its words), item_id, distinct.  Items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, n)))).alias("gram")).distinct()


def _bit_map(hashes: DataFrame, n: int) -> tuple[str, int]:
    """hashes (h: bigint), n of them -> (a SQL literal of the map's 64-bit words, the number of words, a power of two)."""
    words = 1
    while 64 * words < min(BITS * n, MOST_BITS):
        words *= 2
    places = hashes.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("x"))
    set_bits = places.groupBy(F.pmod(F.shiftrightunsigned("x", 6), F.lit(words)).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 AS int)))").alias("bits"))
    found = [0] * words
    for r in set_bits.collect():  # the map itself
        found[r["word"]] = r["bits"]
    return f"from_json('{json.dumps(found)}', 'array<bigint>')", words


def _passes(map_sql: str, words: int, h: str) -> str:
    bit = lambda x: f"getbit({map_sql}[cast(pmod(shiftrightunsigned({x}, 6), {words}) AS int)], cast({x} & 63 AS int)) = 1"
    return f"{bit(h)} AND {bit(f'shiftrightunsigned({h}, 32)')}"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> uid, doc_id, n_words, hit: array of (at, n, items), one row for each row of docs.

    at is the 1-based position of the window's first word, items the ids of the items that have the window.
    """
    windows = stage(item_windows(benchmark, window), "windows")
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.countDistinct("gram").alias("c")).collect()}  # one row per window length
    worded = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    worded = worded.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    parts = []
    for n in sorted(sizes):
        hashes = windows.where(F.col("n") == n).select(F.xxhash64(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x))).alias("h"))
        test = _passes(*_bit_map(hashes, sizes[n]), "x")
        own = f"IF(n_words < {n}, array(), transform(sequence(1, greatest(n_words - {n - 1}, 1)), i -> xxhash64(slice(h, i, {n}))))"
        places = f"array_compact(transform({own}, (x, i) -> IF({test}, i + 1, NULL)))"
        parts.append(f"transform({places}, i -> named_struct('at', i, 'n', {n}, 'gram', concat_ws(' ', slice(w, i, {n}))))")
    empty = "cast(array() as array<struct<at:int,n:int,gram:string>>)"
    found = worded.select("uid", "doc_id", "n_words", F.expr(f"concat({', '.join([empty, *parts])})").alias("found"))
    found = found.select("uid", "doc_id", "n_words", F.explode_outer("found").alias("f")).select("uid", "doc_id", "n_words", "f.at", "f.n", "f.gram")
    grams = windows.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    verified = found.join(F.broadcast(grams) if sum(sizes.values()) <= JOINED else grams.hint("merge"), "gram", "left")
    return verified.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("bigint").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", "n", "items"))).alias("hit"),
    )


def covered(hit: Column) -> Column:
    """The number of words inside any of the windows."""
    ordered = F.array_sort(F.transform(hit, lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["n"]).alias("end"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(h["end"] - F.greatest(a["end"], h["at"]), F.lit(0))).alias("n"))
    return F.aggregate(ordered, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    One row for each row of docs, repeated doc_ids too.  Null and empty texts have no words and aren't
    contaminated; null and empty items have no windows; repeated items share theirs, and an item whose id is
    null hits words but isn't counted.  items_sha256 is of the ids, sorted as strings and joined by commas.
    Other columns are ignored.  Empty tables give no rows, or rows without hits.
    """
    n_hit = covered(F.col("hit"))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.col("hit.items"))), lambda x: x.cast("string")))
    return hits(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their columns, whose text isn't contaminated.

    A row goes for its own text: rows without doc_id and rows that share one are judged apart.
    """
    of_text = F.xxhash64("text")
    rows = docs.select(F.struct("doc_id", of_text.alias("of_text")).alias("doc_id"), "text")
    bad = contamination(rows, benchmark, window).where("contaminated").select(F.col("doc_id.doc_id").alias("_bad"), F.col("doc_id.of_text").alias("_of_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (of_text == bad["_of_text"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text without the hit words: contaminated texts become their other words, lower-cased and joined by a space.

    Rows are matched by doc_id, so rows that share one must be equal.
    """
    rows = docs.select("doc_id", "text")
    spans = hits(rows, benchmark, window).where(F.size("hit") > 0).groupBy(F.col("doc_id").alias("bad")).agg(F.first("hit").alias("hit"))
    left = F.filter(words_of(F.col("text")), lambda w, i: ~F.exists("hit", lambda h: (i + 1 >= h["at"]) & (i + 1 < h["at"] + h["n"])))
    return rows.join(spans, F.col("doc_id").eqNullSafe(F.col("bad")), "left").select("doc_id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.array_join(left, " ")).alias("text"))
