"""Mixing sources to target weights by systematic sampling.

A source's target in words is shared out by weight and stops at a multiple of the source's own size; what
is cut off goes to the other sources by weight.  Every document of a source then has the same expected
number of copies, target / size of the source.  Along a fixed order of the source's documents these
expectations are summed; one random offset is added, and a document is emitted once for each whole number
that the sum crosses within it.  The order is by size, so each stretch of similar sizes gets its share and
the words taken differ from the target by about one large document at most.

The running sum needs only a document's rank in its source.  A source may hold a third of all rows, so the
rank is put together from three counts: of the smaller sizes in the source, of the earlier pieces of the
same size (pieces of PIECE documents, by hash), and within the piece.  No window spans a source's rows.
Only DataFrame functions are used; the text is read once, to count its words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Of the random offsets.
SEED = 17
#: Documents of one source and size that are ranked together.
PIECE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target, rate.

    Sources are ordered by code point, null last, and get the weights in turn, from the first again after the
    last.  Together the targets are share times all sizes, unless every source is at its limit of most times
    its size.  Cutting at the limits and resharing until none is above is filling all sources to one level per
    unit of weight: sources are taken by limit / weight, and the level is the first that the next limit allows.
    Each window here has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    by_limit = Window.orderBy(most * F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= most * F.col("source_size"))
    final = F.min(F.when(F.col("fits"), F.struct(most * F.col("source_size") / F.col("w"), "level")))
    chosen = levels.withColumn("final", final.over(everything)["level"])
    target = F.least(F.coalesce(F.col("final") * F.col("w"), most * F.col("source_size")), most * F.col("source_size"))
    return chosen.select(
        "source",
        "source_size",
        F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes (doc_id, source, size, tie) -> (cells, pieces, rates): what a row's rank and rate are put together from.

    cells has one row per source and distinct size (a corpus of T words has at most sqrt(2 T) of them in a source),
    pieces one per PIECE documents and cell, rates one per source.
    """
    by_size = stage(sizes.groupBy("source", "size").count(), "cells")
    rates = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).cast("double").alias("source_size")), weights, share, most)
    earlier = F.sum("count").over(Window.partitionBy("source").orderBy("size")) - F.col("count")
    cells = by_size.select(F.col("source").alias("c"), F.col("size").alias("y"), earlier.alias("before"), F.ceil(F.col("count") / PIECE).alias("pieces"))
    counted = _dealt(sizes, cells).groupBy("source", "size", "piece").count()
    inside = Window.partitionBy("source", "size").orderBy("piece")
    pieces = stage(
        counted.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("piece").alias("p"), (F.sum("count").over(inside) - F.col("count")).alias("earlier")), "pieces"
    )
    return cells, pieces, rates.select(F.col("source").alias("rated"), "source_size", "target", "rate")


def _dealt(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with the number of smaller documents in their source, and their piece."""
    piece = F.pmod(F.xxhash64("doc_id", "tie", F.lit(SEED)), F.col("pieces"))
    return rows.join(cells, F.col("source").eqNullSafe(F.col("c")) & (F.col("size") == F.col("y"))).drop("c", "y").withColumn("piece", piece)


def _taken(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], seed: int) -> DataFrame:
    """rows (doc_id, source, size, tie, ...) with source_size, target and copies."""
    cells, pieces, rates = plan
    at = F.row_number().over(Window.partitionBy("source", "size", "piece").orderBy("doc_id", "tie"))
    ranked = (
        _dealt(rows, cells)
        .withColumn("at", at)
        .join(pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("piece") == F.col("p")))
        .withColumn("rank", F.col("before") + F.col("earlier") + F.col("at"))
    )
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)
    upto = lambda k: F.floor(F.col("rate") * k + offset)
    return ranked.join(rates, F.col("source").eqNullSafe(F.col("rated"))).select(
        *rows.columns, F.col("source_size").cast("bigint").alias("source_size"), "target", (upto(F.col("rank")) - upto(F.col("rank") - 1)).alias("copies")
    )


def _sized(docs: DataFrame) -> list[Column]:
    """tie orders rows that share a doc_id; those that share it too are equal and interchangeable."""
    return [docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), F.xxhash64(docs["text"]).alias("tie")]


def copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, copies; one row for each row.

    size counts words; copies is how often the mix takes the document, whole, at most ceil(most).  A null text has
    no words, a null source is a source of its own, null doc_ids are ranked first and rows that share one are
    ranked apart (equal ones are interchangeable).  A source without words has target 0 and is not taken.
    Reruns over the same rows agree.  No rows give no rows.
    """
    sizes = stage(docs.select(*_sized(docs)), "sizes")
    return _taken(sizes, _plan(sizes, weights, share, most), seed).drop("tie")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as copies() says, with docs' own columns; repeated rows are taken apart."""
    sizes = stage(docs.select(*_sized(docs)), "sizes")
    rows = docs.select(*_sized(docs), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    taken = _taken(rows, _plan(sizes, weights, share, most), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
