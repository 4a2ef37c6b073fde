"""Groups of spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit leaves a half of a word intact.  So a word of L letters stands in blocks of its own length and, as the shorter one of an insertion,
of the length above, and of each length in two: the words that share the first half (they are a range of the sorted
dictionary) and those that share the last half (a range of the dictionary sorted by reversed words).  A block is a length, a
stretch [a, e) in which the edit falls, and the letters before and after it.  A block of more than LIMIT words is subdivided:
the stretch is halved, and every word enters the block of either half, again with a shared prefix or a shared suffix that is longer.
A stretch of one letter has as many words as there are letters at most, so subdividing ends, and every pair is compared in the one block
whose stretch holds the place of its first difference: none twice.

Blocks are counted before they are dealt out, with counts combined before the shuffle, so a large block never meets in one task;
rows are then sorted by block, and tasks scan the ranges, comparing neighbours at each distance with whole numpy arrays.
All letters are below U+0100, so a word is one byte a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import scratch, stage
from factloom.llm.hashing import octets

RUN = "[A-Za-zÀ-ÿ]+"
#: One of so many hashes of (document, run) has a letter deleted.
EDITED = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Words of a block that are compared with one another; a larger block is subdivided.  More than there are letters.
LIMIT = 128
#: A form stands so many times as often as its variant, at least.
RATIO = 2

_UPPER, _LOWER, _BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ISO-8859-1"
_BLOCK = ["size", "a", "e", "head", "tail"]
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def word_counts(docs: DataFrame, edited: int | None = EDITED, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """docs (doc_id, text) -> word, n: its occurrences in all texts, for words of enough letters and occurrences.

    Null texts have no runs; a null doc_id counts as an empty one in the hash.  edited=None deletes nothing.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if edited is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        cut = (h % F.length("run")).cast("int")
        without = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))
        word = F.when(h % edited == 0, without).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _halves(rows: DataFrame) -> DataFrame:
    """rows (code, n, full, size, a, e) -> the same in the blocks of the two halves of [a, e), with what is shared."""
    middle = ((F.col("a") + F.col("e")) / 2).cast("int")
    half = F.explode(F.array(F.struct(middle.alias("a"), F.col("e").alias("e")), F.struct(F.col("a").alias("a"), middle.alias("e")))).alias("half")
    each = rows.select("code", "n", "full", "size", half).select("code", "n", "full", "size", "half.*").where("a < e")
    length, after = F.octet_length("code"), F.col("size") - F.col("e")
    head, tail = F.substring(F.col("code"), F.lit(1), F.col("a")), F.substring(F.col("code"), length - after + 1, after)
    return each.select("code", "n", "full", "size", "a", "e", head.alias("head"), tail.alias("tail"))


def _first_blocks(words: DataFrame) -> DataFrame:
    """words (word, n) -> every word in the blocks of its length and of the length above, by first and by last half."""
    code = F.encode("word", _BYTES)
    size = F.explode(F.array(F.octet_length("code"), F.octet_length("code") + 1))
    both = words.select(code.alias("code"), "n").select("code", "n", size.alias("size"))
    return _halves(both.select("code", "n", (F.col("size") == F.octet_length("code")).alias("full"), "size", F.lit(0).alias("a"), F.col("size").alias("e")))


def equal_bytes(eight: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each i, how many bytes from x[i] and from y[i] on agree, n[i] at most; eight: octets() of the bytes."""
    out = n.copy()
    left, done = np.flatnonzero(n > 0), 0
    while len(left):
        unlike = (eight[x[left] + done] ^ eight[y[left] + done]) & _FIRST[np.minimum(n[left] - done, 8)]
        hit = unlike != 0
        low = unlike[hit] & (~unlike[hit] + np.uint64(1))
        out[left[hit]] = done + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        done += 8
        left = left[~hit]
        left = left[n[left] > done]
    return out


def near_pairs(starts: np.ndarray, lengths: np.ndarray, eight: np.ndarray, size: np.ndarray, a: np.ndarray, e: np.ndarray, full: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block (last: the row after it) whose words differ by one edit, the first difference in [a, e)."""
    row = np.arange(len(starts))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i, distance = row, 1
    while True:
        i = i[i + distance < last[i]]
        if not len(i):
            break
        one, two = i, i + distance
        some = np.flatnonzero(full[one] | full[two])
        one, two = one[some], two[some]
        short, long = np.where(full[one], two, one), np.where(full[one], one, two)  # equal lengths: either
        begin = a[long]
        at = begin + equal_bytes(eight, starts[short] + begin, starts[long] + begin, lengths[short] - begin)
        here = np.flatnonzero(at < e[long])
        short, long, at = short[here], long[here], at[here]
        rest = size[long] - at - 1
        same = equal_bytes(eight, starts[short] + at + full[short], starts[long] + at + 1, rest)
        near = same == rest
        found.append((short[near], long[near]))
        distance += 1
    if not found:
        return row[:0], row[:0]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> near pairs.  The last block of a batch waits for its other rows: LIMIT at most."""
    waiting: pa.Table | None = None

    def work(rows: pa.Table, starts_block: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = rows.column("code").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(code.buffers()[1], np.int64)[code.offset : code.offset + len(code) + 1]
        data = np.frombuffer(code.buffers()[2] or b"", np.uint8)
        first = np.flatnonzero(starts_block)
        last = np.repeat(np.append(first[1:], len(rows)), np.diff(np.append(first, len(rows))))
        values = [rows.column(c).to_numpy().astype(np.int64) for c in ("size", "a", "e")]
        x, y = near_pairs(offsets[:-1], np.diff(offsets), octets(data), *values, rows.column("full").to_numpy(), last)
        if len(x):
            x, y = pa.array(x), pa.array(y)
            pair = pa.Table.from_arrays([rows.column("code").take(x), rows.column("n").take(x), rows.column("code").take(y), rows.column("n").take(y)], ["code", "n", "other", "other_n"])
            yield from pair.combine_chunks().to_batches()

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.ones(len(rows), bool)
        new[1:] = False
        for c in _BLOCK:
            column = rows.column(c).combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return new

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        if not len(rows):
            continue
        new = begins(rows)
        cut = int(np.flatnonzero(new)[-1])
        waiting = rows.slice(cut)
        if cut:
            yield from work(rows.slice(0, cut), new[:cut])
    if waiting is not None:
        yield from work(waiting, begins(waiting))


def _pairs(words: DataFrame, limit: int) -> DataFrame:
    """words (word, n) -> every pair of them that is one edit apart, once: code, n, other, other_n."""
    level = stage(_first_blocks(words), "blocks")
    found: DataFrame | None = None
    while True:
        sizes = level.groupBy(*_BLOCK).agg(F.count("*").alias("members"), F.max("full").alias("any")).where("any and members > 1").drop("any")
        sized = stage(level.join(sizes, _BLOCK), "sized")
        ranges = sized.where(F.col("members") <= limit).drop("members").repartition(*_BLOCK)
        pairs = stage(ranges.sortWithinPartitions(*_BLOCK, "code").mapInArrow(_scan, "code binary, n bigint, other binary, other_n bigint"), "pairs")
        found = pairs if found is None else found.unionAll(pairs)
        open_ = sized.where(F.col("members") > limit).drop("members", "head", "tail")
        if open_.isEmpty():
            return found
        level = stage(_halves(open_), "blocks")


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: the end of the chain of forms.  Each round doubles the steps; a form occurs more often, so chains end."""
    links = stage(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(words: DataFrame, limit: int = LIMIT, ratio: int = RATIO) -> DataFrame:
    """words (word, n), distinct, of letters below U+0100 -> word, form, root, n, n_near, form_n.

    n_near: words one inserted, deleted or replaced letter away.  form: the most frequent of them (ties: the first in code-point order)
    if it occurs ratio times as often, else null.  root: the last of the chain of forms, the word itself without one.  No words: no rows.
    """
    with scratch(words.sparkSession) as keep:
        words = stage(words.select("word", "n"), "words")
        pairs = _pairs(words, limit)
        sides = F.explode(F.array(F.struct("code", "other", F.col("other_n").alias("m")), F.struct(F.col("other").alias("code"), F.col("code").alias("other"), F.col("n").alias("m")))).alias("s")
        near = pairs.select(sides).select("s.*").groupBy("code").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
        best = near.select(F.decode("code", _BYTES).alias("word"), "n_near", F.decode("best.other", _BYTES).alias("form"), (-F.col("best.m")).alias("form_n"))
        is_form = F.col("form_n") >= ratio * F.col("n")
        formed = stage(
            words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")),
            "formed",
        )
        ends = _roots(formed.where("form is not null"))
        return keep(stage(formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"))


def spelling_variants(docs: DataFrame, edited: int | None = EDITED) -> DataFrame:
    """docs (doc_id, text) -> the words of all texts with their forms and roots; see word_counts() and variants().  Other columns are ignored."""
    return variants(word_counts(docs, edited))
