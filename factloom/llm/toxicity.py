"""Toxicity by subword bags.

A word is the set of its character n-grams (over UTF-8 bytes, with edge marks), hashed into BUCKETS embeddings; a bag of
words is the mean of its words' vectors, each the mean of its features; a linear softmax over that mean tells the two
classes apart.  Embeddings and softmax are trained jointly.  Misspellings share most of a word's n-grams, so unseen
ones get nearly its vector.

A document is as toxic as the bag of its most toxic WINDOW words in a row.  In training, the first round takes the whole
document as one bag, the later ones the window of the whole document that scores highest at that time, so in clean
documents the most misleading windows are learnt from.  In these rounds a share of the words is misspelt anew each time,
in both classes alike.  A document without words is a bag of nothing; one such counts as clean in training.

After training each bucket's effect on the log-odds is a number, and a word's effect a mean of numbers; scoring
hashes each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import hashing

BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 4
GRAMS = (3, 4, 5, 6)
#: Labelled documents of each class that are learnt from, chosen by hash, and their bytes of text: the bounds of what reaches the driver.
SAMPLE = {1: 2000, 0: 2500}
SAMPLE_BYTES = 16 << 20
#: Bytes from which a text is learnt from only if there is room after all shorter ones.
LONG_BYTES = 1 << 20
#: Words that a training step takes at a time.
STEP_WORDS = 1 << 16
THRESHOLD = 0.7

SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def features(words: hashing.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the features of the chosen words, one after another."""
    starts, ends = words.starts[which], words.ends[which]
    sizes = ends - starts
    total = sizes + 2
    cuts = np.concatenate([[0], np.cumsum(total)])
    data = np.zeros(cuts[-1], np.uint8)
    inner = np.ones(cuts[-1], bool)
    inner[cuts[:-1]] = False
    inner[cuts[1:] - 1] = False
    data[cuts[:-1]], data[cuts[1:] - 1] = 1, 2  # edge marks: bytes that no word has
    data[inner] = words.data[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
    owner = np.repeat(np.arange(len(which)), total)
    eight = hashing.octets(data)
    found, owners = [], []
    for n in GRAMS:
        if len(data) >= n:
            at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
            found.append(hashing.mix(eight[at] << np.uint64(64 - 8 * n) | np.uint64(n)))
            owners.append(owner[at])
    short = np.flatnonzero(sizes < min(GRAMS) - 1)  # a word too short for an n-gram is a feature itself
    found.append(hashing.mix(words.hashes[which[short]] + np.uint64(99)))
    owners.append(short)
    hashes, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (hashes[order] >> np.uint64(64 - 18)).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(which)))])


@dataclass
class Model:
    effects: np.ndarray  # of each bucket on the log-odds
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of each text, by its most toxic window; texts without words have the bias alone."""
        out = []
        for _, _, words in hashing.chunks(texts, SEPARATOR):
            _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            buckets, cuts = features(words, first)
            effect = np.add.reduceat(self.effects[buckets], cuts[:-1]) / np.diff(cuts) if len(first) else np.empty(0)
            best, _ = best_windows(effect[inverse], words.first)
            out.append(1 / (1 + np.exp(-np.clip(best + self.bias, -60, 60))))
        return np.concatenate(out) if out else np.empty(0)


def best_windows(effect: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean effect of each text's best window (its words are first[i]:first[i + 1]; none: 0), and the means of all windows."""
    n = np.diff(first)
    best = np.zeros(len(n))
    sums = np.concatenate([[0.0], np.cumsum(effect)])
    short, long = (n > 0) & (n <= WINDOW), n > WINDOW
    best[short] = (sums[first[1:][short]] - sums[first[:-1][short]]) / n[short]
    means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW if len(effect) >= WINDOW else np.empty(0)
    if long.any():
        spans = np.stack([first[:-1][long], first[1:][long] - WINDOW + 1], 1)
        best[long] = np.maximum.reduceat(np.append(means, -np.inf), spans.ravel())[::2]
    return best, means


def best_starts(effect: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first word of each text's best window."""
    begin = first[:-1].copy()
    best, means = best_windows(effect, first)
    for k in np.flatnonzero(np.diff(first) > WINDOW).tolist():
        begin[k] += int(np.argmax(means[first[k] : first[k + 1] - WINDOW + 1]))
    return begin


def vocabulary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, hashing.Words]:
    """The texts as numbers of distinct words: (first word of each text, number of each word's distinct word, the distinct words).

    Texts are hashed a few megabytes at a time; only distinct words are kept.
    """
    seen: dict[int, int] = {}
    numbers, counts, blobs, sizes, hashes = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for _, _, words in hashing.chunks(texts, SEPARATOR):
        distinct, at, own = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = np.array([k for k, h in enumerate(keys) if h not in seen], np.int64)
        base = len(seen)
        seen.update((keys[k], base + i) for i, k in enumerate(new.tolist()))
        data, size = spans(words, at[new])
        blobs.append(data)
        sizes.append(size)
        hashes.append(distinct[new])
        numbers.append(np.array([seen[h] for h in keys], np.int32)[own])
        counts.append(words.counts())
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    ends = np.cumsum(np.concatenate(sizes))
    return first, np.concatenate(numbers), hashing.Words(np.concatenate(blobs), np.concatenate(hashes), ends - np.concatenate(sizes), ends, np.array([0, len(ends)]))


def spans(words: hashing.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the chosen words one after another, number of bytes of each)."""
    starts, sizes = words.starts[which], words.ends[which] - words.starts[which]
    return words.data[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)], sizes


def misspelt(words: hashing.Words, which: np.ndarray, rng: np.random.Generator) -> hashing.Words:
    """The chosen words (of four bytes or more), each with two neighbours exchanged, one byte left out or one doubled; the first stays."""
    data, sizes = spans(words, which)
    kind = rng.integers(0, 3, len(which))  # 0: exchange, 1: leave out, 2: double
    place = 1 + rng.integers(0, sizes - 2)
    new = sizes + (kind == 2) - (kind == 1)
    owner = np.repeat(np.arange(len(which)), new)
    cuts = np.concatenate([[0], np.cumsum(new)])
    k = np.arange(cuts[-1]) - cuts[owner]
    at, how = place[owner], kind[owner]
    source = k + ((how == 1) & (k >= at)) - ((how == 2) & (k > at)) + ((how == 0) & (k == at)) - ((how == 0) & (k == at + 1))
    data = data[(np.cumsum(sizes) - sizes)[owner] + source]
    return hashing.Words(data, hashing.hash_spans(data, cuts[:-1], cuts[1:]), cuts[:-1], cuts[1:], np.array([0, len(which)]))


def train(
    texts: pa.Array, labels: np.ndarray, rounds: int = 60, bag_rounds: int = 1, refresh: int = 3, rate: float = 0.3, dropout: float = 0.5, edits: float = 0.3, seed: int = 5
) -> Model:
    """Fit embeddings and softmax on the texts; labels are 0 or 1.  Without both classes the bias alone is fitted.

    In the window rounds each feature of a word is left out with probability `dropout`: no single n-gram may
    carry a word, so a misspelling that keeps most of them is still recognised; and words are misspelt with
    probability `edits`.  Windows are chosen anew every `refresh` rounds.
    """
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    first, inverse, words = vocabulary(texts)
    first, labels = np.append(first, first[-1]), np.append(labels, 0)  # the document without words
    n_distinct = len(words.hashes)
    parts = [features(words, np.arange(lo, min(lo + 16384, n_distinct))) for lo in range(0, n_distinct, 16384)]
    buckets = np.concatenate([np.empty(0, np.int32), *(b for b, _ in parts)])
    cuts = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(np.diff(c) for _, c in parts)]))])
    del parts
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    head = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full(x.shape, 1e-8, np.float32) for x in (table, head, bias)]
    n_words = np.diff(first)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    onehot = np.stack([1 - labels, labels], 1)

    def slopes(docs: slice, begin: np.ndarray, size: np.ndarray, keep: float, edit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of table, head and bias from one stretch of words of each of these texts."""
        doc = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        share = (1 / np.maximum(size, 1))[doc]
        changed = np.flatnonzero((rng.random(len(at)) < edit) & ((words.ends - words.starts)[inverse[at]] >= 4)) if edit else np.empty(0, np.int64)
        which, own = np.unique(inverse[at], return_inverse=True)
        n = cuts[which + 1] - cuts[which]
        feature = buckets[np.arange(n.sum()) + np.repeat(cuts[which] - (np.cumsum(n) - n), n)]
        if len(changed):
            extra, extra_cuts = features(misspelt(words, inverse[at[changed]], rng), np.arange(len(changed)))
            own[changed] = len(which) + np.arange(len(changed))
            feature, n = np.concatenate([feature, extra]), np.concatenate([n, np.diff(extra_cuts)])
        owner = np.repeat(np.arange(len(n)), n)
        if keep < 1:
            chosen = rng.random(len(feature)) < keep
            owner, feature = owner[chosen], feature[chosen]
        count = np.maximum(np.bincount(owner, minlength=len(n)), 1)
        vectors = np.stack([np.bincount(owner, table[feature, d], len(n)) for d in range(DIMENSIONS)], 1) / count[:, None]
        bag = np.stack([np.bincount(doc, vectors[own, d] * share, len(size)) for d in range(DIMENSIONS)], 1)
        logits = bag @ head + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        error = (odds / odds.sum(1, keepdims=True) - onehot[docs]) * weight[docs, None]
        of_bag = error @ head.T
        of_word = np.stack([np.bincount(own, of_bag[doc, d] * share, len(n)) for d in range(DIMENSIONS)], 1) / count[:, None]
        return np.stack([np.bincount(feature, of_word[owner, d], BUCKETS) for d in range(DIMENSIONS)], 1), bag.T @ error, error.sum(0)

    def step(begin: np.ndarray, size: np.ndarray, keep: float, edit: float) -> None:
        """One gradient step on one stretch of words of each text, a part of the texts at a time."""
        total: list[np.ndarray] = []
        upto, lo = np.concatenate([[0], np.cumsum(size)]), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP_WORDS, "right")) - 1)
            part = slopes(slice(lo, hi), begin[lo:hi], size[lo:hi], keep, edit)
            total = [a + b for a, b in zip(total, part, strict=True)] if total else list(part)
            lo = hi
        for value, grad, kept in zip((table, head, bias), total, squares, strict=True):
            kept += grad * grad
            value -= (rate * grad / np.sqrt(kept)).astype(np.float32)

    for turn in range(rounds):
        if turn < bag_rounds:
            step(first[:-1], n_words, 1.0, 0.0)
            continue
        if (turn - bag_rounds) % refresh == 0:
            effect = (table @ (head[:, 1] - head[:, 0]))[buckets]
            means = np.add.reduceat(effect, cuts[:-1]) / np.diff(cuts) if n_distinct else np.empty(0)
            begin = best_starts(means[inverse], first)
        step(begin, np.minimum(n_words, WINDOW), 1 - dropout, edits)
    return Model(table @ (head[:, 1] - head[:, 0]), float(bias[1] - bias[0]))


def held_out_column() -> Column:
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Learn from labelled documents, at most sample[c] of class c, that aren't held out.  Only texts and labels.toxic are used.

    Rows without doc_id, text or label are passed over.  Rows that share a doc_id count once, with the least of their
    texts; a doc_id with both labels counts in both classes.  Texts are taken whole, in the order of a hash of doc_id, up to
    SAMPLE_BYTES of each class; those over LONG_BYTES come after all others, so that one of them can't take the place of the rest.  If a class has
    texts and none of them fits, that is an error.
    """
    free = labels.where("doc_id is not null and toxic is not null").where(~held_out_column()).select("doc_id", F.col("toxic").alias("y")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for c, n in sorted(sample.items()):
        part = free.where(F.col("y") == c).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    within = Window.partitionBy("y").orderBy(F.octet_length("text") > LONG_BYTES, *order)  # over the sample alone
    placed = once.withColumn("upto", F.sum(F.octet_length("text")).over(within)).withColumn("place", F.row_number().over(within))
    fits = F.col("upto") <= SAMPLE_BYTES
    # Of a class whose first text doesn't fit, only its length comes to the driver.
    rows = placed.where(fits | (F.col("place") == 1)).select("doc_id", "y", F.when(fits, F.col("text")).alias("text")).toArrow()
    if rows.column("text").null_count:
        raise ValueError(f"no text of some class is within {SAMPLE_BYTES} bytes")
    rows = rows.take(pa.array(np.lexsort([rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()])))
    return train(rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted; one row for each row of docs.

    The whole text counts.  Null and empty texts and texts without words get the score of the bias.  A null doc_id
    isn't held out.  Other columns are ignored, but for those (bigint) that `more` asks to keep.  No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(batch.columns[-1]), pa.float64())], [*batch.schema.names[:-1], "score"])

    rows = docs.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), *more, F.lower("text").alias("text"))
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that aren't predicted toxic.

    A row goes for its own text: rows without doc_id and rows that share one are judged apart.
    """
    model = fit(docs, labels)
    of_text = F.xxhash64("text")
    bad = score(docs, model, of_text.alias("_of_text")).where("predicted = 1").select(F.col("doc_id").alias("_bad"), "_of_text").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (of_text == bad["_of_text"]), "left_anti")
