"""Text as columns: canonical forms, tokens, sentences, chunk windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^ \t\n\r\f\x0B]+"
TOKEN = r"[\p{L}\p{N}_\-]+"


def canonical(x: Column) -> Column:
    """Trimmed, lower case, yo folded, white space collapsed."""
    return F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("ё"), F.lit("е")), r"\s+", " ")


def compact(x: Column) -> Column:
    return F.regexp_replace(canonical(x), r"[\s_-]", "")


def loose(x: Column) -> Column:
    return F.regexp_replace(canonical(x), "_", " ")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(x: Column) -> Column:
    """Runs outside ASCII white space."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(WORD), F.lit(0))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it within lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trie(words: Iterable[str]) -> str:
    """A pattern of all words, which takes the longest that stands at a place: words that begin alike share their beginning, and places where none begins are left early."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def escaped(ch: str) -> str:
        return ch if ch.isalnum() or ch in " _%<>=" else "\\" + ch

    def any_child(children: list[tuple[str, dict]]) -> str:
        if len(children) <= 6:
            return "|".join(escaped(ch) + after(n) for ch, n in children)
        # Groups by range, so that a character is compared with a few of the others.
        step = max(6, round(len(children) ** 0.5))
        groups = [children[i : i + step] for i in range(0, len(children), step)]
        return "|".join(f"(?=[{escaped(g[0][0])}-{escaped(g[-1][0])}])(?:{any_child(g) if len(g) < len(children) else g})" for g in groups)

    def after(node: dict) -> str:
        children = sorted((ch, n) for ch, n in node.items() if ch)
        if not children:
            return ""
        if len(children) == 1 and "" not in node:
            return escaped(children[0][0]) + after(children[0][1])
        return f"(?:{any_child(children)})" + ("?" if "" in node else "")

    return after(root)


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words, as they are written."""
    return text.rlike(trie(words))


def window_spans(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """array of (start: first word, n_words, char_start, char_end): the windows of window_starts() and where they stand in the text.

    Lengths of words and of the gaps before them are added up by steps of windows first, so a text costs its words and the square of
    its windows, not windows times words.
    """
    size = max(50, size)
    step = size - min(overlap, size // 2)
    text = F.coalesce(text, F.lit(""))
    # One pair for each word; what follows the last word has none.
    pairs = F.filter(F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word")), lambda p: p["word"].isNotNull())
    lengths = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), (F.length(p["gap"]) + F.length(p["word"])).alias("both")))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x["both"])

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = window_starts(n, size, overlap)
        sums = F.transform(starts, lambda s: total(F.slice(w, s + 1, step)))
        return let(
            sums,
            lambda b: F.transform(
                starts,
                lambda s, i: F.struct(
                    s.alias("start"),
                    F.least(F.lit(size), n - s).alias("n_words"),
                    (F.aggregate(F.slice(b, 1, i), F.lit(0), lambda t, x: t + x) + F.get(w, s)["gap"]).alias("char_start"),
                    (F.aggregate(F.slice(b, 1, i), F.lit(0), lambda t, x: t + x) + total(F.slice(w, s + 1, size))).alias("char_end"),
                ),
            ),
        )

    return let(lengths, windows)


def window_starts(n: Column, size: int = 400, overlap: int = 50) -> Column:
    """First words of the chunk windows of a text with n words: one if it fits, else every step while words are left."""
    size = max(50, size)
    step = size - min(overlap, size // 2)
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[.!?;\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
