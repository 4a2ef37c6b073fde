"""Secrets in texts, weighed by how many owners and repositories hold them.

Patterns give candidates.  A candidate's value is hashed, and the hashes are counted over the whole corpus by
distinct owner and repository.  A value that SHARED owners hold is an example that was copied about (`copied`); one that few owners
hold and that looks drawn at random is `live`; the rest, words and placeholders, is `plain`.  The count also finds what no pattern of
a context does: a run of characters that stands alone in one document and as a marked secret in another is a span of kind `known`.

A text is read once.  Of a match only its length, the gap before it and the hash of its value leave the text, so what is shuffled is
some 60 bytes a match.  Places are running sums of gaps and lengths within a document.  Counts are taken by (value, owner, repository), then
by (value, owner), then by value, each combined before its shuffle, so a value that a third of all rows hold is no hot key; verdicts come back
by a plain equi-join, which AQE splits.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import scratch, stage

#: Distinct owners from which a value counts as copied about.
SHARED = 3
#: Distinct characters that a value must have to look drawn at random.
VARIED = 6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int = 0  # of the value
    least: int = 1  # characters of the value; shorter matches are dropped


def _any_case(word: str) -> str:
    """A pattern of the letters in either case; engines differ in what a flag for it folds."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_VALUE = r"[A-Za-z0-9+/_.=-]+"
_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The kinds that are always reported.  A maximal run of enough characters is what a run with a check of its length finds.
BASE = (
    Kind("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?({_VALUE})""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds with a context of their own.
MORE = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Kind("url", r"://[A-Za-z0-9._~%-]+:([A-Za-z0-9._~%!$&*+=-]+)@", 1, 4),
)
#: Runs that may be secrets by their form or because they are marked elsewhere.
RUN = Kind("run", r"[A-Za-z0-9+/_.=-]{16,}")
# Public forms of issued tokens.
FORMS = {
    "jwt": r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$",
    "github": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "slack": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "google": r"^AIza[A-Za-z0-9_-]{35}$",
}
# Parts of values that stand for a secret without being one.
PLACEHOLDER = "example|changeme|change_me|placeholder|your[_-]|dummy|sample|xxxx|1234567"
KNOWN = "known"
#: Every kind in the order of a tie.
NAMES = [*(k.name for k in BASE + MORE), *FORMS, KNOWN]

_FOUND = "array<struct<kind:int,pos:int,gap:int,len:int,value:string,varied:boolean>>"


def _looks_random(value: Column) -> Column:
    """Letters with digits, enough distinct characters, and no placeholder's words."""
    varied = F.size(F.array_distinct(F.split(F.substring(value, 1, 256), ""))) >= VARIED
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~F.lower(value).rlike(PLACEHOLDER)


def _kind_of_run(value: Column) -> Column:
    """The number of a run's form; that of `known` if it has none."""
    kind = F.lit(NAMES.index(KNOWN))
    for name, form in FORMS.items():
        kind = F.when(value.rlike(form), F.lit(NAMES.index(name))).otherwise(kind)
    return kind


def _matches(text: Column, kind: Kind) -> Column:
    """Every match of a pattern: its number, the characters since the match before it, its length, its value's hash.

    Splitting at the pattern gives the gaps.  Matches that fail are kept with the kind null, as later places count them.
    """
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    # Zipped, so that each list is made once for a text and not once for each of its matches; the text after the last match is a gap of its own.
    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("whole"), values.alias("value"))

    def one(m: Column, i: Column) -> Column:
        value = m["value"]
        of = _kind_of_run(value) if kind is RUN else F.lit(NAMES.index(kind.name))
        keep = value.rlike("[0-9]") & value.rlike("[A-Za-z]") if kind is RUN else F.length(value) >= kind.least
        return F.struct(
            F.when(keep, of).alias("kind"), i.alias("pos"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("len"), F.md5(value).alias("value"), _looks_random(value).alias("varied")
        )

    return F.when(text.rlike(kind.pattern), F.transform(zipped, one)).otherwise(F.array().cast(_FOUND))


def _placed(found: DataFrame) -> DataFrame:
    """found (uid, owner, repository, p0, p1, ...: matches of each pattern) -> one row for each match that holds: start, end, kind, value, varied."""
    lists = [c for c in found.columns if c[0] == "p" and c[1:].isdigit()]
    fields = ("kind", "pos", "gap", "len", "value", "varied")

    def tag(k: int, c: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(k).alias("pattern"), *(x[f] for f in fields)))

    tagged = F.flatten(F.array(*(tag(k, c) for k, c in enumerate(lists))))
    each = found.select("uid", "owner", "repository", F.explode(tagged).alias("m")).select("uid", "owner", "repository", "m.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("uid", "pattern").orderBy("pos"))
    return each.withColumn("end", upto).where("kind is not null").select("uid", "owner", "repository", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value", "varied")


def _frequencies(spans: DataFrame) -> DataFrame:
    """spans -> value, n_owners, n_repositories, verdict, for values that some pattern of a context marks."""
    marked = F.max(F.col("kind") != NAMES.index(KNOWN))
    held = spans.groupBy("value", "owner", "repository").agg(marked.alias("marked"), F.max("varied").alias("varied"))
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max("marked").alias("marked"), F.max("varied").alias("varied"))
    values = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("marked").alias("marked"), F.max("varied").alias("varied"))
    verdict = F.when(F.col("n_owners") >= SHARED, "copied").when(F.col("varied"), "live").otherwise("plain")
    return values.where("marked").select("value", "n_owners", "n_repositories", verdict.alias("verdict"))


def find_spans(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, columns of owner and repository) -> (rows, spans).

    rows: uid, doc_id, one for each row of docs.  spans: uid, kind, start, end (code points, end exclusive), verdict,
    n_owners, n_repositories.  A null owner is an owner like any other.  Null and empty texts have no spans.  Texts are searched whole; rows that
    share a doc_id are searched apart.  Other columns are ignored.  A run that lies within a span of another kind isn't reported again.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [*BASE, *MORE, RUN]
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in repository))
    with scratch(spark) as keep:
        found = stage(
            docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col(owner).cast("string").alias("owner"), F.md5(key).alias("repository"), *(_matches(text, k).alias(f"p{i}") for i, k in enumerate(kinds))),
            "matches",
        )
        placed = stage(_placed(found), "placed")
        judged = placed.join(_frequencies(placed), "value")
        known = F.col("kind") == NAMES.index(KNOWN)
        before = Window.partitionBy("uid").orderBy("start", known, F.desc("end"))
        covered = F.max(F.when(~known, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
        spans = judged.withColumn("covered", covered).where(~known | F.col("covered").isNull() | (F.col("covered") < F.col("end")))
        return keep(found.select("uid", "doc_id")), keep(stage(spans.select("uid", "kind", "start", "end", "verdict", "n_owners", "n_repositories"), "spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each, in the order of the array."""
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each row of docs: doc_id, counts and digest of the base spans, all spans, and how many are live or copied.

    spans: kind:start:end by start and then by kind.  live, copied: numbers of spans with that verdict.  least_owners: the fewest
    owners of any span's value, null without spans.  Texts without spans give zeros and the digest of an empty text.  See find_spans().
    """
    rows, spans = find_spans(docs, owner, repository)
    per_row = spans.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("all"),  # the spans of one document
        F.min("n_owners").alias("least_owners"),
    )
    of = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("bigint")
    are = lambda v: F.size(F.filter("all", lambda s: s["verdict"] == v)).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")
    return (
        rows.join(per_row, "uid", "left")
        .withColumn("all", F.coalesce("all", none))
        .select(
            "doc_id",
            *(of(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)),
            F.sha2(_listed(F.filter("all", lambda s: s["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
            _listed(F.col("all")).alias("spans"),
            are("live").alias("n_live"),
            are("copied").alias("n_copied"),
            "least_owners",
        )
    )


def remove_live(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), mark: str = "[secret]") -> DataFrame:
    """The rows of docs, with their columns; each live span of the text is replaced by a mark, overlapping ones by one mark.

    Rows keep their order of columns; null texts stay null.  Rows that share a doc_id are cleaned apart.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        held = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        rows, spans = find_spans(held.select(F.col("_row").alias("doc_id"), "text", *dict.fromkeys((owner, *repository))), owner, repository)
        live = spans.where("verdict = 'live'").join(rows, "uid").select(F.col("doc_id").alias("_row"), "start", "end")
        order = Window.partitionBy("_row").orderBy("start", F.desc("end"))
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = live.withColumn("_reach", F.coalesce(reach, F.lit(0))).where(F.col("end") > F.col("_reach"))
        cuts = apart.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "_reach"))).alias("_cuts"))
        at = lambda i: F.get("_cuts", i)
        part = lambda c, i: F.substring(F.col("text"), F.when(i > 0, at(i - 1)["end"]).otherwise(0).cast("int") + 1, F.greatest(c["start"] - F.when(i > 0, at(i - 1)["end"]).otherwise(0), F.lit(0)).cast("int"))
        joined = F.transform("_cuts", lambda c, i: F.concat(part(c, i), F.when(c["start"] >= c["_reach"], mark).otherwise("")))
        rest = F.expr("substring(text, cast(element_at(_cuts, -1).end AS int) + 1)")
        text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(joined, ""), rest))
        return keep(stage(held.join(cuts, "_row", "left").withColumn("text", text).select(*docs.columns), "cleaned"))
