"""Tables as snapshots: what a commit adds is written first and becomes visible by one rename of a manifest.

A store is a folder.  Data files stand in folders of their own that never change; the manifest of a version lists, for each table, its folders.
A commit writes only what is new: a row is dead once its name stands in `removed` with a later commit, so replacing one document of a
thousand million writes one document and one name.  A run that ends between data and manifest leaves the version before as it was, and
folders that vacuum() takes away.  Two commits on one version can't both succeed: the second finds its manifest there and fails.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.text import window_spans
from factloom.registry import query
from factloom.sources.tables import load

MANIFESTS, DATA = "_manifests", "data"
#: Folders of a table from which compact() is due.
MANY = 64


class Conflict(RuntimeError):
    """Another commit was faster."""


class Store:
    """Named tables of a folder, by version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(MANIFESTS)
        if not self._fs().exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs().listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """{table: {"folders": [...], "schema": ...}} of a version, the last one by default; nothing before the first commit."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/{MANIFESTS}/{version:08d}.json", wholetext=True).first()[0])

    def latest(self) -> int:
        return (self.versions() or [0])[-1]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All rows ever committed to a table up to a version."""
        entry = self.manifest(version)[table]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*(f"{self.root}/{f}" for f in entry["folders"]))

    def live(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table with columns name and commit that no later commit has removed."""
        rows = self.read(table, version)
        gone = self.read("removed", version).groupBy("name").agg(F.max("commit").alias("gone"))
        return rows.join(gone, "name", "left").where("gone IS NULL OR commit >= gone").drop("gone").select(*rows.columns)

    def write(self, df: DataFrame, *partition_by: str) -> tuple[str, StructType]:
        """Rows that no version lists yet."""
        folder = f"{DATA}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return folder, df.schema

    def commit(self, base: int, added: dict[str, tuple[str, StructType]], replace: bool = False) -> int:
        """The version after `base`, with folders added to tables, or in the place of those the tables had."""
        tables = self.manifest(base)
        for name, (folder, schema) in added.items():
            before = [] if replace or name not in tables else tables[name]["folders"]
            tables[name] = {"folders": [*before, folder], "schema": schema.jsonValue()}
        final, draft = self._path(MANIFESTS, f"{base + 1:08d}.json"), self._path(MANIFESTS, f".{uuid.uuid4().hex}")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)  # fails where the version is there
        except Exception as error:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {base + 1} of {self.root} is there") from error
            raise
        return base + 1

    def compact(self, tables: list[str]) -> int:
        """Live rows in one folder for each table.  Rows keep their commits, so names in `removed` mean what they meant; versions of contents that aren't live are forgotten."""
        base = self.latest()
        return self.commit(base, {t: self.write(self.live(t, base)) for t in tables}, replace=True)

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the last ones, and folders that none of those lists; run it while nobody commits.  Returns how many folders went."""
        kept = self.versions()[-keep:]
        for version in set(self.versions()) - set(kept):
            self._fs().delete(self._path(MANIFESTS, f"{version:08d}.json"), False)
        used = {f for v in kept for entry in self.manifest(v).values() for f in entry["folders"]}
        left = [f.getPath().getName() for f in self._fs().listStatus(self._path(DATA))] if self._fs().exists(self._path(DATA)) else []
        gone = [f for f in left if f"{DATA}/{f}" not in used]
        for folder in gone:
            self._fs().delete(self._path(DATA, folder), True)
        return len(gone)


def new_store(spark: SparkSession) -> Store:
    """An empty store in the cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return Store(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")


DOCUMENTS = "name string, doc_id string, content_hash string, version bigint, n_chunks bigint, commit bigint"
CHUNKS = "name string, doc_id string, ordinal bigint, char_start bigint, char_end bigint, token_count bigint, text_hash string, text string, commit bigint"
REMOVED = "name string, commit bigint"
DELTAS = "name string, status string, version bigint, chunks_added bigint, chunks_removed bigint, commit bigint"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "removed": REMOVED, "deltas": DELTAS}


def create(store: Store) -> int:
    """The store's tables, without rows."""
    empty = lambda schema: store.spark.createDataFrame([], schema)
    return store.commit(0, {name: store.write(empty(schema)) for name, schema in TABLES.items()})


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_rows(documents: DataFrame) -> DataFrame:
    """documents (name, doc_id, text, commit) -> CHUNKS: the windows of words, as they stand in the text."""
    rows = documents.select("name", "doc_id", "text", "commit", F.posexplode(window_spans(F.col("text"))).alias("ordinal", "w"))
    part = F.substring(F.col("text"), F.col("w.char_start") + 1, F.col("w.char_end") - F.col("w.char_start"))
    out = rows.select(
        "name", "doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("w.char_start").cast("bigint").alias("char_start"), F.col("w.char_end").cast("bigint").alias("char_end"),
        F.col("w.n_words").cast("bigint").alias("token_count"), _hash(part).alias("text_hash"), part.alias("text"), "commit",
    )
    return out


def ingest(store: Store, files: DataFrame, complete: bool = False) -> int:
    """files (name, text) -> a version in which they are the live content of their names.

    A name whose content is known is left as it is (`unchanged`); other content replaces it and its chunks (`changed`); names met
    for the first time are `new`; names without text are `skipped_empty` and keep what they have.  With complete=True the files are all there is, so
    other live names are `removed`.  Content that its name had before gets its old version back, other content the highest version plus one.
    Rows with a null name are dropped; of several contents of one name the greatest hash counts.  The delta of the commit is a table: one row for each
    name that came or went, with the chunks that did.  Only texts of new and changed names are cut into chunks.
    """
    base = store.latest()
    number = F.lit(base + 1).cast("bigint")
    text = F.coalesce(F.col("text"), F.lit(""))
    incoming = files.where("name IS NOT NULL").groupBy("name").agg(F.max(F.struct(_hash(text).alias("h"), text.alias("text"))).alias("i")).select("name", F.col("i.h").alias("h"), "i.text")
    history = store.read("documents", base)
    live = store.live("documents", base).select("name", F.col("content_hash").alias("old_hash"), F.col("version").alias("old_version"), F.col("n_chunks").alias("old_chunks"))
    known = history.groupBy("name", F.col("content_hash").alias("h")).agg(F.min("version").alias("known_version"))
    highest = history.groupBy("name").agg(F.max("version").alias("highest"))
    joined = incoming.join(live, "name", "full").join(known, ["name", "h"], "left").join(highest, "name", "left")
    status = (
        F.when(F.col("h").isNull(), "removed" if complete else "kept")
        .when(F.col("text") == "", "skipped_empty")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") == F.col("h"), "unchanged")
        .otherwise("changed")
    )
    comes = F.col("status").isin("new", "changed")
    version = F.coalesce("known_version", F.coalesce("highest", F.lit(0)) + 1)
    plan_folder, plan_schema = store.write(
        joined.withColumn("status", status).where("status <> 'kept'")
        .withColumn("version", F.when(comes, version).otherwise(F.col("old_version")))
        .withColumn("n_chunks", F.when(comes, F.size(window_spans(F.col("text")))).otherwise(0).cast("bigint"))
        .select("name", "status", "h", F.when(comes, F.col("text")).alias("text"), "version", "n_chunks", F.when(F.col("status").isin("changed", "removed"), F.col("old_chunks")).otherwise(0).cast("bigint").alias("chunks_removed"))
    )
    plan = store.spark.read.schema(plan_schema).parquet(f"{store.root}/{plan_folder}")
    fresh = plan.where("status IN ('new', 'changed')").select("name", F.concat(F.lit("doc_"), F.substring("h", 1, 24)).alias("doc_id"), F.col("h").alias("content_hash"), "text", "version", "n_chunks", number.alias("commit"))
    return store.commit(
        base,
        {
            "documents": store.write(fresh.drop("text")),
            "chunks": store.write(chunk_rows(fresh)),
            "removed": store.write(plan.where("status IN ('changed', 'removed')").select("name", number.alias("commit"))),
            "deltas": store.write(plan.select("name", "status", "version", F.col("n_chunks").alias("chunks_added"), "chunks_removed", number.alias("commit"))),
        },
    )


def recompute(store: Store, table: str, rows: DataFrame, key: list[str], rule: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Results of `work` for all rows, computed only for those whose signature isn't stored: the key's values and the rule's version.

    work(rows) keeps the columns of the key and adds its own.  Results are stored under `table` with column rule; a table that isn't there yet is made.
    """
    base = store.latest()
    stored = store.manifest(base)
    todo = rows
    if table in stored:
        todo = rows.join(store.read(table, base).where(F.col("rule") == rule).select(*key).distinct(), key, "left_anti")
    return store.commit(base, {table: store.write(work(todo).withColumn("rule", F.lit(rule)).withColumn("commit", F.lit(base + 1).cast("bigint")))})


# ---- queries: the documents come twice, as a catalog would meet them


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text")


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts have an errata line, texts of src3 are gone, pages are new."""
    docs = load(spark, sf_dir, "documents").where("coalesce(source, '') <> 'src3'")
    text = F.when(F.col("lang") == "en", F.concat(F.coalesce("text", F.lit("")), F.lit("\nErrata: none so far."))).otherwise(F.col("text"))
    again = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), text.alias("text"))
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("text"))
    return again.unionByName(pages)


def twice(spark: SparkSession, sf_dir: str) -> Store:
    """A store with two complete ingests of the tables."""
    store = new_store(spark)
    create(store)
    ingest(store, _first(spark, sf_dir), complete=True)
    ingest(store, _second(spark, sf_dir), complete=True)
    return store


def _n_chunks(t: str) -> str:
    n = rf"len(regexp_extract_all({t}, '[^ \t\n\r\f\x0B]+'))"
    return f"(CASE WHEN {n} = 0 THEN 0 WHEN {n} <= 400 THEN 1 ELSE len(range(0, {n}, 350)) END)::BIGINT"


_TWICE_SQL = f"""a AS (SELECT 'doc-' || doc_id AS name, coalesce(text, '') AS t FROM documents),
    b AS (SELECT 'doc-' || doc_id AS name, coalesce(text, '') || CASE WHEN lang = 'en' THEN chr(10) || 'Errata: none so far.' ELSE '' END AS t FROM documents WHERE coalesce(source, '') <> 'src3'
          UNION ALL SELECT 'page-' || page_id, coalesce(html, '') FROM pages),
    j AS (SELECT coalesce(b.name, a.name) AS name, nullif(a.t, '') AS old, b.t AS new, CASE WHEN b.name IS NULL THEN CASE WHEN a.t <> '' THEN 'removed' END WHEN b.t = '' THEN 'skipped_empty'
          WHEN nullif(a.t, '') IS NULL THEN 'new' WHEN a.t = b.t THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.name = b.name)"""


@query(
    f"""WITH {_TWICE_SQL} SELECT name, CASE WHEN t = '' THEN 'skipped_empty' ELSE 'new' END AS status, CASE WHEN t <> '' THEN 1 END::BIGINT AS version, {_n_chunks('t')} AS chunks_added, 0::BIGINT AS chunks_removed, 2::BIGINT AS "commit" FROM a
    UNION ALL SELECT name, status, CASE WHEN status = 'changed' THEN 2 WHEN status <> 'skipped_empty' OR old IS NOT NULL THEN 1 END::BIGINT, CASE WHEN status IN ('new', 'changed') THEN {_n_chunks('new')} ELSE 0 END::BIGINT,
    CASE WHEN status IN ('changed', 'removed') THEN {_n_chunks('old')} ELSE 0 END::BIGINT, 3::BIGINT FROM j WHERE status IS NOT NULL"""
)
def a10_ingest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two ingests did to every name: status, version, chunks that came and went."""
    return twice(spark, sf_dir).read("deltas")


@query(
    f"""WITH {_TWICE_SQL}, f AS (SELECT name, coalesce(CASE WHEN new <> '' THEN new END, old) AS t, CASE status WHEN 'changed' THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN status IN ('new', 'changed') THEN 3 ELSE 2 END::BIGINT AS "commit" FROM j WHERE status <> 'removed' AND (new <> '' OR old IS NOT NULL))
    SELECT name, 'doc_' || substr(sha256(t), 1, 24) AS doc_id, version, "commit", {_n_chunks('t')} AS n_chunks, coalesce((SELECT count(*) FROM f AS x WHERE x.name = f.name), 0)::BIGINT AS n_live FROM f"""
)
def a10_live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is live after both: one document a name, with as many chunks as are live."""
    store = twice(spark, sf_dir)
    chunks = store.live("chunks").groupBy("name").agg(F.count(F.lit(1)).alias("n_chunks"))
    docs = store.live("documents").drop("n_chunks")
    n = docs.groupBy("name").agg(F.count(F.lit(1)).alias("n_live"))
    return docs.join(chunks, "name", "left").join(n, "name").select("name", "doc_id", "version", "commit", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "n_live")


#: What is extracted from chunks: a rule's version, and the numbers that stand in a text.
RULE = "numbers-1"
NUMBERS = r"[0-9]+(?:[.,][0-9]+)?"


def _numbers(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "text_hash", F.regexp_count("text", F.lit(NUMBERS)).cast("bigint").alias("n_numbers"))


def _signed(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat_ws("#", "name", F.col("ordinal").cast("string")).alias("chunk_id"), "text_hash", "text")


@query(
    rf"""WITH {_TWICE_SQL}, s AS (SELECT 2::BIGINT AS c, name, t FROM a UNION ALL SELECT 3, name, CASE WHEN new <> '' THEN new ELSE old END FROM j WHERE status <> 'removed'),
    w AS (SELECT c, name, t, regexp_extract_all(t, '[^ \t\n\r\f\x0B]+') AS w, string_split_regex(t, '[^ \t\n\r\f\x0B]+') AS g FROM s WHERE t <> ''),
    e AS (SELECT c, name, unnest(w) AS w, unnest(g[: len(w)]) AS g, generate_subscripts(w, 1) AS i FROM w),
    u AS (SELECT c, name, i, sum(length(g) + length(w)) OVER (PARTITION BY c, name ORDER BY i) AS upto, length(w) AS n FROM e),
    k AS (SELECT c, name, t, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 400 THEN [0] ELSE range(0, len(w), 350) END) AS s0 FROM w),
    h AS (SELECT k.c, k.name || '#' || (s0 // 350) AS chunk_id, t[x.upto - x.n + 1 : y.upto] AS part FROM k JOIN u x ON x.c = k.c AND x.name = k.name AND x.i = s0 + 1 JOIN u y ON y.c = k.c AND y.name = k.name AND y.i = least(k.n, s0 + 400))
    SELECT chunk_id, sha256(part) AS text_hash, len(regexp_extract_all(part, '{NUMBERS}'))::BIGINT AS n_numbers, (min(c) = 3) AS computed_late FROM h GROUP BY chunk_id, part"""
)
def i15_extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction after either ingest, the second time only of chunks whose (chunk, hash) isn't stored; one row for each result."""
    store = new_store(spark)
    create(store)
    for files in (_first(spark, sf_dir), _second(spark, sf_dir)):
        ingest(store, files, complete=True)
        late = recompute(store, "numbers", _signed(store.live("chunks")), ["chunk_id", "text_hash"], RULE, _numbers)
    return store.read("numbers").select("chunk_id", "text_hash", "n_numbers", (F.col("commit") == late).alias("computed_late"))
