"""Catalog, outbox and cache tables as batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.registry import query
from factloom.sources.tables import CATALOG_SQL, catalog, load


@query(f"WITH {CATALOG_SQL} SELECT doc_id, ordinal, token_count FROM chunks JOIN docs USING (doc_id) WHERE coalesce(active, TRUE)")
def a16_active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of active documents (F12: a missing flag is active)."""
    docs, chunks = catalog(spark, sf_dir)
    return chunks.join(docs.where(F.coalesce("active", F.lit(True))), "doc_id", "left_semi")


@query(f"WITH {CATALOG_SQL} SELECT doc_id, title, updated_at, count(ordinal) AS n_chunks FROM docs LEFT JOIN chunks USING (doc_id) GROUP BY ALL")
def a17_documents_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = catalog(spark, sf_dir)
    counts = chunks.groupBy("doc_id").agg(F.count("ordinal").alias("n"))  # before the join: one row for each document
    return docs.join(counts, "doc_id", "left").select("doc_id", "title", "updated_at", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks"))


@query(
    f"""WITH {CATALOG_SQL} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM docs WHERE coalesce(active, TRUE)) AS active_documents,
    (SELECT count(*) FROM chunks JOIN docs USING (doc_id) WHERE coalesce(active, TRUE)) AS active_chunks"""
)
def a18_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = catalog(spark, sf_dir)
    counts = chunks.groupBy("doc_id").agg(F.count("ordinal").alias("n"))
    active = F.coalesce("active", F.lit(True))
    return docs.join(counts, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count_if(active).alias("active_documents"),
        F.coalesce(F.sum(F.when(active, F.col("n"))), F.lit(0)).alias("active_chunks"),
    )


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n_versions FROM events GROUP BY user_id")
def b1_document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after upserting every event under its user: the last wins.  Partial maxima are taken before the shuffle."""
    rows = load(spark, sf_dir, "events")
    state = F.struct("ts", "event_id", "event_type", "value")
    best = rows.groupBy("user_id").agg(F.max(state).alias("s"), F.count(F.lit(1)).alias("n_versions"))
    return best.select("user_id", "s.event_type", "s.event_id", "s.value", "n_versions")


@query(
    """WITH new AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ordinal, l_quantity * 2 AS token_count FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber <= 2),
    old AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ordinal, l_quantity AS token_count FROM lineitem)
    SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new"""
)
def b2_chunk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the re-ingested documents are replaced: every seventh order comes again with two doubled chunks."""
    _, chunks = catalog(spark, sf_dir)
    new = chunks.where("doc_id % 7 = 0 AND ordinal <= 2").withColumn("token_count", F.col("token_count") * 2)
    return replace_chunks(chunks, new)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


@query(
    f"""WITH {CATALOG_SQL}, c AS (SELECT c_custkey AS doc_id, c_acctbal > 0 AS new_active FROM customer)
    SELECT doc_id, coalesce(new_active, active) AS active, new_active IS NOT NULL AS updated FROM docs LEFT JOIN c USING (doc_id)"""
)
def b3_active_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = catalog(spark, sf_dir)
    changes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") > 0).alias("new_active"))
    return docs.join(changes, "doc_id", "left").select("doc_id", F.coalesce("new_active", "active").alias("active"), F.col("new_active").isNotNull().alias("updated"))


@query(
    """SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, max_by(props, (ts, event_id)) AS payload, 'pending' AS status, count(*) AS version
    FROM events GROUP BY user_id, event_type"""
)
def b4_outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each dedupe key: the first event's id, the last payload, pending again."""
    return enqueue(load(spark, sf_dir, "events"))


def enqueue(events: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id", "event_type").agg(
        F.min_by("event_id", order).alias("event_id"), F.max_by("props", order).alias("payload"), F.first(F.lit("pending")).alias("status"), F.count(F.lit(1)).alias("version")
    )


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> (SELECT min(event_type) FROM events) ORDER BY ts, event_id LIMIT 100")
def b5_outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 oldest pending events; those of the first type count as processed."""
    events = load(spark, sf_dir, "events")
    done = events.agg(F.min("event_type").alias("done"))
    return events.join(F.broadcast(done), F.col("event_type") != F.col("done")).orderBy("ts", "event_id").limit(100).select("event_id", "user_id", "event_type")


@query(
    """SELECT user_id, event_type, count(*) FILTER (value < 50) AS attempts, CASE WHEN bool_or(value >= 50) THEN 'processed' ELSE 'pending' END AS status,
    max(CASE WHEN value >= 50 THEN ts END) AS processed_at FROM events GROUP BY ALL"""
)
def b6_outbox_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an attempt, failed below 50: failures add up and stay pending, a success is final."""
    good = F.col("value") >= 50
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count_if(F.col("value") < 50).alias("attempts"), F.when(F.bool_or(good), "processed").otherwise("pending").alias("status"), F.max(F.when(good, F.col("ts"))).alias("processed_at")
    )


@query(
    """WITH k AS (SELECT doc_id, sha256(concat_ws('|', sha256(coalesce(text, '')), 'model-a', '64')) AS key, doc_id % 3 AS m FROM documents)
    SELECT key, CASE WHEN min(m) = 0 THEN 'cached' WHEN min(m) = 1 THEN 'stale' ELSE 'missing' END AS state, count(*) AS n FROM k GROUP BY key"""
)
def b7_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of the texts, one row for each key, and whether its vector is there, of another model, or missing."""
    key = F.sha2(F.concat_ws("|", F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("model-a"), F.lit("64")), 256)
    rows = load(spark, sf_dir, "documents").select(key.alias("key"), (F.col("doc_id") % 3).alias("m"))
    state = F.when(F.min("m") == 0, "cached").when(F.min("m") == 1, "stale").otherwise("missing")
    return rows.groupBy("key").agg(state.alias("state"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, 'doc_' || substr(sha256(coalesce(text, '')), 1, 24) AS document_uid, 'measurement_' || substr(sha1(concat_ws('|', coalesce(source, ''), coalesce(lang, ''), n_chars::VARCHAR)), 1, 32) AS measurement_uid FROM documents"""
)
def b14_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 24)).alias("document_uid"),
        F.concat(F.lit("measurement_"), F.substring(F.sha1(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("n_chars").cast("string")).cast("binary")), 1, 32)).alias("measurement_uid"),
    )


@query(f"WITH {CATALOG_SQL}, n AS (SELECT doc_id, ordinal AS src, lead(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS dst FROM chunks) SELECT * FROM n WHERE dst IS NOT NULL")
def b15_next_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks = catalog(spark, sf_dir)
    return chunks.select("doc_id", F.col("ordinal").alias("src"), F.lead("ordinal").over(Window.partitionBy("doc_id").orderBy("ordinal")).alias("dst")).where("dst IS NOT NULL")


@query(
    """WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS first_seen FROM h GROUP BY ALL)
    SELECT source, h AS content_hash, first_seen, row_number() OVER (PARTITION BY source ORDER BY first_seen) AS version FROM f"""
)
def i14_content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a name: a new content hash is the next version, a known one keeps its own.

    Places are counted in pieces of doc_id ranges, so no name's rows stand in one window.
    """
    seen = load(spark, sf_dir, "documents").groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).agg(F.min("doc_id").alias("first_seen"))
    seen = seen.withColumn("piece", F.floor(F.col("first_seen") / 4096))
    sizes = seen.groupBy("source", "piece").count()
    before = sizes.select("source", "piece", (F.sum("count").over(Window.partitionBy("source").orderBy("piece")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "piece").orderBy("first_seen"))
    return seen.withColumn("place", place).join(before, ["source", "piece"]).select("source", "content_hash", "first_seen", (F.col("before") + F.col("place")).alias("version"))
