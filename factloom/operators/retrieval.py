"""Ranking: BM25, vectors, fusion, diversification, rerankers."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as T
from factloom.registry import query
from factloom.sources.tables import load

K1, B = 1.5, 0.75
QUESTION = "The of, with and stupid license? (the)"


def asked_terms(question: str) -> Counter[str]:
    """The question's tokens, as texts have them, with how often each is asked."""
    return Counter(re.findall(r"[\w\-]+", question.lower()))


def bm25(docs: DataFrame, question: str, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of the documents that hold a term of the question; a term asked twice counts twice.

    Tokens are filtered to the question's terms within each row, so what is shuffled is one row for each
    document and asked term, and lengths come with the same scan.  Document frequencies of the few asked terms
    and two totals are the only aggregates.
    """
    asked = asked_terms(question)
    terms = docs.sparkSession.createDataFrame([(t, n) for t, n in asked.items()], "term string, asked int")
    tokens = docs.select(F.col(id_column).alias("id"), T.tokens(F.col("text")).alias("t")).select(
        "id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(*asked)).alias("hits")
    )
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = tokens.select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("asked") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(totals)).groupBy("id").agg(F.sum(weight).alias("score")).where("score > 0")


def _bm25_sql(question: str) -> str:
    values = ", ".join(f"('{t}', {n})" for t, n in asked_terms(question).items())
    return rf"""q(term, asked) AS (VALUES {values}),
    k AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_\-]+') AS t FROM documents),
    l AS (SELECT doc_id, len(t) AS dl FROM k), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM k) JOIN q USING (term) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    bm AS (SELECT doc_id AS id, sum(asked * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM f JOIN d USING (term) JOIN q USING (term) JOIN l USING (doc_id), a GROUP BY doc_id)"""


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank, from 1; the order must be total."""
    best = ranked.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query(f"WITH {_bm25_sql(QUESTION)} SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm ORDER BY 2 DESC, 1 LIMIT 50")
def h1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bm25(load(spark, sf_dir, "documents"), QUESTION).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return top(scored, 50, F.desc("score"), F.asc("doc_id"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"


@query(f"WITH s AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY 2 DESC, 1 LIMIT 50")
def h2_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vectors.where("vec_id <> 0").crossJoin(F.broadcast(asked)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top(scored, 50, F.desc("score"), F.asc("vec_id"))


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two (id, rank) lists; ties go to the lexical list, then the dense, then the id."""
    rows = lexical.select("id", F.col("rank").alias("lr"), F.lit(None).cast("bigint").alias("dr")).unionByName(dense.select("id", F.lit(None).cast("bigint").alias("lr"), F.col("rank").alias("dr")))
    one = rows.groupBy("id").agg(F.min("lr").alias("lr"), F.min("dr").alias("dr"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return one.withColumn("score", F.round(part("lr") + part("dr"), 9))


_FUSED_SQL = f"""{_bm25_sql(QUESTION)},
    x AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS lr FROM bm ORDER BY round(score, 6) DESC, id LIMIT 100),
    v AS (SELECT e.vec_id AS id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    y AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS dr FROM v ORDER BY s DESC, id LIMIT 100),
    u AS (SELECT coalesce(x.id, y.id) AS id, lr, dr, round(coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + dr), 0), 9) AS score FROM x FULL JOIN y ON x.id = y.id)"""


def _both_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = bm25(load(spark, sf_dir, "documents"), QUESTION).withColumn("score", F.round("score", 6))
    vectors = load(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dense = vectors.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top(scored, 100, F.desc("score"), F.asc("id")), top(dense, 100, F.desc("score"), F.asc("id"))




def fused_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("lr"), F.asc_nulls_last("dr"), F.asc("id")]


@query(f"WITH {_FUSED_SQL} SELECT id, score, row_number() OVER (ORDER BY score DESC, lr NULLS LAST, dr NULLS LAST, id) AS rank FROM u ORDER BY 3 LIMIT 20")
def h3_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(fuse(*_both_lists(spark, sf_dir)), 20, *fused_order()).select("id", "score", "rank")


def diversify(ranked: DataFrame, group: str, per_group: int, k: int) -> DataFrame:
    """(.., old_rank, rank): at most per_group rows of a group in rank order, then what is left over, k in all."""
    late = F.row_number().over(Window.partitionBy(group).orderBy("rank")) > per_group
    rows = ranked.withColumn("late", late).withColumnRenamed("rank", "old_rank")
    return top(rows, k, F.col("late"), F.col("old_rank")).drop("late")


@query(
    f"""WITH {_bm25_sql(QUESTION)}, r AS (SELECT id, source, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS old_rank FROM bm JOIN documents ON doc_id = id ORDER BY 3 LIMIT 100),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY old_rank) > 3 AS late FROM r)
    SELECT id, source, old_rank, row_number() OVER (ORDER BY late, old_rank) AS new_rank FROM p ORDER BY 4 LIMIT 30"""
)
def h4_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = bm25(docs, QUESTION).withColumn("score", F.round("score", 6))
    ranked = top(scored, 100, F.desc("score"), F.asc("id"))
    ranked = docs.select(F.col("doc_id").alias("id"), "source").join(F.broadcast(ranked), "id")
    return diversify(ranked.select("id", "source", "rank"), "source", 3, 30).withColumnRenamed("rank", "new_rank")


@query(
    r"""WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\-]+')) AS t FROM documents),
    s AS (SELECT doc_id, len(list_intersect(t, ['license', 'stupid', 'worthless', 'general', 'public', 'und', 'que']))::BIGINT AS score FROM k)
    SELECT doc_id, score, round(1.0 / row_number() OVER (ORDER BY score DESC, doc_id), 9) AS rank_score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"""
)
def h6_overlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of asked terms in the document; a rank's score is its reciprocal (h7)."""
    asked = F.array(*map(F.lit, ["license", "stupid", "worthless", "general", "public", "und", "que"]))
    scored = load(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(T.tokens(F.col("text")), asked)).cast("bigint").alias("score")).where("score > 0")
    return top(scored, 50, F.desc("score"), F.asc("doc_id")).select("doc_id", "score", F.round(1.0 / F.col("rank"), 9).alias("rank_score"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS q, trim(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2 + CASE WHEN contains(q, 'license') THEN 0.35 ELSE 0 END + CASE WHEN contains(q, 'general') THEN 0.25 ELSE 0 END
    + CASE WHEN contains(q, 'public') THEN 0.25 ELSE 0 END + CASE WHEN contains(q, 'version') THEN 0.10 ELSE 0 END - CASE WHEN contains(q, 'apache') THEN 0.30 ELSE 0 END
    - CASE WHEN length(t) < 40 THEN 0.20 ELSE 0 END)), 6) AS score FROM d"""
)
def h8_evidence_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence scores: boosts for each kind of constraint met, penalties for a conflicting material and short quotes."""
    q = F.lower(F.coalesce("text", F.lit("")))
    has = lambda w, s: F.when(q.contains(w), s).otherwise(0.0)
    score = F.lit(0.2) + has("license", 0.35) + has("general", 0.25) + has("public", 0.25) + has("version", 0.10) - has("apache", 0.30)
    short = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 40, 0.20).otherwise(0.0)
    return load(spark, sf_dir, "documents").select("doc_id", F.round(clamp(score - short), 6).alias("score"))


@query(
    r"""WITH y AS (SELECT doc_id, lang, list_max(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:19|20)[0-9][0-9]'), lambda x: x::INT), lambda x: x BETWEEN 1950 AND 2035)) AS yr FROM documents),
    s AS (SELECT doc_id, round((CASE WHEN lang IN ('de', 'fr') THEN 0.55 ELSE 0 END + CASE WHEN yr >= 2024 - 10 + 1 THEN 0.45 ELSE 0 END)::DOUBLE, 6) AS score FROM y)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY 3 LIMIT 100"""
)
def h9_metadata_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geography .55 and recency .45 never filter; the present year is a parameter (2024), the span ten years."""
    years = F.filter(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?:19|20)[0-9][0-9]"), F.lit(0)), lambda x: x.cast("int")), lambda x: x.between(1950, 2035))
    score = F.when(F.col("lang").isin("de", "fr"), 0.55).otherwise(0.0) + F.when(F.array_max(years) >= 2015, 0.45).otherwise(0.0)
    scored = load(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))
    return top(scored, 100, F.desc("score"), F.asc("doc_id"))
