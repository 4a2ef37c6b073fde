"""From a question to an answer: retrieval with a fallback, the typed cascade, dispatch, payloads and templates.

Every step is a lazy plan over the tables; which one runs is decided by whether a first row exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import canonical
from factloom.operators.facts import N_SQL, find, normalized
from factloom.operators.retrieval import QUESTION, _bm25_sql, bm25, cosine, fuse, fused_order, top
from factloom.plans.planner import Constraints, intent_of, plan_question
from factloom.registry import query
from factloom.sources.tables import FACTS_SQL, fact_rows, load

#: Candidates that each list of a fusion has, for k results: at least the first, else so many times k.
CANDIDATES, PER_RESULT = 50, 5


@dataclass(frozen=True)
class Preset:
    """How an installation extracts and answers."""

    name: str
    extraction: str
    synthesis: str
    strict: bool
    backend: str


# The presets, the default first.
PRESETS = (
    Preset("expert_max", "hybrid", "hybrid", False, "auto"),
    Preset("strict_audit", "deterministic", "template", True, "auto"),
    Preset("offline_reliable", "deterministic", "template", False, "fallback"),
)


def preset(asked: Column) -> Column:
    """The settings of the preset that is asked for: of the default if none is, null if there is no such preset."""
    name = F.when(F.trim(F.coalesce(asked, F.lit(""))) == "", PRESETS[0].name).otherwise(asked)
    settings = lambda p: F.struct(*(F.lit(v).alias(k) for k, v in vars(p).items()))
    return F.element_at(F.create_map(*(x for p in PRESETS for x in (F.lit(p.name), settings(p)))), name)


_ASKED_PRESET = "CASE role WHEN 'system' THEN 'strict_audit' WHEN 'assistant' THEN 'offline_reliable' END"


@query(
    f"WITH p(preset, extraction, synthesis, strict, backend) AS (VALUES {', '.join(str(tuple(vars(p).values())) for p in PRESETS)}), c AS (SELECT conv_id, turn, coalesce({_ASKED_PRESET}, '{PRESETS[0].name}') AS preset FROM conversations) SELECT conv_id, turn, preset, extraction, synthesis, strict, backend FROM c JOIN p USING (preset)"
)
def i13_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings that every turn is answered with: the system is strict, assistants are offline, users have the default."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", preset(F.expr(_ASKED_PRESET)).alias("p"))
    return rows.select("conv_id", "turn", F.col("p.name").alias("preset"), "p.extraction", "p.synthesis", "p.strict", "p.backend")


def retrieve(docs: DataFrame, vectors: DataFrame | None, question: str, asked: DataFrame | None, mode: str, k: int) -> tuple[str, str, DataFrame]:
    """(mode that ran, why it isn't the one asked for, (id, score, rank)): lexical, dense or fused search.

    docs (doc_id, text), vectors (vec_id, embedding), asked: one row (q: the question's vector).  Without vectors or a
    vector of the question, or with none that is near, the lexical search answers.
    """
    n = max(CANDIDATES, PER_RESULT * k)
    lexical = top(bm25(docs, question).withColumn("score", F.round("score", 6)), n, F.desc("score"), F.asc("id"))
    cut = lambda ranked: ranked.where(F.col("rank") <= k).select("id", "score", "rank")
    if mode == "bm25":
        return mode, "", cut(lexical)
    if vectors is None or asked is None:
        return "bm25", "there are no vectors", cut(lexical)
    scored = vectors.crossJoin(F.broadcast(asked.limit(1))).select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).where("score > 0")
    dense = top(scored, n, F.desc("score"), F.asc("id"))
    if dense.isEmpty():
        return "bm25", "no vector is near the question's", cut(lexical)
    if mode == "embedding":
        return mode, "", cut(dense)
    fused = top(fuse(lexical.select("id", "rank"), dense.select("id", "rank")), k, *fused_order())
    return mode, "", fused.select("id", "score", "rank")


@query(
    f"""WITH {_bm25_sql(QUESTION)} SELECT 'bm25' AS mode, 'no vector is near the question''s' AS reason, id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm ORDER BY 4 DESC, 3 LIMIT 10"""
)
def h5_mode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fused search whose question has a vector of zeros: the lexical list answers, and says why."""
    vectors = load(spark, sf_dir, "embeddings")
    zero = vectors.where("vec_id = 0").select(F.transform("embedding", lambda x: x * 0).alias("q"))
    mode, reason, rows = retrieve(load(spark, sf_dir, "documents"), vectors, QUESTION, zero, "hybrid", 10)
    return rows.select(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"), "id", "score", "rank")


@query(f"WITH {_bm25_sql(QUESTION)}, r AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT id AS doc_id, rank, round(1.0::DOUBLE / rank, 9) AS score FROM r WHERE rank <= {CANDIDATES}")
def h7_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a list of candidates as scores."""
    scored = bm25(load(spark, sf_dir, "documents"), QUESTION).withColumn("score", F.round("score", 6))
    return top(scored, CANDIDATES, F.desc("score"), F.asc("id")).select(F.col("id").alias("doc_id"), "rank", F.round(1.0 / F.col("rank"), 9).alias("score"))


#: What the cascade found.
EXACT, RELAXED, CHUNKS, NONE = "exact_facts_found", "relaxed_facts_found", "chunks_only_no_structured_facts", "no_relevant_sources"


def search_facts(rows: DataFrame, material: str | None, regime: str | None, property: str | None, docs: DataFrame | None = None, question: str = "", k: int = 12) -> tuple[str, DataFrame]:
    """The typed cascade: facts that match all that is asked, else facts that match a part (regime or property among it), else chunks, else nothing."""
    exact = find(rows, material, regime, property)
    if not exact.isEmpty():
        return EXACT, exact
    for kept in ((None, regime, property), (material, regime, None), (material, None, property)):
        relaxed = find(rows, *kept)
        if any(kept[1:]) and not relaxed.isEmpty():
            return RELAXED, relaxed
    if docs is not None and question:
        found = retrieve(docs, None, question, None, "bm25", k)[2]
        if not found.isEmpty():
            return CHUNKS, found
    return NONE, rows.where(F.lit(False))


_CASES = [("Brand#11", "R", None, ""), ("Nothing", "R", None, ""), ("Nothing", None, None, QUESTION), ("Nothing", None, None, "qqqq")]


@query(
    f"""WITH {FACTS_SQL}, {_bm25_sql(QUESTION)} SELECT 0 AS asked, '{EXACT}' AS status, count(*) AS n FROM facts WHERE lower(material) = 'brand#11' AND lower(regime) = 'r'
    UNION ALL SELECT 1, '{RELAXED}', count(*) FROM facts WHERE lower(regime) = 'r' UNION ALL SELECT 2, '{CHUNKS}', least(12, count(*)) FROM bm UNION ALL SELECT 3, '{NONE}', 0"""
)
def i8_typed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four searches, one for each way in which the cascade can end."""
    rows, docs = fact_rows(spark, sf_dir), load(spark, sf_dir, "documents")
    out = None
    for i, (material, regime, prop, question) in enumerate(_CASES):
        status, found = search_facts(rows, material, regime, prop, docs, question)
        one = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("asked"), F.lit(status).alias("status"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def payload(facts: DataFrame) -> DataFrame:
    """One row for each (material, regime, property) of an answer: its values in order, how many facts and sources stand behind it, and its edges in the graph."""
    n = normalized(facts)
    triple = ["material", "regime", "property"]
    edges = F.array(*(F.concat_ws(" ", F.lit("Fact"), F.lit(kind), F.col(c)) for kind, c in (("OF_MATERIAL", "material"), ("UNDER", "regime"), ("MEASURES", "property"))))
    rows = n.groupBy(*triple).agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.countDistinct("document_id").alias("n_sources"),
        F.round(F.min("value_normalized"), 3).alias("low"),
        F.round(F.max("value_normalized"), 3).alias("high"),
        F.min("seq").alias("first_fact"),
        F.max("unit_normalized").alias("unit"),
    )
    return rows.withColumn("edges", F.array_join(edges, "; "))


@query(
    f"""WITH {N_SQL} SELECT material, regime, property, count(*) AS n_facts, count(DISTINCT document_id) AS n_sources, round(min(value_normalized), 3) AS low, round(max(value_normalized), 3) AS high, min(seq) AS first_fact, max(unit_normalized) AS unit,
    'Fact OF_MATERIAL ' || material || '; Fact UNDER ' || regime || '; Fact MEASURES ' || property AS edges FROM k GROUP BY material, regime, property"""
)
def i9_answer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload(fact_rows(spark, sf_dir))


# The sentences of answers by kind.
TEMPLATES = {
    "overview": "%s of %s under %s: %s to %s %s in %d facts of %d sources.",
    "comparison": "%s of %s under %s ranges over %s to %s %s (%d facts, %d sources).",
    "gaps": "%s of %s under %s has no value above %s; the highest is %s %s (%d facts, %d sources).",
}


def sentence(kind: str) -> Column:
    """A row of payload() as a sentence; numbers with one decimal."""
    one = lambda c: F.format_string("%.1f", F.col(c))
    return F.format_string(TEMPLATES[kind], "property", "material", "regime", one("low") if kind != "gaps" else F.lit("49"), one("high"), "unit", "n_facts", "n_sources")


@query(
    f"""WITH {N_SQL}, p AS (SELECT material, regime, property, count(*) AS n_facts, count(DISTINCT document_id) AS n_sources, printf('%.1f', round(min(value_normalized), 3)) AS low, printf('%.1f', round(max(value_normalized), 3)) AS high, max(unit_normalized) AS unit, max(value) AS top FROM k GROUP BY ALL)
    SELECT material, regime, property, CASE WHEN top <= 49 THEN 'gaps' WHEN n_sources > 1 THEN 'comparison' ELSE 'overview' END AS kind,
    CASE WHEN top <= 49 THEN property || ' of ' || material || ' under ' || regime || ' has no value above 49; the highest is ' || high || ' ' || unit || ' (' || n_facts || ' facts, ' || n_sources || ' sources).'
    WHEN n_sources > 1 THEN property || ' of ' || material || ' under ' || regime || ' ranges over ' || low || ' to ' || high || ' ' || unit || ' (' || n_facts || ' facts, ' || n_sources || ' sources).'
    ELSE property || ' of ' || material || ' under ' || regime || ': ' || low || ' to ' || high || ' ' || unit || ' in ' || n_facts || ' facts of ' || n_sources || ' sources.' END AS answer FROM p"""
)
def i10_template_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact_rows(spark, sf_dir)
    triple = ["material", "regime", "property"]
    tops = rows.groupBy(*triple).agg(F.max("value").alias("top"))
    p = payload(rows).join(tops, triple)
    kind = F.when(F.col("top") <= 49, "gaps").when(F.col("n_sources") > 1, "comparison").otherwise("overview")
    answer = F.when(F.col("top") <= 49, sentence("gaps")).when(F.col("n_sources") > 1, sentence("comparison")).otherwise(sentence("overview"))
    return p.select(*triple, kind.alias("kind"), answer.alias("answer"))


# The order in which ways to answer are tried, and the words that call for each.
ROUTES = [("clarify", []), ("inventory", ["inventory", "which materials", "какие материалы"]), ("conflict", ["conflict", "different values", "противореч"]), ("history", ["history", "decision", "истори"]), ("gaps", ["gap", "not reported", "пробел", "нет данных"]), ("comparison", ["compar", "сравн", "versus"])]


def route(text: Column) -> Column:
    """How each question of a table is answered: clarify if it is too short or has no words, else by its words, else by retrieval."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    out = F.when((F.length(F.trim(t)) < 12) | ~t.rlike(r"[\p{L}]{3}"), "clarify")
    for name, words in ROUTES[1:]:
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name)
    return out.otherwise("retrieval")


@query(
    r"SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''))) < 12 OR NOT regexp_matches(text, '[\p{L}]{3}') THEN 'clarify' "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in ROUTES[1:])
    + " ELSE 'retrieval' END AS route FROM conversations"
)
def i7_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", route(F.col("text")).alias("route"))


@dataclass(frozen=True)
class Answer:
    """How a question was answered: the route, what was found, its rows, and a sentence for each where there are facts."""

    route: str
    status: str
    rows: DataFrame
    constraints: Constraints


def ask(facts: DataFrame, docs: DataFrame, question: str, now_year: int, k: int = 12, resolve: Callable[[str], tuple[str | None, str | None, str | None]] | None = None) -> Answer:
    """Answer one question: clarify, exact fact, inventory, typed facts, analytics by intent, else chunks.

    resolve maps a question to (material, regime, property) where the facts use other names than the vocabulary.
    """
    c = plan_question(question, now_year)
    spark = facts.sparkSession
    way = spark.range(1).select(route(F.lit(question))).first()[0]
    if way == "clarify":
        return Answer(way, NONE, facts.where(F.lit(False)), c)
    first = lambda names: names[0] if names else None
    asked = resolve(question) if resolve else (first(c.materials), first(c.regimes), first(c.properties))
    if way == "inventory":
        return Answer(way, EXACT, facts.groupBy("material").agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("property").alias("n_properties")), c)
    if way in ("comparison", "conflict", "gaps", "history") and not all(asked):
        rows = payload(find(facts, *asked))
        return Answer(way, EXACT if not rows.isEmpty() else NONE, rows.withColumn("answer", sentence("comparison")), c)
    status, found = search_facts(facts, *asked, docs, question, k) if any(asked) else search_facts(facts.where(F.lit(False)), None, None, None, docs, question, k)
    if status in (EXACT, RELAXED):
        found = payload(found).withColumn("answer", sentence("overview"))
    return Answer("typed_facts" if status in (EXACT, RELAXED) else "retrieval", status, found, c)


@query("SELECT d.doc_id AS point_id, substr(coalesce(text, ''), 1, 2000) AS payload, source, label, len(embedding)::INT AS dims FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def b8_vector_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for a vector store: the vector's size, and the first 2,000 characters of its chunk as payload."""
    docs, vectors = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(F.col("doc_id").alias("point_id"), F.substring(F.coalesce("text", F.lit("")), 1, 2000).alias("payload"), "source", "label", F.size("embedding").alias("dims"))


@query(
    f"""WITH {N_SQL}, p AS (SELECT material, property, count(*) AS n, printf('%.1f', round(min(value_normalized), 3)) AS low, printf('%.1f', round(max(value_normalized), 3)) AS high FROM k GROUP BY 1, 2),
    l AS (SELECT material, '| ' || property || ' | ' || n || ' | ' || low || ' | ' || high || ' |' AS line, property FROM p)
    SELECT material, '# ' || material || chr(10) || '| property | facts | low | high |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY property) AS markdown FROM l GROUP BY material"""
)
def b18_markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each material: a table of its properties, a few hundred lines at most, as properties are a vocabulary."""
    one = lambda c: F.format_string("%.1f", F.round(c, 3))
    p = normalized(fact_rows(spark, sf_dir)).groupBy("material", "property").agg(F.count(F.lit(1)).alias("n"), F.min("value_normalized").alias("low"), F.max("value_normalized").alias("high"))
    line = F.format_string("| %s | %d | %s | %s |", "property", "n", one("low"), one("high"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("property", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("# "), F.col("material"), F.lit("\n| property | facts | low | high |\n|-|-|-|-|\n"))
    return p.groupBy("material").agg(lines.alias("lines")).select("material", F.concat(head, F.array_join("lines", "\n")).alias("markdown"))
