"""What answers are put together from: overviews, coverage, inventories, source gates, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as T
from factloom.operators.facts import N_SQL, normalized
from factloom.registry import query
from factloom.sources.tables import FACTS_SQL, fact_rows, load


@query(f"WITH {FACTS_SQL}, g AS (SELECT material, regime, property, max(value) AS top FROM facts GROUP BY 1, 2, 3) SELECT material, regime, property, regime = 'R' AS by_regime, regime IS NULL OR regime = 'R' OR contains(lower(property), 'small') AS loose FROM g WHERE top < 50 AND (regime = 'R' OR contains(lower(property), 'small'))")
def f5_gap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by two rules: the strict one wants the regime, the loose one takes a missing regime or the property's text."""
    gaps = fact_rows(spark, sf_dir).groupBy("material", "regime", "property").agg(F.max("value").alias("top")).where("top < 50")
    strict, named = F.col("regime") == "R", F.contains(F.lower("property"), F.lit("small"))
    return gaps.where(strict | named).select("material", "regime", "property", strict.alias("by_regime"), (F.col("regime").isNull() | strict | named).alias("loose"))


@query(f"WITH {FACTS_SQL}, m AS (SELECT DISTINCT p_brand AS material FROM part) SELECT material, count(f.seq) AS facts, count(DISTINCT f.regime) AS regimes, count(DISTINCT f.property) AS properties, max(f.value) AS top FROM m LEFT JOIN facts f USING (material) GROUP BY material")
def f7_material_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known material, with or without facts."""
    own = fact_rows(spark, sf_dir).groupBy("material").agg(F.count("seq").alias("facts"), F.countDistinct("regime").alias("regimes"), F.countDistinct("property").alias("properties"), F.max("value").alias("top"))
    known = load(spark, sf_dir, "part").select(F.col("p_brand").alias("material")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return known.join(own, "material", "left").select("material", zero("facts"), zero("regimes"), zero("properties"), "top")


@query(f"WITH {FACTS_SQL} SELECT document_id, bool_or(material = 'Brand#11') AS has_material, bool_or(contains(lower(property), 'eco')) AS has_property, bool_or(equipment = 1) AS has_equipment FROM facts GROUP BY 1")
def f11_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("document_id").agg(
        F.bool_or(F.col("material") == "Brand#11").alias("has_material"), F.bool_or(F.lower("property").contains("eco")).alias("has_property"), F.bool_or(F.col("equipment") == 1).alias("has_equipment")
    )


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, contains(t, 'license') OR contains(t, 'licence') AS a, contains(t, 'public') OR contains(t, 'mit') AS b FROM d)
    SELECT doc_id, CASE WHEN a AND b THEN 'strict' WHEN a THEN 'partial' ELSE 'no_match' END AS level FROM h"""
)
def f13_match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraints by any of their values: strict; the primary alone: partial."""
    t = F.lower(F.coalesce("text", F.lit("")))
    a, b = t.contains("license") | t.contains("licence"), t.contains("public") | t.contains("mit")
    return load(spark, sf_dir, "documents").select("doc_id", F.when(a & b, "strict").when(a, "partial").otherwise("no_match").alias("level"))


@query(
    f"""WITH {N_SQL}, r(regime) AS (VALUES ('A'), ('R')) SELECT material, count(DISTINCT canonical_fact_key) AS facts FROM k SEMI JOIN r USING (regime) WHERE property = (SELECT min(p_type) FROM part)
    GROUP BY material ORDER BY facts DESC, material LIMIT 20"""
)
def f18_material_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials with canonical facts of one property; the regime asked for stands for its kinds."""
    kinds = spark.createDataFrame([("A",), ("R",)], "regime string")
    wanted = load(spark, sf_dir, "part").agg(F.min("p_type").alias("wanted"))
    rows = normalized(fact_rows(spark, sf_dir)).join(F.broadcast(kinds), "regime", "left_semi").join(F.broadcast(wanted), F.col("property") == F.col("wanted"))
    return rows.groupBy("material").agg(F.countDistinct("canonical_fact_key").alias("facts")).orderBy(F.desc("facts"), "material").limit(20)


@query(f"WITH {FACTS_SQL} SELECT bool_or(material = 'Brand#11') AS material, bool_or(regime = 'X') AS regime, bool_or(property LIKE 'S%') AS property, bool_or(value BETWEEN 10 AND 12) AS numeric, bool_or(laboratory = 'NATION_1') AS laboratory FROM facts")
def f19_constraint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the asked fields any grounded row covers, in one pass."""
    has = lambda c, n: F.bool_or(c).alias(n)
    return fact_rows(spark, sf_dir).agg(
        has(F.col("material") == "Brand#11", "material"), has(F.col("regime") == "X", "regime"), has(F.col("property").startswith("S"), "property"), has(F.col("value").between(10, 12), "numeric"), has(F.col("laboratory") == "NATION_1", "laboratory")
    )


@query(
    f"""WITH {FACTS_SQL}, e AS (SELECT DISTINCT 'material' AS t, material AS l FROM facts WHERE value = 50 UNION SELECT DISTINCT 'regime', regime FROM facts WHERE value = 50 UNION SELECT DISTINCT 'property', property FROM facts WHERE value = 50)
    SELECT t || ':' || substr(sha256(lower(l)), 1, 18) AS node_id, t AS type, l AS label FROM e ORDER BY 1 LIMIT 180"""
)
def f23_local_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph around the final facts, 180 at most by id."""
    labels = F.array(*(F.struct(F.lit(c).alias("type"), F.col(c).alias("label")) for c in ("material", "regime", "property")))
    nodes = fact_rows(spark, sf_dir).where("value = 50").select(F.explode(labels).alias("n")).select("n.*").distinct()
    return nodes.select(F.concat_ws(":", "type", F.substring(F.sha2(F.lower("label"), 256), 1, 18)).alias("node_id"), "type", "label").orderBy("node_id").limit(180)


@query(
    f"""WITH {FACTS_SQL}, s AS (SELECT material, regime, count(*) AS n, sum(CASE WHEN effect <> 'unknown' THEN 10 ELSE 0 END + CASE WHEN laboratory <> '' THEN 4 ELSE 0 END + 1)::BIGINT AS score FROM facts GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY material ORDER BY score DESC, regime) AS place FROM s) SELECT material, regime, n, score, place FROM r WHERE place <= 8"""
)
def g17_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done with each material: regimes by the score of their measurements, eight at most."""
    points = F.when(F.col("effect") != "unknown", 10).otherwise(0) + F.when(F.col("laboratory") != "", 4).otherwise(0) + 1
    scored = fact_rows(spark, sf_dir).groupBy("material", "regime").agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("score"))
    place = F.row_number().over(Window.partitionBy("material").orderBy(F.desc("score"), "regime")).cast("bigint")
    return scored.withColumn("place", place).where("place <= 8")


@query(f"WITH {FACTS_SQL}, d AS (SELECT DISTINCT coalesce(material, '-') AS material, concat_ws(', ', regime, property) AS detail, effect FROM facts) SELECT * FROM d ORDER BY material, detail, effect LIMIT 6")
def g21_display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact_rows(spark, sf_dir).select(F.coalesce("material", F.lit("-")).alias("material"), F.concat_ws(", ", "regime", "property").alias("detail"), "effect").distinct()
    return rows.orderBy("material", "detail", "effect").limit(6)


@query(
    r"""WITH k AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\-]+')) AS t FROM documents),
    s AS (SELECT doc_id, source, 5 * (list_has_any(t, ['license', 'licensed'])::INT + list_has_any(t, ['public', 'mit', 'apache'])::INT) + 0.35::DOUBLE * len(list_intersect(t, ['general', 'version', 'released', 'under'])) AS score, list_has_any(t, ['license', 'licensed']) AS gate FROM k),
    g AS (SELECT * FROM s WHERE gate), v AS (SELECT source, sum(score) AS total, max(score) AS best FROM g GROUP BY source), w AS (SELECT max(total) AS t, max(best) AS b FROM v),
    o AS (SELECT g.* FROM g JOIN v USING (source), w WHERE total >= 0.55 * t OR best >= 0.9 * b), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM o)
    SELECT doc_id, source, round(score, 6) AS score FROM r WHERE place <= 5"""
)
def h11_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold an anchor, of sources that win the vote (55 % of the best total or 90 % of the best score), five a source."""
    t = F.array_distinct(T.tokens(F.col("text")))
    some = lambda *ws: F.arrays_overlap("t", F.array(*map(F.lit, ws)))
    count = lambda *ws: F.size(F.array_intersect("t", F.array(*map(F.lit, ws))))
    score = 5 * (some("license", "licensed").cast("int") + some("public", "mit", "apache").cast("int")) + 0.35 * count("general", "version", "released", "under")
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", t.alias("t")).where(some("license", "licensed")).select("doc_id", "source", score.alias("score"))
    votes = rows.groupBy("source").agg(F.sum("score").alias("total"), F.max("score").alias("best"))
    top = votes.agg(F.max("total").alias("t"), F.max("best").alias("b"))
    winners = votes.crossJoin(F.broadcast(top)).where("total >= 0.55 * t OR best >= 0.9 * b").select("source")
    ranked = rows.join(winners, "source", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")))
    return ranked.where("place <= 5").select("doc_id", "source", F.round("score", 6).alias("score"))


@query(
    f"""WITH {FACTS_SQL}, u AS (SELECT document_id, chunk_id, 1 AS origin FROM facts WHERE value > 48 UNION ALL SELECT document_id, chunk_id, 2 FROM facts WHERE tax > 0.07 UNION ALL SELECT document_id, chunk_id, 3 FROM facts WHERE effect = 'increase'),
    d AS (SELECT document_id, chunk_id, min(origin)::BIGINT AS origin FROM u GROUP BY 1, 2) SELECT * FROM d ORDER BY origin, document_id, chunk_id LIMIT 12"""
)
def h15_evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of three origins, each place once, twelve rows."""
    rows = fact_rows(spark, sf_dir)
    origins = F.array_compact(F.array(F.when(F.col("value") > 48, 1), F.when(F.col("tax") > 0.07, 2), F.when(F.col("effect") == "increase", 3)))
    one = rows.select("document_id", "chunk_id", F.array_min(origins).alias("o")).where("o IS NOT NULL").groupBy("document_id", "chunk_id").agg(F.min("o").cast("bigint").alias("origin"))
    return one.orderBy("origin", "document_id", "chunk_id").limit(12)


@query("SELECT p_partkey, 'Table columns: brand | type | size' || chr(10) || array_to_string(list_filter([CASE WHEN p_brand <> '' THEN 'brand: ' || p_brand END, CASE WHEN p_type <> '' THEN 'type: ' || p_type END, CASE WHEN p_size > 10 THEN 'size: ' || p_size END], lambda x: x IS NOT NULL), ' | ') AS text FROM part")
def c2_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A serialised row of each part; cells that count as empty (here: sizes up to 10) are left out."""
    cells = F.array_compact(
        F.array(F.when(F.col("p_brand") != "", F.concat(F.lit("brand: "), "p_brand")), F.when(F.col("p_type") != "", F.concat(F.lit("type: "), "p_type")), F.when(F.col("p_size") > 10, F.concat(F.lit("size: "), F.col("p_size").cast("string"))))
    )
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Table columns: brand | type | size\n"), F.array_join(cells, " | ")).alias("text"))


_W = r"[\p{L}\p{N}_]"


def _word(pattern: str, replacement: str) -> tuple[str, str]:
    """A rewrite of whole words, in a form that every engine reads alike."""
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{pattern})([^\p{{L}}\p{{N}}_]|$)", f"$1{replacement}$2"


# Rewrites of damaged text, in order: divided words, lost units, units and grades that were pulled apart, blanks.
REWRITES = [
    (rf"({_W})-\s*\n\s*({_W})", "$1$2"),
    (r"[ \t]*\n[ \t]*((?:MPa|МПа|ksi|HV|HRC|°C|C)(?:[^\p{L}\p{N}_]|$)|%)", " $1"),
    _word(r"[MmМм]\s*[PpРрПп]\s*[AaАа]", "MPa"),
    _word(r"[HhНн]\s*[Vv]", "HV"),
    _word(r"[Kk]\s+[Ss]\s*[Ii]", "ksi"),
    _word(r"[Вв][Тт]\s*[- ]?\s*6", "ВТ6"),
    _word(r"[Bb][Tt]\s*[- ]?\s*6", "VT6"),
    _word(r"7075\s*[–—-]?\s*[ТTт]\s*6", "7075-T6"),
    _word(r"[Tt][Ii]\s*[- ]?\s*6\s*[Aa][Ll]\s*[- ]?\s*4\s*[Vv]", "Ti-6Al-4V"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


def repaired(text: Column) -> Column:
    for pattern, replacement in REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


@query(
    "SELECT doc_id, sha256("
    + "".join("regexp_replace(" for _ in REWRITES)
    + "coalesce(text, '')"
    + "".join(", '{}', '{}', 'g')".format(p, r.replace("$", "\\").replace("\n", "' || chr(10) || '")) for p, r in REWRITES)
    + ") AS text_hash FROM documents"
)
def c5_repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with hyphens at line ends, split units and blanks put right."""
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(repaired(F.coalesce("text", F.lit(""))), 256).alias("text_hash"))


# Words that add synonyms to a question.
SYNONYMS = {"the": ["article"], "with": ["together", "along"], "und": ["and"]}


@query(
    "SELECT conv_id, turn, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN contains(lower(text), '{t}') AND NOT contains(lower(text), '{s}') THEN '{s}' END" for t, ss in SYNONYMS.items() for s in ss)
    + "], lambda x: x IS NOT NULL), ' ') AS additions FROM conversations"
)
def c17_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms of what a question holds, without those it holds already."""
    low = F.lower("text")
    adds = [F.when(low.contains(t) & ~low.contains(s), s) for t, ss in SYNONYMS.items() for s in ss]
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_compact(F.array(*adds)), " ").alias("additions"))


@query("WITH a AS (SELECT lower(trim(p_brand)) AS b, count(*) AS n FROM part GROUP BY 1), f AS (SELECT lower(trim(p_type)) AS t, lower(trim(p_brand)) AS b FROM part) SELECT t AS property, b AS material, n AS parts, count(*) AS pairs FROM f JOIN a USING (b) GROUP BY ALL")
def d2_canonical_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of names as an equi-join of their canonical forms."""
    part = load(spark, sf_dir, "part").select(T.canonical(F.col("p_type")).alias("property"), T.canonical(F.col("p_brand")).alias("material"))
    sizes = part.groupBy("material").agg(F.count(F.lit(1)).alias("parts"))
    return part.join(sizes, "material").groupBy("property", "material", "parts").agg(F.count(F.lit(1)).alias("pairs"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^(exp|experiment)[ _-]?[0-9]+$') THEN '' ELSE trim(regexp_replace(p_name, '[.,;:!?]+', '', 'g')) END AS name FROM part")
def d7_resolver_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.lower("p_name").rlike("^(exp|experiment)[ _-]?[0-9]+$"), "").otherwise(F.trim(F.regexp_replace("p_name", "[.,;:!?]+", "")))
    return load(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(lower(p_brand), '^(mpa|hv|ksi|%)$') THEN 'unit_like' WHEN regexp_matches(p_brand, '^[A-Z]{1,2}[0-9]{4,}$') THEN 'font_code' WHEN regexp_matches(p_brand, '#[0-9]+$') THEN 'grade' ELSE 'context' END AS verdict FROM part")
def e16_material_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    verdict = F.when(F.lower(b).rlike("^(mpa|hv|ksi|%)$"), "unit_like").when(b.rlike("^[A-Z]{1,2}[0-9]{4,}$"), "font_code").when(b.rlike("#[0-9]+$"), "grade").otherwise("context")
    return load(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


@query(f"WITH {FACTS_SQL} SELECT seq, material, regime, property FROM facts WHERE property <> '' AND (material <> '' OR regime <> '') AND tax >= 0.02 AND NOT (value > 45)")
def e21_graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted facts that name a property, and a material or a process, go to the graph; no node is made up."""
    named = (F.col("property") != "") & ((F.col("material") != "") | (F.col("regime") != ""))
    return fact_rows(spark, sf_dir).where(named & (F.col("tax") >= 0.02) & ~(F.col("value") > 45)).select("seq", "material", "regime", "property")


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '(?:with|under|of) ([a-z]{4,})', 1), ',') AS constraints FROM conversations")
def i6_question_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names after a preposition are kept as constraints."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("(?:with|under|of) ([a-z]{4,})"), F.lit(1))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("constraints"))


@query("WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id FROM c ANTI JOIN o USING (doc_id, h)")
def i15_changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction must run on again: chunks whose signature isn't in the cache (here: a fifth is new, a quarter changed)."""
    now = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    cached = now.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("h")))
    return now.join(cached, ["doc_id", "h"], "left_anti").select("doc_id")


@query(f"WITH {FACTS_SQL} SELECT 'Answer' AS src, 'HAS_MATERIAL' AS type, material AS dst, count(*) AS weight FROM facts WHERE value = 50 GROUP BY material UNION ALL SELECT material, 'IN_DOCUMENT', document_id::VARCHAR, count(*) FROM facts WHERE value = 50 GROUP BY material, document_id")
def i12_answer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from an answer to its materials and from those to their documents, with the number of facts."""
    rows = fact_rows(spark, sf_dir).where("value = 50")
    top = rows.groupBy("material").agg(F.count(F.lit(1)).alias("weight")).select(F.lit("Answer").alias("src"), F.lit("HAS_MATERIAL").alias("type"), F.col("material").alias("dst"), "weight")
    low = rows.groupBy("material", "document_id").agg(F.count(F.lit(1)).alias("weight")).select(F.col("material").alias("src"), F.lit("IN_DOCUMENT").alias("type"), F.col("document_id").cast("string").alias("dst"), "weight")
    return top.unionByName(low)
