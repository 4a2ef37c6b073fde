"""The property graph: nodes and edges from facts, neighbourhoods, listings, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.registry import query
from factloom.sources.tables import FACTS_SQL, fact_rows, load

#: Edge type, column of the target, node type of the target.
EDGES = [("USES_MATERIAL", "material", "Material"), ("HAS_REGIME", "regime", "Regime"), ("OF_PROPERTY", "property", "Property"), ("PERFORMED_AT", "laboratory", "Laboratory")]


def edges(rows: DataFrame) -> DataFrame:
    """Distinct (src, type, dst) of every experiment: writing them again changes nothing."""
    targets = F.array(*(F.struct(F.lit(t).alias("type"), F.concat(F.lit(f"{kind}:"), F.col(c)).alias("dst")) for t, c, kind in EDGES))
    src = F.concat(F.lit("Experiment:"), F.col("document_id").cast("string"))
    return rows.select(src.alias("src"), F.explode(targets).alias("e")).select("src", "e.type", "e.dst").distinct()


EDGES_SQL = f"{FACTS_SQL}, e AS MATERIALIZED (" + " UNION ".join(f"SELECT 'Experiment:' || document_id AS src, '{t}' AS type, '{kind}:' || {c} AS dst FROM facts" for t, c, kind in EDGES) + ")"


@query(f"WITH {EDGES_SQL} SELECT src, type, dst FROM e")
def b12_experiment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(fact_rows(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT id, split_part(id, ':', 1) AS type, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def b9_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their degree: the result of merging every endpoint by id."""
    e = edges(fact_rows(spark, sf_dir))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("type"), "degree")


@query(f"WITH {FACTS_SQL} SELECT property, effect, unit, count(*) AS n FROM facts GROUP BY GROUPING SETS ((property), (effect), (unit))")
def b10_bundle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col(c)] for c in ("property", "effect", "unit")]
    return fact_rows(spark, sf_dir).groupingSets(sets, "property", "effect", "unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FACTS_SQL} SELECT seq AS fact_id, 'FACT_SUBJECT' AS type, material AS target FROM facts UNION ALL SELECT seq, 'FACT_PROCESS', regime FROM facts
    UNION ALL SELECT seq, 'FACT_PARAMETER', property FROM facts UNION ALL SELECT seq, 'DESCRIBED_IN', document_id::VARCHAR FROM facts WHERE value > 49"""
)
def b11_fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda t, c: F.struct(F.lit(t).alias("type"), c.alias("target"))
    described = F.when(F.col("value") > 49, F.array(pair("DESCRIBED_IN", F.col("document_id").cast("string")))).otherwise(F.array().cast("array<struct<type:string,target:string>>"))
    own = F.array(pair("FACT_SUBJECT", F.col("material")), pair("FACT_PROCESS", F.col("regime")), pair("FACT_PARAMETER", F.col("property")))
    return fact_rows(spark, sf_dir).select(F.col("seq").alias("fact_id"), F.explode(F.concat(own, described)).alias("e")).select("fact_id", "e.type", "e.target")


@query(f"WITH {FACTS_SQL} SELECT 'gap_' || sha1(material || '|' || regime || '|' || property) AS gap_id, unnest(['GAP_FOR_ENTITY', 'GAP_FOR_REGIME', 'GAP_FOR_PROPERTY']) AS type, unnest([material, regime, property]) AS target FROM (SELECT material, regime, property FROM facts GROUP BY ALL HAVING max(value) < 50)")
def b13_gap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = fact_rows(spark, sf_dir).groupBy("material", "regime", "property").agg(F.max("value").alias("top")).where("top < 50")
    gap = F.concat(F.lit("gap_"), F.sha1(F.concat_ws("|", "material", "regime", "property").cast("binary")))
    kinds = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("target")) for t, c in (("GAP_FOR_ENTITY", "material"), ("GAP_FOR_REGIME", "regime"), ("GAP_FOR_PROPERTY", "property"))))
    return gaps.select(gap.alias("gap_id"), F.explode(kinds).alias("e")).select("gap_id", "e.type", "e.target")


@query(f"WITH {FACTS_SQL} SELECT document_id, material AS entity, count(*) AS mentions, max(tax) AS confidence FROM facts GROUP BY ALL")
def b16_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("document_id", F.col("material").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.max("tax").alias("confidence"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey + 1000 AS a, n_regionkey AS b FROM nation UNION ALL SELECT s_suppkey + 10000, s_nationkey + 1000 FROM supplier),
    u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h(id, d) AS (SELECT 0, 0 UNION SELECT u.b, h.d + 1 FROM h JOIN u ON h.id = u.a WHERE h.d < 2)
    SELECT id::BIGINT AS id, min(d)::BIGINT AS hops FROM h GROUP BY id"""
)
def f9_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two undirected steps of region 0, with the number of steps."""
    nation, supplier = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    pair = lambda a, b: F.struct(a.cast("bigint").alias("src"), b.cast("bigint").alias("dst"))
    e = nation.select(pair(F.col("n_nationkey") + 1000, F.col("n_regionkey")).alias("e")).unionAll(supplier.select(pair(F.col("s_suppkey") + 10000, F.col("s_nationkey") + 1000).alias("e"))).select("e.*")
    return within(e, spark.sql("SELECT 0L AS id"), 2)


def within(e: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hops) of nodes reachable from start by so many edges in either direction; each step visits new nodes only."""
    both = e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = frontier = start.select("id", F.lit(0).cast("bigint").alias("hops"))
    for step in range(1, hops + 1):
        reached = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(step).cast("bigint"))
        seen = seen.unionByName(frontier)
    return seen


@query(
    f"""WITH {EDGES_SQL}, n AS MATERIALIZED (SELECT src, type, dst FROM e WHERE dst = 'Regime:R' ORDER BY src, type LIMIT 49), k AS MATERIALIZED (SELECT src AS id FROM n UNION SELECT 'Regime:R')
    SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""
)
def f10_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star around an entity: 50 nodes at most, in order of id, and the edges between kept nodes."""
    e = edges(fact_rows(spark, sf_dir))
    kept = e.where("dst = 'Regime:R'").orderBy("src", "type").limit(49).select(F.col("src").alias("id"))
    kept = kept.unionAll(spark.sql("SELECT 'Regime:R' AS id"))
    left, right = kept.select(F.col("id").alias("src")), kept.select(F.col("id").alias("dst"))
    return e.join(F.broadcast(left), "src", "left_semi").join(F.broadcast(right), "dst", "left_semi").select("src", "type", "dst")


@query(
    f"""WITH {FACTS_SQL}, t AS (SELECT 'Experiment:' || document_id AS subject, 'USES_REGIME' AS predicate, regime AS object, chunk_id FROM facts
    UNION SELECT 'Experiment:' || document_id, 'MEASURES', property, chunk_id FROM facts UNION SELECT property, 'HAS_CHANGE', effect, chunk_id FROM facts WHERE effect <> 'unknown') SELECT * FROM t"""
)
def f20_relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact_rows(spark, sf_dir)
    one = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    experiment = F.concat(F.lit("Experiment:"), F.col("document_id").cast("string"))
    triples = F.array_compact(
        F.array(
            one(experiment, "USES_REGIME", F.col("regime")), one(experiment, "MEASURES", F.col("property")), F.when(F.col("effect") != "unknown", one(F.col("property"), "HAS_CHANGE", F.col("effect")))
        )
    )
    return rows.select("chunk_id", F.explode(triples).alias("t")).select("t.*", "chunk_id").distinct()


@query(
    f"""WITH {FACTS_SQL} SELECT document_id, array_to_string(list_sort(list(DISTINCT material)), ',') AS materials, array_to_string(list_sort(list(DISTINCT regime)), ',') AS regimes,
    max_by(property, (seq, property)) AS last_property, bool_or(effect = 'increase') AS has_change FROM facts GROUP BY document_id"""
)
def f21_experiment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples gathered to one row for each experiment; of single-valued predicates the last wins."""
    gathered = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return fact_rows(spark, sf_dir).groupBy("document_id").agg(
        gathered("material").alias("materials"), gathered("regime").alias("regimes"), F.max_by("property", F.struct("seq", "property")).alias("last_property"), F.bool_or(F.col("effect") == "increase").alias("has_change")
    )


@query(
    f"""WITH {FACTS_SQL}, k AS (SELECT DISTINCT document_id FROM facts WHERE value = 50), a AS (SELECT DISTINCT material FROM facts SEMI JOIN k USING (document_id) WHERE value > 48)
    SELECT seq FROM facts SEMI JOIN k USING (document_id) WHERE material IN (SELECT material FROM a)"""
)
def f22_pruned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of kept experiments whose subject is an allowed name."""
    rows = fact_rows(spark, sf_dir)
    inside = rows.join(rows.where("value = 50").select("document_id").distinct(), "document_id", "left_semi")
    return inside.join(inside.where("value > 48").select("material").distinct(), "material", "left_semi").select("seq")


def listing(rows: DataFrame) -> DataFrame:
    """(type, label, degree, facts) of every entity."""
    labels = F.array(*(F.struct(F.lit(kind).alias("type"), F.col(c).alias("label")) for _, c, kind in EDGES))
    return rows.select("document_id", F.explode(labels).alias("e")).groupBy("e.type", "e.label").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("document_id").alias("facts"))


LISTING_SQL = f"{FACTS_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS type, {c} AS label, document_id FROM facts" for _, c, kind in EDGES) + "), g AS (SELECT type, label, count(*) AS degree, count(DISTINCT document_id) AS facts FROM l GROUP BY ALL)"


@query(f"WITH {LISTING_SQL} SELECT * FROM g ORDER BY degree DESC, type, label LIMIT 40")
def g11_entity_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(fact_rows(spark, sf_dir)).orderBy(F.desc("degree"), "type", "label").limit(40)


@query(
    f"""WITH {FACTS_SQL} SELECT material AS entity, array_to_string(list_sort(list(DISTINCT regime)), ',') AS regimes, array_to_string(list_sort(list(DISTINCT property)), ',') AS properties,
    count(DISTINCT laboratory) AS laboratories, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM facts GROUP BY material"""
)
def g12_entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    gathered = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return fact_rows(spark, sf_dir).groupBy(F.col("material").alias("entity")).agg(
        gathered("regime").alias("regimes"), gathered("property").alias("properties"), F.countDistinct("laboratory").alias("laboratories"), F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks")
    )


@query(f"WITH {EDGES_SQL} SELECT type, count(*) AS n_edges, count(DISTINCT dst) AS n_targets FROM e GROUP BY type")
def g13_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(fact_rows(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("dst").alias("n_targets"))


@query(
    f"""WITH {FACTS_SQL}, r AS (SELECT material, regime FROM facts GROUP BY ALL HAVING count(*) > 10), d AS (SELECT material, regime || ' (' || property || ')' AS detail, regime FROM facts WHERE value > 49 GROUP BY ALL)
    SELECT material, regime FROM r ANTI JOIN (SELECT DISTINCT material, regime FROM d) USING (material, regime) UNION ALL SELECT material, detail FROM d"""
)
def g19_regime_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare regime is dropped where a detailed one with the same base stands."""
    rows = fact_rows(spark, sf_dir)
    bare = rows.groupBy("material", "regime").agg(F.count(F.lit(1)).alias("n")).where("n > 10").drop("n")
    detailed = rows.where("value > 49").select("material", "regime", F.format_string("%s (%s)", "regime", "property").alias("detail")).distinct()
    return bare.join(detailed.select("material", "regime").distinct(), ["material", "regime"], "left_anti").unionAll(detailed.select("material", F.col("detail").alias("regime")))


@query(
    f"""WITH {FACTS_SQL}, x AS (SELECT document_id, list(DISTINCT material) AS m, list(DISTINCT regime) AS r, list(DISTINCT property) AS p, list(DISTINCT equipment) AS q, list(DISTINCT laboratory) AS l FROM facts GROUP BY 1),
    a AS (SELECT * FROM x WHERE document_id = (SELECT min(document_id) FROM facts)),
    s AS (SELECT x.document_id, round(0.35::DOUBLE * list_has_any(x.m, a.m)::INT + 0.25 * list_has_any(x.r, a.r)::INT + 0.2 * list_has_any(x.p, a.p)::INT + 0.1 * list_has_any(x.q, a.q)::INT + 0.05 * list_has_any(x.l, a.l)::INT, 3)::DOUBLE AS score
    FROM x, a WHERE x.document_id <> a.document_id) SELECT document_id, score FROM s WHERE score > 0 ORDER BY score DESC, document_id LIMIT 50"""
)
def h13_similar_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments that share most with one anchor: one row of sets is broadcast, never all pairs."""
    rows = fact_rows(spark, sf_dir)
    sets = rows.groupBy("document_id").agg(*(F.collect_set(c).alias(c) for c in ("material", "regime", "property", "equipment", "laboratory")))
    first = rows.agg(F.min("document_id").alias("document_id"))
    anchor = rows.join(F.broadcast(first), "document_id", "left_semi").groupBy("document_id").agg(*(F.collect_set(c).alias(f"a_{c}") for c in ("material", "regime", "property", "equipment", "laboratory"))).withColumnRenamed("document_id", "a_id")
    weights = {"material": 0.35, "regime": 0.25, "property": 0.20, "equipment": 0.10, "laboratory": 0.05}
    score = reduce(lambda a, b: a + b, (F.when(F.arrays_overlap(c, f"a_{c}"), w).otherwise(0.0) for c, w in weights.items()))
    scored = sets.crossJoin(F.broadcast(anchor)).where("document_id <> a_id").select("document_id", F.round(score, 3).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "document_id").limit(50)


@query(
    f"""WITH {LISTING_SQL}, s AS (SELECT type, label, 10 + CASE WHEN label = 'Brand#11' THEN 60 WHEN label = 'R' THEN 45 ELSE 0 END + CASE type WHEN 'Material' THEN 8 WHEN 'Regime' THEN 6 WHEN 'Property' THEN 5 ELSE 2 END AS score FROM g)
    SELECT type, label, score::BIGINT AS score FROM s ORDER BY score DESC, type, label LIMIT 30"""
)
def h14_node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("type") == "Material", 8).when(F.col("type") == "Regime", 6).when(F.col("type") == "Property", 5).otherwise(2)
    score = 10 + F.when(F.col("label") == "Brand#11", 60).when(F.col("label") == "R", 45).otherwise(0) + weight
    return listing(fact_rows(spark, sf_dir)).select("type", "label", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "type", "label").limit(30)


@query(f"WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM facts) SELECT document_id, seq, k::BIGINT AS place FROM r WHERE k <= 3")
def g18_context_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three facts of each document, as a context takes them."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("seq")).cast("bigint")
    return fact_rows(spark, sf_dir).select("document_id", "seq").withColumn("place", place).where("place <= 3")
