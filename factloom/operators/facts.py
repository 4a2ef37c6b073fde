"""The canonical fact layer: normalisation, keys, dedupe, conflicts, gaps, deltas.

Every rule about a set of rows is one aggregation by the canonical key, with partial aggregates before the shuffle;
evidence is counted and hashed rather than carried where only its number matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import units as U
from factloom.functions.text import canonical
from factloom.registry import query
from factloom.sources.tables import FACTS_SQL, fact_rows, load


def key_part(x: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("ё"), F.lit("е"))


def effect_part(x: Column) -> Column:
    e = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(e.isin("", "unknown", "none", "null"), "").otherwise(e)


def normalized(rows: DataFrame) -> DataFrame:
    """Adds value_normalized, unit_normalized, family, value_text, effect_part and canonical_fact_key."""
    mpa = U.to_mpa(F.col("value"), F.col("unit"))
    out = (
        rows.withColumn("value_normalized", F.coalesce(mpa, F.col("value")))
        .withColumn("unit_normalized", F.when(mpa.isNotNull(), "MPa").otherwise(U.unit_label(F.col("unit"))))
        .withColumn("family", F.when(mpa.isNotNull(), "strength").when(F.col("value").isNotNull(), "raw_numeric"))
        .withColumn("value_text", U.value_text(F.col("value_normalized")))
        .withColumn("effect_part", effect_part(F.col("effect")))
    )
    parts = ["material", "regime", "property", "value_text", "unit_normalized", "effect_part"]
    return out.withColumn("canonical_fact_key", F.concat_ws("|", *(key_part(F.col(p)) for p in parts)))


N_SQL = f"""{FACTS_SQL}, n AS (SELECT *, CASE unit WHEN 'ksi' THEN value * 6.894757 ELSE value END AS value_normalized, 'MPa' AS unit_normalized,
  CASE WHEN effect = 'unknown' THEN '' ELSE effect END AS effect_part,
  regexp_replace(printf('%.3f', round(CASE unit WHEN 'ksi' THEN value * 6.894757 ELSE value END, 3)), '\\.?0+$', '') AS value_text FROM facts),
  k AS (SELECT *, concat_ws('|', lower(material), lower(regime), lower(property), value_text, 'mpa', effect_part) AS canonical_fact_key FROM n)"""


def _n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(fact_rows(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linestatus = 'O' THEN round(l_quantity * 6.894757, 6) ELSE l_quantity END AS mpa FROM lineitem")
def d5_strength_mpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linestatus") == "O", "ksi").otherwise("MPa")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.round(U.to_mpa(F.col("l_quantity"), unit), 6).alias("mpa"))


@query(f"WITH {N_SQL} SELECT seq, value AS value_original, unit AS unit_original, round(value_normalized, 6) AS value_normalized, unit_normalized, 'strength' AS family FROM n")
def d6_measurement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).select("seq", F.col("value").alias("value_original"), F.col("unit").alias("unit_original"), F.round("value_normalized", 6).alias("value_normalized"), "unit_normalized", "family")


@query(f"WITH {N_SQL} SELECT seq, canonical_fact_key FROM k")
def d13_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).select("seq", "canonical_fact_key")


@query(f"WITH {N_SQL} SELECT material, regime, property, count(*) AS n_rows, count(DISTINCT value_text) AS n_values FROM k GROUP BY ALL")
def f16_fact_row_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each material, regime and property of an experiment's arrays, which are never made: they would only be taken apart again."""
    rows = _n(spark, sf_dir).groupBy("material", F.coalesce("regime", F.lit("")).alias("regime"), "property", "value_text").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("material", "regime", "property").agg(F.sum("n").alias("n_rows"), F.count("value_text").alias("n_values"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each canonical key: the first row's fields, all evidence, and the first experiment that has one."""
    first = F.min(F.struct("seq", "material", "regime", "property", "value_normalized", "unit_normalized", "value_text", "effect_part", "equipment", "laboratory"))
    # Each piece of evidence is one row first: counting distinct ones beside other aggregates would expand every row.
    pieces = normalized(rows).groupBy("canonical_fact_key", "document_id", "chunk_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    whole = pieces.groupBy("canonical_fact_key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("evidence_count"), F.sum("n").alias("raw_count"), F.max("top").alias("max_value"))
    return whole.select("canonical_fact_key", "first.*", "evidence_count", "raw_count", "max_value")


@query(f"WITH {N_SQL} SELECT canonical_fact_key, min(seq) AS seq, any_value(material) AS material, count(DISTINCT (document_id, chunk_id)) AS evidence_count, count(*) AS raw_count FROM k GROUP BY canonical_fact_key")
def g1_fact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(fact_rows(spark, sf_dir)).select("canonical_fact_key", "seq", "material", "evidence_count", "raw_count")


@query(f"WITH {N_SQL} SELECT property, value_text, unit_normalized, effect_part, max(tax) AS confidence, count(*) AS n FROM k GROUP BY ALL")
def g2_measurement_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).groupBy("property", "value_text", "unit_normalized", "effect_part").agg(F.max("tax").alias("confidence"), F.count(F.lit(1)).alias("n"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Triples with two or more distinct value identities: (value, unit|effect), or the effect alone where there is no value."""
    triple = ["material", "regime", "property"]
    n = normalized(rows).select(*(canonical(F.col(c)).alias(c) for c in triple), "value_text", "unit_normalized", "effect_part", "unit", "document_id", "chunk_id")
    # Distinct values and distinct sources are counted apart: each is one hash aggregation, where together every row would be expanded.
    values = n.groupBy(*triple, "value_text", "unit_normalized", "effect_part", "unit").agg(F.count(F.lit(1)).alias("n"))
    identity = F.when(F.col("value_text") != "", F.concat_ws("|", "value_text", "unit_normalized", "effect_part")).when(F.col("effect_part") != "", F.concat(F.lit("|"), "effect_part"))
    effect = F.when(F.col("effect_part") != "", F.col("effect_part"))
    grouped = values.groupBy(*triple).agg(
        F.size(F.collect_set(identity)).cast("bigint").alias("n_identities"),
        F.sort_array(F.collect_set("value_text")).alias("all_values"),
        F.sort_array(F.collect_set("unit")).alias("source_units"),
        F.min(effect).alias("low"),
        F.max(effect).alias("high"),
    )
    reason = F.when(F.size("source_units") > 1, "units").when(F.col("low") < F.col("high"), "effects").otherwise("values")
    found = grouped.where("n_identities >= 2 AND material <> '' AND regime <> '' AND property <> ''").withColumn("reason", reason).drop("low", "high")
    sources = n.groupBy(*triple, "document_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*triple).agg(F.count(F.lit(1)).alias("sources_count"))
    return found.join(sources, triple)


@query(
    f"""WITH {N_SQL}, g AS (SELECT lower(material) AS material, lower(regime) AS regime, lower(property) AS property, count(DISTINCT concat_ws('|', value_text, unit_normalized, effect_part)) AS n_identities,
    array_to_string(list_sort(list(DISTINCT value_text))[1:10], ',') AS "values", array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, count(DISTINCT (document_id, chunk_id)) AS sources_count,
    CASE WHEN count(DISTINCT unit) > 1 THEN 'units' WHEN count(DISTINCT nullif(effect_part, '')) > 1 THEN 'effects' ELSE 'values' END AS reason FROM k GROUP BY 1, 2, 3)
    SELECT * FROM g WHERE n_identities >= 2"""
)
def g3_conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(fact_rows(spark, sf_dir)).select(
        "material", "regime", "property", "n_identities", F.array_join(F.slice("all_values", 1, 10), ",").alias("values"), F.array_join("source_units", ",").alias("units"), "sources_count", "reason"
    )


@query(f"WITH {N_SQL} SELECT canonical_fact_key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def g4_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).groupBy("canonical_fact_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    f"""WITH {N_SQL}, c AS (SELECT canonical_fact_key, count(*) AS n FROM k GROUP BY 1)
    SELECT (SELECT count(*) FROM k) AS raw_facts, (SELECT count(*) FROM c) AS canonical_facts, (SELECT count(*) FROM c WHERE n > 1) AS duplicate_groups,
    (SELECT count(*) FROM k) - (SELECT count(*) FROM c) AS duplicate_facts, (SELECT count(DISTINCT material) FROM k) AS materials, (SELECT count(DISTINCT regime) FROM k) AS regimes, (SELECT count(DISTINCT property) FROM k) AS properties"""
)
def g5_expansion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the knowledge report, over the canonical rows: one aggregation by key, one over its result."""
    return deduplicated(fact_rows(spark, sf_dir)).agg(
        F.sum("raw_count").alias("raw_facts"),
        F.count(F.lit(1)).alias("canonical_facts"),
        F.count_if(F.col("raw_count") > 1).alias("duplicate_groups"),
        (F.sum("raw_count") - F.count(F.lit(1))).alias("duplicate_facts"),
        F.countDistinct("material").alias("materials"),
        F.countDistinct("regime").alias("regimes"),
        F.countDistinct("property").alias("properties"),
    )


@query(
    f"""WITH {N_SQL}, a AS (SELECT canonical_fact_key, count(*) FILTER (document_id % 3 <> 0) AS before, count(*) AS after FROM k GROUP BY 1)
    SELECT canonical_fact_key, before, after, CASE WHEN before = 0 THEN 'new' WHEN after > before THEN 'corroborated' ELSE 'unchanged' END AS state FROM a"""
)
def g6_knowledge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before: the facts of two thirds of the orders; after: all.  Both reports are read off one aggregation by key."""
    rows = _n(spark, sf_dir)
    both = rows.groupBy("canonical_fact_key").agg(F.count_if(F.col("document_id") % 3 != 0).alias("before"), F.count(F.lit(1)).alias("after"))
    return both.withColumn("state", F.when(F.col("before") == 0, "new").when(F.col("after") > F.col("before"), "corroborated").otherwise("unchanged"))


@query(
    f"""WITH {FACTS_SQL} SELECT 'same_property_different_materials' AS type, property AS subject, '' AS detail, count(DISTINCT material) AS n FROM facts GROUP BY property HAVING count(DISTINCT material) >= 2
    UNION ALL SELECT 'same_material_property_different_regimes', material, property, count(DISTINCT regime) FROM facts GROUP BY material, property HAVING count(DISTINCT regime) >= 2"""
)
def g7_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = fact_rows(spark, sf_dir).select("material", "regime", "property").distinct()
    one = triples.groupBy("property").agg(F.countDistinct("material").alias("n")).select(F.lit("same_property_different_materials").alias("type"), F.col("property").alias("subject"), F.lit("").alias("detail"), "n")
    two = triples.groupBy("material", "property").agg(F.countDistinct("regime").alias("n")).select(F.lit("same_material_property_different_regimes").alias("type"), F.col("material").alias("subject"), F.col("property").alias("detail"), "n")
    return one.unionByName(two).where("n >= 2")


@query(f"WITH {FACTS_SQL} SELECT DISTINCT material, regime, property FROM facts")
def g8_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).select("material", "regime", "property").distinct()


#: Combinations of labels that may be asked for.
GRID = 50_000_000
GRID_SQL = "m AS (SELECT DISTINCT material FROM facts), r AS (SELECT DISTINCT regime FROM facts), p AS (SELECT DISTINCT property FROM facts), w AS (SELECT * FROM m, r, p)"


@query(f"WITH {FACTS_SQL}, {GRID_SQL}, s AS (SELECT DISTINCT material, regime, property FROM facts WHERE value > 45) SELECT material, regime, property, 'gap_' || substr(sha256(concat_ws('|', material, regime, property)), 1, 24) AS gap_id FROM w ANTI JOIN s USING (material, regime, property)")
def f8_inferred_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested triples without a fact: an anti-join of the vocabulary grid with the high values.

    The grid is what is asked for, so it may have GRID cells at most: the labels are counted first.
    """
    rows = fact_rows(spark, sf_dir)
    axes = ["material", "regime", "property"]
    cells = math.prod(rows.agg(*(F.countDistinct(c) for c in axes)).first())
    if cells > GRID:
        raise ValueError(f"{cells} combinations were asked for, more than {GRID}: ask for fewer labels")
    wanted = rows.agg(*(F.collect_set(c).alias(c) for c in axes))
    for c in axes:
        wanted = wanted.withColumn(c, F.explode(c))
    missing = wanted.join(rows.where("value > 45").select("material", "regime", "property"), ["material", "regime", "property"], "left_anti")
    return missing.withColumn("gap_id", F.concat(F.lit("gap_"), F.substring(F.sha2(F.concat_ws("|", "material", "regime", "property"), 256), 1, 24)))


@query(
    f"""WITH {FACTS_SQL}, g AS (SELECT material, regime, property, 'no values above 49' AS reason, count(*) AS n_facts, max(value) AS top FROM facts GROUP BY 1, 2, 3)
    SELECT concat_ws('|', lower(material), lower(regime), lower(property), reason) AS gap_key, n_facts, 'Measure ' || property || ' of ' || material || ' under ' || regime || '.' AS question FROM g WHERE top <= 49"""
)
def g10_gap_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by canonical triple and reason, with the research question each gives (g9)."""
    gaps = fact_rows(spark, sf_dir).groupBy("material", "regime", "property").agg(F.count(F.lit(1)).alias("n_facts"), F.max("value").alias("top")).where("top <= 49")
    key = F.concat_ws("|", *(key_part(F.col(c)) for c in ("material", "regime", "property")), F.lit("no values above 49"))
    return gaps.select(key.alias("gap_key"), "n_facts", F.format_string("Measure %s of %s under %s.", "property", "material", "regime").alias("question"))


@query(f"WITH {N_SQL} SELECT material, regime, count(DISTINCT document_id) AS experiments, array_to_string(list_sort(list(DISTINCT property)), ',') AS properties, array_to_string(list_sort(list(DISTINCT effect)), ',') AS effects FROM k GROUP BY 1, 2")
def g15_grouped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("material", "regime").agg(
        F.countDistinct("document_id").alias("experiments"), F.array_join(F.sort_array(F.collect_set("property")), ",").alias("properties"), F.array_join(F.sort_array(F.collect_set("effect")), ",").alias("effects")
    )


@query(
    f"""WITH {N_SQL} SELECT material, round(min(value_normalized), 6) AS low, round(max(value_normalized), 6) AS high, array_to_string(list_sort(list(DISTINCT value_text))[1:3], ',') AS sample,
    count(DISTINCT unit) > 1 AS mixed_units FROM k GROUP BY material"""
)
def g16_comparison_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).groupBy("material").agg(
        F.round(F.min("value_normalized"), 6).alias("low"),
        F.round(F.max("value_normalized"), 6).alias("high"),
        F.array_join(F.slice(F.sort_array(F.collect_set("value_text")), 1, 3), ",").alias("sample"),
        (F.countDistinct("unit") > 1).alias("mixed_units"),
    )


@query(f"WITH {FACTS_SQL} SELECT material, regime, property, count(DISTINCT value::VARCHAR || ' ' || unit) AS n FROM facts GROUP BY 1, 2, 3 HAVING count(DISTINCT value::VARCHAR || ' ' || unit) > 1")
def g20_conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("material", "regime", "property").agg(F.countDistinct(F.concat_ws(" ", F.col("value").cast("string"), "unit")).alias("n")).where("n > 1")


_CONFLICT_SQL = "x AS (SELECT material, regime, property FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT concat_ws('|', value_text, effect_part)) >= 60)"


@query(f"WITH {N_SQL}, {_CONFLICT_SQL} SELECT seq, canonical_fact_key FROM k SEMI JOIN x USING (material, regime, property)")
def f17_facts_in_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose triple has 60 or more distinct value identities."""
    rows = _n(spark, sf_dir)
    keys = ["material", "regime", "property"]
    bad = rows.groupBy(*keys).agg(F.countDistinct("value_text", "effect_part").alias("n")).where("n >= 60")
    return rows.join(bad, keys, "left_semi").select("seq", "canonical_fact_key")


@query(f"WITH {FACTS_SQL} SELECT seq, material, value FROM facts WHERE material = 'Brand#11' AND regime = 'R' AND lower(property) = (SELECT lower(min(p_type)) FROM part)")
def f1_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one material, regime and property, compared in canonical form."""
    wanted = load(spark, sf_dir, "part").agg(canonical(F.min("p_type")).alias("wanted"))
    rows = fact_rows(spark, sf_dir).where((F.col("material") == "Brand#11") & (F.col("regime") == "R"))
    return rows.join(F.broadcast(wanted), canonical(F.col("property")) == F.col("wanted")).select("seq", "material", "value")


def find(rows: DataFrame, material: str | None = None, regime: str | None = None, property: str | None = None) -> DataFrame:
    """Rows that meet the given constraints; one that isn't given isn't in the plan."""
    for column, wanted in (("material", material), ("regime", regime), ("property", property)):
        if wanted is not None:
            rows = rows.where(key_part(F.col(column)) == wanted.strip().lower().replace("ё", "е"))
    return rows


@query(f"WITH {FACTS_SQL} SELECT seq, material, regime, property, value FROM facts WHERE lower(regime) = 'a' AND lower(material) = 'brand#23' ORDER BY seq LIMIT 200")
def f2_find_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(fact_rows(spark, sf_dir), material="Brand#23", regime="A").orderBy("seq").limit(200).select("seq", "material", "regime", "property", "value")


@query(
    f"""WITH {FACTS_SQL}, p AS (SELECT min(p_type) AS t FROM part), b AS (
    SELECT 'material' AS bucket, seq FROM facts WHERE material = 'Brand#11' UNION ALL SELECT 'material_regime', seq FROM facts WHERE material = 'Brand#11' AND regime = 'R'
    UNION ALL SELECT 'material_property', seq FROM facts, p WHERE material = 'Brand#11' AND property = t UNION ALL SELECT 'regime_property', seq FROM facts, p WHERE regime = 'R' AND property = t),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS place FROM b) SELECT bucket, seq, place FROM r WHERE place <= 5"""
)
def f3_partial_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows for each way of matching two of three: one scan, one small sorted list for each bucket."""
    wanted = load(spark, sf_dir, "part").agg(F.min("p_type").alias("t"))
    rows = fact_rows(spark, sf_dir).crossJoin(F.broadcast(wanted))
    m, r, p = F.col("material") == "Brand#11", F.col("regime") == "R", F.col("property") == F.col("t")
    named = F.array_compact(F.array(F.when(m, "material"), F.when(m & r, "material_regime"), F.when(m & p, "material_property"), F.when(r & p, "regime_property")))
    parts = [rows.select("seq", F.explode(named).alias("bucket")).where(F.col("bucket") == b).orderBy("seq").limit(5) for b in ("material", "material_regime", "material_property", "regime_property")]
    found = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return found.select("bucket", "seq", F.row_number().over(Window.partitionBy("bucket").orderBy("seq")).cast("bigint").alias("place"))


@query(f"WITH {FACTS_SQL} SELECT material, min(regime) AS first_regime, count(DISTINCT equipment) AS equipment, count(DISTINCT laboratory) AS laboratories, count(*) AS measurements FROM facts GROUP BY material")
def f4_decision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("material").agg(F.min("regime").alias("first_regime"), F.countDistinct("equipment").alias("equipment"), F.countDistinct("laboratory").alias("laboratories"), F.count(F.lit(1)).alias("measurements"))


@query(f"WITH {N_SQL}, c AS (SELECT canonical_fact_key, max(tax) AS confidence, min(seq) AS fact_id FROM k GROUP BY 1) SELECT fact_id, confidence FROM c ORDER BY confidence DESC, fact_id LIMIT 100")
def f6_accepted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 surest canonical facts; the first row of a key names it."""
    best = _n(spark, sf_dir).groupBy("canonical_fact_key").agg(F.max("tax").alias("confidence"), F.min("seq").alias("fact_id"))
    return best.select("fact_id", "confidence").orderBy(F.desc("confidence"), "fact_id").limit(100)


@query(
    f"""WITH {N_SQL} SELECT seq, value_normalized BETWEEN 100 AND 200 AS in_range, value_normalized <= 150 AS at_most, abs(value_normalized - 150) <= 0.02 * 150 AS near FROM n
    WHERE value_normalized BETWEEN 100 AND 200 OR value_normalized <= 150"""
)
def d9_numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact against a range, an upper bound and a value with 2 % tolerance, in MPa."""
    v = F.col("value_normalized")
    return _n(spark, sf_dir).where(v.between(100, 200) | (v <= 150)).select("seq", v.between(100, 200).alias("in_range"), (v <= 150).alias("at_most"), (F.abs(v - 150) <= 0.02 * 150).alias("near"))


def anchor_score(required: list[Column], optional: list[Column]) -> Column:
    """Share of anchors met; optional ones weigh .35."""
    met = lambda cs: sum((F.when(c, 1).otherwise(0) for c in cs), F.lit(0))
    return F.round((met(required) + 0.35 * met(optional)) / max(1.0, len(required) + 0.35 * len(optional)), 4)


@query(
    f"""WITH {FACTS_SQL}, s AS (SELECT seq, (material = 'Brand#11')::INT AS a, (regime = 'R')::INT AS b, (value > 25)::INT AS c, (effect = 'increase')::INT AS d FROM facts)
    SELECT seq, round((a + b + 0.35::DOUBLE * (c + d)) / (2 + 0.35::DOUBLE * 2), 4) AS score, CASE WHEN a + b + c + d = 4 THEN 'exact' WHEN b + c + d > 0 THEN 'relaxed' ELSE 'rejected' END AS level FROM s WHERE a + b > 0"""
)
def f14_typed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact: nothing asked for is missing.  Relaxed: something is there besides the material.  With the anchor score (f15)."""
    m, r, v, e = F.col("material") == "Brand#11", F.col("regime") == "R", F.col("value") > 25, F.col("effect") == "increase"
    level = F.when(m & r & v & e, "exact").when(r | v | e, "relaxed").otherwise("rejected")
    return fact_rows(spark, sf_dir).where(m | r).select("seq", anchor_score([m, r], [v, e]).alias("score"), level.alias("level"))


@query(
    f"""WITH {FACTS_SQL}, s AS (SELECT seq, round(0.5 + 0.25 + CASE WHEN value > 0 THEN 0.10 ELSE 0 END + CASE WHEN effect = 'increase' THEN 0.05 ELSE 0 END + tax, 6)::DOUBLE AS score FROM facts)
    SELECT seq, score FROM s ORDER BY score DESC, seq LIMIT 100"""
)
def h10_fact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(0.5) + 0.25 + F.when(F.col("value") > 0, 0.10).otherwise(0.0) + F.when(F.col("effect") == "increase", 0.05).otherwise(0.0) + F.col("tax")
    return fact_rows(spark, sf_dir).select("seq", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "seq").limit(100)


@query(f"WITH {FACTS_SQL}, c AS (SELECT laboratory, count(*) AS n FROM facts GROUP BY 1) SELECT laboratory, n FROM c ORDER BY n DESC, laboratory LIMIT 10")
def h16_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rows(spark, sf_dir).groupBy("laboratory").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "laboratory").limit(10)


@query(
    f"""WITH {FACTS_SQL}, r AS (SELECT property, CASE WHEN tax < 0.02 THEN 'low_confidence' WHEN value > 45 THEN 'unit_out_of_range' WHEN effect = 'unknown' AND unit = 'ksi' THEN 'missing_marker' END AS reason FROM facts)
    SELECT property, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL ORDER BY n DESC, reason, property LIMIT 10"""
)
def e19_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest first reasons (e15: rules in order, the first that fails)."""
    reason = F.coalesce(F.when(F.col("tax") < 0.02, "low_confidence"), F.when(F.col("value") > 45, "unit_out_of_range"), F.when((F.col("effect") == "unknown") & (F.col("unit") == "ksi"), "missing_marker"))
    rows = fact_rows(spark, sf_dir).select("property", reason.alias("reason")).where("reason IS NOT NULL")
    return rows.groupBy("property", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason", "property").limit(10)
