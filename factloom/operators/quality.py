"""What becomes of extracted candidates: experiments with their confidence, verdicts, the quality report, and facts ranked for an answer.

An experiment is what one chunk tells of a material, or measures.  Its rules and those of its measurements are arrays within
the row of the chunk, so verdicts need no shuffle; only the counts of a report do, and they are combined before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.operators.extract import EXPERIMENT, LABORATORY, TEAM, _family_sql, any_of, any_sql, family, measurements, prose
from factloom.operators.guards import ADAPTERS, CHECKED_SQL, JUDGED_SQL, LEAST, SOFT_REASONS, checked_candidates, measurement_reason, split_rejections
from factloom.operators.relations import FORMS
from factloom.registry import query
from factloom.sources.domain import KEY, chunks

CONCLUSION = FORMS["conclusions"][0]
# Phrases that say that nothing was measured.
GAP_SIGNALS = ["нет данных", "не измер", "отсутств", "missing data", "not measured"]
# What an experiment's confidence is made of, in hundredths.
POINTS = {"start": 15, "material": 25, "regime": 20, "property": 20, "value": 15, "support": 10, "outcome": 10, "no_evidence": -20, "ambiguous": -20}
#: Reasons that are found before an experiment's measurements are looked at; its measurements share them.
EARLY = ["missing_material", "missing_regime_or_measurement", "missing_evidence", "gap_only_not_experiment"]


def experiment_confidence(has: dict[str, Column]) -> Column:
    """Points for what an experiment states, less for what it lacks, between 0 and 1 (E14).  has: a boolean for each of POINTS but start; null counts as false."""
    given = (F.when(has[name], points).otherwise(0) for name, points in POINTS.items() if name != "start")
    return F.greatest(F.lit(0), F.least(F.lit(100), sum(given, F.lit(POINTS["start"])))) / 100


def experiments(texts: DataFrame) -> DataFrame:
    """(order_id, line, text, and with_forms()) -> order_id, line, text, material, regime: array<string>, confidence, reason, found: array of measurements with reason.

    A chunk that names no material and measures nothing is no experiment.  reason: the first rule that the experiment fails, null if it is accepted.  The reason of a
    measurement is its own, unless the experiment was ruled out before its measurements; an accepted measurement of an experiment that isn't has the experiment's.
    """
    plain = F.col("plain")
    names = {d: V.all_names(d).alias(d) for d in ("material", "regime", "equipment")}
    # One row out of one: what is looked up in a text is computed before the filter and not once more after it.
    rows = texts.select(*KEY, "text", "plain", F.inline_outer(F.array(F.struct(*names.values(), measurements(plain).alias("m")))))
    rows = rows.where((F.size("material") > 0) | (F.size("m") > 0)).withColumn("found", F.transform("m", lambda m: F.struct(m.alias("m"), measurement_reason(m, plain).alias("own"))))
    ids = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(EXPERIMENT), F.lit(1)), lambda x: F.ltrim(x, F.lit(" ("))))
    has = {
        "material": F.size("material") > 0,
        "regime": F.size("regime") > 0,
        "property": F.exists("m", lambda m: m["property"] != ""),
        "value": F.exists("m", lambda m: m["value"].isNotNull() & F.coalesce(m["unit"] != "", F.lit(False))),
        "support": (F.size("equipment") > 0) | F.col("text").rlike(LABORATORY) | F.col("text").rlike(TEAM),
        "outcome": plain.rlike(CONCLUSION) | F.exists("m", lambda m: m["effect"] != "unknown"),
        "no_evidence": plain == "",
        "ambiguous": F.size(ids) > 1,
    }
    rows = rows.withColumn("confidence", experiment_confidence(has))
    none = F.size("m") == 0
    reason = (
        F.when(~has["material"], "missing_material")
        .when(~has["regime"] & none, "missing_regime_or_measurement")
        .when(has["no_evidence"], "missing_evidence")
        .when(none & any_of(plain, GAP_SIGNALS), "gap_only_not_experiment")
        .when(~none & F.forall("found", lambda x: x["own"].isNotNull()), "all_measurements_rejected")
        .when(F.col("confidence") < LEAST, "low_confidence")
    )
    rows = rows.withColumn("reason", reason)
    shared = F.when(F.col("reason").isin(EARLY), F.col("reason"))
    found = F.transform("found", lambda x: F.struct(x["m"]["property"].alias("property"), x["m"]["value"].alias("value"), x["m"]["unit"].alias("unit"), x["m"]["effect"].alias("effect"), F.coalesce(shared, x["own"], F.col("reason")).alias("reason")))
    return rows.select(*KEY, "text", "material", "regime", "confidence", "reason", found.alias("found"))


#: e: experiments; f: their measurements.
EXPERIMENTS_SQL = f"""{JUDGED_SQL},
    s AS (SELECT uid, count(*) AS n_m, bool_or(value IS NOT NULL AND coalesce(unit <> '', false)) AS valued, bool_or(effect <> 'unknown') AS moved, bool_or(reason IS NULL) AS some_good FROM v GROUP BY uid),
    p AS (SELECT t.uid, t.order_id, t.line, t.text, t.plain, {V.all_sql('material')} AS materials, {V.all_sql('regime')} AS regimes, {V.all_sql('equipment')} AS devices, coalesce(n_m, 0) AS n_m,
        coalesce(valued, false) AS valued, coalesce(moved, false) AS moved, coalesce(some_good, false) AS some_good FROM t LEFT JOIN s USING (uid)),
    h AS (SELECT *, greatest(0, least(100, {POINTS['start']} + CASE WHEN len(materials) > 0 THEN {POINTS['material']} ELSE 0 END + CASE WHEN len(regimes) > 0 THEN {POINTS['regime']} ELSE 0 END + CASE WHEN n_m > 0 THEN {POINTS['property']} ELSE 0 END
        + CASE WHEN valued THEN {POINTS['value']} ELSE 0 END + CASE WHEN len(devices) > 0 OR regexp_matches(text, '{LABORATORY}') OR regexp_matches(text, '{TEAM}') THEN {POINTS['support']} ELSE 0 END
        + CASE WHEN moved OR regexp_matches(plain, '{CONCLUSION}') THEN {POINTS['outcome']} ELSE 0 END + CASE WHEN plain = '' THEN {POINTS['no_evidence']} ELSE 0 END
        + CASE WHEN len(list_distinct(list_transform(regexp_extract_all(text, '{EXPERIMENT}', 1), lambda x: ltrim(x, ' (')))) > 1 THEN {POINTS['ambiguous']} ELSE 0 END)) / 100 AS confidence FROM p WHERE len(materials) > 0 OR n_m > 0),
    e AS (SELECT *, CASE WHEN len(materials) = 0 THEN 'missing_material' WHEN len(regimes) = 0 AND n_m = 0 THEN 'missing_regime_or_measurement' WHEN plain = '' THEN 'missing_evidence'
        WHEN n_m = 0 AND {any_sql('plain', GAP_SIGNALS)} THEN 'gap_only_not_experiment' WHEN n_m > 0 AND NOT some_good THEN 'all_measurements_rejected' WHEN confidence < {LEAST} THEN 'low_confidence' END AS verdict FROM h),
    f AS (SELECT e.uid, e.order_id, e.line, e.text, e.materials, e.regimes, v.property, v.value, v.unit, v.effect, CASE WHEN e.verdict IN ({', '.join(f"'{r}'" for r in EARLY)}) THEN e.verdict ELSE coalesce(v.reason, e.verdict) END AS reason FROM v JOIN e USING (uid))"""


@query(f"WITH {EXPERIMENTS_SQL} SELECT order_id, line, array_to_string(materials, ';') AS materials, round(confidence, 6) AS confidence, verdict AS reason FROM e")
def e14_experiment_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every experiment that a chunk tells of, its confidence, and the first rule that it fails."""
    return experiments(prose(spark, sf_dir)).select(*KEY, F.array_join("material", ";").alias("materials"), F.round("confidence", 6).alias("confidence"), "reason")


_SPLIT_SQL = f"CASE WHEN reason IN ({', '.join(f'{chr(39)}{r}{chr(39)}' for r in SOFT_REASONS)}) THEN 'quarantine' ELSE 'rejected' END"


def outcomes(texts: DataFrame) -> DataFrame:
    """(order_id, line, text) -> extractor, fact_type, reasons: array<string>, status: a row for each candidate: experiments, measurements, and facts of sentences."""
    told = experiments(V.with_forms(texts))
    of = lambda kind, fact_type, reason: F.struct(F.lit(kind).alias("extractor"), fact_type.alias("fact_type"), reason.alias("reason"))
    whole = F.array(of("experiment", F.lit("ExperimentResultFact"), F.col("reason")))
    parts = F.transform("found", lambda m: of("measurement", family(m["property"], m["unit"]), m["reason"]))
    ruled = split_rejections(told.select(F.explode(F.concat(whole, parts)).alias("o")).select("o.*"))
    ruled = ruled.select("extractor", "fact_type", F.array_compact(F.array("reason")).alias("reasons"), F.when(F.col("reason").isNull(), "accepted").otherwise(F.col("status")).alias("status"))
    return ruled.unionByName(checked_candidates(texts).select(F.col("extractor_name").alias("extractor"), "fact_type", "reasons", "status"))


_OUTCOMES_SQL = f"""SELECT 'experiment' AS extractor, 'ExperimentResultFact' AS fact_type, coalesce(reason, '') AS reasons, status FROM (WITH {EXPERIMENTS_SQL} SELECT verdict AS reason, CASE WHEN verdict IS NULL THEN 'accepted' ELSE {_SPLIT_SQL.replace('reason', 'verdict')} END AS status FROM e)
    UNION ALL SELECT 'measurement', fact_type, coalesce(reason, ''), status FROM (WITH {EXPERIMENTS_SQL} SELECT {_family_sql()} AS fact_type, reason, CASE WHEN reason IS NULL THEN 'accepted' ELSE {_SPLIT_SQL} END AS status FROM f)
    UNION ALL SELECT 'extractive_' || CASE adapter {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ADAPTERS.items())} END || '_adapter', fact_type, reasons, CASE WHEN reasons = '' THEN 'accepted' ELSE 'quarantine' END FROM (WITH {CHECKED_SQL} SELECT adapter, fact_type, reasons FROM r)"""


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "text")


@query(f"WITH o AS ({_OUTCOMES_SQL}), r AS (SELECT extractor, fact_type, status, unnest(string_split(reasons, ',')) AS reason FROM o WHERE reasons <> '') SELECT extractor, fact_type, reason, status, count(*) AS n FROM r GROUP BY ALL")
def e18_rejection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections of experiments, measurements and facts of sentences by reason; those of soft reasons are kept for review."""
    return outcomes(_prose(spark, sf_dir)).select("extractor", "fact_type", F.explode("reasons").alias("reason"), "status").groupBy("extractor", "fact_type", "reason", "status").agg(F.count(F.lit(1)).alias("n"))


def quality_report(results: DataFrame) -> DataFrame:
    """outcomes() -> extractor, fact_type, candidates, accepted, rejected, quarantined, acceptance_rate (G14)."""
    of = lambda status: F.count_if(F.col("status") == status)
    rows = results.groupBy("extractor", "fact_type").agg(F.count(F.lit(1)).alias("candidates"), of("accepted").alias("accepted"), of("rejected").alias("rejected"), of("quarantine").alias("quarantined"))
    return rows.withColumn("acceptance_rate", F.round(F.col("accepted") / F.col("candidates"), 6))


@query(
    f"""WITH o AS ({_OUTCOMES_SQL}) SELECT extractor, fact_type, count(*) AS candidates, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'quarantine') AS quarantined,
    round(count(*) FILTER (status = 'accepted') / count(*), 6) AS acceptance_rate FROM o GROUP BY ALL"""
)
def g14_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was extracted from the chunks and what became of it, by extractor and type of fact."""
    return quality_report(outcomes(_prose(spark, sf_dir)))


# What a fact's score is made of.
SCORES = {"material": 12, "regime": 12, "property": 12, "value": 10, "unit": 8, "effect": 8, "evidence": 10, "table": 6, "made_id": -16, "no_effect": -6, "no_regime": -5}
# Signs that a quote comes from a table.
TABLE_SIGNS = ["table columns", ".csv", ".xlsx"]
PRIMARY, SUPPORTING = 5, 20


def fact_score(has: dict[str, Column]) -> Column:
    """has: a boolean for each of SCORES; null counts as false."""
    return reduce(lambda a, b: a + b, (F.when(has[name], points).otherwise(0) for name, points in SCORES.items()))


def answer_tiers(facts: DataFrame, by: str, ties: list[Column]) -> DataFrame:
    """facts (by, score, exact: boolean, ...) with tier and place, which replace columns of these names: of each `by` (null is one too) the five best exact facts are primary and the next twenty supporting (H12).

    Each partition keeps 25 rows of a group before the shuffle, so a hot group costs no more than another.  A null `exact` is none, a null score comes last.
    """
    best = [F.desc("score"), *ties]
    near = facts.withColumn("_among", F.row_number().over(Window.partitionBy(by, "exact").orderBy(*best))).where(F.col("_among") <= PRIMARY + SUPPORTING)
    tiered = near.withColumn("tier", F.when(F.col("exact") & (F.col("_among") <= PRIMARY), "primary").otherwise("supporting"))
    placed = tiered.withColumn("place", F.row_number().over(Window.partitionBy(by, "tier").orderBy(*best)))
    return placed.where((F.col("tier") == "primary") | (F.col("place") <= SUPPORTING)).drop("_among")


_STATED_SQL = f"regexp_matches(text, '{EXPERIMENT}')"


@query(
    f"""WITH {EXPERIMENTS_SQL}, d AS (SELECT DISTINCT order_id, line, unnest(materials) AS material, coalesce(regimes[1], '') AS regime, property, value, unit, effect, NOT {_STATED_SQL} AS made, {any_sql('lower(text)', TABLE_SIGNS)} AS from_table FROM f WHERE reason IS NULL),
    g AS (SELECT *, regime <> '' AS exact, {SCORES['material'] + SCORES['property'] + SCORES['evidence']} + CASE WHEN regime <> '' THEN {SCORES['regime']} ELSE {SCORES['no_regime']} END + CASE WHEN value IS NOT NULL THEN {SCORES['value']} ELSE 0 END + CASE WHEN unit <> '' THEN {SCORES['unit']} ELSE 0 END
        + CASE WHEN effect <> 'unknown' THEN {SCORES['effect']} ELSE {SCORES['no_effect']} END + CASE WHEN from_table THEN {SCORES['table']} ELSE 0 END + CASE WHEN made THEN {SCORES['made_id']} ELSE 0 END AS score FROM d),
    q AS (SELECT *, row_number() OVER (PARTITION BY material, exact ORDER BY score DESC, order_id, line, property, value NULLS FIRST, unit NULLS FIRST, effect) AS k FROM g),
    l AS (SELECT *, CASE WHEN exact AND k <= {PRIMARY} THEN 'primary' ELSE 'supporting' END AS tier FROM q),
    o AS (SELECT *, row_number() OVER (PARTITION BY material, tier ORDER BY score DESC, order_id, line, property, value NULLS FIRST, unit NULLS FIRST, effect) AS place FROM l)
    SELECT material, tier, place, order_id, line, regime, property, value, unit, effect, score::INT AS score FROM o WHERE tier = 'primary' OR place <= {SUPPORTING}"""
)
def h12_answer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted measurements of every material, as an answer about it would rank them."""
    low, stated = F.lower("text"), F.col("text").rlike(EXPERIMENT)
    rows = experiments(prose(spark, sf_dir)).select(
        *KEY,
        F.explode_outer("material").alias("material"),
        F.coalesce(F.get("regime", F.lit(0)), F.lit("")).alias("regime"),
        (~stated).alias("made"),
        any_of(low, TABLE_SIGNS).alias("from_table"),
        F.filter("found", lambda m: m["reason"].isNull()).alias("found"),
    )
    # Outer explodes: those of the other kind are filtered by the size of their arrays first, for which all of a text's rules would be tried twice.
    facts = rows.select("*", F.explode_outer("found").alias("m")).where("material IS NOT NULL AND m IS NOT NULL").select(*KEY, "material", "regime", "made", "from_table", "m.property", "m.value", "m.unit", "m.effect").distinct()
    full = lambda c: F.col(c) != ""
    moved = F.col("effect") != "unknown"
    has = {"material": full("material"), "regime": full("regime"), "property": full("property"), "value": F.col("value").isNotNull(), "unit": full("unit"), "effect": moved, "evidence": F.lit(True), "table": F.col("from_table"), "made_id": F.col("made"), "no_effect": ~moved, "no_regime": ~full("regime")}
    ranked = answer_tiers(facts.withColumn("score", fact_score(has)).withColumn("exact", full("regime")), "material", [F.col("order_id"), F.col("line"), F.col("property"), F.asc_nulls_first("value"), F.asc_nulls_first("unit"), F.col("effect")])
    return ranked.select("material", "tier", "place", *KEY, "regime", "property", "value", "unit", "effect", "score")
