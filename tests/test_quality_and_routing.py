"""Verdicts on experiments, tiers of facts and routes of questions against results worked out by hand."""

import pytest

from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.operators import quality
from factloom.plans import routing
from factloom.plans.questions import plan

# Text, confidence in hundredths, reason of the experiment, reasons of its measurements; None: no experiment.
TOLD = [
    ("After annealing the alloy VT6 showed a tensile strength of 980 MPa.", 95, None, [None]),
    ("VT6 after annealing: tensile strength of 980 MPa. Research team Alpha did it. Conclusion: it is fit.", 100, None, [None]),
    ("Corrosion resistance of VT6 increased after annealing.", 90, "all_measurements_rejected", ["unknown_property_schema"]),
    ("A tensile strength of 980 MPa was seen.", 50, "missing_material", ["missing_material"]),
    ("VT6 is a good alloy.", 40, "missing_regime_or_measurement", []),
    ("VT6 after annealing.", 60, None, []),
    ("VT6 after annealing: нет данных.", 60, "gap_only_not_experiment", []),
    ("E1 and E2: VT6 after annealing.", 40, "low_confidence", []),
    ("E1 and E2: VT6, strength 980 MPa.", 55, None, [None]),
    ("Nothing of the domain.", None, None, []),
    ("", None, None, []),
    (None, None, None, []),
]


def frame(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "order_id bigint, line bigint, text string")


def test_experiments_with_verdicts(spark):
    rows = quality.experiments(V.with_forms(frame(spark, [t[0] for t in TOLD]))).collect()
    got = {r["line"]: (round(100 * r["confidence"]), r["reason"], [m["reason"] for m in r["found"]]) for r in rows}
    assert got == {i: (points, reason, parts) for i, (_, points, reason, parts) in enumerate(TOLD) if points is not None}


def test_repeated_chunks_stay_apart(spark):
    text = TOLD[0][0]
    twice = spark.createDataFrame([(1, 1, text), (1, 1, text)], "order_id bigint, line bigint, text string")
    assert quality.experiments(V.with_forms(twice)).count() == 2


def test_confidence_is_kept_between_bounds(spark):
    names = [n for n in quality.POINTS if n != "start"]
    rows = [dict.fromkeys(names, False), dict.fromkeys(names, True), {**dict.fromkeys(names, False), "no_evidence": True}, {**dict.fromkeys(names), "material": True}]
    made = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} boolean" for n in names))
    got = [r[0] for r in made.select(quality.experiment_confidence({n: F.col(n) for n in names})).collect()]
    assert got == [pytest.approx(x) for x in (0.15, 0.75, 0.0, 0.40)]


def test_report_counts_every_candidate(spark):
    texts = frame(spark, [t[0] for t in TOLD])
    report = {(r["extractor"], r["fact_type"]): tuple(r[c] for c in ("candidates", "accepted", "rejected", "quarantined", "acceptance_rate")) for r in quality.quality_report(quality.outcomes(texts)).collect()}
    assert report["experiment", "ExperimentResultFact"] == (9, 4, 3, 2, 0.444444)
    assert report["measurement", "MechanicalPropertyFact"] == (4, 3, 1, 0, 0.75)
    assert report["measurement", "ExperimentResultFact"] == (1, 0, 0, 1, 0.0)
    assert quality.quality_report(quality.outcomes(texts.limit(0))).count() == 0


def test_tiers_keep_five_exact_facts_first(spark):
    # Of one group thirty facts, the best of them not exact; of another three that aren't exact at all.
    rows = [("a", 100 - i, i >= 3, i) for i in range(30)] + [("b", 7, False, i) for i in range(3)] + [("c", None, True, 0)]
    facts = spark.createDataFrame(rows, "material string, score int, exact boolean, n int")
    got = quality.answer_tiers(facts, "material", [F.col("n")]).collect()
    of = lambda m, tier: [r["n"] for r in sorted((r for r in got if (r["material"], r["tier"]) == (m, tier)), key=lambda r: r["place"])]
    assert of("a", "primary") == [3, 4, 5, 6, 7]
    assert of("a", "supporting") == [0, 1, 2, *range(8, 25)]
    assert of("b", "primary") == [] and of("b", "supporting") == [0, 1, 2]
    assert of("c", "primary") == [0]


def test_score_of_a_fact(spark):
    names = list(quality.SCORES)
    full = {n: n not in ("table", "made_id", "no_effect", "no_regime") for n in names}
    cases = [(full, 72), ({**full, "table": True}, 78), ({**full, "regime": False, "no_regime": True}, 55), ({**full, "effect": False, "no_effect": True, "made_id": True}, 42), (dict.fromkeys(names), 0)]
    made = spark.createDataFrame([tuple(c[n] for n in names) for c, _ in cases], ", ".join(f"{n} boolean" for n in names))
    assert [r[0] for r in made.select(quality.fact_score({n: F.col(n) for n in names})).collect()] == [s for _, s in cases]


# Question, analytical intent, answer mode, whether chunks are retrieved and the graph is expanded, coarse intent.
ASKED = [
    ("Какая прочность у ВТ6 после отжига?", "strict_material_regime_property", "strict", False, True, "experiment_lookup"),
    ("Есть ли противоречия по прочности ВТ6 после отжига?", "unknown", "search", True, False, "conflict_analysis"),
    ("История решений по ВТ6", "decision_history", "history", False, True, "experiment_lookup"),
    ("Какие пробелы по ВТ6?", "gap_analysis", "gaps", False, True, "gap_analysis"),
    ("Сравни ВТ6 и 7075-T6", "material_comparison", "comparison", False, True, "experiment_lookup"),
    ("Чем отличаются annealing и aging для ВТ6?", "regime_comparison", "comparison", False, True, "experiment_lookup"),
    ("Что лучше?", "unknown", "search", True, False, "experiment_lookup"),
    ("Покажи похожие на ВТ6", "similar_experiments", "search", True, True, "experiment_lookup"),
    ("С чем связан ВТ6?", "graph_neighborhood", "neighborhood", False, True, "experiment_lookup"),
    ("На каком оборудовании это сделано?", "equipment_usage", "overview", False, True, "equipment_lookup"),
    ("Какая лаборатория изучает ВТ6?", "lab_activity", "overview", False, True, "laboratory_lookup"),
    ("Какая команда изучает ВТ6?", "team_activity", "overview", False, True, "laboratory_lookup"),
    ("Документы по теме отжига", "topic_search", "search", True, True, "experiment_lookup"),
    ("Расскажи о ВТ6", "material_overview", "overview", False, True, "experiment_lookup"),
    ("Расскажи об отжиге", "regime_overview", "overview", False, True, "experiment_lookup"),
    ("Tell of annealing", "regime_overview", "overview", False, True, "experiment_lookup"),
    # The sign "dn" is within "hardness".
    ("Tell of hardness", "property_overview", "overview", False, True, "parameter_lookup"),
    ("Найди отчет", "general_search", "search", True, True, "experiment_lookup"),
    ("Какие сплавы есть?", "unknown", "search", True, False, "material_inventory"),
    ("Какие сплавы есть и что с ними?", "unknown", "search", True, False, "material_activity_summary"),
    ("Что делали с ВТ6?", "material_overview", "overview", False, True, "material_activity_summary"),
    ("Покажи схему насоса", "general_search", "search", True, True, "image_lookup"),
    ("Как проверить герметичность?", "unknown", "search", True, False, "requirement_lookup"),
    ("Какой артикул?", "unknown", "search", True, False, "part_article_lookup"),
    ("Давление клапана", "unknown", "search", True, False, "parameter_lookup"),
    ("Какой корпус?", "unknown", "search", True, False, "material_lookup"),
    ("Нужен ГОСТ 123", "unknown", "search", True, False, "standard_lookup"),
    ("Какие требования?", "unknown", "search", True, False, "requirement_lookup"),
    ("Насос NPK-200", "unknown", "search", True, False, "object_overview"),
    ("", "unknown", "search", True, False, "experiment_lookup"),
    (None, "unknown", "search", True, False, "experiment_lookup"),
]


def test_routes_and_coarse_intents(spark):
    asked = V.with_forms(frame(spark, [a[0] for a in ASKED]))
    routes = {r["line"]: (r["intent"], r["answer_mode"], r["retrieval_required"], r["graph_expansion_required"]) for r in routing.routed(plan(asked, "plain")).collect()}
    wrong = {ASKED[i][0]: got for i, got in routes.items() if got != ASKED[i][1:5]}
    assert wrong == {} and len(routes) == len(ASKED)
    intents = {r["line"]: r["intent"] for r in routing.coarse(asked).collect()}
    assert {ASKED[i][0]: got for i, got in intents.items() if got != ASKED[i][5]} == {} and len(intents) == len(ASKED)
