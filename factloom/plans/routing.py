"""How questions are routed: the analytical intent and answer mode of planned questions, and the coarse intent of any question.

Rules are tables in order of precedence; the first whose words and needs are met decides.  Questions come as a table, so a log of
them is routed in one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.operators.extract import TEXT_SQL, any_of, any_sql
from factloom.plans.questions import _PLAN_SQL, plan
from factloom.registry import query
from factloom.sources.domain import KEY, MATERIALS, REGIMES
from factloom.sources.tables import load, spread


class Rule(NamedTuple):
    """words: one must be in the question, unless there are none; need: a condition on its columns, in the SQL of either engine; {n} is the size of an array."""

    intent: str
    mode: str = ""
    words: tuple[str, ...] = ()
    need: str = ""
    retrieval: bool = False
    graph: bool = True


# Analytical intents with answer mode, words, and whether chunks are retrieved and the graph is expanded.
ROUTES = [
    Rule("unknown", "search", ("противореч", "неоднород", "расходятся", "разные значения", "conflict", "different values"), retrieval=True, graph=False),
    Rule("strict_material_regime_property", "strict", need="kind = 'exact_fact'"),
    Rule("decision_history", "history", need="kind = 'decision_history'"),
    Rule("gap_analysis", "gaps", need="kind = 'gap_analysis'"),
    Rule("material_comparison", "comparison", ("сравн", "сопостав", "чем отличаются", "лучше"), "{n}(material) >= 2"),
    Rule("regime_comparison", "comparison", ("сравн", "сопостав", "чем отличаются", "лучше"), "{n}(regime) >= 2"),
    Rule("similar_experiments", "search", ("похож", "аналогич", "similar"), retrieval=True),
    Rule("graph_neighborhood", "neighborhood", ("связан", "граф вокруг", "окружение", "neighborhood")),
    Rule("equipment_usage", "overview", ("оборудован", "установк", "печь", "прибор", "equipment")),
    Rule("lab_activity", "overview", ("лаборатор", "lab ")),
    Rule("team_activity", "overview", ("команд", "группа", "team")),
    Rule("topic_search", "search", ("тема", "теме", "темы", "тематик", "документы по", "topic"), retrieval=True),
    Rule("material_overview", "overview", need="{n}(material) = 1"),
    Rule("regime_overview", "overview", need="{n}(regime) > 0"),
    Rule("property_overview", "overview", need="{n}(property) > 0"),
    Rule("general_search", "search", ("что есть", "покажи", "найди", "что известно"), retrieval=True),
    Rule("unknown", "search", retrieval=True, graph=False),
]

# Words that tell what a question is about.
SIGNS = {
    "stock": ["сплав", "материал"],
    "listing": ["какие", "что есть", "список", "перечень", "все", "имеются"],
    "loaded": ["что загружено", "что есть"],
    "activity": ["что делали", "что с каждым", "что с ними", "что с ним", "какие режим", "как обрабатывали", "какие свойства", "какие измерения"],
    "thing": ["насос", "pump", "клапан", "valve", "npk-200", "dn50"],
    "lookup": [
        "параметр", "давлен", "температур", "материал", "корпус", "стандарт", "гост", "iso", "артикул", "деталь", "требован", "изображ", "схем", "монтаж", "оборудован", "лаборатор",
        "прочность", "твёрд", "тверд", "пластич", "корроз", "что делали", "режим",
    ],
}
INVENTORY = "((stock AND listing) OR loaded)"
# Coarse intents and their words.
COARSE = [
    Rule("material_activity_summary", need=f"activity AND ({INVENTORY} OR {{n}}(material) > 0)"),
    Rule("image_lookup", words=("изображ", "схем", "image", "монтаж")),
    Rule("equipment_lookup", words=("оборудован", "установк", "печь", "прибор", "станок", "equipment")),
    Rule("laboratory_lookup", words=("лаборатор", "команд", "группа", "laboratory", "team")),
    Rule("requirement_lookup", words=("герметич",)),
    Rule("conflict_analysis", words=("противореч", "неоднород", "расход", "разные значения", "conflict", "different values")),
    Rule("gap_analysis", words=("пробел", "не хватает", "нет данных", "не измер", "не привед", "not reported", "gap")),
    Rule("part_article_lookup", words=("артикул", "article", "part number")),
    Rule("parameter_lookup", words=("параметр", "давлен", "температур", "dn", "pn")),
    Rule("material_inventory", need=INVENTORY),
    Rule("material_lookup", words=("материал", "корпус")),
    Rule("standard_lookup", words=("стандарт", "гост", "iso", "astm", "en ")),
    Rule("requirement_lookup", words=("требован", "requirement")),
    Rule("object_overview", need="thing AND NOT lookup"),
    Rule("experiment_lookup"),
]


def first_rule(rules: list[Rule], value: str, text: str = "plain") -> Column:
    """That field of the first rule which a row meets."""

    def met(rule: Rule) -> Column:
        parts = ([any_of(F.col(text), list(rule.words))] if rule.words else []) + ([F.expr(rule.need.format(n="size"))] if rule.need else [])
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return reduce(lambda acc, rule: acc.when(met(rule), getattr(rule, value)), rules[1:], F.when(met(rules[0]), getattr(rules[0], value)))


def first_rule_sql(rules: list[Rule], value: str) -> str:
    def met(rule: Rule) -> str:
        return " AND ".join([*([any_sql("plain", list(rule.words))] if rule.words else []), *([f"({rule.need.format(n='len')})"] if rule.need else [])]) or "true"

    literal = lambda x: str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return "CASE " + " ".join(f"WHEN {met(r)} THEN {literal(getattr(r, value))}" for r in rules) + " END"


def routed(planned: DataFrame) -> DataFrame:
    """plan() with plain -> order_id, line, intent, answer_mode, retrieval_required, graph_expansion_required."""
    # One number stands for the rule, so the rules are tried once for a question.
    numbered = [rule._replace(intent=str(i)) for i, rule in enumerate(ROUTES)]
    placed = planned.select(*KEY, first_rule(numbered, "intent").cast("int").alias("i"))
    fields = {"intent": "intent", "mode": "answer_mode", "retrieval": "retrieval_required", "graph": "graph_expansion_required"}
    return placed.select(*KEY, *(F.get(F.array(*(F.lit(getattr(r, f)) for r in ROUTES)), F.col("i")).alias(name) for f, name in fields.items()))


def coarse(questions: DataFrame) -> DataFrame:
    """(order_id, line, and with_forms()) -> order_id, line, intent."""
    signs = questions.select(*KEY, "plain", V.all_names("material").alias("material"), *(any_of(F.col("plain"), words).alias(name) for name, words in SIGNS.items()))
    return signs.select(*KEY, first_rule(COARSE, "intent").alias("intent"))


# ---- queries: a question for every line item, of its material, regime and numbers

QUESTIONS = [
    "Какая прочность у {m} после {r}?", "What is the tensile strength of {m} after {r}?", "Сравни {m} и ВТ6 по прочности", "Чем отличаются {r} и annealing для {m}?", "Есть ли противоречия по {m}?", "Какие пробелы есть по {m}?",
    "История решений по {m} и {r}", "Покажи похожие эксперименты на {m}", "С чем связан {m}?", "На каком оборудовании делали {r}?", "Which equipment was used for {r}?", "Какая лаборатория изучает {m}?", "Какая команда занималась {r}?",
    "Документы по теме {r}", "Что известно о {m}?", "Что дает {r}?", "Какая твёрдость получена?", "Найди отчет номер {n}", "Какие материалы загружены?", "Какие сплавы есть и что с ними делали?", "Что делали с {m}?", "Покажи схему насоса NPK-{n}",
    "Какой артикул у уплотнения?", "Какое давление у клапана DN{v}?", "Какой корпус у детали?", "Какой стандарт нужен: ГОСТ {n}?", "Какие требования к валу?", "Насос NPK-200", "Как проверить герметичность?", "Концентрация сульфатов не более {v} мг/л при {r}", "Hello {n}", "",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, line, text: one question for each line item, drawn from QUESTIONS by its keys."""
    pick = lambda words, key: F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))
    fills = {"{m}": pick(MATERIALS, F.col("l_partkey")), "{r}": pick(REGIMES, F.col("l_suppkey")), "{v}": F.col("l_quantity").cast("int").cast("string"), "{n}": F.col("l_orderkey").cast("string")}
    form = pick(QUESTIONS, F.col("l_orderkey") * 5 + F.col("l_linenumber"))
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), fills.items(), form)
    read = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return spread(read, "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), text.alias("text"))


def _questions_sql() -> str:
    pick = lambda words, key: "[" + ", ".join(f"'{w}'" for w in words) + f"][({key}) % {len(words)} + 1]"
    fills = {"{m}": pick(MATERIALS, "l_partkey"), "{r}": pick(REGIMES, "l_suppkey"), "{v}": "l_quantity::INT::VARCHAR", "{n}": "l_orderkey::VARCHAR"}
    text = reduce(lambda t, kv: f"replace({t}, '{kv[0]}', {kv[1]})", fills.items(), pick(QUESTIONS, "l_orderkey * 5 + l_linenumber"))
    return f"asked AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, {text} AS text FROM lineitem), t AS (SELECT order_id, line, text, {V.forms_sql('text')} FROM asked)"


_ASKED_SQL = _questions_sql()
_FIELDS_SQL = ", ".join(f"{first_rule_sql(ROUTES, f)} AS {name}" for f, name in (("intent", "intent"), ("mode", "answer_mode"), ("retrieval", "retrieval_required"), ("graph", "graph_expansion_required")))


@query(f"WITH {_PLAN_SQL.replace(TEXT_SQL, _ASKED_SQL)} SELECT order_id, line, {_FIELDS_SQL} FROM x")
def i3_question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's analytical intent, how it is answered, and whether chunks are retrieved and the graph is expanded for it."""
    return routed(plan(V.with_forms(questions(spark, sf_dir)), "plain"))
_SIGNS_SQL = ", ".join(f"{any_sql('plain', words)} AS {name}" for name, words in SIGNS.items())


@query(f"WITH {_ASKED_SQL}, s AS (SELECT *, {V.all_sql('material')} AS material, {_SIGNS_SQL} FROM t) SELECT order_id, line, {first_rule_sql(COARSE, 'intent')} AS intent FROM s")
def i4_question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's coarse intent."""
    return coarse(V.with_forms(questions(spark, sf_dir)))
