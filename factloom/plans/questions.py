"""Questions as a table: what each asks for, as columns, so a log of questions is planned in one pass."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import units as U
from factloom.functions import vocab as V
from factloom.functions.text import holds_any, let, trie
from factloom.operators.extract import TEXT_SQL, number, prose
from factloom.registry import query
from factloom.sources.domain import KEY
from factloom.sources.tables import load

_DOMAINS = ("material", "regime", "property", "equipment")


def with_matches(texts: DataFrame) -> DataFrame:
    """with_forms(), and the spellings of each domain that a row holds, computed once: columns met_*."""
    return texts.select("*", *(V.matches(d).alias(f"met_{d}") for d in _DOMAINS))


def asked_names(domain: str) -> Column:
    """The names that a row of with_matches() asks for, sorted; a spelling within a longer one that is there too doesn't count."""
    met = F.col(f"met_{domain}")
    kept = F.filter(met, lambda x: ~F.exists(met, lambda y: (y["a"] != x["a"]) & F.contains(y["p"], x["p"])))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["name"])))


def _asked_sql(domain: str) -> str:
    listed = "[" + ", ".join(f"{{'a': '{a}', 'p': '{V.squeezed(a)}', 'name': '{c}', 'hit': {V.held_sql(a)}}}" for a, c in V.ordered(domain)) + "]"
    return f"(SELECT list_sort(list_distinct(list_transform(list_filter(f, lambda x: len(list_filter(f, lambda y: y.a <> x.a AND contains(y.p, x.p))) = 0), lambda x: x.name))) FROM (SELECT list_filter({listed}, lambda x: x.hit) AS f))"


@query(f"WITH {TEXT_SQL} SELECT order_id, line, " + ", ".join(f"array_to_string({_asked_sql(d)}, ';') AS {d}" for d in _DOMAINS) + " FROM t")
def i2_alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a text asks for; a spelling within a longer one that was met doesn't count."""
    return with_matches(prose(spark, sf_dir)).select(*KEY, *(F.array_join(asked_names(d), ";").alias(d) for d in _DOMAINS))


# Bounds in words and signs, and units as they are written in questions.
BOUNDS = {"не более": "<=", "не выше": "<=", "at most": "<=", "до": "<=", "≤": "<=", "<=": "<=", "less than": "<", "below": "<", "<": "<", "не менее": ">=", "at least": ">=", "от": ">=", "≥": ">=", ">=": ">=", "above": ">", ">": ">", "=": "="}
_UNITS = r"мг/дм3|мг/л|mg/l|г/л|g/l|г/т|g/t|м3/ч|m3/h|м/с|m/s|т/сут|t/day|т/год|t/y|kt/y|mt/y|usd/t|\$/t|руб/т|rub/t|мпа|mpa|ksi|hv|hrc|ppm|%|°c|c"
_NUMBER = r"\d+(?:[.,]\d+)?"
_BOUND = "|".join(sorted(BOUNDS, key=len, reverse=True)).replace("$", r"\$")
#: A bound, a number or two, and a unit; and the words before, up to a mark that ends them.
ASKED = rf"({_BOUND})?\s*({_NUMBER})(?:\s*(?:[-–—]|до)\s*({_NUMBER}))?\s*({_UNITS})(?:[^\p{{L}}\p{{N}}]|$)"
#: How every match of ASKED ends.
_ENDS = rf"\d\s*(?:{_UNITS})(?:[^\p{{L}}\p{{N}}]|$)"
#: ASKED as the same matches are found sooner: a place where none can begin is left at once, and bounds and units share their beginnings.
_SOONER = rf"(?=[\s0-9{''.join(sorted({b[0] for b in BOUNDS}))}])({trie(BOUNDS)})?\s*({_NUMBER})(?:\s*(?:[-–—]|до)\s*({_NUMBER}))?\s*({trie(_UNITS.replace(chr(92), '').split('|'))})(?:[^\p{{L}}\p{{N}}]|$)"
CONTEXT = r"[\p{L}\p{N}₂²³/ ._—–-]{0,80}$"
#: What a number can be asked of: properties and materials.
PARAMETERS = sorted({**V.ALIASES["material"], **V.ALIASES["property"]}.items(), key=lambda kv: (-len(kv[0]), kv[0]))


_ROW = "struct<r:string,n:int,l:int,name:string>"


def _rows(aliases: list[tuple[str, str]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"r": f" {a[::-1]} " if len(a) <= V.SHORT else a[::-1], "n": len(a) + (len(a) <= V.SHORT), "l": -len(a), "name": c} for a, c in aliases])), f"array<{_ROW}>")


def _parameter(back: Column, met: Column | None) -> Column:
    """The name whose spelling stands last before the number, the longest of those that end alike; short ones as whole words; null if there is none.

    back: the words before, between spaces and reversed.  met: as in with_forms(); long spellings that the text doesn't hold needn't be looked for.
    """
    rows = _rows(PARAMETERS)
    if met is not None:
        places = [p for d in ("material", "property") for p in V.PLACES[d]]
        named = dict(PARAMETERS)
        long = _rows([(a, named.get(a, "")) for _, a, _ in V.SPELLINGS])
        asked = F.filter(met, lambda i: i.isin(*(p for p in places if len(V.SPELLINGS[p][1]) > V.SHORT)))
        rows = F.concat(_rows([kv for kv in PARAMETERS if len(kv[0]) <= V.SHORT]), F.transform(asked, lambda i: F.get(long, i)))
    held = F.filter(rows, lambda x: F.contains(back, x["r"]))
    return F.array_min(F.transform(held, lambda x: F.struct((F.instr(back, x["r"]) + x["n"]).alias("start"), x["l"].alias("l"), x["name"].alias("name"))))["name"]


_ASKS = "array<struct<parameter:string,operator:string,value:double,value_min:double,value_max:double,unit:string>>"


def numeric_asks(plain: Column, met: Column | None = None) -> Column:
    """array of (parameter, operator, value, value_min, value_max, unit): numbers with a unit and something that they are asked of; equal ones are one."""
    # The pieces between the numbers are the words before them; what a match is made of is read from the match.
    parts = lambda ms: F.transform(ms, lambda m: F.struct(*(F.regexp_extract(m, _SOONER, g).alias(n) for n, g in (("op", 1), ("lo", 2), ("hi", 3), ("u", 4)))))
    cut = lambda ms: F.zip_with(F.slice(F.split(plain, _SOONER), 1, F.size(ms)), parts(ms), lambda c, p: F.struct(c.alias("ctx"), p["op"].alias("op"), p["lo"].alias("lo"), p["hi"].alias("hi"), p["u"].alias("u")))
    found = let(F.regexp_extract_all(plain, F.lit(_SOONER), F.lit(0)), cut)
    bounds = F.create_map(*(F.lit(v) for kv in BOUNDS.items() for v in kv))
    # Step by step, so that what several columns need is computed once for each number.
    turned = F.transform(found, lambda m: F.struct(m.alias("m"), F.reverse(F.concat(F.lit(" "), F.regexp_extract(m["ctx"], CONTEXT, 0), F.lit(" "))).alias("back")))
    named = F.filter(F.transform(turned, lambda t: F.struct(t["m"].alias("m"), _parameter(t["back"], met).alias("name"), U.unit_label(t["m"]["u"]).alias("unit"))), lambda n: n["name"].isNotNull())

    def ask(n: Column) -> Column:
        m, name, unit = n["m"], n["name"], n["unit"]
        ranged = m["hi"] != ""
        return F.struct(
            F.when((name == "расход") & (unit == "m/s"), "скорость потока").when((name == "скорость потока") & unit.isin("m3/h", "t/day"), "расход").otherwise(name).alias("parameter"),
            F.when(ranged, "range").when(m["op"] != "", F.element_at(bounds, m["op"])).otherwise("=").alias("operator"),
            F.when(~ranged, number(m["lo"])).alias("value"),
            F.when(ranged, number(m["lo"])).alias("value_min"),
            F.when(ranged, number(m["hi"])).alias("value_max"),
            unit.alias("unit"),
        )

    asks = F.array_distinct(F.transform(named, ask))
    return F.when(plain.rlike(_ENDS), asks.cast(_ASKS)).otherwise(F.array().cast(_ASKS))


_PARAMETERS_SQL = "[" + ", ".join(f"{{'r': '{a[::-1]}', 'n': {len(a)}, 's': {int(len(a) <= V.SHORT)}, 'name': '{c}'}}" for a, c in PARAMETERS) + "]"
_FOUND_SQL = (
    f"unnest(list_transform(string_split_regex(plain, '{ASKED}')[: len(regexp_extract_all(plain, '{ASKED}'))], lambda x: regexp_extract(x, '{CONTEXT}'))) AS ctx, "
    + ", ".join(f"unnest(list_transform(regexp_extract_all(plain, '{ASKED}', {g}), lambda x: coalesce(x, ''))) AS {n}" for n, g in (("op", 1), ("lo", 2), ("hi", 3), ("u", 4)))
)
_BACK = "reverse(' ' || ctx || ' ')"
_AT = f"instr({_BACK}, CASE x.s WHEN 1 THEN ' ' || x.r || ' ' ELSE x.r END)"
_ASKS_SQL = rf"""{TEXT_SQL}, m AS (SELECT order_id, line, {_FOUND_SQL} FROM t),
    n AS MATERIALIZED (SELECT *, {U.unit_label_sql('u')} AS unit, list_min(list_transform(list_filter({_PARAMETERS_SQL}, lambda x: {_AT} > 0), lambda x: {{'start': {_AT} + x.n + x.s, 'n': -x.n, 'name': x.name}})).name AS name FROM m),
    a AS (SELECT DISTINCT order_id, line, CASE WHEN name = 'расход' AND unit = 'm/s' THEN 'скорость потока' WHEN name = 'скорость потока' AND unit IN ('m3/h', 't/day') THEN 'расход' ELSE name END AS parameter,
    CASE WHEN hi <> '' THEN 'range' WHEN op <> '' THEN CASE op {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BOUNDS.items())} END ELSE '=' END AS operator,
    CASE WHEN hi = '' THEN replace(lo, ',', '.')::DOUBLE END AS value, CASE WHEN hi <> '' THEN replace(lo, ',', '.')::DOUBLE END AS value_min, CASE WHEN hi <> '' THEN replace(hi, ',', '.')::DOUBLE END AS value_max, unit FROM n WHERE name IS NOT NULL)"""


@query(f"WITH {_ASKS_SQL} SELECT * FROM a")
def d8_numeric_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select(*KEY, F.explode(numeric_asks(F.col("plain"), F.col("met"))).alias("a")).select(*KEY, "a.*").distinct()


#: 'the last n years', and years.
LAST_YEARS = r"(?:последн[\p{L}]*|last)\s+(\d{1,2})\s+(?:лет|год[\p{L}]*|years?)"
YEAR = r"(?:^|[^\p{L}\p{N}])((?:19|20)\d\d)"


def time_filter(text: Column, now_year: int) -> Column:
    """(start_year, end_year) that a text asks for; nulls if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    last = F.regexp_extract(low, LAST_YEARS, 1).try_cast("int")
    years = F.transform(F.regexp_extract_all(low, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    start = F.when(last.isNotNull(), F.lit(now_year + 1) - last).otherwise(F.array_min(years))
    return F.struct(start.alias("start_year"), F.when(last.isNotNull(), F.lit(now_year)).otherwise(F.array_max(years)).alias("end_year"))


_ASKED_TIME = ["capacity of the last 5 years", "decisions since 2019 and 2023", "последние 10 лет, медь", "no time at all", "in 1998"]
_TIME_TEXT_SQL = "list_value(" + ", ".join(f"'{x}'" for x in _ASKED_TIME) + f")[o_orderkey % {len(_ASKED_TIME)} + 1] || ' ' || o_orderdate"


@query(
    f"""WITH q AS (SELECT o_orderkey, lower({_TIME_TEXT_SQL}) AS t FROM orders), y AS (SELECT o_orderkey, try_cast(nullif(regexp_extract(t, '{LAST_YEARS}', 1), '') AS INT) AS n, list_transform(regexp_extract_all(t, '{YEAR}', 1), lambda x: x::INT) AS y FROM q)
    SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN 2025 - n ELSE list_min(y) END AS start_year, CASE WHEN n IS NOT NULL THEN 2024 ELSE list_max(y) END AS end_year FROM y"""
)
def d10_time_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that a question asks for, relative to 2024."""
    asked = F.element_at(F.array(*map(F.lit, _ASKED_TIME)), (F.col("o_orderkey") % len(_ASKED_TIME) + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", time_filter(F.concat_ws(" ", asked, F.col("o_orderdate").cast("string")), 2024).alias("t")).select("o_orderkey", "t.*")


# Words of wide questions, and of kinds of questions, in order of precedence.
BROAD = ["обзор", "все ", "review", "overview", "all "]
KINDS = [
    ("decision_history", ["history", "decision", "истори", "решени"]),
    ("gap_analysis", ["gap", "not reported", "no numerical", "пробел", "нет данных", "не измер"]),
    ("exact_fact", []),
    ("equipment_usage", ["equipment", "device", "оборудован", "установк"]),
    ("team_activity", ["team", "laborator", "команд", "лаборатор", "эксперт"]),
    ("entity_overview", []),
]
#: Kinds of facts that a kind of question is answered with.
TARGETS = {"exact_fact": "MechanicalPropertyFact", "gap_analysis": "DataGapFact", "equipment_usage": "TechnologySolutionFact", "team_activity": "ExpertiseFact", "entity_overview": "ExperimentResultFact", "decision_history": "PublicationClaimFact", "unknown": ""}


def plan(texts: DataFrame, *more: str) -> DataFrame:
    """(order_id, line, with_forms()) -> more columns (plain), names asked for, geographies, number of numeric constraints, kind, whether an exact fact is asked, kind of facts."""
    named = with_matches(texts).select(*KEY, "plain", *(asked_names(d).alias(d) for d in _DOMAINS), V.geographies(F.col("plain")).alias("geographies"), F.size(numeric_asks(F.col("plain"), F.col("met"))).alias("n_numeric"))
    one = (F.size("material") == 1) & (F.size("regime") == 1) & (F.size("property") == 1)
    plain = F.col("plain")
    exact = one & (F.col("n_numeric") == 0) & (F.size("geographies") == 0) & ~_any(plain, BROAD)
    some = (F.size("material") + F.size("regime") + F.size("property") + F.size("geographies") + F.col("n_numeric")) > 0
    conditions = {"exact_fact": exact, "equipment_usage": (F.size("equipment") > 0) | _any(plain, dict(KINDS)["equipment_usage"]), "entity_overview": some}
    kind = F.when(F.lit(False), F.lit(""))
    for name, marks in KINDS:
        kind = kind.when(conditions[name] if name in conditions else _any(plain, marks), name)
    rows = named.withColumn("kind", kind.otherwise("unknown")).withColumn("exact", exact)
    targets = F.create_map(*(F.lit(v) for kv in TARGETS.items() for v in kv))
    return rows.select(*KEY, *more, *_DOMAINS, "geographies", "n_numeric", "kind", (F.col("exact") & (F.col("kind") == "exact_fact")).alias("exact"), F.element_at(targets, F.col("kind")).alias("target"))


def _any(text: Column, marks: list[str]) -> Column:
    return holds_any(text, marks)


def _any_sql(marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(plain, '{m}')" for m in marks) + ")"


_GEO_SQL = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(plain, '{m}') THEN '{g}' END" for m, g in V.GEOGRAPHY.items()) + "], lambda x: x IS NOT NULL)))"
_EXACT_SQL = f"(len(material) = 1 AND len(regime) = 1 AND len(property) = 1 AND n_numeric = 0 AND len(geographies) = 0 AND NOT {_any_sql(BROAD)})"
_KIND_SQL = "CASE " + " ".join(
    f"WHEN {cond} THEN '{name}'"
    for name, cond in [
        *((n, _any_sql(m)) for n, m in KINDS[:2]),
        ("exact_fact", _EXACT_SQL),
        ("equipment_usage", f"(len(equipment) > 0 OR {_any_sql(dict(KINDS)['equipment_usage'])})"),
        ("team_activity", _any_sql(dict(KINDS)["team_activity"])),
        ("entity_overview", "len(material) + len(regime) + len(property) + len(geographies) + n_numeric > 0"),
    ]
) + " ELSE 'unknown' END"
_PLAN_SQL = f"""{TEXT_SQL}, o AS (SELECT row_number() OVER () AS uid, * FROM t), w AS (SELECT uid, {_FOUND_SQL} FROM o),
    c AS (SELECT DISTINCT uid, op, lo, hi, {U.unit_label_sql('u')} AS unit, list_min(list_transform(list_filter({_PARAMETERS_SQL}, lambda x: {_AT} > 0), lambda x: {{'start': {_AT} + x.n + x.s, 'n': -x.n, 'name': x.name}})).name AS name FROM w),
    k AS (SELECT uid, count(DISTINCT (CASE WHEN hi <> '' THEN 'range' WHEN op <> '' THEN CASE op {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BOUNDS.items())} END ELSE '=' END, lo, hi, unit, name)) AS n FROM c WHERE name IS NOT NULL GROUP BY uid),
    p AS (SELECT order_id, line, plain, {', '.join(f'{_asked_sql(d)} AS {d}' for d in _DOMAINS)}, {_GEO_SQL} AS geographies, coalesce(n, 0)::INT AS n_numeric FROM o LEFT JOIN k USING (uid)),
    x AS (SELECT *, {_KIND_SQL} AS kind FROM p)"""


@query(
    f"WITH {_PLAN_SQL} SELECT order_id, line, {', '.join(f"array_to_string({d}, ';') AS {d}" for d in (*_DOMAINS, 'geographies'))}, n_numeric, kind, kind = 'exact_fact' AS exact, CASE kind "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TARGETS.items())
    + " END AS target FROM x"
)
def i1_question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a question: its constraints and what kind of answer it asks for."""
    return plan(prose(spark, sf_dir)).select(*KEY, *(F.array_join(d, ";").alias(d) for d in (*_DOMAINS, "geographies")), "n_numeric", "kind", "exact", "target")
