"""From a question to a plan: constraints and intent of one question on the driver, ladders for tables of questions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.registry import query
from factloom.sources.tables import load


@dataclass(frozen=True)
class NumericConstraint:
    operator: str  # <=, <, >=, >, =, range
    low: float | None
    high: float | None
    unit: str

    def matches(self, lo: Column, hi: Column) -> Column:
        """A fact between lo and hi against this; equality within two per cent."""
        if self.operator == "range":
            return (lo <= self.high) & (hi >= self.low)
        if self.operator in ("<=", "<"):
            return lo <= self.high if self.operator == "<=" else lo < self.high
        if self.operator in (">=", ">"):
            return hi >= self.low if self.operator == ">=" else hi > self.low
        return F.abs(lo - self.low) <= 0.02 * abs(self.low)


@dataclass(frozen=True)
class Constraints:
    """What a question asks for."""

    materials: tuple[str, ...] = ()
    regimes: tuple[str, ...] = ()
    properties: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    numeric: tuple[NumericConstraint, ...] = ()
    start_year: int | None = None
    end_year: int | None = None
    intent: str = field(default="search")

    broad: bool = False

    @property
    def exact(self) -> bool:
        """One material, one regime and one property, and nothing else: no number, place or year."""
        single = len(self.materials) == len(self.regimes) == len(self.properties) == 1
        return single and not (self.numeric or self.geographies or self.start_year or self.end_year or self.broad)


_NUMBER = r"(\d+(?:[.,]\d+)?)"
_UNIT = r"(мг/дм3|мг/л|mg/l|г/л|g/l|г/т|g/t|м3/ч|m3/h|м/с|m/s|т/сут|t/day|т/год|t/y|kt/y|Mt/y|USD/t|\$/t|руб/т|RUB/t|МПа|MPa|ksi|HV|HRC|ppm|%|°C|C)(?![\w/])"
_RANGE = re.compile(rf"{_NUMBER}\s*[-–]\s*{_NUMBER}\s*{_UNIT}", re.I)
_BOUND = re.compile(rf"(≤|>=|<=|≥|<|>|не более|не выше|не менее|до|от|at most|at least|less than|below|above)\s*{_NUMBER}\s*{_UNIT}", re.I)
_EXACT = re.compile(rf"{_NUMBER}\s*{_UNIT}", re.I)
# Bounds in words.
_OPERATORS = {"≤": "<=", "не более": "<=", "не выше": "<=", "до": "<=", "от": ">=", "less than": "<", "at most": "<=", "≥": ">=", "не менее": ">=", "at least": ">=", "below": "<", "above": ">"}


def numeric_constraints(question: str) -> tuple[NumericConstraint, ...]:
    """Ranges, then bounds, then exact values; a stretch of text is read once, and equal constraints are one."""
    found, taken = [], []

    def free(m: re.Match) -> bool:
        return all(m.end() <= a or m.start() >= b for a, b in taken)

    number = lambda s: float(s.replace(",", "."))
    for m in _RANGE.finditer(question):
        found.append(NumericConstraint("range", *sorted((number(m[1]), number(m[2]))), m[3]))
        taken.append(m.span())
    for m in filter(free, list(_BOUND.finditer(question))):
        op = _OPERATORS.get(m[1].lower(), m[1])
        found.append(NumericConstraint(op, None, number(m[2]), m[3]) if op[0] == "<" else NumericConstraint(op, number(m[2]), None, m[3]))
        taken.append(m.span())
    for m in filter(free, list(_EXACT.finditer(question))):
        found.append(NumericConstraint("=", number(m[1]), number(m[1]), m[2]))
    return tuple(dict.fromkeys(found))


def names(question: str, domain: str) -> tuple[str, ...]:
    """Names whose spelling is in the question, the longest first; one inside a spelling already met is passed over, short ones count as whole words."""
    low = re.sub(r"\s+", " ", question.strip().lower().replace("ё", "е"))
    packed, met, out = V.squeezed(low), [], []
    for alias, name in V.ordered(domain):
        here = bool(re.search(rf"(?<![^\W_]){re.escape(alias)}(?![^\W_])", low)) if len(alias) <= V.SHORT else alias in low or V.squeezed(alias) in packed
        if here and not any(V.squeezed(alias) in longer for longer in met):
            met.append(V.squeezed(alias))
            out.append(name)
    return tuple(dict.fromkeys(out))


def plan_question(question: str, now_year: int) -> Constraints:
    """The constraints of a question; now_year anchors 'the last n years'."""
    start = end = None
    if m := re.search(r"(?:последн\w*|last)\s+(\d+)\s+(?:лет|год\w*|years?)", question, re.I):
        start, end = now_year - int(m[1]) + 1, now_year
    elif years := [int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", question)]:
        start, end = min(years), max(years)
    low = question.lower()
    markers = sorted({label for m, label in V.GEOGRAPHY.items() if m in low})
    return Constraints(names(question, "material"), names(question, "regime"), names(question, "property"), tuple(markers), numeric_constraints(question), start, end, intent_of(question), any(w in low for w in BROAD))


BROAD = ("обзор", "все ", "review", "overview", "all ")
# Words by which questions are sorted, in order of precedence.
INTENTS = [
    ("conflict", ["conflict", "different values", "противореч"]),
    ("gaps", ["gap", "not reported", "пробел", "нет данных"]),
    ("history", ["history", "decision", "истори"]),
    ("comparison", ["compar", "сравн", "versus"]),
    ("similar", ["similar", "похож"]),
    ("equipment", ["equipment", "furnace", "оборудован"]),
    ("laboratory", ["laborator", "team", "лаборатор"]),
    ("search", ["show", "find", "what", "how", "the"]),
]


def intent_of(question: str) -> str:
    low = question.lower()
    return next((name for name, words in INTENTS if any(w in low for w in words)), "unknown")


def intent_column(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda acc, iw: acc.when(reduce(lambda a, b: a | b, (low.contains(w) for w in iw[1])), iw[0]), INTENTS, F.when(F.lit(False), F.lit(""))).otherwise("unknown")


_INTENT_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in INTENTS) + " ELSE 'unknown' END"


@query(f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM conversations")
def i4_coarse_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", intent_column(F.col("text")).alias("intent"))


@query(
    f"""WITH i AS (SELECT role, {_INTENT_SQL} AS intent FROM conversations) SELECT role, intent, CASE intent WHEN 'gaps' THEN 'gaps' WHEN 'history' THEN 'history' WHEN 'comparison' THEN 'comparison'
    WHEN 'equipment' THEN 'overview' WHEN 'laboratory' THEN 'overview' ELSE 'search' END AS answer_mode, count(*) AS n FROM i GROUP BY ALL"""
)
def i3_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by intent and answer mode."""
    rows = load(spark, sf_dir, "conversations").select("role", intent_column(F.col("text")).alias("intent"))
    mode = F.when(F.col("intent").isin("gaps", "history", "comparison"), F.col("intent")).when(F.col("intent").isin("equipment", "laboratory"), "overview").otherwise("search")
    return rows.groupBy("role", "intent", mode.alias("answer_mode")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''))) < 12 THEN 'too_short' WHEN NOT regexp_matches(text, '[\p{L}]{3}') THEN 'noise'
    WHEN len(regexp_extract_all(text, '[\p{L}\p{N}_\-]+')) < 3 THEN 'unclear' ELSE 'ok' END AS verdict FROM conversations"""
)
def i5_understanding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    verdict = F.when(F.length(F.trim(t)) < 12, "too_short").when(~t.rlike(r"[\p{L}]{3}"), "noise").when(F.regexp_count(t, F.lit(r"[\p{L}\p{N}_\-]+")) < 3, "unclear").otherwise("ok")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", verdict.alias("verdict"))
