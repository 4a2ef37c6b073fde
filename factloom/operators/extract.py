"""Extraction from chunks: rules over prose, roles of table columns, candidates of typed facts.

Each rule is a pattern or a list of markers; each chunk gives an array of what the rules find, exploded.  All of it is
column expressions over a table of chunks (order_id, line, kind, text), so it runs where the text lies and shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import units as U
from factloom.functions import vocab as V
from factloom.functions.text import compact, holds_any, let
from factloom.registry import query
from factloom.sources.domain import CHUNKS_SQL, KEY, MATERIALS, REGIMES, chunks
from factloom.sources.tables import load

_ID = "order_id, line"
#: Text chunks with the forms that names are looked up in.
TEXT_SQL = f"{CHUNKS_SQL}, t AS (SELECT {_ID}, text, {V.forms_sql('text')} FROM chunks WHERE kind = 'text')"
ROW_SQL = f"{CHUNKS_SQL}, t AS (SELECT {_ID}, text FROM chunks WHERE kind = 'table_row')"
W = r"[\p{L}\p{N}_]*"
_NUM = r"(\d+(?:[.,]\d+)?)"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_forms(chunks(spark, sf_dir, "text"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "table_row")


def _some(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of a few words: what is cheap to ask before a pattern is tried."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def any_of(text: Column, marks: list[str]) -> Column:
    return holds_any(text, marks)


def any_sql(text: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


def number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


# Words of effects, in the order in which they are tried.
EFFECTS = [("increase", "повыс|увелич|increase"), ("decrease", "сниз|уменьш|decrease"), ("no_change", "без измен|unchanged|no change")]
EFFECT_WORD = "(?:" + "|".join(p for _, p in EFFECTS) + ")"


def effect_of(word: Column) -> Column:
    return reduce(lambda acc, e: acc.when(word.rlike(e[1]), e[0]), EFFECTS, F.when(F.lit(False), F.lit(""))).otherwise("unknown")


def effect_sql(word: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({word}, '{p}') THEN '{n}'" for n, p in EFFECTS) + " ELSE 'unknown' END"


def nearest_effect(plain: Column, found: Column) -> Column:
    """The first effect word within 80 characters of a stretch of the text."""
    at = F.instr(plain, found)
    return F.regexp_extract(F.substring(plain, F.greatest(at - 80, F.lit(1)), F.least(at - 1, F.lit(80)) + F.length(found) + 80), EFFECT_WORD, 0)


def nearest_effect_sql(found: str) -> str:
    at = f"instr(plain, {found})"
    return f"regexp_extract(substr(plain, greatest({at} - 80, 1), least({at} - 1, 80) + length({found}) + 80), '{EFFECT_WORD}')"


# Patterns of measured properties over lower-case text: pattern, property as written, property, groups of value and unit,
# where the effect is looked for (in the match, around it, in a group, nowhere), confidence.
_STRENGTH_UNIT = r"(мпа|mpa|гпа|gpa|ksi)"
MEASUREMENTS = [
    (rf"(?:предел\s+прочности\s*(?:σв|sigma_b)?|прочност[ьи])[^.;,\n]{{0,80}}?(?:увелич{W}\s+до\s+|составил{W}\s+|=|:)?{_NUM}\s*{_STRENGTH_UNIT}", "предел прочности", "прочность", 1, 2, "match", 0.88),
    (rf"(?:ultimate\s+tensile\s+strength|tensile\s+strength|strength)[^.;,\n]{{0,80}}?(?:of\s+|=|:|reached\s+|was\s+|is\s+)?{_NUM}\s*(ksi|mpa|gpa)", "tensile strength", "прочность", 1, 2, "near", 0.90),
    (rf"(?:относительное\s+)?удлинение[^.;,\n]{{0,40}}?{_NUM}\s*(%)", "удлинение", "пластичность", 1, 2, "none", 0.86),
    (rf"(hv|hrc)\s*{_NUM}", "твёрдость", "твёрдость", 2, 1, "none", 0.86),
    (rf"твердость[^.;,\n]{{0,30}}?{_NUM}\s*(hv|hrc)", "твёрдость", "твёрдость", 1, 2, "none", 0.86),
]
CORROSION = rf"(коррозионн{W}\s+стойк{W}|corrosion\s+resistance)[^.;\n]{{0,80}}?((?:повыс|увелич|increase|сниз|уменьш|decrease){W})"
# For each of MEASUREMENTS words of which a text that it finds something in holds one, and units likewise; and such words of CORROSION.
_STRENGTHS = ["мпа", "mpa", "гпа", "gpa", "ksi"]
MEASURED_WORDS = [(["прочност"], _STRENGTHS), (["strength"], _STRENGTHS), (["удлинение"], ["%"]), (["hv", "hrc"], ["hv", "hrc"]), (["твердость"], ["hv", "hrc"])]
CORROSION_WORDS = ["коррозионн", "corrosion"]
_KIND = "struct<property_raw:string,property:string,value:double,unit:string,effect:string,confidence:double>"


def measurements(plain: Column) -> Column:
    """array of (property_raw, property, value, unit, effect, confidence) by all rules; equal ones are one."""

    def by_rule(pattern: str, raw: str, name: str, value: int, unit: int, effect: str, confidence: float) -> Column:
        # No pattern looks beyond its match, so groups are read from matches, which are few and short, and not from the text again.
        part = lambda m, g: F.regexp_extract(m, pattern, g)
        # A strength in Russian is an increase or nothing is known of it; the word must stand in the match.
        word = {"match": lambda m: F.regexp_extract(m, "увелич", 0), "near": lambda m: nearest_effect(plain, m), "none": lambda m: F.lit("")}[effect]
        fact = lambda m: F.struct(
            F.lit(raw).alias("property_raw"), F.lit(name).alias("property"), number(part(m, value)).alias("value"), U.unit_label(part(m, unit)).alias("unit"), effect_of(word(m)).alias("effect"), F.lit(confidence).alias("confidence")
        )
        return F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), fact)

    bare = lambda m: F.struct(
        m["raw"].alias("property_raw"), F.lit("коррозионная стойкость").alias("property"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), effect_of(m["w"]).alias("effect"), F.lit(0.72).alias("confidence")
    )
    corrosion = F.arrays_zip(*(F.regexp_extract_all(plain, F.lit(CORROSION), F.lit(g)).alias(n) for n, g in (("raw", 1), ("w", 2))))
    kind = f"array<{_KIND}>"
    only = lambda found, *words: F.when(reduce(lambda a, b: a & b, (_some(plain, w) for w in words)), found.cast(kind)).otherwise(F.array().cast(kind))
    found = [only(by_rule(*rule), *words) for rule, words in zip(MEASUREMENTS, MEASURED_WORDS, strict=True)]
    return F.array_distinct(F.flatten(F.array(*found, only(F.transform(corrosion, bare), CORROSION_WORDS))))


def _measurements_sql() -> str:
    def one(pattern: str, raw: str, name: str, value: int, unit: int, effect: str, confidence: float) -> str:
        word = {"match": "regexp_extract(m, 'увелич')", "near": nearest_effect_sql("m"), "none": "''"}[effect]
        groups = ", ".join(f"unnest(regexp_extract_all(plain, '{pattern}', {g})) AS {c}" for c, g in (("m", 0), ("v", value), ("u", unit)))
        return f"SELECT {_ID}, '{raw}' AS property_raw, '{name}' AS property, replace(v, ',', '.')::DOUBLE AS value, {U.unit_label_sql('u')} AS unit, {effect_sql(word)} AS effect, {confidence}::DOUBLE AS confidence FROM (SELECT {_ID}, plain, {groups} FROM t)"

    bare = f"SELECT {_ID}, raw, 'коррозионная стойкость', NULL, NULL, {effect_sql('w')}, 0.72 FROM (SELECT {_ID}, unnest(regexp_extract_all(plain, '{CORROSION}', 1)) AS raw, unnest(regexp_extract_all(plain, '{CORROSION}', 2)) AS w FROM t)"
    return " UNION ".join([*(one(*rule) for rule in MEASUREMENTS), bare])


@query(f"WITH {TEXT_SQL} {_measurements_sql()}")
def e4_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select(*KEY, F.explode(measurements(F.col("plain"))).alias("m")).select(*KEY, "m.*").distinct()


# Process parameters: what stands before the number, within how many characters, property, confidence; and the units.
_AMOUNT = r"(?:<=|>=|≤|≥|<|>|=|до|от|не\s+более|не\s+менее)?\s*" + _NUM + r"(?:\s*[-–]\s*\d+(?:[.,]\d+)?)?\s*(мг/л|мг/дм3|мг/дм³|mg/l|mg/dm3|mg/dm³|г/л|g/l|м/с|m/s|м3/ч|м³/ч|m3/h|m³/h|т/сутки|т/сут|t/day|t/d|%|ppm)"
_PRICE = r"(?:<=|>=|≤|≥|<|>|=|до|от|не\s+более|не\s+менее)?\s*" + _NUM + r"\s*(usd/t|\$/t|rub/t|руб/т|руб\.?/т|руб/м3|руб/м³|rub/m3|usd/m3|млн\s*руб(?:/год)?|млн\s*rub(?:/year)?)"
_BEFORE = [
    (rf"сульфат{W}|sulfates?|sulphates?|so4", 60, "концентрация", 0.83),
    (rf"хлорид{W}|chlorides?|cl", 60, "концентрация", 0.83),
    (rf"ca|кальци{W}|calcium", 50, "концентрация", 0.80),
    (rf"mg|магни{W}|magnesium", 50, "концентрация", 0.80),
    (rf"na|натри{W}|sodium", 50, "концентрация", 0.80),
    (r"сухой\s+остаток|total\s+dissolved\s+solids|tds", 70, "сухой остаток", 0.84),
    (rf"скорост{W}\s+(?:поток{W}|циркуляц{W})|flow\s+(?:velocity|rate)|circulation\s+rate", 70, "скорость потока", 0.82),
    (rf"производительност{W}|capacity|throughput", 70, "производительность", 0.80),
    (rf"извлечени{W}|recovery", 70, "извлечение", 0.82),
    (rf"выход\s+металл{W}|metal\s+yield|yield", 70, "выход металла", 0.80),
    (rf"распределени{W}|коэффициент\s+распределени{W}|distribution(?:\s+coefficient)?", 90, "распределение", 0.81),
]
_MONEY = rf"capex|opex|капитальн{W}\s+затрат{W}|эксплуатационн{W}\s+затрат{W}|технико-экономическ{W}\s+показател{W}|экономическ{W}\s+показател{W}|стоимост{W}"
#: For each of PARAMETERS words of which a text that it finds something in holds one.
PARAMETER_WORDS = [
    ["сульфат", "sulfate", "sulphate", "so4"], ["хлорид", "chlorid", "cl"], ["ca", "кальци"], ["mg", "магни", "magnesium"], ["na", "натри", "sodium"], ["сухой", "total", "tds"], ["скорост", "flow", "circulation"],
    ["производительност", "capacity", "throughput"], ["извлечени", "recovery"], ["выход", "yield"], ["распределени", "distribution"], ["capex", "opex", "затрат", "показател", "стоимост"],
]
#: What stands at the end of every match of PARAMETERS.
_AMOUNT_END = r"\d\s*(?:мг/|mg/|г/л|g/l|м/с|m/s|м3/ч|м³/ч|m3/h|m³/h|т/сут|t/d|%|ppm|usd/|\$/t|rub/|руб|млн)"
PARAMETERS = [*((f"({raw})[^.;\\n]{{0,{reach}}}?{_AMOUNT}", name, conf) for raw, reach, name, conf in _BEFORE), (f"({_MONEY})[^.;,\\n]{{0,45}}?{_PRICE}", "экономический показатель", 0.76)]


@query(
    f"WITH {TEXT_SQL} "
    + " UNION ".join(
        f"SELECT {_ID}, raw AS property_raw, '{name}' AS property, replace(v, ',', '.')::DOUBLE AS value, {U.unit_label_sql('u')} AS unit, {conf}::DOUBLE AS confidence FROM (SELECT {_ID}, "
        + ", ".join(f"unnest(regexp_extract_all(plain, '{pattern}', {g})) AS {c}" for c, g in (("raw", 1), ("v", 2), ("u", 3)))
        + " FROM t)"
        for pattern, name, conf in PARAMETERS
    )
)
def e5_process_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations, flows, recoveries and prices: each rule's number with a unit that is near its words."""

    kind = "array<struct<property_raw:string,property:string,value:double,unit:string,confidence:double>>"

    def by_rule(pattern: str, name: str, confidence: float, words: list[str]) -> Column:
        # As in measurements(), groups are read from matches.
        part = lambda m, g: F.regexp_extract(m, pattern, g)
        fact = lambda m: F.struct(part(m, 1).alias("property_raw"), F.lit(name).alias("property"), number(part(m, 2)).alias("value"), U.unit_label(part(m, 3)).alias("unit"), F.lit(confidence).alias("confidence"))
        return F.when(_some(F.col("plain"), words), F.transform(F.regexp_extract_all("plain", F.lit(pattern), F.lit(0)), fact).cast(kind)).otherwise(F.array().cast(kind))

    found = F.array_distinct(F.flatten(F.array(*(by_rule(*rule, words) for rule, words in zip(PARAMETERS, PARAMETER_WORDS, strict=True)))))
    return prose(spark, sf_dir).where(F.col("plain").rlike(_AMOUNT_END)).select(*KEY, F.explode(found).alias("m")).select(*KEY, "m.*").distinct()


# Ways to say that something wasn't measured, and the gap that each means.
GAPS = [
    (rf"коррозионн{W}\s+стойк{W}[^.;\n]{{0,40}}не\s+измер", "коррозионная стойкость не измерялась"),
    (rf"(?:необходим|нужн|требу){W}[^.;\n]{{0,80}}дополнительн{W}\s+данн{W}[^.;\n]{{0,60}}коррозионн{W}\s+стойк", "нужны дополнительные данные по коррозионной стойкости"),
    (r"(?:corrosion\s+resistance|corrosion\s+data)[^.;\n]{0,90}?(?:no\s+(?:numerical|numeric)?\s*corrosion\s+data|no\s+(?:numerical|numeric)\s+data|not\s+reported|were\s+not\s+reported)", "no numerical corrosion data were reported"),
]


@query(
    f"WITH {TEXT_SQL}, g AS (SELECT {_ID}, {V.first_sql('material')} AS material, {V.first_sql('regime')} AS regime, unnest(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(plain, '{p}') THEN '{r}' END" for p, r in GAPS)
    + f"""], lambda x: x IS NOT NULL)) AS reason FROM t)
    SELECT {_ID}, material, regime, 'коррозионная стойкость' AS property, reason, substr(sha256(concat_ws('|', coalesce(material, ''), coalesce(regime, ''), 'коррозионная стойкость', reason)), 1, 24) AS gap_id FROM g"""
)
def e6_gap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data gaps that chunks state, with the material and regime that they name."""
    plain = F.col("plain")
    found = F.array_compact(F.array(*(F.when(plain.rlike(p), reason) for p, reason in GAPS)))
    gaps = prose(spark, sf_dir).select(*KEY, V.first_name("material").alias("material"), V.first_name("regime").alias("regime"), F.explode(found).alias("reason"))
    key = F.concat_ws("|", F.coalesce("material", F.lit("")), F.coalesce("regime", F.lit("")), F.lit("коррозионная стойкость"), "reason")
    return gaps.select(*KEY, "material", "regime", F.lit("коррозионная стойкость").alias("property"), "reason", F.substring(F.sha2(key, 256), 1, 24).alias("gap_id"))


@query(f"WITH {TEXT_SQL} SELECT {_ID}, {effect_sql(f'regexp_extract(plain, {chr(39)}{EFFECT_WORD}{chr(39)})')} AS effect FROM t")
def e9_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect that a chunk's first effect word tells."""
    return prose(spark, sf_dir).select(*KEY, effect_of(F.regexp_extract("plain", EFFECT_WORD, 0)).alias("effect"))


# How people, laboratories, teams, topics and equipment are introduced.
_NAME = r"[A-Za-zА-Яа-яЁё0-9_.\- ]"
PERSON = r"([А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.)"
LABORATORY = r"((?:лаборатори[ия]|[Ll]aboratory|[Ii]nstitute|[Dd]epartment)\s+[^;,.]+)"
TEAM = rf"(?:[Кк]оманд[аы]|[Гг]рупп[аы]|[Rr]esearch\s+team|[Tt]eam)\s*[:\-]?\s*({_NAME}{{2,70}}?)(?:\s+(?:выполн|провод|использ|работал|in\s+laboratory|used|using|worked)|;|\.|\n|$)"
TOPIC = r"(?:[Тт]ема|[Тт]ематика|[Tt]opic|[Tt]ag|[Тт]ег)\s*[:\-]\s*([^;.\n|]{2,90})"
DEVICE = r"(?:[Оо]борудование|[Уу]становка|[Пп]рибор|[Ee]quipment|[Dd]evice|[Ss]tand)\s*[:\-]\s*([^;.\n|]{2,90})"
EXPERIMENT = r"((?:^|[^\p{L}\p{N}_])(?:E[0-9]+|EXP-[A-ZА-Я0-9_.\-]+))"
_LABELS = {"person": PERSON, "laboratory": LABORATORY, "team": TEAM, "topic": TOPIC, "device": DEVICE}
_TEMPERATURE, _HOURS = r"(\d+(?:[,.]\d+)?)\s*(?:°\s*)?[CСс]", r"(\d+(?:[,.]\d+)?)\s*(?:ч|h|час)"


@query(
    f"WITH {TEXT_SQL} SELECT {_ID}, array_to_string({V.all_sql('material')}, ';') AS materials, array_to_string({V.all_sql('regime')}, ';') AS regimes, array_to_string({V.all_sql('equipment')}, ';') AS equipment, "
    + ", ".join(f"trim(regexp_extract(text, '{p}', 1), ' .;') AS {n}" for n, p in _LABELS.items())
    + f""", CASE WHEN {V.first_sql('regime')} IS NOT NULL THEN replace(nullif(regexp_extract(text, '{_TEMPERATURE}', 1), ''), ',', '.')::DOUBLE END AS temperature,
    CASE WHEN {V.first_sql('regime')} IS NOT NULL THEN replace(nullif(regexp_extract(text, '{_HOURS}', 1), ''), ',', '.')::DOUBLE END AS hours,
    ltrim(regexp_extract(text, '{EXPERIMENT}', 1), ' (') AS experiment_id FROM t"""
)
def e3_text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk of prose names: materials, regimes with temperature and duration, equipment, people, laboratories, teams, topics."""
    joined = lambda d: F.array_join(V.all_names(d), ";")
    has_regime = V.first_name("regime").isNotNull()
    first_number = lambda p: F.when(has_regime, number(F.regexp_extract("text", p, 1)))
    return prose(spark, sf_dir).select(
        *KEY,
        joined("material").alias("materials"),
        joined("regime").alias("regimes"),
        joined("equipment").alias("equipment"),
        *(F.trim(F.regexp_extract("text", p, 1), F.lit(" .;")).alias(n) for n, p in _LABELS.items()),
        first_number(_TEMPERATURE).alias("temperature"),
        first_number(_HOURS).alias("hours"),
        F.ltrim(F.regexp_extract("text", EXPERIMENT, 1), F.lit(" (")).alias("experiment_id"),
    )


# Markers of the sentence adapters.
CIRCULATION_MEDIA, CATHOLYTE = ["католит", "catholyte", "электролит", "electrolyte"], ["католит", "catholyte"]
CIRCULATION_FLOW = ["циркуляц", "рециркуляц", "поток", "расход", "скорость", "flow", "circulation", "recirculation"]
CIRCULATION_PLACE = ["электроэкстракц", "electrowinning", "electroextraction", "никел", "nickel"]
TECHNOLOGY = ["метод", "способ", "технология", "схема", "система", "решение", "применяется", "используется", "позволяет", "предназначен", "рекомендуется", "method", "technology", "approach", "system", "solution", "used for", "applied for", "designed for", "recommended"]
CLAIM = ["вывод", "заключение", "рекомендуется", "показано", "установлено", "reported", "concluded", "recommended", "suggests", "indicates", "demonstrated"]
SOLUTIONS = [("схема циркуляции", ["схема", "scheme"]), ("циркуляционный контур", ["контур", "loop"]), ("расход католита", ["расход", "flow rate"]), ("скорость потока католита", ["скорость", "flow velocity"])]
_SENTENCES_SQL = rf"""{CHUNKS_SQL}, c AS (SELECT {_ID}, unnest(list_slice(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)),
    lambda s: trim(s, ' .;')), lambda s: length(s) BETWEEN 20 AND 900), 1, 20)) AS text FROM chunks WHERE kind = 'text'),
    s AS (SELECT {_ID}, text, {V.forms_sql('text')} FROM c),
    n AS (SELECT {_ID}, text, plain, {V.first_sql('material')} AS material, {V.first_sql('regime')} AS process, {V.first_sql('equipment')} AS equipment, {V.first_sql('property')} AS property FROM s)"""
_EXPERT = f"coalesce(nullif(regexp_extract(text, '{PERSON}', 1), ''), nullif(trim(regexp_extract(text, '{LABORATORY}', 1), ' .;'), ''), nullif(trim(regexp_extract(text, '{TEAM}', 1), ' .;'), ''))"
_INDICATOR = "CASE WHEN contains(plain, 'capex') OR contains(plain, 'капитальн') THEN 'CAPEX' WHEN contains(plain, 'opex') OR contains(plain, 'эксплуатацион') OR contains(plain, 'operating cost') THEN 'OPEX' WHEN contains(plain, 'тариф') THEN 'tariff' ELSE 'cost' END"


def candidates_sql(more: str = "") -> str:
    """The candidates, with further columns of their sentence."""
    own = f"{_ID}{more}"
    return f"""    SELECT {own}, 'TechnologySolutionFact' AS fact_type, 'circulation' AS adapter, material, CASE WHEN {any_sql('plain', CIRCULATION_PLACE[:3])} THEN 'электроэкстракция' ELSE process END AS process,
        CASE {' '.join(f"WHEN {any_sql('plain', marks)} THEN '{label}'" for label, marks in SOLUTIONS)} WHEN {any_sql('plain', CATHOLYTE)} THEN 'циркуляция католита' ELSE 'циркуляция электролита' END AS detail,
        NULL::DOUBLE AS value, NULL AS unit, 0.84::DOUBLE AS confidence FROM n WHERE {any_sql('plain', CIRCULATION_MEDIA)} AND {any_sql('plain', CIRCULATION_FLOW)} AND {any_sql('plain', CIRCULATION_PLACE)}
    UNION SELECT {own}, 'TechnologySolutionFact', 'technology', material, process, coalesce(process, material, equipment, property), NULL, NULL,
        CASE WHEN process IS NOT NULL AND coalesce(material, equipment, property) IS NOT NULL THEN 0.81 ELSE 0.77 END FROM n WHERE {any_sql('plain', TECHNOLOGY)} AND coalesce(process, material, equipment, property) IS NOT NULL
    UNION SELECT {own}, 'PublicationClaimFact', 'claim', material, process, coalesce(property, process, material, equipment), NULL, NULL, 0.79 FROM n WHERE {any_sql('plain', CLAIM)} AND coalesce(property, process, material, equipment) IS NOT NULL
    UNION SELECT {own}, 'ExpertiseFact', 'expertise', material, process, {_EXPERT}, NULL, NULL, 0.78 FROM n WHERE {_EXPERT} IS NOT NULL AND coalesce(process, material, property, equipment) IS NOT NULL
    UNION SELECT {own}, 'EconomicIndicatorFact', 'economic', material, process, {_INDICATOR}, replace(v, ',', '.')::DOUBLE, {U.unit_label_sql('u')}, 0.80
        FROM (SELECT *, unnest(regexp_extract_all(plain, '{_PRICE}', 1)) AS v, unnest(regexp_extract_all(plain, '{_PRICE}', 2)) AS u FROM n)"""


@query(f"WITH {_SENTENCES_SQL} {candidates_sql()}")
def e7_sentence_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate facts of sentences: circulation, technology, claims, expertise and prices, with the first name of each kind as their subject."""
    return sentence_candidates(chunks(spark, sf_dir, "text"))


def sentence_candidates(texts: DataFrame, *more: str) -> DataFrame:
    """(order_id, line, text) -> candidate facts of up to 20 sentences of each, with more columns (text, equipment) of the sentence; equal ones are one."""
    lines = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    kept = F.slice(F.filter(F.transform(lines, lambda s: F.trim(s, F.lit(" .;"))), lambda s: F.length(s).between(20, 900)), 1, 20)
    s = V.with_forms(texts.select(*KEY, F.explode(kept).alias("text")))
    plain = F.col("plain")
    n = s.select(*KEY, "text", "plain", *(V.first_name(d).alias(c) for d, c in (("material", "material"), ("regime", "process"), ("equipment", "equipment"), ("property", "property"))))
    some = lambda *cols: F.coalesce(*cols)
    label = reduce(lambda acc, kv: acc.when(any_of(plain, kv[1]), kv[0]), SOLUTIONS, F.when(F.lit(False), F.lit(""))).when(any_of(plain, CATHOLYTE), "циркуляция католита").otherwise("циркуляция электролита")
    found = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1), F.lit(" .;")), F.lit(""))
    expert = some(F.nullif(F.regexp_extract("text", PERSON, 1), F.lit("")), found(LABORATORY), found(TEAM))
    indicator = F.when(any_of(plain, ["capex", "капитальн"]), "CAPEX").when(any_of(plain, ["opex", "эксплуатацион", "operating cost"]), "OPEX").when(plain.contains("тариф"), "tariff").otherwise("cost")

    def fact(kind: str, adapter: str, detail: Column, confidence: Column, process: Column = F.col("process"), value: Column = F.lit(None), unit: Column = F.lit(None)) -> Column:
        return F.struct(
            F.lit(kind).alias("fact_type"), F.lit(adapter).alias("adapter"), F.col("material"), process.alias("process"), detail.alias("detail"), value.cast("double").alias("value"), unit.cast("string").alias("unit"), confidence.alias("confidence")
        )

    topic = some("process", "material", "equipment", "property")
    circulates = any_of(plain, CIRCULATION_MEDIA) & any_of(plain, CIRCULATION_FLOW) & any_of(plain, CIRCULATION_PLACE)
    single = F.array_compact(
        F.array(
            F.when(circulates, fact("TechnologySolutionFact", "circulation", label, F.lit(0.84), F.when(any_of(plain, CIRCULATION_PLACE[:3]), "электроэкстракция").otherwise(F.col("process")))),
            F.when(any_of(plain, TECHNOLOGY) & topic.isNotNull(), fact("TechnologySolutionFact", "technology", topic, F.when(F.col("process").isNotNull() & some("material", "equipment", "property").isNotNull(), 0.81).otherwise(0.77))),
            F.when(any_of(plain, CLAIM) & topic.isNotNull(), fact("PublicationClaimFact", "claim", some("property", "process", "material", "equipment"), F.lit(0.79))),
            F.when(expert.isNotNull() & topic.isNotNull(), fact("ExpertiseFact", "expertise", expert, F.lit(0.78))),
        )
    )
    price = lambda m, g: F.regexp_extract(m, _PRICE, g)
    priced = F.transform(F.regexp_extract_all("plain", F.lit(_PRICE), F.lit(0)), lambda m: fact("EconomicIndicatorFact", "economic", indicator, F.lit(0.80), value=number(price(m, 1)), unit=U.unit_label(price(m, 2))))
    kind = "array<struct<fact_type:string,adapter:string,material:string,process:string,detail:string,value:double,unit:string,confidence:double>>"
    priced = F.when(_some(plain, ["usd/", "$/t", "rub", "руб"]), priced.cast(kind)).otherwise(F.array().cast(kind))
    return n.select(*KEY, *more, F.explode(F.array_distinct(F.concat(single, priced))).alias("f")).select(*KEY, *more, "f.*").distinct()


def row_cells(text: Column) -> Column:
    """array of (k, v) of a serialised row, in order; keys lower-cased with yo folded, blank values dropped, of repeated keys the last wins."""
    key = lambda c: F.regexp_replace(F.translate(F.lower(F.trim(F.split_part(c, F.lit(":"), F.lit(1)))), "ё", "е"), r"\s+", " ")
    cells = F.transform(F.split(text, r" \| "), lambda c: F.struct(key(c).alias("k"), F.when(F.instr(c, ":") > 0, F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c)))).otherwise("").alias("v")))
    full = F.filter(cells, lambda c: (c["v"] != "") & (c["k"] != ""))
    later = lambda x, i: F.slice(x, i + 2, F.greatest(F.size(x) - i - 1, F.lit(0)))
    return let(full, lambda x: F.filter(x, lambda c, i: ~F.exists(later(x, i), lambda d: d["k"] == c["k"])))


CELLS_SQL = rf"""{ROW_SQL}, x AS (SELECT {_ID}, text, list_filter(list_transform(string_split(text, ' | '), lambda c: struct_pack(k := regexp_replace(replace(lower(trim(split_part(c, ':', 1))), 'ё', 'е'), '\s+', ' ', 'g'),
    v := CASE WHEN contains(c, ':') THEN trim(substr(c, strpos(c, ':') + 1)) ELSE '' END)), lambda c: c.v <> '' AND c.k <> '') AS c FROM t),
    r AS (SELECT {_ID}, text, list_filter(c, lambda x, i: NOT list_contains(list_transform(c[i + 1:], lambda y: y.k), x.k)) AS c FROM x)"""


@query(f"WITH {CELLS_SQL}, p AS (SELECT {_ID}, unnest(c) AS e FROM r) SELECT {_ID}, e.k AS key, e.v AS value FROM p")
def e10_serialised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_rows(spark, sf_dir).select(*KEY, F.explode(row_cells(F.col("text"))).alias("c")).select(*KEY, F.col("c.k").alias("key"), F.col("c.v").alias("value"))


# The headers of each role.
ROLES = {
    "material": ["material", "материал", "сплав", "alloy", "grade", "марка", "вещество", "руда", "концентрат", "штейн", "шлак", "раствор"],
    "regime": ["regime", "режим", "process", "обработка", "термообработка", "process_regime", "процесс", "технология", "метод", "method"],
    "property": ["property", "свойство", "показатель", "metric", "parameter", "параметр", "условие", "condition", "indicator"],
    "value": ["value", "значение", "result", "результат", "capacity", "мощность", "производительность", "effect", "эффект"],
    "unit": ["unit", "ед.", "единица", "units", "ед. изм.", "единицы"],
    "equipment": ["equipment", "оборудование", "установка", "stand", "device", "cell", "furnace", "reactor"],
    "laboratory": ["laboratory", "лаборатория", "lab"],
    "team": ["team", "команда", "group", "группа"],
    "employee": ["employee", "сотрудник", "researcher", "исполнитель", "author", "expert", "эксперт", "автор"],
    "conclusion": ["conclusion", "вывод", "effect", "эффект"],
    "topic": ["tag", "topic", "тематика", "тег"],
}


def role(cells: Column, headers: list[str]) -> Column:
    """The first cell whose key is one of the headers; else the first whose key holds one; else ''."""
    exact = F.filter(cells, lambda c: F.array_contains(F.array(*map(F.lit, headers)), c["k"]))
    near = F.filter(cells, lambda c: any_of(c["k"], headers))
    return F.coalesce(F.get(exact, F.lit(0))["v"], F.get(near, F.lit(0))["v"], F.lit(""))


def role_sql(headers: list[str]) -> str:
    exact = "(" + ", ".join(f"'{h}'" for h in headers) + ")"
    return f"coalesce((list_filter(c, lambda x: x.k IN {exact})[1]).v, (list_filter(c, lambda x: {any_sql('x.k', headers)})[1]).v, '')"


@query(f"WITH {CELLS_SQL} SELECT {_ID}, " + ", ".join(f"{role_sql(h)} AS {n}" for n, h in ROLES.items()) + " FROM r")
def e11_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that plays each role in a table row."""
    return with_roles(table_rows(spark, sf_dir)).select(*KEY, *ROLES)


def with_roles(rows: DataFrame) -> DataFrame:
    held = rows.withColumn("cells", row_cells(F.col("text")))
    return held.select(*KEY, "text", "cells", *(role(F.col("cells"), headers).alias(name) for name, headers in ROLES.items()))


_NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
_VALUE_SQL = f"try_cast(replace(nullif(regexp_extract(value, '{_NUMBER}'), ''), ',', '.') AS DOUBLE)"
_NAMED = {"material": "material", "regime": "regime", "property": "property", "equipment": "equipment"}


def _named_sql(column: str) -> str:
    return f"(SELECT coalesce({V.first_sql(_NAMED[column])}, trim({column})) FROM (SELECT {V.forms_sql(column)}))"


@query(
    f"""WITH {CELLS_SQL}, p AS (SELECT {_ID}, """
    + ", ".join(f"{role_sql(h)} AS {n}" for n, h in ROLES.items())
    + f""" FROM r) SELECT {_ID}, {', '.join(f'{_named_sql(c)} AS {c}' for c in _NAMED)}, {_VALUE_SQL} AS value, {U.unit_label_sql('unit')} AS unit, {effect_sql('lower(conclusion)')} AS effect, laboratory, team, employee, topic,
    CASE WHEN material <> '' AND property <> '' AND {_VALUE_SQL} IS NOT NULL THEN 0.86 ELSE 0.5 END::DOUBLE AS confidence FROM p"""
)
def e12_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row as an experiment: names resolved, value, unit and effect read; rows without material, property or value count little."""
    p = with_roles(table_rows(spark, sf_dir))
    value = number(F.regexp_extract("value", _NUMBER, 0))
    whole = (F.col("material") != "") & (F.col("property") != "") & value.isNotNull()
    return p.select(
        *KEY,
        *(V.canonical_name(F.col(c), d).alias(c) for c, d in _NAMED.items()),
        value.alias("value"),
        U.unit_label(F.col("unit")).alias("unit"),
        effect_of(F.lower("conclusion")).alias("effect"),
        "laboratory",
        "team",
        "employee",
        "topic",
        F.when(whole, 0.86).otherwise(0.5).alias("confidence"),
    )


# Assay headers (analyte and unit) and wide capacity headers (year and unit).
ASSAY = r"^(au|ag|cu|ni|co|fe|s|pt|pd|pb|zn|as), ?(g/t|г/т|%|mg/l|мг/л|mg/kg|ppm)$"
WIDE = r"^(?:capacity|мощность|производительность)[^0-9]*((?:19|20)[0-9]{2}), ?(t/y|т/год|kt/y|t/day|m3/h|%)$"


@query(
    f"""WITH {CELLS_SQL}, e AS (SELECT {_ID}, unnest(list_slice(list_filter(c, lambda x: regexp_matches(x.k, '{ASSAY}') OR regexp_matches(x.k, '{WIDE}')), 1, 6)) AS e FROM r),
    n AS (SELECT {_ID}, e.k AS k, list_transform(regexp_extract_all(e.v, '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')::DOUBLE) AS n FROM e)
    SELECT {_ID}, CASE WHEN regexp_matches(k, '{ASSAY}') THEN 'assay' ELSE 'capacity' END AS fact_type, CASE WHEN regexp_matches(k, '{ASSAY}') THEN regexp_extract(k, '{ASSAY}', 1) ELSE regexp_extract(k, '{WIDE}', 1) END AS subject,
    {U.unit_label_sql(f"CASE WHEN regexp_matches(k, '{ASSAY}') THEN regexp_extract(k, '{ASSAY}', 2) ELSE regexp_extract(k, '{WIDE}', 2) END")} AS unit, list_min(n) AS value, list_min(n) AS value_min, list_max(n) AS value_max FROM n WHERE len(n) > 0"""
)
def e13_typed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay and wide capacity cells as candidates, up to six in a row; of a range the lower bound is the value."""
    cells = F.slice(F.filter(row_cells(F.col("text")), lambda c: c["k"].rlike(ASSAY) | c["k"].rlike(WIDE)), 1, 6)
    e = table_rows(spark, sf_dir).select(*KEY, F.explode(cells).alias("c")).select(*KEY, F.col("c.k").alias("k"), F.transform(F.regexp_extract_all("c.v", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), number).alias("n"))
    is_assay = F.col("k").rlike(ASSAY)
    part = lambda g: F.when(is_assay, F.regexp_extract("k", ASSAY, g)).otherwise(F.regexp_extract("k", WIDE, g))
    return e.where(F.size("n") > 0).select(
        *KEY, F.when(is_assay, "assay").otherwise("capacity").alias("fact_type"), part(1).alias("subject"), U.unit_label(part(2)).alias("unit"), F.array_min("n").alias("value"), F.array_min("n").alias("value_min"), F.array_max("n").alias("value_max")
    )


@query(
    f"""WITH {CELLS_SQL}, p AS (SELECT {_ID}, 'table_row' AS kind, CASE WHEN {role_sql(ROLES['material'])} <> '' AND {role_sql(ROLES['property'])} <> '' THEN 'experiment' WHEN len(c) > 0 THEN 'cells' ELSE 'nothing' END AS result FROM r),
    u AS (SELECT text, {V.forms_sql('text')} FROM chunks WHERE kind = 'text'),
    k AS (SELECT kind, result FROM p UNION ALL SELECT 'text', CASE WHEN text = '' THEN 'nothing' WHEN {' OR '.join(f"regexp_matches(plain, '{pattern}')" for pattern in [*(m[0] for m in MEASUREMENTS), CORROSION])} THEN 'experiment' ELSE 'prose' END FROM u)
    SELECT kind, result, count(*) AS n FROM k GROUP BY ALL"""
)
def e1_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk goes to the extractor of its kind; what comes back, by kind and result."""
    rows = with_roles(table_rows(spark, sf_dir)).select(
        F.lit("table_row").alias("kind"), F.when((F.col("material") != "") & (F.col("property") != ""), "experiment").when(F.size("cells") > 0, "cells").otherwise("nothing").alias("result")
    )
    found = F.size(measurements(F.col("plain"))) > 0
    text = prose(spark, sf_dir).select(F.lit("text").alias("kind"), F.when(F.col("text") == "", "nothing").when(found, "experiment").otherwise("prose").alias("result"))
    return rows.unionAll(text).groupBy("kind", "result").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXT_SQL} SELECT {_ID}, " + ", ".join(f"coalesce({V.first_sql(d)}, '') AS {d}" for d in V.NAMES) + " FROM t")
def d1_alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of each domain in a chunk; '' where there is none."""
    return prose(spark, sf_dir).select(*KEY, *(F.coalesce(V.first_name(d), F.lit("")).alias(d) for d in V.NAMES))


_LABELS_SQL = "list_value(" + ", ".join(f"'{x}'" for x in MATERIALS + REGIMES) + ")"
_COMPACT_SQL = r"regexp_replace(replace(lower(trim(label)), 'ё', 'е'), '[\s_-]', '', 'g')"


@query(
    f"""WITH a AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, {_LABELS_SQL}[l_partkey % {len(MATERIALS + REGIMES)} + 1] AS label FROM lineitem),
    d(k, name, type, p) AS (VALUES """
    + ", ".join(f"('{V.squeezed(a)}', '{c}', '{t}', {i})" for d, t in (("material", "Material"), ("regime", "Process"), ("equipment", "Equipment")) for i, (a, c) in enumerate(V.ordered(d)))
    + f") SELECT {_ID}, label, arg_min(name, (type, p)) AS resolved, arg_min(type, (type, p)) AS type FROM a LEFT JOIN d ON {_COMPACT_SQL} = k GROUP BY ALL"
)
def d3_registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels resolved by their exact spelling, also without separators: a hash join with the vocabulary."""
    labels = MATERIALS + REGIMES
    asked = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.element_at(F.array(*map(F.lit, labels)), (F.col("l_partkey") % len(labels) + 1).cast("int")).alias("label")
    )
    kind = F.when(F.col("domain") == "material", "Material").when(F.col("domain") == "regime", "Process").when(F.col("domain") == "equipment", "Equipment")
    dim = V.dim_alias(spark).withColumn("type", kind).where("type is not null")
    # The vocabulary is made one row for each spelling first, so a label meets one row at most.
    best = dim.groupBy("alias_compact").agg(F.min(F.struct("type", "priority", "canonical")).alias("best"))
    joined = asked.join(F.broadcast(best), compact(F.col("label")) == F.col("alias_compact"), "left")
    return joined.select(*KEY, "label", F.col("best.canonical").alias("resolved"), F.col("best.type").alias("type")).distinct()


_UNITS = ["МПа", " mpa", "GPa", "ksi", "hv", "Г/Т", "мг/дм³", "м3/ч", "т/сут", "тыс.т/год", "$/t", "руб./т", "°С", "furlong", "%", "млн руб/год"]
_UNIT_SQL = "list_value(" + ", ".join(f"'{u}'" for u in _UNITS) + f")[(l_orderkey + l_linenumber) % {len(_UNITS)} + 1]"


@query(f"SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, {U.unit_label_sql(_UNIT_SQL)} AS unit FROM lineitem")
def d4_unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _UNITS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_UNITS) + 1).cast("int"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), U.unit_label(raw).alias("unit"))


@query(f"WITH {TEXT_SQL} SELECT {_ID}, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{g}' END" for m, g in V.GEOGRAPHY.items()) + "], lambda x: x IS NOT NULL))), ',') AS geographies FROM t")
def d11_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select(*KEY, F.array_join(V.geographies(F.col("text")), ",").alias("geographies"))


@query(f"WITH {TEXT_SQL} SELECT {_ID}, try_cast(replace(nullif(regexp_extract(text, '-?[0-9]+(?:[.,][0-9]+)?'), ''), ',', '.') AS DOUBLE) AS number FROM t")
def d12_first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select(*KEY, U.decimal(F.col("text")).alias("number"))


@query(
    f"""WITH {TEXT_SQL}, m AS (SELECT {_ID}, {V.first_sql('regime')} AS process, regexp_extract(text, '([0-9]+) C\\b', 1) AS t, regexp_extract(text, '([0-9]+) h\\b', 1) AS h FROM t)
    SELECT {_ID}, CASE WHEN try_cast(nullif(t, '') AS INT) >= 30 THEN coalesce(process, 'treatment') || ' (' || concat_ws(', ', t || ' C', CASE WHEN h <> '' THEN h || ' h' END) || ')' ELSE process END AS regime FROM m"""
)
def e23_regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process with temperature and time; temperatures below 30 are no treatment."""
    t, h = F.regexp_extract("text", r"([0-9]+) C\b", 1), F.regexp_extract("text", r"([0-9]+) h\b", 1)
    process = V.first_name("regime")
    label = F.concat(F.coalesce(process, F.lit("treatment")), F.lit(" ("), F.concat_ws(", ", F.concat(t, F.lit(" C")), F.when(h != "", F.concat(h, F.lit(" h")))), F.lit(")"))
    return prose(spark, sf_dir).select(*KEY, F.when(t.try_cast("int") >= 30, label).otherwise(process).alias("regime"))


# The family of facts that a property or, without one, a unit belongs to.
FAMILIES = {
    "MechanicalPropertyFact": (["прочность", "твёрдость", "пластичность", "вязкость"], ["MPa", "GPa", "ksi", "HV", "HRC"]),
    "ProcessParameterFact": (["концентрация", "сухой остаток", "скорость потока", "расход", "извлечение", "выход металла", "распределение", "температура"], ["mg/L", "g/L", "ppm", "m/s", "m3/h", "g/t", "C", "bar"]),
    "EconomicIndicatorFact": (["экономический показатель"], ["USD/t", "EUR/t", "RUB/t", "USD/m3", "RUB/m3", "mln RUB"]),
    "FacilityCapacityFact": (["производительность"], ["t/day", "t/y", "kt/y", "Mt/y"]),
    "ExperimentResultFact": (["коррозионная стойкость", "эффективность"], []),
}


def family(prop: Column, unit: Column) -> Column:
    by_property = reduce(lambda acc, kv: acc.when(prop.isin(kv[1][0]), kv[0]), FAMILIES.items(), F.when(F.lit(False), F.lit("")))
    return reduce(lambda acc, kv: acc.when(unit.isin(kv[1][1]), kv[0]), ((k, v) for k, v in FAMILIES.items() if v[1]), by_property).otherwise("ExperimentResultFact")


def _family_sql() -> str:
    listed = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return "CASE " + " ".join(f"WHEN property IN {listed(p)} THEN '{k}'" for k, (p, _) in FAMILIES.items()) + " " + " ".join(f"WHEN unit IN {listed(u)} THEN '{k}'" for k, (_, u) in FAMILIES.items() if u) + " ELSE 'ExperimentResultFact' END"


@query(f"WITH {TEXT_SQL}, m AS ({_measurements_sql()}) SELECT {_family_sql()} AS family, property, unit, count(*) AS n FROM m GROUP BY ALL")
def e20_fact_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements by family of facts."""
    return e4_measurements(spark, sf_dir).groupBy(family(F.col("property"), F.col("unit")).alias("family"), "property", "unit").agg(F.count(F.lit(1)).alias("n"))


_CLAIMED = r"(\d+(?:[.,]\d+)?)\s*(mpa|мпа|ksi|hv|hrc|%|мг/л|mg/l)"


@query(
    f"""WITH {TEXT_SQL}, c AS (SELECT {_ID}, unnest(regexp_extract_all(plain, '{_CLAIMED}', 1)) AS v, unnest(regexp_extract_all(plain, '{_CLAIMED}', 2)) AS u FROM t),
    k AS (SELECT DISTINCT order_id, line, replace(v, ',', '.')::DOUBLE AS claimed, {U.unit_label_sql('u')} AS unit FROM c)
    SELECT order_id, line, claimed, unit, abs(claimed - l_quantity) <= greatest(1.0, 0.005 * abs(l_quantity)) AS supported FROM k JOIN lineitem ON l_orderkey = order_id AND l_linenumber = line"""
)
def i11_grounding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric claims of chunks against the line item that they tell of: supported within max(1, .5 %) of its quantity."""
    claims = prose(spark, sf_dir).select(*KEY, F.explode(F.arrays_zip(F.regexp_extract_all("plain", F.lit(_CLAIMED), F.lit(1)).alias("v"), F.regexp_extract_all("plain", F.lit(_CLAIMED), F.lit(2)).alias("u"))).alias("c"))
    claims = claims.select(*KEY, number(F.col("c.v")).alias("claimed"), U.unit_label(F.col("c.u")).alias("unit")).distinct()
    known = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").alias("known"))
    near = F.abs(F.col("claimed") - F.col("known")) <= F.greatest(F.lit(1.0), 0.005 * F.abs("known"))
    return claims.join(known, KEY).select(*KEY, "claimed", "unit", near.alias("supported"))


# Families of entities that are told by their form.
FORMS = {
    "ArticleNumber": r"DN[0-9]+|NPK-[0-9]+",
    "Standard": r"(?:ГОСТ|ISO|ASTM|DIN)\s?[A-Z]?[0-9][0-9.\-]*",
    "Part": r"[Pp]ump|[Vv]alve|[Нн]асос|[Кк]лапан|spoon",
    "Grade": r"[0-9]{2}[А-ЯX][0-9]{2}[А-ЯXH][0-9]*[А-ЯT]?|[0-9]{4}-T[0-9]",
}
_RELATIONS = [("USES_REGIME", "regime", 0.78), ("STUDIES", "material", 0.82), ("USES_EQUIPMENT", "equipment", 0.72), ("MEASURES", "property", 0.80)]


def _kinds() -> list[tuple[str, str]]:
    return [("Material", "material"), ("ProcessRegime", "regime"), ("Property", "property"), ("Equipment", "equipment")]


@query(
    f"WITH {TEXT_SQL}, f AS (SELECT {_ID}, "
    + ", ".join(f"{V.all_sql(d)} AS {d}" for _, d in _kinds())
    + ", "
    + ", ".join(f"list_distinct(regexp_extract_all(text, '{p}')) AS \"{n}\"" for n, p in FORMS.items())
    + ", nullif(ltrim(regexp_extract(text, '"
    + EXPERIMENT
    + f"', 1), ' ('), '') AS experiment FROM t), e AS ("
    + " UNION ALL ".join([f"SELECT {_ID}, '{k}' AS type, unnest({d}) AS name FROM f" for k, d in _kinds()] + [f"SELECT {_ID}, '{n}', unnest(\"{n}\") FROM f" for n in FORMS] + [f"SELECT {_ID}, 'Experiment', experiment FROM f WHERE experiment IS NOT NULL"])
    + ") SELECT type, name, count(*) AS n_chunks FROM e GROUP BY ALL"
)
def e2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by family, with the number of chunks that name them."""
    return entities(prose(spark, sf_dir)).groupBy("type", "name").agg(F.count(F.lit(1)).alias("n_chunks"))


def entities(texts: DataFrame) -> DataFrame:
    """(order_id, line, text, plain, packed) -> (order_id, line, type, name), each once for a chunk."""
    typed = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))
    by_name = [typed(kind, V.all_names(d)) for kind, d in _kinds()]
    by_form = [typed(kind, F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))) for kind, p in FORMS.items()]
    experiment = F.nullif(F.ltrim(F.regexp_extract("text", EXPERIMENT, 1), F.lit(" (")), F.lit(""))
    own = typed("Experiment", F.array_compact(F.array(experiment)))
    return texts.select(*KEY, F.explode(F.flatten(F.array(*by_name, *by_form, own))).alias("e")).select(*KEY, "e.type", "e.name")


@query(
    f"WITH {TEXT_SQL}, f AS (SELECT {_ID}, coalesce(nullif(ltrim(regexp_extract(text, '{EXPERIMENT}', 1), ' ('), ''), 'EXP-' || substr(sha256(order_id || '|' || line), 1, 12)) AS subject, "
    + ", ".join(f"{V.all_sql(d)} AS {d}" for _, d, _ in _RELATIONS)
    + " FROM t), r AS (SELECT * FROM f WHERE len(material) > 0 AND (len(regime) > 0 OR len(property) > 0)) "
    + " UNION ALL ".join(f"SELECT {_ID}, subject, '{p}' AS predicate, unnest({d}[1:12]) AS object, {c}::DOUBLE AS confidence FROM r" for p, d, c in _RELATIONS)
)
def e2_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the experiment that a chunk tells of, if it names a material and a regime or property: up to twelve of a kind."""
    stated = F.nullif(F.ltrim(F.regexp_extract("text", EXPERIMENT, 1), F.lit(" (")), F.lit(""))
    made = F.concat(F.lit("EXP-"), F.substring(F.sha2(F.concat_ws("|", *KEY), 256), 1, 12))
    f = prose(spark, sf_dir).select(*KEY, F.coalesce(stated, made).alias("subject"), *(V.all_names(d).alias(d) for _, d, _ in _RELATIONS))
    one = lambda p, d, c: F.transform(F.slice(d, 1, 12), lambda o: F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit(c).alias("confidence")))
    told = (F.size("material") > 0) & ((F.size("regime") > 0) | (F.size("property") > 0))
    return f.select(*KEY, "subject", F.explode(F.when(told, F.flatten(F.array(*(one(*r) for r in _RELATIONS))))).alias("r")).select(*KEY, "subject", "r.*")
