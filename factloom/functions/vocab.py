"""Alias vocabulary: fixed names, their spellings, and how a text is matched against them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.search import met
from factloom.functions.text import canonical, compact, let, trie

# Canonical names of materials, regimes, properties and equipment, and their spellings.
NAMES = {
    "material": {
        "ВТ6": ["вт6", "vt6", "ti-6al-4v", "ti6al4v"],
        "12Х18Н10Т": ["12х18н10т", "12x18h10t"],
        "7075-T6": ["7075-t6", "7075"],
        "никель": ["никель", "никеля", "никелевым", "nickel", "ni"],
        "медь": ["медь", "медный", "медным", "copper", "cu"],
        "сульфаты": ["сульфаты", "сульфат", "sulfates", "so4"],
        "SO2": ["so2", "so₂", "диоксид серы", "sulfur dioxide"],
        "хлориды": ["хлориды", "хлорид", "chlorides", "cl"],
        "Ca": ["ca", "кальций", "calcium"],
        "Mg": ["mg", "магний", "magnesium"],
        "Na": ["na", "натрий", "sodium"],
        "Au": ["золото", "gold", "au"],
        "Ag": ["серебро", "silver", "ag"],
        "МПГ": ["мпг", "pgm"],
        "штейн": ["штейн", "matte"],
        "шлак": ["шлак", "slag"],
        "шахтные воды": ["шахтные воды", "шахтных вод", "mine water"],
        "католит": ["католит", "catholyte"],
        "электролит": ["электролит", "электролита", "electrolyte"],
    },
    "regime": {
        "отжиг": ["отжиг", "отжига", "отжиге", "annealing"],
        "старение": ["старение", "старения", "старении", "aging"],
        "термообработка": ["heat treatment", "термообработка"],
        "закалка": ["закалка", "закалки", "закалке", "quenching"],
        "криообработка": ["криообработка", "криообработки", "криообработке", "cryogenic treatment"],
        "обессоливание": ["обессоливание", "обессоливания", "desalination", "водоочистка"],
        "электроэкстракция": ["электроэкстракция", "электроэкстракции", "электролиз", "электролиза", "electrowinning", "electrolysis"],
        "циркуляция католита": ["циркуляция католита", "циркуляции католита", "catholyte circulation"],
        "кучное выщелачивание": ["кучное выщелачивание", "кучного выщелачивания", "heap leaching"],
        "выщелачивание": ["выщелачивание", "leaching"],
        "пирометаллургия": ["пирометаллургия", "pyrometallurgy"],
        "гидрометаллургия": ["гидрометаллургия", "hydrometallurgy"],
        "ПВП": ["печь взвешенной плавки", "пвп", "flash smelting furnace"],
        "газоочистка": ["газоочистка", "очистка газов", "очистки газов", "gas cleaning"],
        "удаление SO2": ["удаление so2", "удаление диоксида серы", "so2 removal"],
        "закачка шахтных вод": ["закачка шахтных вод", "закачки шахтных вод", "deep well injection"],
    },
    "property": {
        "прочность": ["прочность", "прочности", "предел прочности", "tensile strength", "ultimate tensile strength", "strength", "σв", "sigma_b"],
        "твёрдость": ["твердость", "твердости", "hardness", "hv", "hrc"],
        "пластичность": ["пластичность", "пластичности", "elongation", "ductility"],
        "вязкость": ["вязкость", "вязкости", "ударная вязкость", "impact toughness"],
        "коррозионная стойкость": ["коррозионная стойкость", "коррозионной стойкости", "коррозионную стойкость", "corrosion resistance", "corrosion"],
        "концентрация": ["концентрация", "концентрации", "concentration"],
        "сухой остаток": ["сухой остаток", "total dissolved solids", "tds"],
        "скорость потока": ["скорость потока", "скорость циркуляции", "flow velocity"],
        "расход": ["расход", "расход раствора", "расход католита", "подача", "flow rate", "feed rate"],
        "температура": ["температура", "temperature"],
        "производительность": ["производительность", "capacity", "throughput"],
        "извлечение": ["извлечение", "recovery"],
        "выход металла": ["выход металла", "metal yield"],
        "распределение": ["распределение", "распределению", "distribution"],
        "экономический показатель": ["технико-экономические показатели", "экономический показатель", "capex", "opex", "капитальные затраты", "эксплуатационные затраты"],
        "эффективность": ["эффективность", "efficiency"],
    },
    "equipment": {
        "ванна электроэкстракции": ["ванна электроэкстракции", "ванны электроэкстракции", "electrowinning cell"],
        "диафрагменная ячейка": ["диафрагменная ячейка", "диафрагменные ячейки", "diaphragm cell"],
        "ПВП": ["печь взвешенной плавки", "пвп", "flash smelting furnace"],
        "система газоочистки": ["система газоочистки", "система очистки газов", "gas cleaning system"],
        "насос": ["насос", "насосы", "pump", "pumps"],
        "пилотная установка": ["pilot plant", "пилотная установка"],
        "установка": ["установка", "установки"],
    },
}
GEOGRAPHY = {"росси": "Россия", "russia": "Россия", "china": "Китай", "кита": "Китай", "german": "Германия", "герман": "Германия"}
#: A spelling of so many characters counts as a whole word only.
SHORT = 3
ALIASES = {domain: {alias: name for name, spellings in names.items() for alias in spellings} for domain, names in NAMES.items()}


def ordered(domain: str) -> list[tuple[str, str]]:
    """(spelling, name), the longest first, then by spelling."""
    return sorted(ALIASES[domain].items(), key=lambda kv: (-len(kv[0]), kv[0]))


def squeezed(alias: str) -> str:
    return "".join(ch for ch in alias if ch not in " _-")


def whole_word(alias: str) -> str:
    """A pattern that any engine reads alike: the spelling with no letter or digit beside it."""
    return rf"(?:^|[^\p{{L}}\p{{N}}]){re.escape(alias)}(?:$|[^\p{{L}}\p{{N}}])"


def dim_alias(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(domain, alias_norm, alias_compact, canonical, priority); path: a Parquet table (domain, alias, canonical) of more spellings, which come after.

    The vocabulary is asked for, so it doesn't grow with the data.
    """
    rows = [(d, a, c, i) for d in ALIASES for i, (a, c) in enumerate(ordered(d))]
    table = spark.createDataFrame(rows, "domain string, alias string, canonical string, priority int")
    if path is not None:
        table = table.unionByName(spark.read.parquet(path).select("domain", "alias", "canonical", F.lit(len(rows)).alias("priority")))
    return table.select("domain", canonical(F.col("alias")).alias("alias_norm"), compact(F.col("alias")).alias("alias_compact"), "canonical", "priority")


def with_forms(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the forms of a text that names are looked up in, and what is met there of every domain, computed once for all of them: plain, packed and met."""
    plain = df.withColumn("plain", canonical(F.col(text)))
    return plain.withColumn("packed", F.regexp_replace("plain", r"[\s_-]", "")).withColumn("met", met(F.col("plain"), *_tables(list(NAMES))))


#: Every spelling as (domain, spelling, name); those of a domain stand together, the longest first, and are known by their place.
SPELLINGS = [(domain, alias, name) for domain in NAMES for alias, name in ordered(domain)]
PLACES = {domain: [i for i, s in enumerate(SPELLINGS) if s[0] == domain] for domain in NAMES}


def _tables(domains: list[str]) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Long spellings without separators, and short ones, with their places.  A short one with another sign than letters and digits is never a whole word."""
    long: dict[str, list[int]] = {}
    short: dict[str, list[int]] = {}
    for i, (domain, alias, _) in enumerate(SPELLINGS):
        if domain in domains and len(alias) > SHORT:
            long.setdefault(squeezed(alias), []).append(i)
        elif domain in domains and alias.isalnum():
            short.setdefault(alias, []).append(i)
    return long, short


def _met(plain: Column, packed: Column, domains: list[str]) -> Column:
    """The places of all spellings of some domains that a short text holds, in order; also of a lambda's variable.

    A text that holds a spelling as it is holds it without separators too, so long ones are looked up in the packed form only.  One pattern finds the longest
    spelling that begins at each character; those that it begins with are there as well.
    """
    long, short = _tables(domains)
    began = {q: sorted(i for p, places in long.items() if q.startswith(p) for i in places) for q in long}
    places = lambda found, table: F.transform(found, lambda x: F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,array<int>>"), x))
    none = F.array().cast("array<array<int>>")
    of_long = places(F.regexp_extract_all(packed, F.lit(f"(?=({trie(began)}))"), F.lit(1)), began) if long else none
    of_short = places(F.regexp_extract_all(plain, F.lit(rf"(?<![\p{{L}}\p{{N}}])({trie(short)})(?![\p{{L}}\p{{N}}])"), F.lit(1)), short) if short else none
    return F.array_sort(F.array_distinct(F.flatten(F.concat(of_long, of_short))))


def _in(domain: str) -> Column:
    return F.filter("met", lambda x: x.between(PLACES[domain][0], PLACES[domain][-1]))


def _names() -> Column:
    return F.from_json(F.lit(json.dumps([name for _, _, name in SPELLINGS])), "array<string>")


def matches(domain: str) -> Column:
    """array of (a: spelling, p: without separators, name) that a row of with_forms() holds, the longest first."""
    rows = F.from_json(F.lit(json.dumps([{"a": a, "p": squeezed(a), "name": name} for _, a, name in SPELLINGS])), "array<struct<a:string,p:string,name:string>>")
    return F.transform(_in(domain), lambda x: F.get(rows, x))


def first_name(domain: str) -> Column:
    """The name of the longest spelling in a row of with_forms(); null if there is none."""
    return F.get(_names(), F.get(_in(domain), F.lit(0)))


def all_names(domain: str) -> Column:
    """Every name of which a row of with_forms() holds a spelling, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_in(domain), lambda x: F.get(_names(), x))))


def canonical_name(x: Column, domain: str) -> Column:
    """The name of the longest spelling that a short text holds; else the trimmed text."""
    forms = F.struct(canonical(x).alias("plain"), compact(x).alias("packed"))
    found = let(forms, lambda f: F.get(_names(), F.get(_met(f["plain"], f["packed"], [domain]), F.lit(0))))
    return F.coalesce(found, F.trim(F.coalesce(x, F.lit(""))))


def geographies(x: Column) -> Column:
    """Labels whose marker is in the text, sorted."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(m), label) for m, label in GEOGRAPHY.items())))))


def forms_sql(x: str) -> str:
    """The same forms in SQL, of a column that isn't null."""
    plain = rf"regexp_replace(replace(lower(trim({x})), 'ё', 'е'), '\s+', ' ', 'g')"
    return f"{plain} AS plain, regexp_replace({plain}, '[ _-]', '', 'g') AS packed"


def held_sql(alias: str) -> str:
    return f"regexp_matches(plain, '{whole_word(alias)}')" if len(alias) <= SHORT else f"(contains(plain, '{alias}') OR contains(packed, '{squeezed(alias)}'))"


def first_sql(domain: str) -> str:
    return "CASE " + " ".join(f"WHEN {held_sql(a)} THEN '{c}'" for a, c in ordered(domain)) + " END"


def all_sql(domain: str) -> str:
    parts = (f"CASE WHEN {' OR '.join(map(held_sql, spellings))} THEN '{name}' END" for name, spellings in NAMES[domain].items())
    return f"list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"
