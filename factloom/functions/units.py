"""Units and measured values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Megapascals of one ksi.
KSI = 6.894757

# Units and their spellings, in lower case and without spaces.
UNIT_NAMES = {
    "MPa": ["mpa", "мпа"], "GPa": ["gpa", "гпа"], "ksi": ["ksi"], "psi": ["psi"], "bar": ["bar", "бар"],
    "HV": ["hv"], "HRC": ["hrc"], "HB": ["hb"], "%": ["%"], "ppm": ["ppm"], "pH": ["ph"],
    "C": ["c", "с", "°c", "°с", "celsius"], "K": ["k"], "mm": ["mm", "мм"],
    "h": ["h", "hr", "hrs", "hour", "hours", "ч", "ч."], "min": ["min", "mins", "minute", "minutes", "мин", "мин."],
    "mg/L": ["mg/l", "mg/dm3", "mg/dm³", "мг/л", "мг/дм3", "мг/дм³"], "g/L": ["g/l", "г/л"], "g/t": ["g/t", "г/т"], "mg/kg": ["mg/kg", "мг/кг"],
    "m/s": ["m/s", "м/с"], "m3/h": ["m3/h", "m³/h", "м3/ч", "м³/ч"],
    "t/day": ["t/day", "t/d", "т/сут", "т/сутки"], "t/y": ["t/y", "t/year", "tpa", "tonnes/year", "tons/year", "т/год", "т/г"],
    "kt/y": ["kt/y", "kt/year", "ktpa", "кт/год", "тыс.т/год", "тыст/год"], "Mt/y": ["mt/y", "mt/year", "mtpa", "мт/год", "млнт/год", "млн.т/год"],
    "USD/t": ["usd/t", "$/t"], "EUR/t": ["eur/t", "€/t"], "RUB/t": ["rub/t", "руб/т", "руб./т"],
    "USD/m3": ["usd/m3"], "RUB/m3": ["rub/m3", "руб/м3", "руб/м³"], "mln RUB": ["млнруб"], "mln RUB/year": ["млнруб/год"],
}
UNIT_LABELS = {spelling: label for label, spellings in UNIT_NAMES.items() for spelling in spellings}


def unit_label(x: Column) -> Column:
    """The label of a unit; an unknown one is unchanged."""
    names = F.create_map(*(F.lit(v) for pair in UNIT_LABELS.items() for v in pair))
    return F.coalesce(F.element_at(names, F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit(""))), F.trim(x))


def unit_label_sql(x: str) -> str:
    """The same in SQL."""
    return f"coalesce(CASE replace(lower(trim({x})), ' ', '') " + " ".join(f"WHEN '{s}' THEN '{u}'" for s, u in UNIT_LABELS.items()) + f" END, trim({x}))"


def to_mpa(value: Column, unit: Column) -> Column:
    """A strength in MPa, null if its unit is neither MPa nor ksi."""
    label = F.lower(unit_label(unit))
    return F.when(label == "ksi", value * KSI).when(label == "mpa", value)


def value_text(value: Column) -> Column:
    """At most three decimals without trailing zeros; empty for null."""
    return F.coalesce(F.regexp_replace(F.format_string("%.3f", F.round(value, 3)), r"\.?0+$", ""), F.lit(""))


def decimal(text: Column) -> Column:
    """The first number in a text, with a comma or a point."""
    return F.replace(F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
