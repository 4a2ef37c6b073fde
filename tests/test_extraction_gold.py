"""Rules of extraction against rows written by hand, apart from the tables of patterns that the SQL is made of."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions.vocab import with_forms
from factloom.operators.extract import measurements
from factloom.operators.guards import shortest, validated_measurements

#: Text, and (property as written, property, value, unit, effect) of what it states.
GOLD = [
    ("Прочность снизилась до 450 МПа.", [("предел прочности", "прочность", 450.0, "MPa", "unknown")]),
    ("Предел прочности σв увеличился до 1,2 ГПа", [("предел прочности", "прочность", 1.2, "GPa", "increase")]),
    ("Tensile strength was 65 ksi and decreased after aging.", [("tensile strength", "прочность", 65.0, "ksi", "decrease")]),
    ("Corrosion resistance of the alloy increased.", [("corrosion resistance", "коррозионная стойкость", None, None, "increase")]),
    ("Коррозионной стойкости сплава не снизило.", [("коррозионной стойкости", "коррозионная стойкость", None, None, "decrease")]),
    ("Относительное удлинение составило 12,5 %", [("удлинение", "пластичность", 12.5, "%", "unknown")]),
    ("Твёрдость HV 340; твёрдость достигала 42 HRC", [("твёрдость", "твёрдость", 340.0, "HV", "unknown"), ("твёрдость", "твёрдость", 42.0, "HRC", "unknown")]),
    ("Нет данных.", []),
    ("", []),
    (None, []),
]


def test_measurements(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLD)], "id int, text string")
    found = with_forms(rows).select("id", F.explode(measurements(F.col("plain"))).alias("m")).select("id", "m.*").collect()
    have = {i: set() for i in range(len(GOLD))}
    for r in found:
        have[r["id"]].add((r["property_raw"], r["property"], r["value"], r["unit"], r["effect"]))
    assert have == {i: set(want) for i, (_, want) in enumerate(GOLD)}


#: Property, value, unit, effect, text, and the first rule that fails.
RULES = [
    ("прочность", 450.0, "MPa", "unknown", "прочность 450 мпа", None),
    ("прочность", None, None, "unknown", "прочность не указана", "measurement_without_value_or_effect"),
    ("прочность", None, None, "increase", "прочность выросла", None),
    ("коррозионная стойкость", None, None, "increase", "коррозионная стойкость не измерялась, но увеличилась", "gap_phrase_not_measurement"),
    ("прочность", 12.0, "%", "unknown", "прочность 12 %", "property_unit_mismatch"),
    ("пластичность", 12.0, "MPa", "unknown", "удлинение 12 мпа", "property_unit_mismatch"),
    ("вязкость", 12.0, "MPa", "unknown", "вязкость 12 мпа", "unknown_property_schema"),
    ("твёрдость", 12.0, "MPa", "unknown", "твердость 12 мпа", "unit_incompatible_with_property"),
    ("твёрдость", 12.0, "HV", "unknown", "hv 12", "missing_required_property_marker"),
    ("твёрдость", 12.0, "HV", "unknown", "твердость " + "x" * 150 + " hv 12", "value_without_property_window"),
]


def test_validators(spark):
    rows = spark.createDataFrame([(i, *r[:4], 0.9, r[4]) for i, r in enumerate(RULES)], "id int, property string, value double, unit string, effect string, confidence double, plain string")
    assert {r["id"]: r["reason"] for r in validated_measurements(rows).collect()} == {i: r[5] for i, r in enumerate(RULES)}


@pytest.mark.parametrize("sign", [1, -1])
def test_numbers_in_six_digits(spark, sign):
    values = [0.0, 1.0, 450.0, 12.5, 0.1, 1234567.0, 123456.0, 999999.0, 1e-4, 1e-5, 1e-7, 0.000123456, 3.14159265, 100000.0, 1e6, 2.5e10, 1e100, 99999.96]
    rows = spark.createDataFrame([(i, sign * v) for i, v in enumerate(values)] + [(99, None)], "id int, v double")
    have = {r["id"]: r["s"] for r in rows.select("id", shortest(F.col("v")).alias("s")).collect()}
    want = {i: f"{sign * v:g}" for i, v in enumerate(values)}
    want[0] = "0"
    assert have == {**want, 99: ""}
