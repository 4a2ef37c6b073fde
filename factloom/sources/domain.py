"""Chunks of technical prose and of serialised table rows, made from the line items.

The driver's texts hold nothing of the domain, so every line item says something of it: two sentences, and a table row,
drawn from the forms below by its keys and filled with its keys and quantity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import load, spread

MATERIALS = ["ВТ6", "VT6", "Ti-6Al-4V", "7075-T6", "12Х18Н10Т", "nickel", "никеля", "медь", "copper", "SO2", "штейн", "шлак", "unobtainium"]
REGIMES = ["annealing", "отжига", "aging", "quenching", "electrowinning", "heap leaching", "обессоливания", "циркуляции католита", "криообработки", "ПВП", "stirring"]
EQUIPMENT = ["flash smelting furnace", "диафрагменная ячейка", "печь взвешенной плавки", "microscope", "reactor", "a spoon"]
SENTENCES = [
    "After {r} the alloy {m} showed a tensile strength of {v} MPa.",
    "Предел прочности {m} после {r} увеличился до {v} МПа.",
    "Hardness HV {v} was found for {m} after {r}.",
    "Твёрдость {m} достигала {d} HRC без изменений.",
    "Corrosion resistance of {m} increased after {r}.",
    "Коррозионная стойкость {m} не измерялась.",
    "Относительное удлинение {m} равно {d} %.",
    "Концентрация сульфатов не более {v} мг/л при расходе {w} м3/ч.",
    "Chlorides of {v}-{w} mg/l were kept by {r}.",
    "Сухой остаток {v} мг/дм3, извлечение {d} %.",
    "Метод {r} применяется для очистки растворов, {e}.",
    "Циркуляция католита при электроэкстракции никеля: скорость потока {d} м/с.",
    "OPEX составил {v} руб/т для процесса {r}.",
    "Эксперт Иванов И.И. из лаборатории металлургии изучает процесс {r}.",
    "Research team Alpha used {e} in {r} at {w} C for {v} h.",
    "Вывод: {r} повышает извлечение {m}.",
    "Corrosion data of {m}: no numerical data were reported for Russia.",
    "Topic: {r}, {m}; device: {e}.",
    "E{n} of {m}: strength {v} ksi decreased in Germany.",
    "The pump DN{v} was mounted near the valve.",
    "",
]
ROWS = [
    "material: {m} | regime: {r} | property: strength | value: {d} | unit: MPa | effect: increase",
    "Материал: {m} | Режим: {r} | Показатель: твёрдость | Значение: {v} | Ед.: HV | Лаборатория: Lab {n}",
    "alloy grade: {m} | process_regime: {r} | metric: hardness | result: {v}-{w} | units: HRC | team: T{v}",
    "sample: A{n} | Au, g/t: {d} | Cu, %: {v}-{w} | note: x",
    "capacity 2020, t/y: {v} | capacity 2021, t/y: {w} | plant: P{n}",
    "note: nothing here",
    "material: {m} | property: strength | value: abc | unit: MPa | value: {v} | regime:",
    "автор: Иванов И.И. | тематика: {r} | вывод: рекомендуется {r}",
]
KEY = ["order_id", "line"]


def chunks(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """order_id, line, kind (text or table_row), text: two rows for each line item; of one kind only, if that is asked for, without the column."""
    pick = lambda words, key: F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))
    whole = F.col("l_quantity").cast("int").cast("string")
    fills = {
        "{m}": pick(MATERIALS, "l_partkey"),
        "{r}": pick(REGIMES, "l_suppkey"),
        "{e}": pick(EQUIPMENT, "l_orderkey"),
        "{v}": whole,
        "{w}": (F.col("l_quantity").cast("int") + 7).cast("string"),
        "{d}": F.concat(whole, F.lit(",5")),
        "{n}": F.col("l_orderkey").cast("string"),
    }
    fill = lambda form: reduce(lambda text, kv: F.replace(text, F.lit(kv[0]), kv[1]), fills.items(), form)
    read = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    item = spread(read, "l_orderkey", "l_linenumber").withColumn("a", F.col("l_orderkey") * 7 + F.col("l_linenumber")).withColumn("b", F.col("l_partkey") * 3 + F.col("l_linenumber"))
    text: Column = F.trim(F.concat_ws(" ", pick(SENTENCES, "a"), pick(SENTENCES, "b")))
    texts = {"text": fill(text), "table_row": fill(pick(ROWS, "a"))}
    key = [F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line")]
    if kind is not None:
        return item.select(*key, texts[kind].alias("text"))
    both = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts.items()))
    return item.select(*key, F.explode(both).alias("c")).select(*KEY, "c.*")


def _sql() -> str:
    pick = lambda words, key: "[" + ", ".join(f"'{w}'" for w in words) + f"][({key}) % {len(words)} + 1]"
    v = "l_quantity::INT"
    fills = {"{m}": pick(MATERIALS, "l_partkey"), "{r}": pick(REGIMES, "l_suppkey"), "{e}": pick(EQUIPMENT, "l_orderkey"), "{v}": f"({v})::VARCHAR", "{w}": f"({v} + 7)::VARCHAR", "{d}": f"({v})::VARCHAR || ',5'", "{n}": "l_orderkey::VARCHAR"}
    fill = lambda form: reduce(lambda text, kv: f"replace({text}, '{kv[0]}', {kv[1]})", fills.items(), form)
    a, b = "l_orderkey * 7 + l_linenumber", "l_partkey * 3 + l_linenumber"
    text = f"trim({pick(SENTENCES, a)} || ' ' || {pick(SENTENCES, b)})"
    head = "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line"
    return f"chunks AS ({head}, 'text' AS kind, {fill(text)} AS text FROM lineitem UNION ALL {head}, 'table_row', {fill(pick(ROWS, a))} FROM lineitem)"


#: The same chunks as a common table expression.
CHUNKS_SQL = _sql()
