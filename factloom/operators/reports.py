"""Knowledge reports as stored snapshots, and the delta of two of them.

A report is a few tables: facts by canonical key, the evidence of each, conflicts, gaps, opportunities and triples by identity.  Each
is written to the store as one version, so any two versions can be compared later.  A delta is a full join by identity of small rows; evidence is
compared as rows, not as arrays, so a fact with very much evidence is no large row and no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.facts import N_SQL, conflicts, key_part, normalized
from factloom.registry import query
from factloom.sources.snapshots import Store, new_store
from factloom.sources.tables import fact_rows, load

TRIPLE = ["material", "regime", "property"]
#: Tables of things that are told apart by one identity.
SETS = ("conflicts", "gaps", "opportunities", "triples", "materials", "regimes", "properties")
#: A triple whose highest value is at most so much has a gap.
LOW = 49


def report(facts: DataFrame) -> dict[str, DataFrame]:
    """facts -> the tables of a report.  facts: key, material, regime, property, n_rows; evidence: key, document_id, chunk_id; the others: identity."""
    n = normalized(facts).withColumnRenamed("canonical_fact_key", "key")
    triples = n.select(*TRIPLE).distinct()
    joined = lambda *c: F.concat_ws("|", *(key_part(F.col(x)) for x in c))
    low = n.groupBy(*TRIPLE).agg(F.max("value").alias("top")).where(F.col("top") <= LOW)
    several = lambda by, of: triples.select(*by, of).distinct().groupBy(*by).agg(F.sort_array(F.collect_set(of)).alias("all")).where(F.size("all") >= 2)  # noqa: E731  of a vocabulary
    opportunity = lambda kind, df, by: df.select(F.concat_ws("|", F.lit(kind), *by, F.array_join("all", ",")).alias("identity"))
    names = lambda c: n.select(F.col(c).alias("identity")).distinct()
    return {
        "facts": n.groupBy("key").agg(*(F.min(c).alias(c) for c in TRIPLE), F.count(F.lit(1)).alias("n_rows")),
        "evidence": n.select("key", "document_id", "chunk_id").distinct(),
        "conflicts": conflicts(facts).select(F.concat_ws("|", *TRIPLE).alias("identity")),
        "gaps": low.select(F.concat_ws("|", joined(*TRIPLE), F.lit(f"no values above {LOW}")).alias("identity")),
        "opportunities": opportunity("materials", several(["property"], "material"), ["property"]).unionByName(opportunity("regimes", several(["material", "property"], "regime"), ["material", "property"])),
        "triples": triples.select(joined(*TRIPLE).alias("identity")),
        "materials": names("material"),
        "regimes": names("regime"),
        "properties": names("property"),
    }


def store_report(store: Store, facts: DataFrame) -> int:
    """The version that holds the report of some facts; the facts are written first and read once for each table."""
    folder, schema = store.write(facts)
    kept = store.spark.read.schema(schema).parquet(f"{store.root}/{folder}")
    return store.commit(store.latest(), {name: store.write(table) for name, table in report(kept).items()}, replace=True)


def fact_delta(store: Store, before: int, after: int) -> DataFrame:
    """key, state, new_evidence, lost_evidence, rows_before, rows_after: one row for each key of either report.

    state: new or removed keys; corroborated ones have evidence that they had not before; the others are unchanged, or weakened if they only lost some.
    """
    old, new = (store.read("facts", v).select("key", F.col("n_rows").alias(f"rows_{name}")) for v, name in ((before, "before"), (after, "after")))
    evidence = ["key", "document_id", "chunk_id"]
    had, has = store.read("evidence", before), store.read("evidence", after)
    both = had.withColumn("side", F.lit(1)).unionByName(has.withColumn("side", F.lit(2))).groupBy(*evidence).agg(F.sum("side").alias("side"))
    changed = both.where("side < 3").groupBy("key").agg(F.count_if(F.col("side") == 2).alias("new_evidence"), F.count_if(F.col("side") == 1).alias("lost_evidence"))
    state = (
        F.when(F.col("rows_before").isNull(), "new")
        .when(F.col("rows_after").isNull(), "removed")
        .when(F.col("new_evidence") > 0, "corroborated")
        .when(F.col("lost_evidence") > 0, "weakened")
        .otherwise("unchanged")
    )
    rows = old.join(new, "key", "full").join(changed, "key", "left").na.fill(0, ["new_evidence", "lost_evidence"])
    return rows.withColumn("state", state).select("key", "state", "new_evidence", "lost_evidence", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def delta_counts(store: Store, before: int, after: int) -> DataFrame:
    """One row: facts by state, what each set gained, and the nodes and edges that the graph gains."""
    states = ("new", "removed", "corroborated", "weakened", "unchanged")
    counted = fact_delta(store, before, after).agg(*(F.count_if(F.col("state") == s).alias(f"{s}_facts") for s in states))
    for name in SETS:
        gained = store.read(name, after).join(store.read(name, before), "identity", "left_anti").agg(F.count(F.lit(1)).alias(f"new_{name}"))
        counted = counted.join(F.broadcast(gained))  # one row with one row
    nodes = sum((F.col(f"new_{x}") for x in ("materials", "regimes", "properties", "gaps")), F.col("new_facts"))
    return counted.withColumn("new_nodes", nodes).withColumn("new_edges", F.col("new_facts") * 4 + F.col("new_gaps") * 3 + F.col("new_opportunities"))


#: The first report knows orders before one date, the second those since the other: some facts come, some go, some get more evidence.
UNTIL, SINCE = "2000-01-01", "1996-01-01"


def two_reports(spark: SparkSession, sf_dir: str) -> tuple[Store, int, int]:
    store = new_store(spark)
    dated = fact_rows(spark, sf_dir).join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderdate"), "document_id")
    first = store_report(store, dated.where(f"o_orderdate < '{UNTIL}'").drop("o_orderdate"))
    return store, first, store_report(store, dated.where(f"o_orderdate >= '{SINCE}'").drop("o_orderdate"))


_TWO_SQL = f"""{N_SQL}, b AS (SELECT k.* FROM k JOIN orders ON o_orderkey = document_id WHERE o_orderdate < '{UNTIL}'), a AS (SELECT k.* FROM k JOIN orders ON o_orderkey = document_id WHERE o_orderdate >= '{SINCE}'),
    eb AS (SELECT DISTINCT canonical_fact_key AS key, document_id, chunk_id FROM b), ea AS (SELECT DISTINCT canonical_fact_key AS key, document_id, chunk_id FROM a),
    g AS (SELECT key, count(*) AS n FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) GROUP BY key), w AS (SELECT key, count(*) AS n FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea) GROUP BY key),
    fb AS (SELECT canonical_fact_key AS key, count(*) AS n FROM b GROUP BY 1), fa AS (SELECT canonical_fact_key AS key, count(*) AS n FROM a GROUP BY 1),
    d AS (SELECT coalesce(fa.key, fb.key) AS key, CASE WHEN fb.key IS NULL THEN 'new' WHEN fa.key IS NULL THEN 'removed' WHEN g.n > 0 THEN 'corroborated' WHEN w.n > 0 THEN 'weakened' ELSE 'unchanged' END AS state,
          coalesce(g.n, 0) AS new_evidence, coalesce(w.n, 0) AS lost_evidence, coalesce(fb.n, 0) AS rows_before, coalesce(fa.n, 0) AS rows_after FROM fa FULL JOIN fb ON fa.key = fb.key LEFT JOIN g ON g.key = coalesce(fa.key, fb.key) LEFT JOIN w ON w.key = coalesce(fa.key, fb.key))"""


def _gained(select: str) -> str:
    return f"(SELECT count(*) FROM (({select.format(t='a')}) EXCEPT ({select.format(t='b')})))"


_SETS_SQL = {
    "conflicts": "SELECT lower(material), lower(regime), lower(property) FROM {t} GROUP BY ALL HAVING count(DISTINCT concat_ws('|', value_text, unit_normalized, effect_part)) >= 2",
    "gaps": f"SELECT material, regime, property FROM {{t}} GROUP BY ALL HAVING max(value) <= {LOW}",
    "opportunities": "SELECT property, '' AS m, list_sort(list(DISTINCT material)) AS l FROM {t} GROUP BY property HAVING count(DISTINCT material) >= 2 UNION ALL SELECT property, material, list_sort(list(DISTINCT regime)) FROM {t} GROUP BY property, material HAVING count(DISTINCT regime) >= 2",
    "triples": "SELECT DISTINCT material, regime, property FROM {t}",
    "materials": "SELECT DISTINCT material FROM {t}",
    "regimes": "SELECT DISTINCT regime FROM {t}",
    "properties": "SELECT DISTINCT property FROM {t}",
}


@query(f"WITH {_TWO_SQL} SELECT * FROM d")
def g6_report_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every fact between two stored reports."""
    return fact_delta(*two_reports(spark, sf_dir))


@query(
    f"""WITH {_TWO_SQL}, c AS (SELECT {', '.join(f"count(*) FILTER (state = '{s}') AS {s}_facts" for s in ('new', 'removed', 'corroborated', 'weakened', 'unchanged'))}, {', '.join(f'{_gained(sql)} AS new_{name}' for name, sql in _SETS_SQL.items())} FROM d)
    SELECT *, new_facts + new_materials + new_regimes + new_properties + new_gaps AS new_nodes, new_facts * 4 + new_gaps * 3 + new_opportunities AS new_edges FROM c"""
)
def g6_delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the same delta."""
    return delta_counts(*two_reports(spark, sf_dir))
