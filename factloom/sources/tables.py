"""The driver's tables, and the shapes that operators expect on top of them.

The tables are not about technical documents, so facts are bound to them by projection: a line item is a
measurement of a part's brand (material) under a return flag (regime) for a part type (property).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, dealt by keys to more tasks where their files give fewer than two a core: a file of one row group is read by one task, whatever is computed from it."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, *keys) if rows.rdd.getNumPartitions() < tasks else rows


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per measurement; `seq` orders them for first-wins rules."""
    item, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return (
        item.join(part, item["l_partkey"] == part["p_partkey"])
        .join(supplier, item["l_suppkey"] == supplier["s_suppkey"])
        .join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .select(
            F.col("l_orderkey").alias("document_id"),
            F.col("l_linenumber").cast("bigint").alias("chunk_id"),
            F.format_string("%012d-%03d", "l_orderkey", F.col("l_linenumber").cast("bigint")).alias("seq"),
            F.col("p_brand").alias("material"),
            F.col("l_returnflag").alias("regime"),
            F.col("p_type").alias("property"),
            F.col("l_quantity").alias("value"),
            F.when(F.col("l_linestatus") == "O", "ksi").otherwise("MPa").alias("unit"),
            F.when(F.col("l_discount") > 0.05, "increase").otherwise("unknown").alias("effect"),
            F.col("s_suppkey").alias("equipment"),
            F.col("n_name").alias("laboratory"),
            F.col("l_tax").alias("tax"),
        )
    )


#: The same binding as a common table expression.
FACTS_SQL = """facts AS (
  SELECT l_orderkey AS document_id, l_linenumber::BIGINT AS chunk_id, printf('%012d-%03d', l_orderkey, l_linenumber) AS seq,
         p_brand AS material, l_returnflag AS regime, p_type AS property, l_quantity AS value,
         CASE WHEN l_linestatus = 'O' THEN 'ksi' ELSE 'MPa' END AS unit,
         CASE WHEN l_discount > 0.05 THEN 'increase' ELSE 'unknown' END AS effect,
         s_suppkey AS equipment, n_name AS laboratory, l_tax AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a catalog: orders and their lines.  A document is active unless its status is F."""
    docs = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") != "F").alias("active"),
        F.col("o_orderdate").alias("updated_at"),
    )
    chunks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("ordinal"), F.col("l_quantity").alias("token_count"))
    return docs, chunks


CATALOG_SQL = """docs AS (SELECT o_orderkey AS doc_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus <> 'F' END AS active, o_orderdate AS updated_at FROM orders),
chunks AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ordinal, l_quantity AS token_count FROM lineitem)"""
