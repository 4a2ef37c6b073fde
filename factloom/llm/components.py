"""Connected components of an edge table by hooking and contraction.

Every round each node takes the smallest of itself and its neighbours as parent, pointers are jumped
twice, and the edges are renamed to the parents: edges inside a merged group vanish, so the edge table
shrinks by a constant factor and chains halve.  All steps are aggregations with a map-side combine
(safe for a node with very many edges) and plain equi-joins (which AQE splits when a node is hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import scratch, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst: bigint) -> (id, component): every id that has an edge to another, with the smallest id reachable.

    Loops, repeated and reversed edges are allowed; edges with a null end are dropped.  No edges: no rows.
    """
    with scratch(edges.sparkSession) as keep:
        edges = stage(
            edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
            "edges",
        )
        labels = None
        while not edges.isEmpty():
            both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            parents = stage(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("p")).select("id", F.least("id", "p").alias("p")), "parents")
            for _ in range(2):
                up = parents.select(F.col("id").alias("p"), F.col("p").alias("q"))
                parents = parents.join(up, "p").select("id", F.col("q").alias("p"))
            parents = stage(parents, "roots")
            if labels is None:
                labels = parents.select("id", F.col("p").alias("component"))
            else:
                up = parents.select(F.col("id").alias("component"), "p")
                labels = stage(labels.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
            left = parents.select(F.col("id").alias("src"), F.col("p").alias("a"))
            right = parents.select(F.col("id").alias("dst"), F.col("p").alias("b"))
            edges = stage(
                edges.join(left, "src").join(right, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
                "edges",
            )
        return keep(labels) if labels is not None else keep(edges).select(F.col("src").alias("id"), F.col("dst").alias("component"))
