"""Connected components of an edge table, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(w, m): the least smaller neighbour of each node that has one, written so that joins with it deal both sides anew."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to v: u is linked to the least neighbour of v, or to v if v has no smaller one."""
    linked = edges.join(_least(edges), F.col("v") == F.col("w"), "left")
    return linked.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """All smaller neighbours of u, and u, are linked to the smallest."""
    least = _least(edges)
    linked = edges.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node of its component.

    Both stars run until no edge changes. Every round groups and joins the edges
    by node, is written to the shared folder, and gives the driver two numbers.
    A hot node's neighbours are reduced before the shuffle, and its edges meet its
    least neighbour in joins of two written tables, whose large partitions Spark
    splits. Self-links are dropped; an empty table is fine.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(after) == mark or not after[0]:
            break
        mark = tuple(after)
        now = cut(_small_star(cut(_large_star(now), "edges")), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
