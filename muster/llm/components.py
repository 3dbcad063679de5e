"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stage

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``, ``root`` the smallest node reachable.

    Large-star and small-star steps in turn: each node's larger neighbours are hung on its
    smallest one, then its smaller neighbours, until no link changes. A round is a minimum
    per node with partial aggregation and a join; no neighbour list is gathered, and the
    skew join splits a node with very many links. Every round is a written table, so a lost
    executor costs a round at most. Nodes without links are not returned.
    """
    links = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    print_of = None
    for _ in range(ROUNDS):
        links = stage(_small_star(_large_star(links)), "links")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == print_of:
            break
        print_of = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    # every link now leads from a node to its root
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    larger = links.join(least, links["v"] == least["n"])  # u > v: u is a larger neighbour of v
    return larger.select("u", F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links from larger to smaller; smaller neighbours of u, and u, go to the smallest."""
    links = stage(links.distinct(), "links")
    least = links.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = links.join(least, links["u"] == least["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
