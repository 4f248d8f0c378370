"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.scale import settle


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node with a link.

    `links` has columns a and b (long). Alternates large and small stars: each round every
    node's larger, then smaller neighbours are hung below its smallest one, until nothing
    changes. A round is two joins on the node; what it leaves is written to the shared folder,
    so lineage stays short, and so are the smallest neighbours, so that Spark deals both sides
    of a join anew and can split a node with very many links. Self-links and repeated links
    do no harm; no links, no rows.
    """
    edges = settle(_arrange(links.select("a", "b")))
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state["n"] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        edges = settle(_small_star(_large_star(edges)))


def _arrange(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return (
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    hung = both.join(least, "a").where(F.col("b") > F.col("a"))
    return _arrange(hung.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")))
    hung = edges.join(least, "a")
    return _arrange(
        hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    )
