"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import written

#: Edges of a node from which it may be told to every task, and the most such nodes, about.
HOT_EDGES, HOT_NODES = 1000, 10_000


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b).

    Alternating stars: each node's larger neighbours are tied to the smallest neighbour, then
    its smaller ones are, until only stars are left; the rounds grow with the logarithm of the
    graph's size. Every round is a pre-aggregated minimum by node and a join back, and is written
    to the shared folder. The nodes that hold more than a ten-thousandth of all edges, which are
    few at any size, are joined by broadcast: no task gets the edges of a hot node.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        done, hot = _state(links)
        if done:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, hot).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        large = written(large, "large-star")
        small = _with_least(large, hot)
        # the tie of a node to its least neighbour, and of its other neighbours to that one
        links = written(small.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct(), "small-star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(links: DataFrame) -> tuple[bool, int | None]:
    """Whether the links are stars; from how many edges on a node is hot (none is: None)."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("child")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("up"), F.count("*").alias("n"))
    chained = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))
    total, most, n = nodes.agg(F.count(F.when(chained, 1)), F.max("n"), F.sum("n")).first()
    hot = max(HOT_EDGES, (n or 0) // HOT_NODES)
    return total == 0, hot if (most or 0) >= hot else None


def _with_least(edges: DataFrame, hot: int | None) -> DataFrame:
    """``edges`` with the least ``b`` of each ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    if hot is None:
        return edges.join(least.select("a", "least"), "a")
    told = edges.join(F.broadcast(least.where(F.col("n") >= hot).select("a", "least")), "a", "left")
    rest = told.where("least IS NULL").select("a", "b").join(least.where(F.col("n") < hot).select("a", "least"), "a")
    return told.where("least IS NOT NULL").unionAll(rest)
