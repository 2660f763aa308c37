"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id with a link; component is the smallest id reachable.

    ``links`` has columns a and b. Each round takes the minimum neighbour of every node with a partially aggregated
    group-by and joins it back, so that a hub with a third of all links is combined before the shuffle and its join
    partition can be split. The rounds grow with the logarithm of the number of nodes; every round is a written table.
    ``rows`` is a bound on
    the number of links, if one is known. An empty table gives an empty result; loops and repeated links change nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = write_table(edges, "edges", rows)
    before = _state(edges)
    rows = 2 * before[0]  # a round never has more edges than twice those before the first
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = write_table(small, "edges", rows)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    top = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(top).distinct()
