"""Connected components of a table of links, without gathering links anywhere.

Alternates two star operations: every node's larger neighbours are linked to its smallest
neighbour, then its smaller ones are.  Labels fall to each component's smallest node in a
number of rounds that grows with the logarithm of its size.  Each round is one or two
shuffles of the links with minima taken before; rounds end in a table in the shared folder.
Minima of a node that many links share are taken in every task first; the joins that hand
them back are left to adaptive execution, which splits a partition that one node fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones) to its smallest neighbour."""
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and a mark that changes with them, taken while they are written."""
    seen = Observation()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    table = materialize(links.distinct().observe(seen, F.count(F.lit(1)).alias("n"), mark), "links")
    return table, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): for every node of links (a, b) but the smallest of each component, the smallest node that links reach."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, mark = _kept(links)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        links, now = _kept(_star(_star(links, True), False))
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
