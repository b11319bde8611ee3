"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.llm.common import in_parts, stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every neighbour above a node to the smallest node around it. Small star: link the
    node and its neighbours below to the smallest of them."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("of", "low").alias("low"))
    linked = both.join(least, F.col("u") == F.col("of"))
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            linked.select("u", F.col("low").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum over them that any change alters."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (two integer columns u, v); component is the least node.
    ``rows``: about how many edges there are, if known.

    Each round is written to the shared folder, so a lost executor costs that round at most, and the round before it
    is removed. Rounds needed grow with the logarithm of the number of nodes. No round has more edges than the one
    before it, so it is written in the parts that those need.
    """
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = stage(first if rows is None else in_parts(first, rows), "round")
    mark = _mark(now)
    for _ in range(max_rounds):
        after = stage(in_parts(_star(_star(now, large=True), large=False), mark[0]), "round")
        mark_before, mark = mark, _mark(after)
        unstage(now)
        now = after
        if mark == mark_before:
            break
    else:
        raise RuntimeError("the components did not settle")
    # settled: every node but the least of its component has exactly one edge, to that least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
