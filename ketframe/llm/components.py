"""Connected components of a graph given as a DataFrame of links, by contraction; no Python, nothing on the driver but emptiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.session import saved


def priority(node: Column | str) -> Column:
    """The order in which nodes attract others: by hash, so that no chain of ids can make it slow."""
    return F.xxhash64(F.col(node) if isinstance(node, str) else node)


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for each node on a link; component is the smallest node reachable.

    Each round moves every node to the member of its neighbourhood that comes first in
    ``priority`` and joins the links again; stars around their first member, however large, take one
    round. Links to itself, repeated and null ones don't matter; no link gives no row.
    """
    links = saved(_between(links.select("a", "b")), "links")
    moves = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("node", "to")
        first = both.groupBy("node").agg(F.min_by("to", priority("to")).alias("to"), F.min(priority("to")).alias("p"))
        moves.append(saved(first.select("node", F.when(priority("node") <= F.col("p"), F.col("node")).otherwise(F.col("to")).alias("to")), "moves"))
        move = moves[-1]
        one = links.join(move.toDF("a", "a2"), "a").select(F.col("a2").alias("a"), "b")
        two = one.join(move.toDF("b", "b2"), "b").select("a", F.col("b2").alias("b"))
        links = saved(_between(two), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):
        out = move.join(out.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = saved(out, "roots") if len(moves) > 1 else out
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")


def _between(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
