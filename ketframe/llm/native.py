"""Column helpers of the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else; for pure ASCII that is `lower`, which is much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two non-null columns that name a document row by its id and text; rows equal in both are one document."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("key_id"), F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("key_text")]


#: Bytes up to which a table is broadcast; beyond that the join shuffles.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``df`` (a saved table) marked for broadcast if its rows come to at most ``BROADCAST_BYTES``."""
    size = df.agg(F.sum((row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def cross_pairs(placed: DataFrame, keys: list[str], columns: list[str], near: Callable[[Callable, Callable], Column]) -> DataFrame:
    """Pairs (a, b) of nodes in one list but different groups, as ``near`` allows.

    ``placed`` has ``keys``, node, g (its group) and ``columns``. In each list the group with
    most members stands on one side only, so a list that is nearly all one group costs its few
    others times its length, not its square.
    """
    per = placed.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("m"))
    most = per.groupBy(*keys).agg(F.max_by("g", "m").alias("most"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
    apart = placed.join(most, keys)
    cols = ["node", "g", *columns]
    one = apart.filter("g <> most").select(*keys, *[F.col(c).alias(f"{c}_1") for c in cols])
    two = apart.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("most").alias("most_2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    rule = (F.col("g_1") != F.col("g_2")) & ((F.col("g_2") == F.col("most_2")) | (F.col("node_1") < F.col("node_2")))
    both = one.join(two, [*on, rule, near(lambda c: F.col(f"{c}_1"), lambda c: F.col(f"{c}_2"))])
    return both.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()
