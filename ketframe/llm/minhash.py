"""Near-duplicate documents by bottom-k sketches.

One hash function over the shingles; a document keeps its k smallest values. Inverted lists of
retained values give candidates, union sketches estimate their similarity, and the full sets decide.

What keeps lists short, with nothing dropped:

* Equal sets become one class before anything is compared.
* Two sets with similarity t share at least m of k retained values (if one of the two sketches holds its
  whole set this is exact, for others it fails with a chance under 1e-5 for a pair at the threshold). So a
  document needs to stand only in the lists of its k - m + 1 rarest values: what thousands share,
  such as a license passage, brings only those together that consist mostly of it.
* In a list, all are first compared with the one that leads it; only members that lie in different
  components then are compared in pairs. A group of thousands of copies thus costs one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm.components import components, priority
from ketframe.llm.native import cross_pairs
from ketframe.llm.shingles import shingle_sets
from ketframe.session import saved, ship

#: Retained values; of these, how many two documents at the threshold share at least.
K, SHARED = 32, 13


def sketches(docs: DataFrame, words: int, k: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit name of the set) and the sketch, ascending."""
    ship(docs.sparkSession)

    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, texts = part["d"].tolist(), part["t"].tolist()
            for i in range(0, len(ids), 256):
                sets = shingle_sets([(t or "").encode() for t in texts[i : i + 256]], words)
                weights = np.uint64(0xD6E8FEB86659FD93)
                yield pd.DataFrame({
                    "doc_id": pd.array(ids[i : i + 256], "Int64"),
                    "n_shingles": np.array([s.size for s in sets], np.int64),
                    "set_a": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                    "set_b": np.array([(s * (weights ^ s)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                    "sketch": [s[:k].view(np.int64) for s in sets],
                })

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).mapInPandas(sketch, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int, k: int, shared: int) -> DataFrame:
    """Of ``pairs(a, b)`` those that are linked: first by union sketches, then by the full sets."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    near = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    # a union that fits its sketch is known in full; another is an estimate
    near = near.filter(F.when(F.size(union) < k, both * 100 >= F.size(union) * percent).otherwise(both >= shared))
    near = saved(near.select("a", "b").distinct(), "near")

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(one), 128):
            a, b = (shingle_sets([t.encode() for t in x[i : i + 128]], words) for x in (one, two))
            for p, q in zip(a, b, strict=True):
                n = np.intersect1d(p, q, assume_unique=True).size
                out.append(100 * n >= percent * (p.size + q.size - n))
        return pd.Series(out, dtype=bool)

    full = near.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")
    return saved(full.filter(alike("t_a", "t_b")).select("a", "b"), "alike")


#: Bits of a signature: a set's shingles, hashed to so many places.
_PLACES = 2048


def _bounds(texts: DataFrame, words: int) -> DataFrame:
    """node, own (its shingles that no other of these texts has) and marks (its signature, as longs)."""

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 128):
                nodes = part["d"].to_numpy()[i : i + 128]
                sets = shingle_sets([t.encode() for t in part["t"].tolist()[i : i + 128]], words)
                yield pd.DataFrame({"node": np.repeat(nodes, [s.size for s in sets]), "s": np.concatenate(sets).view(np.int64)})

    @F.pandas_udf("array<long>")
    def marks(part: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(part), 128):
            for s in shingle_sets([t.encode() for t in part.tolist()[i : i + 128]], words):
                places = np.zeros(_PLACES, np.uint8)
                places[(s % np.uint64(_PLACES)).astype(np.int64)] = 1
                out.append(np.packbits(places).view(np.int64))
        return pd.Series(out)

    own = texts.mapInPandas(opened, "node long, s long").groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node")).filter("m = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    marked = texts.select(F.col("d").alias("node"), marks("t").alias("marks"))
    return saved(marked.join(own, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), "marks"), "bounds")


def _can_link(p, q, percent: int):
    """False only for pairs that can't be similar enough: by size, by shingles that nobody else has, by places that only one has marked."""

    def allows(common, union):
        return common * 100 >= union * percent

    n, m = p("n"), q("n")
    most = F.least(n - p("own"), m - q("own"))
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda t, k: t + k)
    apart = F.transform(F.array(F.struct(lacks(p("marks"), q("marks")).alias("x"), lacks(q("marks"), p("marks")).alias("y"))), lambda d: allows(F.least(n - d["x"], m - d["y"]), F.greatest(n + d["y"], m + d["x"])))[0]
    return allows(F.least(n, m), F.greatest(n, m)) & allows(most, n + m - most) & apart


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, k: int = K, shared: int = SHARED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``; other columns aren't read.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all their shingles; the
    component is the smallest id reachable, and the document of that id is kept. A null or wordless
    text is linked with nothing. Rows with one id are one document; a row without id stays alone
    (component null, kept). An empty table gives an empty one.
    """
    rows = saved(sketches(docs, words, k, doc_id, text), "sketches")
    whole = rows.filter("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    classes = saved(whole.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    keyed = whole.join(classes, same).select("doc_id", "n_shingles", "node", "sketch")
    nodes = saved(keyed.filter("doc_id = node").select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node", "n"]), "nodes")

    # values that more than one class retains; each class's rarest of them, as far as its prefix reaches
    values = nodes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = values.join(often, "v")
    # a set below k may meet one whose sketch isn't its whole set, unless that would be too large for it
    most = F.ceil(F.col("size") * percent / 100)
    need = F.when(F.col("size") * 100 < k * percent, most).when(F.col("size") < k, F.least(most, F.lit(shared))).otherwise(shared)
    ranked = common.groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    reach = (F.col("size") - need + 1) - (F.col("size") - F.size("vs"))
    lists = saved(ranked.withColumn("reach", reach).filter("reach > 0").select("node", "n", "size", F.size("vs").alias("shared"), F.explode(F.expr("slice(vs, 1, cast(reach as int)).v")).alias("v")), "lists")

    # the first to be compared with: the member with most of its sketch in common with others
    typical = F.shiftleft((F.col("size") - F.col("shared")).cast("long"), 57) + F.shiftrightunsigned(priority("node"), 7)
    leaders = lists.groupBy("v").agg(F.min_by("node", typical).alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    lists = saved(lists.join(leaders, "v").drop("size", "shared"), "shared_lists")
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).filter("d is not null and t is not null")
    texts = saved(texts.join(lists.select(F.col("node").alias("d")).distinct(), "d"), "texts")
    stars = lists.select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    links = _confirmed(stars, texts, nodes, words, percent, k, shared)
    group = saved(components(links), "groups")

    # what is still apart within a list: pairs of different components, sizes permitting
    placed = lists.join(group, "node", "left").select("v", "node", "n", F.coalesce("component", "node").alias("g"))
    mixed = placed.groupBy("v").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("v")
    placed = saved(placed.join(mixed, "v"), "apart")
    bounds = _bounds(texts.join(placed.select(F.col("node").alias("d")).distinct(), "d"), words)
    # one that shares too little with all others together can't be linked at all
    placed = placed.join(bounds, "node").filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    # a pair comes from the least of the values that bring it together, once
    placed = placed.join(placed.groupBy("node").agg(F.collect_set("v").alias("vs")), "node")
    once = lambda p, q: F.col("v") == F.array_min(F.array_intersect(p("vs"), q("vs")))
    rest = cross_pairs(placed, ["v"], ["n", "own", "marks", "vs"], lambda p, q: _can_link(p, q, percent) & once(p, q))
    rest = rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _confirmed(rest, texts, nodes, words, percent, k, shared)
    final = components(links.union(more))

    # ids of one class are linked as well: an id can stand in two classes only if its rows differ
    named = keyed.join(final.toDF("node", "c"), "node", "left").select("doc_id", "n_shingles", F.coalesce("c", "node").alias("component_id"))
    lone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
