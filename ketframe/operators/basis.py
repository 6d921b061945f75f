"""Generalised Pauli (Gell-Mann) matrices as sparse tables, and decompositions by joins with them.

For dimension d and b from 1 to d-1: for each a < b index b^2 + 2a is symmetric and b^2 + 2a + 1
antisymmetric; (b+1)^2 - 1 is diagonal; 0 is sqrt(2/d) times the identity. tr(l_k l_l) = 2 delta.
Products of subsystems carry 1/2^(s-1); their index is mixed-radix over (d1^2, d2^2, ...).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Dim = int | Sequence[int]


def dims(dim: Dim) -> tuple[int, ...]:
    out = (dim,) if isinstance(dim, int) else tuple(int(d) for d in dim)
    if not out or min(out) < 1:
        raise ValueError("dimensions are positive")
    return out


def paulis_shape(dim: Dim) -> tuple[int, ...]:
    d = dims(dim)
    return (*[x * x for x in d], math.prod(d), math.prod(d))


def pauli_matrices(spark: SparkSession, d: int) -> DataFrame:
    """k, r, c, re, im of the nonzero entries."""
    i = lambda c: F.col(c).cast("int")
    b = spark.range(1, d).select(i("id").alias("b"))
    pairs = b.select("b", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("a"))
    zero = F.lit(0.0)
    entry = lambda k, r, c, re, im: F.struct(k.alias("k"), r.alias("r"), c.alias("c"), re.alias("re"), im.alias("im"))
    k, one, lo, hi = F.col("b") * F.col("b") + 2 * F.col("a"), F.lit(1.0), F.col("a"), F.col("b")
    off = pairs.select(F.inline(F.array(entry(k, lo, hi, one, zero), entry(k, hi, lo, one, zero), entry(k + 1, lo, hi, zero, -one), entry(k + 1, hi, lo, zero, one))))
    norm = F.sqrt(F.lit(2.0) / (F.col("b") * (F.col("b") + 1)))
    diag = b.select("b", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("r")).select(((F.col("b") + 1) * (F.col("b") + 1) - 1).alias("k"), "r", F.col("r").alias("c"), F.when(F.col("r") < F.col("b"), norm).otherwise(-F.col("b") * norm).alias("re"), zero.alias("im"))
    unit = spark.range(d).select(F.lit(0).alias("k"), i("id").alias("r"), i("id").alias("c"), F.lit(math.sqrt(2 / d)).alias("re"), zero.alias("im"))
    return unit.union(off).union(diag)


def paulis(spark: SparkSession, dim: Dim) -> DataFrame:
    """k, r, c, re, im of the products for several subsystems; any number of them, always sparse."""
    d = dims(dim)
    out = pauli_matrices(spark, d[0])
    for x in d[1:]:
        new = pauli_matrices(spark, x).toDF("k2", "r2", "c2", "re2", "im2")
        out = out.crossJoin(F.broadcast(new)).select((F.col("k") * (x * x) + F.col("k2")).alias("k"), (F.col("r") * x + F.col("r2")).alias("r"), (F.col("c") * x + F.col("c2")).alias("c"), (F.expr("re * re2 - im * im2") / 2).alias("re"), (F.expr("re * im2 + im * re2") / 2).alias("im"))
    return out


def symmetry(spark: SparkSession, dim: Dim) -> DataFrame:
    """k and sym: 1 symmetric, -1 antisymmetric, 0 diagonal; products combine (0 is neutral)."""
    out = None
    for x in dims(dim):
        root = F.floor(F.sqrt(F.col("id"))).cast("long")
        place = F.col("id") - root * root
        one = spark.range(x * x).select(F.col("id").cast("int").alias("k2"), F.when((F.col("id") == 0) | (place == 2 * root), 0).when(place % 2 == 0, 1).otherwise(-1).alias("s2"))
        if out is None:
            out = one.toDF("k", "sym")
        else:
            product = F.col("sym") * F.col("s2")
            out = out.crossJoin(F.broadcast(one)).select((F.col("k") * (x * x) + F.col("k2")).alias("k"), F.when(product != 0, product).otherwise(F.col("sym") + F.col("s2")).alias("sym"))
    return out


def labels(spark: SparkSession, dim: Dim, symbol: str | Sequence | None = None, delimiter: str = "", norm: bool = True, fmt: str = "latex") -> DataFrame:
    """k and label; fmt is text, latex, latex-text or latex-slash."""
    d = dims(dim)
    if fmt not in ("text", "latex", "latex-text", "latex-slash"):
        raise ValueError(f"unknown format {fmt}")
    each = (symbol,) * len(d) if symbol is None or isinstance(symbol, str) else tuple(symbol)
    if len(each) != len(d):
        raise ValueError("one symbol a subsystem is needed")
    out = None
    for x, sym in zip(d, each, strict=True):
        one = spark.range(x * x).select(F.col("id").cast("int").alias("k2"), _symbol(x, sym, fmt).alias("l2"))
        out = one.toDF("k", "label") if out is None else out.crossJoin(F.broadcast(one)).select((F.col("k") * (x * x) + F.col("k2")).alias("k"), F.concat("label", F.lit(delimiter), "l2").alias("label"))
    if norm and len(d) >= 2:
        power = "2" if len(d) == 2 else f"2**{len(d) - 1}" if fmt == "text" else f"2^{{{len(d) - 1}}}"
        pre, post = {"latex": (r"\frac{", f"}}{{{power}}}"), "latex-text": (r"\textstyle{\frac{", f"}}{{{power}}}}}")}.get(fmt, ("", f"/{power}"))
        out = out.select("k", F.concat(F.lit(pre), "label", F.lit(post)).alias("label"))
    return out


def _symbol(d: int, sym, fmt: str) -> Column:
    number = F.col("id").cast("string")
    if not sym:
        if d == 2:
            return F.get(F.array(*map(F.lit, "IXYZ")), F.col("id").cast("int"))
        if sym is None:
            return F.concat(F.lit("λ"), number) if fmt == "text" else F.concat(F.lit(r"{\lambda_{"), number, F.lit("}}"))
        return number
    if isinstance(sym, str):
        return F.concat(F.lit(f"{{{sym}_{{"), number, F.lit("}}"))
    if len(sym) != d * d:
        raise ValueError("one symbol an element is needed")
    return F.get(F.array(*[F.lit(f"{{{s}}}") for s in sym]), F.col("id").cast("int"))


def l0_projector(spark: SparkSession, reduced: int, original: int) -> DataFrame:
    """k and value for all original^2 components."""
    if reduced > original:
        raise ValueError("the reduced dimension is greater than the original one")
    root = F.floor(F.sqrt(F.col("id") + 1)).cast("long")
    value = F.when(F.col("id") == 0, math.sqrt(reduced / original)).when((root * root == F.col("id") + 1) & (root > reduced), F.sqrt(F.lit(float(reduced)) / root / (root - 1))).otherwise(0.0)
    return spark.range(original * original).select(F.col("id").cast("int").alias("k"), value.alias("value"))


def components(matrices: DataFrame, dim: Dim) -> DataFrame:
    """mat_id, k, re, im of matrices (mat_id, r, c, re, im): 2^(s-2) tr(L_k M). The basis is as large as ``dim`` has it and is broadcast."""
    d = dims(dim)
    b = paulis(matrices.sparkSession, d).select("k", F.col("r").alias("c"), F.col("c").alias("r"), F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    both = matrices.join(F.broadcast(b), ["r", "c"])
    scale = 2.0 ** (len(d) - 2)
    return both.groupBy("mat_id", "k").agg((F.sum(F.expr("re * b_re - im * b_im")) * scale).alias("re"), (F.sum(F.expr("re * b_im + im * b_re")) * scale).alias("im"))


def compose(parts: DataFrame, dim: Dim) -> DataFrame:
    """mat_id, r, c, re, im of components (mat_id, k, re, im)."""
    b = paulis(parts.sparkSession, dim).toDF("k", "r", "c", "b_re", "b_im")
    return parts.join(F.broadcast(b), "k").groupBy("mat_id", "r", "c").agg(F.sum(F.expr("re * b_re - im * b_im")).alias("re"), F.sum(F.expr("re * b_im + im * b_re")).alias("im"))


def check_matrix_dim(n: int, dim: Dim) -> None:
    if math.prod(dims(dim)) != n:
        raise ValueError(f"subsystem dimensions {dims(dim)} don't make a matrix of {n}")


def truncate(parts: DataFrame, original: Dim, reduced: Dim) -> DataFrame:
    """Components (mat_id, k, re, im) of each matrix's leading block, subsystem by subsystem."""
    d, e = dims(original), dims(reduced)
    if len(d) != len(e) or any(y > x for x, y in zip(d, e, strict=True)):
        raise ValueError("reduced dimensions are at most the original ones")
    if d == e:
        return parts
    spark = parts.sparkSession
    out, sizes = parts, [x * x for x in d]
    for i, (x, y) in enumerate(zip(d, e, strict=True)):
        if x == y:
            continue
        new = l0_projector(spark, y, x).filter("value <> 0").select(F.lit(0).alias("to"), F.col("k").alias("own"), "value")
        new = new.union(spark.range(1, y * y).select(F.col("id").cast("int"), F.col("id").cast("int"), F.lit(1.0)))
        inner = math.prod(sizes[i + 1 :])
        own = (F.floor(F.col("k") / inner) % sizes[i]).cast("int")
        outer, rest = F.floor(F.col("k") / (inner * sizes[i])), F.col("k") % inner
        sizes[i] = y * y
        joined = out.withColumns({"own": own, "outer": outer, "rest": rest}).join(F.broadcast(new), "own")
        out = joined.select("mat_id", ((F.col("outer") * sizes[i] + F.col("to")) * inner + F.col("rest")).cast("int").alias("k"), (F.col("re") * F.col("value")).alias("re"), (F.col("im") * F.col("value")).alias("im"))
        out = out.groupBy("mat_id", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return out
