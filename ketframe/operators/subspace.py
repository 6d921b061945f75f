"""Sampled subspaces: distinct states, XOR look-ups, the projected Hamiltonian and its product with vectors.

States are integers (a bit string of up to 62 qubits) or arrays of limbs; vectors and matrices are keyed by them, so no
dense index, filler or sort is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ketframe.functions.limbs import Keys
from ketframe.operators.pauli_sum import group_by_x, terms_fit
from ketframe.session import saved


def pack(bits: DataFrame, column: str = "bits") -> DataFrame:
    """Arrays of 0 and 1, most significant first, as integers s."""
    return bits.withColumn("s", F.aggregate(column, F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))).drop(column)


def unpack(states: DataFrame, num_qubits: int) -> DataFrame:
    """s and its bits, most significant first."""
    if not 0 < num_qubits <= 62:
        raise ValueError("1 to 62 qubits")
    return states.select("s", F.transform(F.sequence(F.lit(num_qubits - 1), F.lit(0), F.lit(-1)), lambda q: F.call_function("shiftright", F.col("s"), q).bitwiseAND(F.lit(1)).cast("int")).alias("bits"))


def distinct_states(states: DataFrame) -> DataFrame:
    return states.select("s").distinct()


def first_positions(states: DataFrame, position: str) -> DataFrame:
    """Each state and the first position it has."""
    return states.groupBy("s").agg(F.min(position).alias("first"))


def state_index(states: DataFrame) -> DataFrame:
    """s and its place in sorted order (from 0).

    The place within a block of the upper bits plus the sizes of earlier blocks: only block sizes,
    never all states, pass through one ordered window.
    """
    keyed = distinct_states(states).withColumn("block", F.shiftright("s", 6))
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("upper", F.shiftright("block", 12))
    per = sizes.groupBy("upper").agg(F.sum("n").alias("n"))
    before_upper = per.select("upper", (F.sum("n").over(Window.orderBy("upper")) - F.col("n")).alias("b0"))
    before = sizes.select("block", "upper", (F.sum("n").over(Window.partitionBy("upper").orderBy("block")) - F.col("n")).alias("b1")).join(before_upper, "upper")
    number = F.row_number().over(Window.partitionBy("block").orderBy("s")) - 1
    return keyed.withColumn("k", number).join(before, "block").select("s", (F.col("b0") + F.col("b1") + F.col("k")).alias("idx"))


def xsource(states: DataFrame, x: int | Column) -> DataFrame:
    """dst and src = dst XOR x where that is in the set, else null."""
    a, b = states.select(F.col("s").alias("dst")), states.select(F.col("s").alias("src"))
    return a.join(b, F.col("src") == F.col("dst").bitwiseXOR(x if isinstance(x, Column) else F.lit(x).cast("long")), "left")


def xsource_all(states: DataFrame, masks: DataFrame) -> DataFrame:
    """x, dst, src for every mask, rows without a source left out (zero for all purposes)."""
    asked = _dealt(states.select(F.col("s").alias("dst")), masks.select("x").distinct()).withColumn("src", Keys(states, "s").xor(F.col("dst"), F.col("x")))
    return asked.join(states.select(F.col("s").alias("src")), "src").select("x", "dst", "src")


def xsource_exists(states: DataFrame, x: int) -> DataFrame:
    """States whose XOR with x is in the set."""
    return states.select("s").join(states.select(F.col("s").alias("t")), F.col("t") == F.col("s").bitwiseXOR(F.lit(x).cast("long")), "left_semi")


def shift_intersect(states: DataFrame, x: int) -> DataFrame:
    """The set and its shift by x, intersected."""
    return states.select("s").intersect(states.select(F.col("s").bitwiseXOR(F.lit(x).cast("long")).alias("s")))


def diag_signs(states: DataFrame, terms: DataFrame) -> DataFrame:
    """z, s and (-1)^|z AND s| for each z mask and state."""
    return _dealt(states.select("s"), terms.select("z").distinct()).select("z", "s", Keys(states, "s").sign(F.col("z"), F.col("s")).cast("int").alias("sign"))


def group_diagonal(states: DataFrame, terms: DataFrame) -> DataFrame:
    """x, s, re, im: the sum of c (-1)^|z AND s| over an x mask's terms, made in place from its array of terms."""
    return _dealt(states.select("s"), group_by_x(terms)).select("x", "s", *_diagonal(F.col("s"), Keys(states, "s")))


def _diagonal(s: Column, keys: Keys) -> list[Column]:
    def total(part: str) -> Column:
        return F.aggregate("terms", F.lit(0.0), lambda a, t: a + t[part] * keys.sign(t["z"], s)).alias(part)

    return [total("re"), total("im")]


def _dealt(states: DataFrame, few: DataFrame) -> DataFrame:
    """Each state with each of the masks: these are few and broadcast; beyond the bound the planner decides."""
    return states.join(F.broadcast(few)) if terms_fit(few) else states.crossJoin(few)


def hproj(states: DataFrame, terms: DataFrame) -> DataFrame:
    """The projected Hamiltonian r, c, re, im (no zero entries) on the distinct states.

    For each x mask a row has at most one column, r XOR x, so entries are complete without any
    aggregation: the one shuffle is the look-up of the column state.
    """
    known, keys = distinct_states(states), Keys(states, "s")
    asked = _dealt(known.select(F.col("s").alias("r")), group_by_x(terms)).withColumn("c", keys.xor(F.col("r"), F.col("x")))
    found = asked.join(known.select(F.col("s").alias("c")), "c")
    # zero entries go inside a generator: as a filter they would be worked out before the look-up, for all pairs that it drops
    entry = F.filter(F.array(F.struct(*_diagonal(F.col("r"), keys))), lambda e: (e["re"] != 0) | (e["im"] != 0))
    return found.select("r", "c", F.inline(entry))


def apply_coo(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """H v: matrix (r, c, re, im) times vector (s, re, im), as (s, re, im)."""
    v = vector.select(F.col("s").alias("c"), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
    both = matrix.join(v, "c")
    re = F.col("re") * F.col("v_re") - F.col("im") * F.col("v_im")
    im = F.col("re") * F.col("v_im") + F.col("im") * F.col("v_re")
    return both.select(F.col("r").alias("s"), re.alias("re"), im.alias("im")).groupBy("s").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def apply_h(states: DataFrame, terms: DataFrame, vector: DataFrame) -> DataFrame:
    """H v without keeping H: each entry of v is sent where the terms move it, if that is in the set."""
    moved = _dealt(vector.select(F.col("s").alias("c"), F.col("re").alias("v_re"), F.col("im").alias("v_im")), group_by_x(terms))
    keys = Keys(states, "s")
    moved = moved.withColumn("r", keys.xor(F.col("c"), F.col("x"))).select("r", "v_re", "v_im", *_diagonal(F.col("r"), keys))
    re = F.col("re") * F.col("v_re") - F.col("im") * F.col("v_im")
    im = F.col("re") * F.col("v_im") + F.col("im") * F.col("v_re")
    summed = moved.select("r", re.alias("re"), im.alias("im")).groupBy("r").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return summed.join(distinct_states(states).withColumnRenamed("s", "r"), "r", "left_semi").withColumnRenamed("r", "s")


def cached_product(known: DataFrame, terms: DataFrame, strategy: tuple[int, int]) -> Callable[[DataFrame], DataFrame]:
    """v -> H v on distinct states, with what ``strategy`` names written once for all products.

    Its first part keeps the look-ups of all masks (1) or finds them anew (0). Its second part keeps the
    signs of all terms (1), the diagonals of all masks (2), or works them out in place (0). With both
    look-ups and diagonals kept that is the projected matrix.
    """
    keep_x, keep_z = strategy
    if strategy == (0, 0):
        return lambda v: apply_h(known, terms, v)
    if strategy == (1, 2):
        matrix = saved(hproj(known, terms), "hproj")
        return lambda v: apply_coo(matrix, v)
    keys, groups = Keys(known, "s"), saved(group_by_x(terms), "terms")
    sources = saved(xsource_all(known, terms), "sources") if keep_x else None
    signs = saved(diag_signs(known, terms), "signs").withColumnRenamed("s", "dst") if keep_z == 1 else None
    diagonals = saved(group_diagonal(known, terms), "diagonals").withColumnRenamed("s", "dst") if keep_z == 2 else None

    def product(vector: DataFrame) -> DataFrame:
        v = vector.select(F.col("s").alias("src"), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
        if keep_x:
            moved = sources.join(v, "src").drop("src")
        else:
            sent = _dealt(v, groups.select("x")).withColumn("dst", keys.xor(F.col("src"), F.col("x"))).drop("src")
            moved = sent.join(known.withColumnRenamed("s", "dst"), "dst", "left_semi")
        if keep_z == 2:
            full = moved.join(diagonals, ["x", "dst"])
        elif keep_z == 1:
            each = moved.join(groups, "x").select("dst", "v_re", "v_im", F.inline("terms")).join(signs, ["z", "dst"])
            full = each.withColumns({"re": F.col("re") * F.col("sign"), "im": F.col("im") * F.col("sign")})
        else:
            full = moved.join(groups, "x").select("dst", "v_re", "v_im", *_diagonal(F.col("dst"), keys))
        re = F.col("re") * F.col("v_re") - F.col("im") * F.col("v_im")
        im = F.col("re") * F.col("v_im") + F.col("im") * F.col("v_re")
        return full.select(F.col("dst").alias("s"), re.alias("re"), im.alias("im")).groupBy("s").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    return product


def start_state(states: DataFrame, terms: DataFrame) -> DataFrame:
    """The state with the least diagonal entry (of equals the smallest); without diagonal terms the smallest state."""
    diagonal = group_diagonal(distinct_states(states), terms).filter(Keys(states, "s").is_zero(F.col("x"))).select("s", "re")
    best = diagonal.agg(F.min(F.struct("re", "s")).alias("best")).select(F.col("best.s").alias("s1"))
    return best.join(distinct_states(states).agg(F.min("s").alias("s0"))).select(F.coalesce("s1", "s0").alias("s"))


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """<a|b> of vectors (s, re, im): one row re, im."""
    j = a.toDF("s", "a_re", "a_im").join(b.toDF("s", "b_re", "b_im"), "s")
    return j.agg(F.sum(F.expr("a_re * b_re + a_im * b_im")).alias("re"), F.sum(F.expr("a_re * b_im - a_im * b_re")).alias("im"))


def rayleigh_matrix(matrix: DataFrame, vectors: DataFrame) -> DataFrame:
    """j, k, re, im of <w_j|H|w_k> for vectors (j, s, re, im), in one product and one sum."""
    v = vectors.toDF("k", "c", "v_re", "v_im")
    moved = matrix.join(v, "c").select("k", F.col("r").alias("s"), F.expr("re * v_re - im * v_im").alias("h_re"), F.expr("re * v_im + im * v_re").alias("h_im"))
    moved = moved.groupBy("k", "s").agg(F.sum("h_re").alias("h_re"), F.sum("h_im").alias("h_im"))
    w = vectors.toDF("j", "s", "w_re", "w_im")
    return w.join(moved, "s").groupBy("j", "k").agg(F.sum(F.expr("w_re * h_re + w_im * h_im")).alias("re"), F.sum(F.expr("w_re * h_im - w_im * h_re")).alias("im"))
