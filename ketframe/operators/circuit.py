"""Circuits of Pauli rotations on state vectors.

A gate is exp(-i theta/2 P) = cos(theta/2) - i sin(theta/2) P for a Pauli string P of masks (x, z);
`x`, `y` and `z` are rotations by pi. With cos = cos(-theta/2) and sin = sin(-theta/2) an entry becomes
cos v[i] + i sin (-i)^|x AND z| (-1)^|z AND i| v[i XOR x].
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.functions.complexes import parity_sign, times_minus_i
from ketframe.session import saved

GATES = "circ_id long, g int, name string, qubits array<int>, angle double"
#: name -> (x flag, z flag); `cz` is a composition and not here.
PAULI_OF = {"x": (1, 0), "y": (1, 1), "z": (0, 1), "rx": (1, 0), "ry": (1, 1), "rz": (0, 1), "rzz": (0, 1)}
TURNS = ("x", "y", "z")


def gates_from_list(spark: SparkSession, circuit: Sequence[tuple], circ_id: int = 0) -> DataFrame:
    """(name, qubits[, angle]) in order; ValueError for an unknown name or a missing angle."""
    rows = []
    for g, (name, qubits, *angle) in enumerate(circuit):
        if name not in PAULI_OF and name != "cz":
            raise ValueError(f"unsupported gate {name}")
        if name not in (*TURNS, "cz") and not angle:
            raise ValueError(f"gate {name} needs an angle")
        rows.append((circ_id, g, name, [qubits] if isinstance(qubits, int) else [int(q) for q in qubits], float(angle[0]) if angle else None))
    return spark.createDataFrame(rows, GATES)


def num_qubits(gates: DataFrame) -> int:
    return gates.select(F.max(F.array_max("qubits"))).first()[0] + 1


def decompose_cz(gates: DataFrame) -> DataFrame:
    """`cz` as rzz(pi/2), rz(-pi/2), rz(-pi/2) (equal up to a global phase); other gates as they are. g becomes 3 g, 3 g + 1, ..."""
    half = math.pi / 2

    def piece(i: int, name: str, qubits: Column, angle: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), F.lit(name).alias("name") if name else F.col("name"), qubits.alias("qubits"), angle.alias("angle"))

    one = lambda k: F.array(F.get("qubits", F.lit(k)))
    pieces = F.when(F.col("name") == "cz", F.array(piece(0, "rzz", F.col("qubits"), F.lit(half)), piece(1, "rz", one(0), F.lit(-half)), piece(2, "rz", one(1), F.lit(-half)))).otherwise(F.array(piece(0, "", F.col("qubits"), F.col("angle"))))
    return gates.select("circ_id", F.col("g").alias("g0"), F.explode(pieces).alias("p")).select("circ_id", (F.col("g0") * 3 + F.col("p.i")).alias("g"), "p.name", "p.qubits", "p.angle")


def compile_gates(gates: DataFrame) -> DataFrame:
    """circ_id, g, x, z, cos, sin; a gate that isn't known is an error at run time."""
    mask = F.aggregate("qubits", F.lit(0).cast("long"), lambda m, q: m + F.call_function("shiftleft", F.lit(1).cast("long"), q))
    flags = {i: F.create_map(*[F.lit(v) for k, f in PAULI_OF.items() for v in (k, f[i])]) for i in (0, 1)}
    known = F.when(F.col("name").isin(*PAULI_OF), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unsupported gate "), F.coalesce("name", F.lit("null")))))
    turn = F.col("name").isin(*TURNS)
    flat = decompose_cz(gates).withColumn("name", known)
    return flat.select("circ_id", "g", (mask * flags[0][F.col("name")]).alias("x"), (mask * flags[1][F.col("name")]).alias("z"), F.when(turn, 0.0).otherwise(F.cos(-F.col("angle") * 0.5)).alias("cos"), F.when(turn, -1.0).otherwise(F.sin(-F.col("angle") * 0.5)).alias("sin"))


def one_hot(spark: SparkSession, n: int, k: int = 0) -> DataFrame:
    """(i, re, im) over all 2^n entries."""
    return spark.range(1 << n).select(F.col("id").alias("i"), F.when(F.col("id") == k, 1.0).otherwise(0.0).alias("re"), F.lit(0.0).alias("im"))


def apply_gate(vectors: DataFrame, x: int, z: int, cos: float, sin: float, keys: Sequence[str] = ()) -> DataFrame:
    """One gate on vectors (keys..., i, re, im). A diagonal gate (x = 0) needs no shuffle; another one joins i with i XOR x."""
    row = F.col("i")
    if x:
        mate = vectors.select(*keys, row.bitwiseXOR(F.lit(x).cast("long")).alias("i"), F.col("re").alias("m_re"), F.col("im").alias("m_im"))
        vectors = vectors.join(mate, [*keys, "i"])
    else:
        vectors = vectors.withColumns({"m_re": F.col("re"), "m_im": F.col("im")})
    re, im = _rotated(F.col("re"), F.col("im"), F.col("m_re"), F.col("m_im"), parity_sign(F.lit(z).cast("long"), row), F.lit((x & z).bit_count()), F.lit(float(cos)), F.lit(float(sin)))
    return vectors.select(*keys, "i", re.alias("re"), im.alias("im"))


def _rotated(re, im, m_re, m_im, sign, k, cos, sin):
    t_re, t_im = times_minus_i(k, m_re, m_im)
    return cos * re - sin * sign * t_im, cos * im + sin * sign * t_re


def simulate_rows(gates: DataFrame, initial: DataFrame, every: int = 8) -> DataFrame:
    """Run one circuit on a vector (i, re, im) by joins; lineage is cut every few shuffling gates. For many qubits."""
    compiled = compile_gates(gates).orderBy("g").collect()  # a circuit's gates
    state, since = initial, 0
    for gate in compiled:
        state = apply_gate(state, gate["x"], gate["z"], gate["cos"], gate["sin"])
        since += gate["x"] != 0
        if since == every:
            state, since = saved(state, "state"), 0
    return state


def simulate_arrays(gates: DataFrame, initial: DataFrame) -> DataFrame:
    """Run every circuit on its vector (circ_id, amps array<struct<re, im>>) by a fold over its gates; no shuffle but that of the gates. For up to about 14 qubits, and many circuits."""
    listed = compile_gates(gates).groupBy("circ_id").agg(F.array_sort(F.collect_list(F.struct("g", "x", "z", "cos", "sin"))).alias("gates"))

    def step(state: Column, gate: Column) -> Column:
        def entry(v: Column, i: Column) -> Column:
            row = i.cast("long")
            mate = F.get(state, row.bitwiseXOR(gate["x"]).cast("int"))
            k = F.bit_count(gate["x"].bitwiseAND(gate["z"]))
            re, im = _rotated(v["re"], v["im"], mate["re"], mate["im"], parity_sign(gate["z"], row), k, gate["cos"], gate["sin"])
            return F.struct(re.alias("re"), im.alias("im"))

        return F.transform(state, entry)

    return initial.join(listed, "circ_id", "left").select("circ_id", F.aggregate(F.coalesce("gates", F.expr("cast(array() as array<struct<g:int,x:bigint,z:bigint,cos:double,sin:double>>)")), F.col("amps"), step).alias("amps"))


def svsim(gates: DataFrame, n: int | None = None, initial_state: int | DataFrame = 0) -> DataFrame:
    """State vector (i, re, im) after one circuit, from a basis state's number or a vector."""
    spark = gates.sparkSession
    n = num_qubits(gates) if n is None else n
    initial = one_hot(spark, n, initial_state) if isinstance(initial_state, int) else initial_state
    if n > 12:
        return simulate_rows(gates, initial)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "re", "im"))), lambda v: F.struct(v["re"].alias("re"), v["im"].alias("im")))
    amps = initial.agg(whole.alias("amps")).select(F.lit(0).cast("long").alias("circ_id"), "amps")
    done = simulate_arrays(gates.withColumn("circ_id", F.lit(0).cast("long")), amps)
    return done.select(F.posexplode("amps").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "v.re", "v.im")
