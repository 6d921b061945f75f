"""Domain inputs derived from the star-schema and event tables: states, terms, matrices, vectors, circuits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def states_ring8(spark: SparkSession, folder: str) -> DataFrame:
    """(s): 8-qubit states with repeats, one a line item; all 256 from a few thousand rows on."""
    return table(spark, folder, "lineitem").select((F.col("l_partkey") % 256).alias("s"))


def states_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(s): states with repeats, one a line item: its order's number, so that the subspace grows with the table."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("s"))


def _scattered(number: Column, low: int) -> Column:
    """Twelve bits of a multiplicative hash."""
    return (F.floor((number * 2654435761) % 4294967296 / low) % 4096).cast("long")


def pauli_strings_part(spark: SparkSession, folder: str) -> DataFrame:
    """(ham_id, pauli, re, im): a 12-letter string a part, with repeats, cancelling pairs and zero coefficients."""
    key = F.col("p_partkey")
    base = key % 1000
    turned = F.when(F.floor(key / 1000) % 2 == 0, 1.0).otherwise(-1.0)
    re = F.when(base % 3 == 0, turned * (base % 17 - 8) / 8).otherwise((F.col("p_size") % 17 - 8) / 8)
    letters = [F.substring(F.lit("IXZY"), (1 + F.shiftright(F.col("x"), q) % 2 + 2 * (F.shiftright(F.col("z"), q) % 2)).cast("int"), F.lit(1)) for q in range(11, -1, -1)]
    named = table(spark, folder, "part").select(F.lit(0).cast("long").alias("ham_id"), _scattered(base, 1_048_576).alias("x"), _scattered(base, 256).alias("z"), re.alias("re"))
    return named.select("ham_id", F.concat(*letters).alias("pauli"), "re", F.lit(0.0).alias("im"))


def terms_part12(spark: SparkSession, folder: str) -> DataFrame:
    """(x, z, re, im): 12-qubit terms with real and imaginary coefficients, summed over all parts; ten masks x, x = 0 among them, and five z for each."""
    size, key = F.col("p_size") % 10, F.col("p_partkey")
    x = F.when(size == 0, 0).otherwise(_scattered(size, 1_048_576)).cast("long")
    raw = table(spark, folder, "part").select(x.alias("x"), _scattered(key % 5 + 1, 256).alias("z"), ((key % 17 - 8) / 8).alias("c"))
    summed = raw.groupBy("x", "z").agg(F.sum("c").alias("c")).filter("c <> 0")
    k = F.bit_count(F.col("x").bitwiseAND(F.col("z"))) % 4
    zero = F.lit(0.0)
    return summed.select("x", "z", F.when(k == 0, F.col("c")).when(k == 2, -F.col("c")).otherwise(zero).alias("re"), F.when(k == 1, -F.col("c")).when(k == 3, F.col("c")).otherwise(zero).alias("im"))


def matrices_emb(spark: SparkSession, folder: str, ids: str = "true") -> DataFrame:
    """(mat_id, r, c, re, im): each embedding as a row-major 8x8 matrix."""
    e = table(spark, folder, "embeddings").filter(ids).select(F.col("vec_id").alias("mat_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "re"))
    return e.select("mat_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).cast("int").alias("c"), "re", F.lit(0.0).alias("im"))


def hermitian_emb(spark: SparkSession, folder: str) -> DataFrame:
    """(mat_id, r, c, re, im): M + M^T over 2."""
    m = matrices_emb(spark, folder)
    both = m.union(m.select("mat_id", "c", "r", "re", "im"))
    return both.groupBy("mat_id", "r", "c").agg((F.sum("re") / 2).alias("re"), F.lit(0.0).alias("im"))


def vectors_emb(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, i, re, im): each embedding as an unnormalised real 6-qubit state."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "re"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), "re", F.lit(0.0).alias("im"))


def _event_gates(events: DataFrame) -> DataFrame:
    """Adds name, qubits and q0 of six-qubit gates: the kind of event is the gate, the user the qubit."""
    names = {"click": "rx", "error": "ry", "purchase": "rz", "signup": "rzz", "view": "cz"}
    name = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("event_type")]
    q0 = (F.col("user_id") % 6).cast("int")
    q1 = ((q0 + 1) % 6).cast("int")
    return events.withColumns({"name": name, "q0": q0, "qubits": F.when(F.col("event_type").isin("signup", "view"), F.array(q0, q1)).otherwise(F.array(q0))})


def gates_events(spark: SparkSession, folder: str) -> DataFrame:
    """(circ_id, g, name, qubits, angle): all events, a circuit a user."""
    e = _event_gates(table(spark, folder, "events"))
    return e.select(F.col("user_id").alias("circ_id"), F.col("event_id").cast("int").alias("g"), "name", "qubits", (F.coalesce("value", F.lit(0.0)) / 100).alias("angle"))


def gates_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(circ_id, g, name, qubits, angle): one circuit with a gate for each kind and qubit, turned by the total of all its events (in cents)."""
    e = _event_gates(table(spark, folder, "events"))
    cents = F.sum(F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")) % 100_000
    kinds = e.groupBy("name", "q0", "qubits").agg(cents.alias("cents"))
    place = F.array_position(F.array(*map(F.lit, ("rx", "ry", "rz", "rzz", "cz"))), F.col("name")) * 6 + F.col("q0")
    return kinds.select(F.lit(0).cast("long").alias("circ_id"), place.cast("int").alias("g"), "name", "qubits", (F.col("cents") / 10_000).alias("angle"))


def gates_ghz(spark: SparkSession, n: int) -> DataFrame:
    """Rotation gates that prepare (|0...0> + |1...1>)/sqrt 2."""
    rows = [("ry", [0], math.pi / 2)]
    for q in range(n - 1):
        rows += [("ry", [q + 1], math.pi / 2), ("cz", [q, q + 1], None), ("ry", [q + 1], -math.pi / 2)]
    return spark.createDataFrame([(0, g, *r) for g, r in enumerate(rows)], "circ_id long, g int, name string, qubits array<int>, angle double")


def terms_tfim(spark: SparkSession, n: int, h: float) -> DataFrame:
    """(x, z, re, im): the periodic transverse-field Ising model, -ZZ on the ring and h X."""
    q = spark.range(n).select(F.col("id").cast("int").alias("q"))
    one = lambda p: F.expr(f"shiftleft(1L, {p})")
    zz = q.select(F.lit(0).cast("long").alias("x"), one("q").bitwiseOR(one(f"(q + 1) % {n}")).alias("z"), F.lit(-1.0).alias("re"), F.lit(0.0).alias("im"))
    return zz.union(q.select(one("q"), F.lit(0).cast("long"), F.lit(float(h)), F.lit(0.0)))
