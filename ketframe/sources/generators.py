"""Random Pauli sums and states, reproducible by seed: made from hashes of row numbers, in parallel and alike under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_states(spark: SparkSession, num_qubits: int, samples: int, seed: int = 0) -> DataFrame:
    """(s): ``samples`` uniform states, with repeats."""
    if not 0 < num_qubits <= 62:
        raise ValueError("1 to 62 qubits")
    return spark.range(samples).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << num_qubits)).alias("s"))


def random_paulisum(spark: SparkSession, num_qubits: int, terms: int, seed: int = 0) -> DataFrame:
    """(ham_id, pauli, re, im): uniform strings with real coefficients in [-1, 1)."""
    letter = lambda q: F.substring(F.lit("IXYZ"), (F.pmod(F.xxhash64(F.lit(seed), "id", q), F.lit(4)) + 1).cast("int"), F.lit(1))
    string = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(num_qubits)), letter), "")
    coeff = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("c")), F.lit(1 << 30)) / float(1 << 29) - 1
    return spark.range(terms).select(F.lit(0).cast("long").alias("ham_id"), string.alias("pauli"), coeff.alias("re"), F.lit(0.0).alias("im"))
