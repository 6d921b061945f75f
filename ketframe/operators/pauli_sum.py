"""Pauli sums: from strings to symplectic (x, z) masks with the phase (-i)^|x AND z| folded in.

A string reads left to right from the most significant qubit. A term acts as
<s|Q|s'> = [s' = s XOR x] (-1)^|z AND s| c, with c including its phase.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.functions import limbs
from ketframe.functions.complexes import parity_sign, times_minus_i

STRINGS = "ham_id long, pauli string, re double, im double"
TERMS = "x long, z long, re double, im double"


def from_paulisum(spark: SparkSession, strings: Sequence[str], coeffs: Sequence[complex], ham_id: int = 0, force_real: bool = False) -> DataFrame:
    """Strings and coefficients as terms (x, z, re, im); masks of strings of over 62 letters are limbs.

    ValueError: lengths differ, strings differ in length, or hold other letters than I, X, Y, Z.
    """
    if len(strings) != len(coeffs):
        raise ValueError("as many coefficients as strings are needed")
    if len({len(s) for s in strings}) > 1:
        raise ValueError("all strings need the same length")
    if any(set(s.upper()) - set("IXYZ") for s in strings):
        raise ValueError("strings hold the letters I, X, Y and Z only")
    rows = [(ham_id, s, complex(c).real, complex(c).imag) for s, c in zip(strings, coeffs, strict=True)]
    wide = any(len(s) > limbs.WIDTH for s in strings)
    terms = fold_phase(symplectic(consolidate(spark.createDataFrame(rows, STRINGS)), wide))
    return real_only(terms) if force_real else terms.drop("ham_id")


def parse(strings: DataFrame) -> DataFrame:
    """Upper-case strings of nonzero coefficient, with masks; a letter other than I, X, Y, Z is an error at run time."""
    return symplectic(strings.filter("re <> 0 or im <> 0"))


def consolidate(strings: DataFrame) -> DataFrame:
    """Sum the coefficients of equal strings; those that cancel go."""
    up = strings.withColumn("pauli", F.upper("pauli"))
    return up.groupBy("ham_id", "pauli").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).filter("re <> 0 or im <> 0")


def symplectic(strings: DataFrame, wide: bool = False) -> DataFrame:
    """Strings with masks x and z, as limbs if ``wide``."""
    letters = F.upper("pauli")
    ok = F.when(letters.rlike("^[IXYZ]+$"), letters).otherwise(F.raise_error(F.concat(F.lit("not a Pauli string: "), F.coalesce("pauli", F.lit("null")))))
    mask = lambda to: limbs.of_mask(F.translate(ok, "IXYZ", to)) if wide else F.conv(F.translate(ok, "IXYZ", to), 2, 10).cast("long")
    return strings.select("ham_id", letters.alias("pauli"), mask("0110").alias("x"), mask("0011").alias("z"), "re", "im")


def fold_phase(terms: DataFrame) -> DataFrame:
    re, im = times_minus_i(limbs.Keys(terms, "x").common_bits(F.col("x"), F.col("z")), F.col("re"), F.col("im"))
    return terms.withColumns({"re": re + F.lit(0.0), "im": im + F.lit(0.0)}).select(*[c for c in ("ham_id",) if c in terms.columns], "x", "z", "re", "im")


def real_only(terms: DataFrame) -> DataFrame:
    """Drop imaginary parts, with a warning if any isn't zero."""
    if terms.filter("im <> 0").limit(1).count():
        warnings.warn("imaginary coefficients are dropped", stacklevel=2)
    return terms.withColumn("im", F.lit(0.0)).drop("ham_id")


def group_by_x(terms: DataFrame) -> DataFrame:
    """One row an x mask: n_terms and terms (array of z, re, im in order of z). One look-up then serves all of them."""
    one = terms.groupBy("x", "z").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return one.groupBy("x").agg(F.count(F.lit(1)).alias("n_terms"), F.array_sort(F.collect_list(F.struct("z", "re", "im"))).alias("terms"))


def matmul(terms: DataFrame, vectors: DataFrame, keys: Sequence[str] = (), num_qubits: int | None = None) -> DataFrame:
    """The Pauli sum times full-space vectors (keys..., i, re, im): one row each with the same columns.

    Each nonzero entry goes to i XOR x, so terms are dealt to entries (a Hamiltonian's terms are few and are
    broadcast by the planner) and one partially aggregated shuffle on (keys, i) sums up. With ``num_qubits``
    a row number beyond the space is a ValueError.
    """
    if num_qubits is not None and vectors.filter((F.col("i") < 0) | (F.col("i") >= 1 << num_qubits)).limit(1).count():
        raise ValueError(f"vectors of {1 << num_qubits} entries are needed")
    t = terms.toDF("x", "z", "c_re", "c_im")
    moved = vectors.join(F.broadcast(t) if terms_fit(terms) else t)
    row = F.col("i").bitwiseXOR(F.col("x"))
    sign = parity_sign(F.col("z"), row)
    re = sign * (F.col("c_re") * F.col("re") - F.col("c_im") * F.col("im"))
    im = sign * (F.col("c_re") * F.col("im") + F.col("c_im") * F.col("re"))
    return moved.select(*keys, row.alias("i"), re.alias("re"), im.alias("im")).groupBy(*keys, "i").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


#: Terms (or groups of terms) up to this many are broadcast: a few MB.
BROADCAST_TERMS = 50_000


def terms_fit(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def arrays(terms: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks x and z and coefficients of a Hamiltonian's terms, ordered by (x, z); real if all of them are."""
    rows = terms.select("x", "z", "re", "im").orderBy("x", "z").collect()  # terms are few
    c = np.array([complex(r["re"], r["im"]) for r in rows])
    return np.array([r["x"] for r in rows], np.int64), np.array([r["z"] for r in rows], np.int64), c if np.any(c.imag) else c.real
