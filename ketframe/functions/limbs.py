"""Bit strings of more than 62 qubits: arrays of 62-bit limbs, most significant first.

Arrays are join and grouping keys like any value, so the operators' XOR keys and parities carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ketframe.functions import complexes

WIDTH = 62


def xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))


def common_bits(a: Column, b: Column) -> Column:
    """How many bits both have."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.bitwiseAND(q)), F.lit(0), lambda t, m: t + F.bit_count(m))


def parity_sign(z: Column, s: Column) -> Column:
    return (1 - 2 * (common_bits(z, s) % 2)).cast("double")


def of_mask(bits: Column) -> Column:
    """A string of 0 and 1 as limbs."""
    size = F.length(bits)
    whole = (F.ceil(size / WIDTH) * WIDTH).cast("int")
    padded = F.lpad(bits, whole, "0")
    return F.transform(F.sequence(F.lit(0), (whole / WIDTH).cast("int") - 1), lambda i: F.conv(F.substring(padded, (i * WIDTH + 1).cast("int"), F.lit(WIDTH)), 2, 10).cast("long"))


class Keys:
    """The bit operations on a table's column: of longs, or of limbs where it is an array."""

    def __init__(self, df: DataFrame, column: str):
        self.wide = isinstance(df.schema[column].dataType, ArrayType)

    def xor(self, a: Column, b: Column) -> Column:
        return xor(a, b) if self.wide else a.bitwiseXOR(b)

    def sign(self, z: Column, s: Column) -> Column:
        return parity_sign(z, s) if self.wide else complexes.parity_sign(z, s)

    def common_bits(self, a: Column, b: Column) -> Column:
        return common_bits(a, b) if self.wide else F.bit_count(a.bitwiseAND(b))

    def is_zero(self, a: Column) -> Column:
        return F.forall(a, lambda m: m == 0) if self.wide else a == 0
