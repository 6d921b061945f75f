"""Complex arithmetic and bit signs as column expressions; a complex number is a pair of double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parity_sign(z: Column, s: Column) -> Column:
    """(-1)^|z AND s|."""
    return (1 - 2 * (F.bit_count(z.bitwiseAND(s)) % 2)).cast("double")


def times_minus_i(k: Column, re: Column, im: Column) -> tuple[Column, Column]:
    """(-i)^k (re + i im): a four-way swap."""
    turn = k % 4
    return (
        F.when(turn == 0, re).when(turn == 1, im).when(turn == 2, -re).otherwise(-im),
        F.when(turn == 0, im).when(turn == 1, -re).when(turn == 2, -im).otherwise(re),
    )


def phase_0_2pi(re: Column, im: Column) -> Column:
    """The argument in [0, 2 pi); the zero number has 0."""
    return wrap(F.atan2(im, re))


def wrap(angle: Column) -> Column:
    turn = 2 * math.pi
    wrapped = angle - F.floor(angle / turn) * turn
    return F.when(wrapped >= turn, 0.0).otherwise(wrapped)


def near_integer(v: Column) -> Column:
    """The nearest integer if it is within 1e-8 + 1e-5 |v|, else -1 (halves go to even)."""
    near = F.rint(v)
    return F.when(F.abs(near - v) <= 1e-8 + 1e-5 * F.abs(v), near.cast("long")).otherwise(F.lit(-1).cast("long"))


def rounded(c: Column, digits: int = 6) -> Column:
    """For comparing across engines: rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)
