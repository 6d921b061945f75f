"""Functions of normal matrices through their eigenvalues, in Arrow batches of whole matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.session import ship

OUT = "mat_id long, entries array<struct<r:int,c:int,re:double,im:double>>, diagonals array<struct<re:double,im:double>>, error string"


def _eigen(m: np.ndarray, hermitian: int) -> tuple[np.ndarray, np.ndarray]:
    if hermitian in (1, True):
        return np.linalg.eigh(m)
    if hermitian == -1:
        values, vectors = np.linalg.eigh(1j * m)
        return -1j * values, vectors
    values, vectors = np.linalg.eig(m)
    # a normal matrix has orthogonal eigenvectors; within an eigenvalue that repeats they need to be made so
    order = np.lexsort((values.imag.round(9), values.real.round(9)))
    return values[order], np.linalg.qr(vectors[:, order])[0]


def matrix_ufunc(operator: Callable[[np.ndarray], np.ndarray], matrices: DataFrame, n: int, hermitian: int = 0, with_diagonals: bool = False, keep_errors: bool = False) -> DataFrame:
    """f(M) = U f(L) U^dagger for matrices (mat_id, r, c, re, im) of size n, as the same columns.

    ``hermitian`` is 1, -1 (anti-Hermitian) or 0 (any normal matrix). with_diagonals adds rows of r = c
    = -1 - j that hold f of the j-th eigenvalue. A matrix that can't be decomposed fails the job, or with
    keep_errors gives one row of r null and the reason in ``error``.
    """
    ship(matrices.sparkSession)
    whole = matrices.groupBy("mat_id").agg(F.collect_list(F.struct("r", "c", "re", "im")).alias("e"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for mat_id, entries in zip(part["mat_id"], part["e"], strict=True):
                m = np.zeros((n, n), complex)
                for e in entries:
                    m[e["r"], e["c"]] += complex(e["re"], e["im"])
                try:
                    values, u = _eigen(m, hermitian)
                except np.linalg.LinAlgError as x:
                    if not keep_errors:
                        raise
                    rows.append((mat_id, [], [], str(x)))
                    continue
                f = np.asarray(operator(values), complex)
                out = (u * f) @ u.conj().T
                rows.append((mat_id, [{"r": r, "c": c, "re": out[r, c].real, "im": out[r, c].imag} for r in range(n) for c in range(n)], [{"re": x.real, "im": x.imag} for x in f], None))
            yield pd.DataFrame(rows, columns=["mat_id", "entries", "diagonals", "error"])

    done = whole.mapInPandas(work, OUT)
    extra = F.transform("diagonals", lambda v, j: F.struct((-1 - j).alias("r"), (-1 - j).alias("c"), v["re"].alias("re"), v["im"].alias("im")))
    rows = F.concat("entries", extra) if with_diagonals else F.col("entries")
    flat = done.select("mat_id", F.explode_outer(rows).alias("x"), "error").select("mat_id", "x.r", "x.c", "x.re", "x.im", "error")
    return flat if keep_errors else flat.drop("error")


def matrix_exp(matrices: DataFrame, n: int, hermitian: int = 0, with_diagonals: bool = False) -> DataFrame:
    return matrix_ufunc(np.exp, matrices, n, hermitian, with_diagonals)


def matrix_angle(matrices: DataFrame, n: int, hermitian: int = 0, with_diagonals: bool = False) -> DataFrame:
    return matrix_ufunc(np.angle, matrices, n, hermitian, with_diagonals)
