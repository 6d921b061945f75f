"""Lowest eigenpairs of sparse Hermitian matrices by single-vector locally optimal conjugate gradients.

Both backends take the best vector in the span of the iterate, its residual and the last step. By
linearity the products of the three with H are carried along, so an iteration costs one product.

* ``solve_each``: a matrix fits one worker; groups of a key (a parameter sweep) are solved in parallel.
* ``ground_state``: rows stay distributed; the driver sees nine sums an iteration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.operators import subspace
from ketframe.session import forget, saved, ship

#: Entries of one matrix up to which a worker solves it (some hundred MB).
LOCAL_ENTRIES = 5_000_000


def project_out(basis: Sequence[np.ndarray], v: np.ndarray) -> np.ndarray:
    """v without its part in the span of the orthonormal basis, normalised; zero if nothing is left of it."""
    size = np.linalg.norm(v)
    for _ in range(2):
        for b in basis:
            v = v - b * np.vdot(b, v)
        now = np.linalg.norm(v)
        if now <= 1e-10 * size or now == 0:
            return np.zeros_like(v)
        v, size = v / now, 1.0
    return v


def lowest(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, orth: Sequence[np.ndarray] = (), maxiter: int = 1000, tol: float | None = None) -> tuple[float, np.ndarray, list[tuple[int, float, float]]]:
    """(energy, vector, history of (iteration, energy, residual norm)), orthogonal to ``orth``.

    Converged when the residual's norm is under tol * 10 * N * (|Hx| + |energy|), tol being the machine
    epsilon if not given, or can't be told from rounding.
    """
    tol = np.finfo(float).eps if tol is None else tol
    x = project_out(orth, start.astype(start.dtype if np.iscomplexobj(start) else float))
    if not np.any(x):
        raise ValueError("the start vector lies in the span that is projected out")
    ax, p, ap, history = product(x), None, None, []
    for i in range(maxiter + 1):
        theta = float(np.vdot(x, ax).real)
        r = ax - theta * x
        for b in orth:
            r = r - b * np.vdot(b, r)
        size = float(np.linalg.norm(r))
        history.append((i, theta, size))
        scale = np.linalg.norm(ax) + abs(theta)
        if size <= max(tol * 10 * x.size * scale * 1e-1, 4e-15 * scale) or size == 0 or i == maxiter:
            break
        y = project_out([*orth, x], r)
        if not np.any(y):
            break
        ay, dirs, images = product(y), [x, y], []
        images = [ax, ay]
        if p is not None:
            # p made orthogonal, with its image carried through the same combination
            q, aq = p.copy(), ap.copy()
            for _ in range(2):
                for b, ab in zip(dirs, images, strict=True):
                    c = np.vdot(b, q)
                    q, aq = q - c * b, aq - c * ab
                n = np.linalg.norm(q)
                if n < 1e-12:
                    break
                q, aq = q / n, aq / n
            if n >= 1e-12:
                dirs.append(q)
                images.append(aq)
        small = np.array([[np.vdot(a, b) for b in images] for a in dirs])
        c = np.linalg.eigh((small + small.conj().T) / 2)[1][:, 0]
        p = sum(c[k] * dirs[k] for k in range(1, len(dirs)))
        ap = sum(c[k] * images[k] for k in range(1, len(dirs)))
        x, ax = c[0] * x + p, c[0] * ax + ap
        norm = np.linalg.norm(x)
        x, ax = x / norm, ax / norm
    return theta, x, history


def lowest_of_matrix(matrix: np.ndarray, start: int = 0, orth: Sequence[np.ndarray] = (), maxiter: int = 1000, tol: float | None = None) -> tuple[float, np.ndarray, int]:
    """(energy, vector, iterations) of a dense Hermitian matrix, from a basis state."""
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
        raise ValueError("a square matrix is needed")
    energy, vector, history = lowest(lambda v: matrix @ v, np.eye(len(matrix), dtype=matrix.dtype)[start], orth, maxiter, tol)
    return energy, vector, history[-1][0]


SOLVED = "energy double, iterations int, residual double, history array<struct<i:int,energy:double,residual:double>>, vector array<struct<s:long,re:double,im:double>>"


def solve_each(matrices: DataFrame, key: str, key_type: str = "long", start: str = "start", levels: int = 1, maxiter: int = 1000, tol: float | None = None) -> DataFrame:
    """For each ``key`` the ``levels`` lowest eigenpairs of its matrix (key, r, c, re, im, start), one row a level.

    ``start`` is the state to start from; excited states are found by projecting the lower ones out.
    """
    ship(matrices.sparkSession)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        states = np.unique(np.concatenate([rows["r"].to_numpy(), rows["c"].to_numpy()]))
        r, c = np.searchsorted(states, rows["r"].to_numpy()), np.searchsorted(states, rows["c"].to_numpy())
        re, im = rows["re"].to_numpy(), rows["im"].to_numpy()
        real = not np.any(im)

        def product(v: np.ndarray) -> np.ndarray:
            if real and not np.iscomplexobj(v):
                return np.bincount(r, re * v[c], states.size)
            w = (re + 1j * im) * v[c]
            return np.bincount(r, w.real, states.size) + 1j * np.bincount(r, w.imag, states.size)

        found, out = [], []
        rng = np.random.default_rng(7)
        for level in range(min(levels, states.size)):
            x0 = np.zeros(states.size, float if real else complex)
            x0[np.searchsorted(states, int(rows[start].iloc[0]))] = 1
            if level:
                x0 = x0 + rng.standard_normal(states.size)
            e, v, history = lowest(product, x0, found, maxiter, tol)
            found.append(v)
            out.append((rows[key].iloc[0], level, e, history[-1][0], history[-1][2], [{"i": a, "energy": b, "residual": g} for a, b, g in history], [{"s": int(s), "re": float(np.real(a)), "im": float(np.imag(a))} for s, a in zip(states, v, strict=True)]))
        return pd.DataFrame(out, columns=[key, "level", "energy", "iterations", "residual", "history", "vector"])

    return matrices.groupBy(key).applyInPandas(work, f"{key} {key_type}, level int, {SOLVED}")


def ground_state(matrix: DataFrame | Callable[[DataFrame], DataFrame], start: DataFrame, maxiter: int = 1000, tol: float = 1e-12) -> tuple[float, DataFrame, int]:
    """(energy, vector (s, re, im), iterations) with everything of the size of a vector left distributed.

    ``matrix`` is a table (r, c, re, im) or a function from vector to vector. Each iteration is written
    to the shared folder, so a lost executor costs at most one.
    """
    product = matrix if callable(matrix) else lambda v: subspace.apply_coo(matrix, v)
    pair = lambda df, a: df.select("s", F.col("re").alias(f"{a}_re"), F.col("im").alias(f"{a}_im"))
    names = ("x", "ax", "p", "ap")
    zero = F.lit(0.0)
    norm = math.sqrt(start.agg(F.sum(F.expr("re * re + im * im"))).first()[0])
    x = saved(start.select("s", (F.col("re") / norm).alias("re"), (F.col("im") / norm).alias("im")), "x")
    state = pair(x, "x").join(pair(product(x), "ax"), "s", "full").select("s", *[F.coalesce(f"{a}_{b}", zero).alias(f"{a}_{b}") for a in ("x", "ax") for b in ("re", "im")], *[zero.alias(f"{a}_{b}") for a in ("p", "ap") for b in ("re", "im")])
    state, theta, iteration = saved(state, "state"), 0.0, 0
    for iteration in range(maxiter + 1):
        theta, size = state.agg(F.sum(F.expr("x_re * ax_re + x_im * ax_im")), F.sqrt(F.sum(F.expr("ax_re * ax_re + ax_im * ax_im")))).first()
        r = state.select("*", *[(F.col(f"ax_{b}") - theta * F.col(f"x_{b}")).alias(f"r_{b}") for b in ("re", "im")])
        left = math.sqrt(max(r.agg(F.sum(F.expr("r_re * r_re + r_im * r_im"))).first()[0], 0.0))
        if left <= tol * (size + abs(theta)) or iteration == maxiter:
            break
        r = r.select(*state.columns, *[(F.col(f"r_{b}") / left).alias(f"r_{b}") for b in ("re", "im")])
        image = pair(product(r.select("s", F.col("r_re").alias("re"), F.col("r_im").alias("im"))), "ar")
        full = r.join(image, "s", "full")
        full = saved(full.select("s", *[F.coalesce(c, zero).alias(c) for c in full.columns if c != "s"]), "directions")
        dirs = (("x", "ax"), ("r", "ar"), ("p", "ap"))
        dot = lambda a, b: (F.sum(F.expr(f"{a}_re * {b}_re + {a}_im * {b}_im")), F.sum(F.expr(f"{a}_re * {b}_im - {a}_im * {b}_re")))
        sums = [c for a, _ in dirs for b, ab in dirs for d in (b, ab) for c in dot(a, d)]
        got = np.array(full.agg(*[c.alias(f"_{i}") for i, c in enumerate(sums)]).first(), float).reshape(3, 3, 2, 2)
        gram, small = got[:, :, 0, 0] + 1j * got[:, :, 0, 1], got[:, :, 1, 0] + 1j * got[:, :, 1, 1]
        values, u = np.linalg.eigh((gram + gram.conj().T) / 2)
        ok = values > 1e-12 * values.max()  # directions that add nothing go
        t = u[:, ok] / np.sqrt(values[ok])
        c = t @ np.linalg.eigh(t.conj().T @ ((small + small.conj().T) / 2) @ t)[1][:, 0]

        def mixed(parts: Sequence[str], c=c) -> list:
            terms = list(zip(c[3 - len(parts) :], parts, strict=True))
            re = sum((F.lit(float(k.real)) * F.col(f"{a}_re") - F.lit(float(k.imag)) * F.col(f"{a}_im") for k, a in terms), zero)
            im = sum((F.lit(float(k.real)) * F.col(f"{a}_im") + F.lit(float(k.imag)) * F.col(f"{a}_re") for k, a in terms), zero)
            return [re, im]

        new = [*mixed(("x", "r", "p")), *mixed(("ax", "ar", "ap")), *mixed(("r", "p")), *mixed(("ar", "ap"))]
        before, state = state, saved(full.select("s", *[e.alias(f"{a}_{b}") for e, (a, b) in zip(new, [(a, b) for a in names for b in ("re", "im")], strict=True)]), "state")
        forget(before, full)
    return theta, state.select("s", F.col("x_re").alias("re"), F.col("x_im").alias("im")), iteration


def eigenvalue_2x2(a: str, d: str, b_re: str, b_im: str):
    """The lower eigenvalue of [[a, b], [b*, d]], stable for diagonal matrices."""
    return F.expr(f"({a} + {d}) / 2 - sqrt(pow(({a} - {d}) / 2, 2) + {b_re} * {b_re} + {b_im} * {b_im})")


def eigenvalue_3x3(a: str, b: str, c: str, d: str, e: str, f: str, d_im: str = "0e0", e_im: str = "0e0", f_im: str = "0e0"):
    """The lowest eigenvalue of the Hermitian [[a, d, e], [d*, b, f], [e*, f*, c]] by the cosine form of Cardano's solution."""
    q = f"(({a} + {b} + {c}) / 3)"
    dd, ee, ff = (f"({x} * {x} + {y} * {y})" for x, y in ((d, d_im), (e, e_im), (f, f_im)))
    p = f"sqrt((pow({a} - {q}, 2) + pow({b} - {q}, 2) + pow({c} - {q}, 2) + 2 * ({dd} + {ee} + {ff})) / 6)"
    around = f"({e} * ({d} * {f} - {d_im} * {f_im}) + {e_im} * ({d} * {f_im} + {d_im} * {f}))"  # real part of d f e*
    det = f"(({a} - {q}) * ({b} - {q}) * ({c} - {q}) + 2 * {around} - ({a} - {q}) * {ff} - ({b} - {q}) * {ee} - ({c} - {q}) * {dd})"
    angle = f"acos(greatest(-1e0, least(1e0, {det} / (2 * pow({p}, 3))))) / 3"
    return F.expr(f"case when {p} = 0 then {q} else {q} + 2 * {p} * cos({angle} + 2 * pi() / 3) end")


def _unit(parts: list[tuple[str, str]]) -> str:
    """An array of (re, im), of unit length; the first basis vector if there is nothing to scale."""
    size = "sqrt(" + " + ".join(f"({re}) * ({re}) + ({im}) * ({im})" for re, im in parts) + ")"
    first = [("1e0" if i == 0 else "0e0", "0e0") for i in range(len(parts))]
    shown = lambda ps, scale: "array(" + ", ".join(f"named_struct('re', ({re}) / {scale}, 'im', ({im}) / {scale})" for re, im in ps) + ")"
    return f"case when {size} = 0 then {shown(first, '1e0')} else {shown(parts, size)} end"


def _norm2(parts: list[tuple[str, str]]) -> str:
    return "(" + " + ".join(f"({re}) * ({re}) + ({im}) * ({im})" for re, im in parts) + ")"


def eigenvector_2x2(a: str, d: str, b_re: str, b_im: str, value: str):
    """A unit eigenvector (array of re, im) of [[a, b], [b*, d]] to the eigenvalue in the column ``value``: of the two rows that it is orthogonal to, the longer one gives it."""
    upper, lower = [(b_re, b_im), (f"{value} - {a}", "0e0")], [(f"{value} - {d}", "0e0"), (b_re, f"-{b_im}")]
    return F.expr(f"case when {_norm2(upper)} >= {_norm2(lower)} then {_unit(upper)} else {_unit(lower)} end")


def eigenvector_3x3(a: str, b: str, c: str, d: str, e: str, f: str, value: str, d_im: str = "0e0", e_im: str = "0e0", f_im: str = "0e0"):
    """A unit eigenvector (array of re, im) of the matrix of ``eigenvalue_3x3`` to the eigenvalue in the column ``value``.

    It is the longest cross product of two rows of M - value. Where these vanish beside the matrix, as for a double
    eigenvalue, any vector orthogonal to the longest row will do.
    """
    rows = [[(f"{a} - {value}", "0e0"), (d, d_im), (e, e_im)], [(d, f"-{d_im}"), (f"{b} - {value}", "0e0"), (f, f_im)], [(e, f"-{e_im}"), (f, f"-{f_im}"), (f"{c} - {value}", "0e0")]]
    times = lambda p, q: (f"(({p[0]}) * ({q[0]}) - ({p[1]}) * ({q[1]}))", f"(({p[0]}) * ({q[1]}) + ({p[1]}) * ({q[0]}))")
    minus = lambda p, q: (f"({p[0]} - {q[0]})", f"({p[1]} - {q[1]})")
    cross = lambda u, v: [minus(times(u[i], v[j]), times(u[j], v[i])) for i, j in ((1, 2), (2, 0), (0, 1))]
    crossed = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    # orthogonal to a row: its two longest places exchanged
    flat = [[r[1], (f"-({r[0][0]})", f"-({r[0][1]})"), ("0e0", "0e0")] if i < 2 else [("0e0", "0e0"), r[2], (f"-({r[1][0]})", f"-({r[1][1]})")] for i, r in enumerate(rows)]
    longest = lambda options, by: "case " + " ".join(f"when {by[i]} >= greatest({', '.join(by)}) then {_unit(o)}" for i, o in enumerate(options)) + " end"
    sizes, lengths = [_norm2(x) for x in crossed], [_norm2(r) for r in rows]
    return F.expr(f"case when greatest({', '.join(sizes)}) > 1e-20 * pow(greatest({', '.join(lengths)}), 2) then {longest(crossed, sizes)} else {longest(flat, lengths)} end")


@dataclass(frozen=True)
class SQDOptions:
    """cache_strategy (x, z): what is kept between distributed products (0 nothing, 1 look-ups or signs, 2 diagonals); a matrix that surely fits a worker is solved there unless nothing is to be kept."""

    return_eigvec: bool = True
    cache_strategy: tuple[int, int] = (1, 0)
    maxiter: int = 1000
    tol: float | None = None

    def __post_init__(self):
        if self.cache_strategy not in {(x, z) for x in (0, 1) for z in (0, 1, 2)}:
            raise ValueError(f"unknown cache strategy {self.cache_strategy}")


def sqd(terms: DataFrame, states: DataFrame, options: SQDOptions | None = None):
    """Lowest energy of the Hamiltonian projected on the distinct states, or (energy, vector (s, re, im), states).

    Starts from the state of least diagonal entry, so it finds the ground state of what is connected to it.
    """
    options = options or SQDOptions()
    spark: SparkSession = states.sparkSession
    known = saved(subspace.distinct_states(states), "states")
    first = subspace.start_state(known, terms).first()
    if first is None or first["s"] is None:
        raise ValueError("no states")
    start = int(first["s"])
    # every mask gives a state one entry at most
    if options.cache_strategy != (0, 0) and known.count() * terms.select("x").distinct().count() <= LOCAL_ENTRIES:
        one = subspace.hproj(known, terms).select(F.lit(0).cast("long").alias("ham_id"), "*", F.lit(start).alias("start"))
        solved = saved(solve_each(one, "ham_id", maxiter=options.maxiter, tol=options.tol).select("energy", "vector"), "solved")
        row = solved.select("energy").first()
        energy = row["energy"] if row else 0.0
        # the vector stays on the executors
        vector = solved.select(F.inline("vector")).select("s", "re", "im") if row else spark.createDataFrame([(start, 1.0, 0.0)], "s long, re double, im double")
    else:
        product = subspace.cached_product(known, terms, options.cache_strategy)
        energy, vector, _ = ground_state(product, spark.createDataFrame([(start, 1.0, 0.0)], "s long, re double, im double"), options.maxiter, options.tol or 1e-12)
    return (energy, vector, known) if options.return_eigvec else energy
