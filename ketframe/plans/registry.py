"""Registered queries (spark, folder) -> DataFrame and their SQL twins, under one name each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.functions.complexes import near_integer, phase_0_2pi, rounded, wrap
from ketframe.operators import basis, circuit, matfun, pauli_sum, pretty, solver, subspace
from ketframe.plans import sql
from ketframe.sources import fixtures
from ketframe.session import saved

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def _query(twin: str | None = None, name: str | None = None):
    def add(f):
        _queries[name or f.__name__] = f
        if twin:
            _oracle[name or f.__name__] = twin
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _real(*names: str) -> list[Column]:
    return [rounded(F.col(n)).alias(n) for n in names]


B = "CAST({} AS BIGINT) AS {}".format
R = lambda e, n: f"{sql.r6(e)} AS {n}"
_RE_IM = f"{R('re', 're')}, {R('im', 'im')}"
_PI = math.pi


# --- Pauli sums -----------------------------------------------------------------------------------


@_query(f"SELECT pauli, {B('x', 'x')}, {B('z', 'z')}, re FROM ({sql.PAULI_STRINGS}) WHERE re <> 0")
def pauli_parse(spark, d):
    return pauli_sum.parse(fixtures.pauli_strings_part(spark, d)).select("pauli", "x", "z", "re")


@_query(f"SELECT {B('x', 'x')}, {B('z', 'z')}, CASE bit_count(x & z) % 4 WHEN 0 THEN re WHEN 2 THEN -re ELSE 0e0 END + 0e0 AS re, CASE bit_count(x & z) % 4 WHEN 1 THEN -re WHEN 3 THEN re ELSE 0e0 END + 0e0 AS im FROM ({sql.PAULI_STRINGS}) WHERE re <> 0")
def pauli_phase(spark, d):
    return pauli_sum.fold_phase(pauli_sum.parse(fixtures.pauli_strings_part(spark, d))).select("x", "z", "re", "im")


@_query(f"SELECT pauli, sum(re) AS re FROM ({sql.PAULI_STRINGS}) GROUP BY 1 HAVING sum(re) <> 0")
def pauli_consolidate(spark, d):
    return pauli_sum.consolidate(fixtures.pauli_strings_part(spark, d)).select("pauli", "re")


@_query(f"SELECT {B('x', 'x')}, {B('count(*)', 'n_terms')}, string_agg(CAST(z AS VARCHAR), ',' ORDER BY z) AS zs, sum(re) AS re, sum(im) AS im FROM (SELECT x, z, sum(re) AS re, sum(im) AS im FROM ({sql.TERMS12}) GROUP BY 1, 2) GROUP BY 1")
def pauli_group_by_x(spark, d):
    total = lambda p: F.aggregate("terms", F.lit(0.0), lambda a, t: a + t[p]).alias(p)
    return pauli_sum.group_by_x(fixtures.terms_part12(spark, d)).select("x", "n_terms", F.array_join(F.col("terms.z").cast("array<string>"), ",").alias("zs"), total("re"), total("im"))


_T6 = f"SELECT x % 64 AS x, z % 64 AS z, re, im FROM ({sql.TERMS12})"


@_query(f"SELECT {B('v.vec_id', 'vec_id')}, {B('xor(v.i, t.x)', 'i')}, {R(f'sum({sql.sign("t.z", "xor(v.i, t.x)")} * t.re * v.re)', 're')}, {R(f'sum({sql.sign("t.z", "xor(v.i, t.x)")} * t.im * v.re)', 'im')} FROM ({sql.VECTORS}) v, ({_T6}) t GROUP BY 1, 2")
def pauli_matmul(spark, d):
    t = fixtures.terms_part12(spark, d).select((F.col("x") % 64).alias("x"), (F.col("z") % 64).alias("z"), "re", "im")
    return pauli_sum.matmul(t, fixtures.vectors_emb(spark, d), ["vec_id"]).select("vec_id", "i", *_real("re", "im"))


@_query(f"SELECT {B('x', 'x')}, {B('z', 'z')}, re FROM ({sql.tfim(8, 2.0)})")
def tfim_terms(spark, d):
    return fixtures.terms_tfim(spark, 8, 2.0).select("x", "z", "re")


def _counted(key: str, of: str) -> str:
    return f"SELECT {key} AS s, CAST({of} AS DOUBLE) AS re FROM lineitem GROUP BY 1"


#: two vectors over all line items: how many there are of a state, and the sum of their numbers
_V0, _V1 = "count(*)", "sum(l_linenumber)"


def _vector(spark, d, key: str, of: str) -> DataFrame:
    return fixtures.table(spark, d, "lineitem").groupBy(F.expr(key).alias("s")).agg(F.expr(of).cast("double").alias("re"), F.lit(0.0).alias("im"))


@_query(f"SELECT {B('xor(v.s, t.x)', 'i')}, {R(f'sum({sql.sign("t.z", "xor(v.s, t.x)")} * t.re * v.re)', 're')} FROM ({_counted('l_partkey', _V0)}) v, ({sql.tfim(20, 1.5)}) t GROUP BY 1")
def tfim_matvec(spark, d):
    v = _vector(spark, d, "l_partkey", _V0).withColumnRenamed("s", "i")
    return pauli_sum.matmul(fixtures.terms_tfim(spark, 20, 1.5), v).select("i", *_real("re"))


# --- states and look-ups ----------------------------------------------------------------------------


@_query(f"SELECT {B('s', 's')} FROM ({sql.STATES})")
def states_distinct(spark, d):
    return subspace.distinct_states(fixtures.states_orders(spark, d))


@_query(f"SELECT {B('s', 's')}, {B('row_number() OVER (ORDER BY s) - 1', 'idx')} FROM ({sql.STATES})")
def state_index(spark, d):
    return subspace.state_index(fixtures.states_orders(spark, d)).select(*_long("s", "idx"))


@_query(f"SELECT {B('s', 's')}, lpad(bin(s), 40, '0') AS bits FROM ({sql.STATES})")
def states_unpack(spark, d):
    return subspace.unpack(subspace.distinct_states(fixtures.states_orders(spark, d)), 40).select("s", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"))


@_query(f"SELECT {B('s', 's')} FROM ({sql.STATES})")
def states_pack(spark, d):
    return subspace.pack(subspace.unpack(subspace.distinct_states(fixtures.states_orders(spark, d)), 40).drop("s"))


@_query(f"SELECT {B('a.s', 'dst')}, {B('coalesce(b.s, -1)', 'src')} FROM ({sql.STATES}) a LEFT JOIN ({sql.STATES}) b ON b.s = xor(a.s, 6)")
def xsource(spark, d):
    return subspace.xsource(subspace.distinct_states(fixtures.states_orders(spark, d)), 6).select("dst", F.coalesce("src", F.lit(-1).cast("long")).alias("src"))


_MASKS = f"SELECT DISTINCT x FROM ({sql.TERMS12})"


@_query(f"SELECT {B('t.x', 'x')}, {B('a.s', 'dst')}, {B('b.s', 'src')} FROM ({sql.STATES}) a, ({_MASKS}) t, ({sql.STATES}) b WHERE b.s = xor(a.s, t.x)")
def xsource_all(spark, d):
    return subspace.xsource_all(subspace.distinct_states(fixtures.states_orders(spark, d)), fixtures.terms_part12(spark, d)).select("x", "dst", "src")


@_query(f"SELECT {B('a.s', 's')} FROM ({sql.STATES}) a WHERE EXISTS (SELECT 1 FROM ({sql.STATES}) b WHERE b.s = xor(a.s, 6))")
def xsource_exists(spark, d):
    return subspace.xsource_exists(subspace.distinct_states(fixtures.states_orders(spark, d)), 6)


@_query(f"SELECT {B('s', 's')} FROM ({sql.STATES}) INTERSECT SELECT {B('xor(s, 6)', 's')} FROM ({sql.STATES})")
def states_intersect_shift(spark, d):
    return subspace.shift_intersect(fixtures.states_orders(spark, d), 6)


@_query(f"SELECT {B('t.z', 'z')}, {B('a.s', 's')}, {B(sql.sign('t.z', 'a.s'), 'sign')} FROM ({sql.STATES}) a, (SELECT DISTINCT z FROM ({sql.TERMS12})) t")
def diag_signs(spark, d):
    return subspace.diag_signs(subspace.distinct_states(fixtures.states_orders(spark, d)), fixtures.terms_part12(spark, d)).select(*_long("z", "s", "sign"))


_DIAG = f"SELECT t.x AS x, a.s AS s, sum(t.re * {sql.sign('t.z', 'a.s')}) + 0e0 AS re, sum(t.im * {sql.sign('t.z', 'a.s')}) + 0e0 AS im FROM ({sql.STATES}) a, ({sql.TERMS12}) t GROUP BY 1, 2"


@_query(f"SELECT {B('x', 'x')}, {B('s', 's')}, re, im FROM ({_DIAG})")
def group_diagonal(spark, d):
    return subspace.group_diagonal(subspace.distinct_states(fixtures.states_orders(spark, d)), fixtures.terms_part12(spark, d)).select("x", "s", *_real("re", "im"))


@_query(f"SELECT {B('s', 's')} FROM ({_DIAG}) WHERE x = 0 ORDER BY re, s LIMIT 1")
def argmin_diag(spark, d):
    return subspace.start_state(fixtures.states_orders(spark, d), fixtures.terms_part12(spark, d))


# --- the projected Hamiltonian --------------------------------------------------------------------


@_query(f"SELECT {B('r', 'r')}, {B('c', 'c')}, re + 0e0 AS re, im + 0e0 AS im FROM ({sql.hproj(sql.STATES, sql.TERMS12)})")
def hproj(spark, d):
    return subspace.hproj(fixtures.states_orders(spark, d), fixtures.terms_part12(spark, d)).select("r", "c", *_real("re", "im"))


_V12 = f"SELECT s, (s % 7 - 3) / 4e0 AS re FROM ({sql.STATES})"
_HV = f"SELECT {B('h.r', 's')}, {R('sum(h.re * v.re)', 're')}, {R('sum(h.im * v.re)', 'im')} FROM ({sql.hproj(sql.STATES, sql.TERMS12)}) h JOIN ({_V12}) v ON v.s = h.c GROUP BY 1"


def _v12(spark, d) -> DataFrame:
    return subspace.distinct_states(fixtures.states_orders(spark, d)).select("s", ((F.col("s") % 7 - 3) / 4.0).alias("re"), F.lit(0.0).alias("im"))


@_query(_HV)
def apply_h_coo(spark, d):
    h = subspace.hproj(fixtures.states_orders(spark, d), fixtures.terms_part12(spark, d))
    return subspace.apply_coo(h, _v12(spark, d)).select("s", *_real("re", "im"))


@_query(f"SELECT {B('xor(v.s, t.x)', 's')}, {R(f'sum({sql.sign("t.z", "xor(v.s, t.x)")} * t.re * v.re)', 're')}, {R(f'sum({sql.sign("t.z", "xor(v.s, t.x)")} * t.im * v.re)', 'im')} FROM ({_V12}) v, ({sql.TERMS12}) t WHERE xor(v.s, t.x) IN ({sql.STATES}) GROUP BY 1")
def apply_h(spark, d):
    return subspace.apply_h(fixtures.states_orders(spark, d), fixtures.terms_part12(spark, d), _v12(spark, d)).select("s", *_real("re", "im"))


# the same subspace over 72 qubits: the low six bits stay, the others move to bit 66 and up, so keys are two limbs
def _spread(column: str) -> Column:
    return F.array(F.shiftleft(F.shiftright(column, 6), 4), F.col(column).bitwiseAND(F.lit(63))).alias(column)


def _wide(spark, d) -> tuple[DataFrame, DataFrame]:
    return fixtures.states_orders(spark, d).select(_spread("s")), fixtures.terms_part12(spark, d).select(_spread("x"), _spread("z"), "re", "im")


_HALVES = lambda c: f"{B(f'({c} >> 6) << 4', f'{c}_high')}, {B(f'{c} & 63', f'{c}_low')}"


@_query(f"SELECT {_HALVES('r')}, {_HALVES('c')}, re + 0e0 AS re, im + 0e0 AS im FROM ({sql.hproj(sql.STATES, sql.TERMS12)})")
def hproj_limbs(spark, d):
    half = lambda c: [F.get(c, F.lit(0)).alias(f"{c}_high"), F.get(c, F.lit(1)).alias(f"{c}_low")]
    return subspace.hproj(*_wide(spark, d)).select(*half("r"), *half("c"), *_real("re", "im"))


@_query(f"SELECT {_HALVES('s')}, re, im FROM ({_HV})")
def apply_h_limbs(spark, d):
    states, terms = _wide(spark, d)
    out = subspace.apply_h(states, terms, _v12(spark, d).select(_spread("s"), "re", "im"))
    return out.select(F.get("s", F.lit(0)).alias("s_high"), F.get("s", F.lit(1)).alias("s_low"), *_real("re", "im"))


@_query(f"SELECT sum(a.re * b.re) AS re, 0e0 AS im FROM ({_counted('l_partkey', _V0)}) a JOIN ({_counted('l_partkey', _V1)}) b ON a.s = b.s")
def inner_product(spark, d):
    return subspace.inner_product(_vector(spark, d, "l_partkey", _V0), _vector(spark, d, "l_partkey", _V1))


_RING = "l_partkey % 256"
_W = f"SELECT 0 AS j, s, re FROM ({_counted(_RING, _V0)}) UNION ALL SELECT 1, s, re FROM ({_counted(_RING, _V1)})"


@_query(f"SELECT {B('a.j', 'j')}, {B('b.j', 'k')}, {R(f'sum(a.re * t.re * {sql.sign("t.z", "a.s")} * b.re)', 're')}, 0e0 AS im FROM ({_W}) a, ({sql.tfim(8, 1.0)}) t, ({_W}) b, (SELECT DISTINCT s FROM ({sql.RING8})) p, (SELECT DISTINCT s FROM ({sql.RING8})) q WHERE b.s = xor(a.s, t.x) AND p.s = a.s AND q.s = b.s GROUP BY 1, 2")
def rayleigh_matrix(spark, d):
    h = subspace.hproj(fixtures.states_ring8(spark, d), fixtures.terms_tfim(spark, 8, 1.0))
    w = _vector(spark, d, _RING, _V0).select(F.lit(0).alias("j"), "s", "re", "im").union(_vector(spark, d, _RING, _V1).select(F.lit(1), "s", "re", "im"))
    return subspace.rayleigh_matrix(h, w).select(*_long("j", "k"), *_real("re", "im"))


# --- eigensolver ----------------------------------------------------------------------------------


def _closed(n: int, h: str) -> str:
    return f"(SELECT -sum(sqrt(1 + {h} * {h} + 2 * {h} * cos((2 * m + 1) * pi() / {n}))) FROM range({n}) t(m))"


def _sweep(spark: SparkSession, states: DataFrame, n: int, fields: list[float]) -> DataFrame:
    """hx, r, c, re, im, start of the chain in several fields: the parts without and with the field are projected once."""
    one = saved(subspace.hproj(states, fixtures.terms_tfim(spark, n, 1.0)), "sweep")
    hx = F.explode(F.array(*map(F.lit, fields))).alias("hx")
    return one.select(hx, "*").select("hx", "r", "c", F.when(F.col("r") != F.col("c"), F.col("re") * F.col("hx")).otherwise(F.col("re")).alias("re"), "im", F.lit(0).cast("long").alias("start"))


@_query(f"SELECT {R(_closed(8, '1e0'), 'energy')}")
def ground_energy_tfim(spark, d):
    states = spark.range(256).select(F.col("id").alias("s"))
    return solver.solve_each(_sweep(spark, states, 8, [1.0]), "hx", "double").select(*_real("energy"))


@_query(f"SELECT CAST(hx AS DOUBLE) AS hx, {R(_closed(8, 'hx'), 'energy')} FROM (VALUES (0.5e0), (1e0), (1.5e0), (2e0)) f(hx)")
def tfim_sweep(spark, d):
    return solver.solve_each(_sweep(spark, fixtures.states_ring8(spark, d), 8, [0.5, 1.0, 1.5, 2.0]), "hx", "double").select("hx", *_real("energy"))


@_query(f"SELECT {R(_closed(8, '1e0'), 'energy')}")
def sqd_ground_energy(spark, d):
    energy = solver.sqd(fixtures.terms_tfim(spark, 8, 1.0), fixtures.states_ring8(spark, d), solver.SQDOptions(return_eigvec=False))
    return spark.createDataFrame([(energy,)], "energy double").select(*_real("energy"))


@_query(f"SELECT {R(_closed(6, '1e0'), 'energy')}")
def ground_energy_distributed(spark, d):
    states = spark.range(64).select(F.col("id").alias("s"))
    h = saved(subspace.hproj(states, fixtures.terms_tfim(spark, 6, 1.0)), "hproj")
    start = spark.createDataFrame([(0, 1.0, 0.0)], "s long, re double, im double")
    energy, _, _ = solver.ground_state(h, start, tol=1e-9)
    return spark.createDataFrame([(energy,)], "energy double").select(*_real("energy"))


# the chain's first excited state is the lowest one of odd parity: free fermions at momenta 2 pi m / n, those at 0 and pi signed
_ODD = "(SELECT -sum(CASE WHEN m = 0 THEN 1 + {0} WHEN m = 4 THEN {0} - 1 ELSE sqrt(1 + {0} * {0} + 2 * {0} * cos(2 * m * pi() / 8)) END) FROM range(8) t(m))".format


@_query(f"SELECT CAST(hx AS DOUBLE) AS hx, CAST(level AS BIGINT) AS level, {R(f'CASE WHEN level = 0 THEN {_closed(8, "hx")} ELSE {_ODD("hx")} + CASE WHEN hx > 1 THEN 2 * (hx - 1) ELSE 0 END END', 'energy')} FROM (VALUES (1e0), (2e0)) f(hx), range(2) l(level)")
def excited_tfim(spark, d):
    states = spark.range(256).select(F.col("id").alias("s"))
    return solver.solve_each(_sweep(spark, states, 8, [1.0, 2.0]), "hx", "double", levels=2).select("hx", *_long("level"), *_real("energy"))


@_query()
def locg_history(spark, d):
    states = spark.range(256).select(F.col("id").alias("s"))
    return solver.solve_each(_sweep(spark, states, 8, [1.0]), "hx", "double").select("hx", F.inline("history")).select("hx", *_long("i"), *_real("energy", "residual"))


def _tiles(spark, d, size: int) -> DataFrame:
    """vec_id, k and a, b, ...: each vector's 64 numbers in groups of so many, the last one going on at the front."""
    e = fixtures.table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit((64 - 1) // size))).alias("k"))
    return e.select("vec_id", *_long("k"), *[F.get("embedding", (F.col("k") * size + i) % 64).cast("double").alias(n) for i, n in enumerate("abcdefghi"[:size])])


def _tiled(size: int) -> str:
    parts = ", ".join(f"CAST(embedding[(k * {size} + {i}) % 64 + 1] AS DOUBLE) {n}" for i, n in enumerate("abcdefghi"[:size]))
    return f"SELECT vec_id, k, {parts} FROM embeddings, range({(64 - 1) // size + 1}) t(k)"


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('k', 'k')}, {R('(a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b + c * c)', 'value')} FROM ({_tiled(4)})")
def eigenpair_2x2(spark, d):
    return _tiles(spark, d, 4).select("vec_id", "k", rounded(solver.eigenvalue_2x2("a", "d", "b", "c")).alias("value"))


#: lowest eigenvalue by its defining property: the smallest root of the characteristic polynomial, by 80 bisections between Gershgorin's bound and the leading block's lower eigenvalue, which interlaces
def _lowest_root(source: str) -> str:
    """``source`` has vec_id, k and the real diagonal a, b, c and the complex d + ig, e + ih, f + ii above it."""
    return f"""WITH RECURSIVE m AS ({source}), p AS (
  SELECT vec_id, k, a + b + c AS t, a * b + a * c + b * c - (d * d + g * g) - (e * e + h * h) - (f * f + i * i) AS u,
    a * b * c + 2 * (e * (d * f - g * i) + h * (d * i + g * f)) - a * (f * f + i * i) - b * (e * e + h * h) - c * (d * d + g * g) AS v,
    least(a - sqrt(d * d + g * g) - sqrt(e * e + h * h), b - sqrt(d * d + g * g) - sqrt(f * f + i * i), c - sqrt(e * e + h * h) - sqrt(f * f + i * i)) - 1 AS lo, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + d * d + g * g) AS hi FROM m),
s AS (SELECT 0 AS n, vec_id, k, t, u, v, lo, hi FROM p UNION ALL
  SELECT n + 1, vec_id, k, t, u, v, CASE WHEN q > 0 THEN lo ELSE mid END, CASE WHEN q > 0 THEN mid ELSE hi END FROM (
    SELECT *, CASE WHEN mid * mid * mid - t * mid * mid + u * mid - v >= 0 THEN 1 ELSE -1 END AS q FROM (SELECT *, (lo + hi) / 2 AS mid FROM s)) WHERE n < 80)
SELECT {B('vec_id', 'vec_id')}, {B('k', 'k')}, {R('hi', 'value')} FROM s WHERE n = 80"""


@_query(_lowest_root(f"SELECT *, 0e0 AS g, 0e0 AS h, 0e0 AS i FROM ({_tiled(6)})"))
def eigenpair_3x3(spark, d):
    return _tiles(spark, d, 6).select("vec_id", "k", rounded(solver.eigenvalue_3x3(*"abcdef")).alias("value"))


@_query(_lowest_root(_tiled(9)))
def eigenpair_3x3_complex(spark, d):
    return _tiles(spark, d, 9).select("vec_id", "k", rounded(solver.eigenvalue_3x3(*"abcdefghi")).alias("value"))


# --- generalised Pauli basis ----------------------------------------------------------------------


@_query(f"SELECT {B('k', 'k')}, {B('r', 'r')}, {B('c', 'c')}, {_RE_IM} FROM ({sql.basis(8)})")
def pauli_basis(spark, d):
    return basis.pauli_matrices(spark, 8).select(*_long("k", "r", "c"), *_real("re", "im"))


@_query(f"SELECT {B('k', 'k')}, {B('r', 'r')}, {B('c', 'c')}, {_RE_IM} FROM ({sql.product(2, 3)})")
def pauli_products(spark, d):
    return basis.paulis(spark, (2, 3)).select(*_long("k", "r", "c"), *_real("re", "im"))


_SYM = "SELECT k, CASE WHEN count(*) FILTER (r <> c) = 0 THEN 0 WHEN max(abs(im)) > 0 THEN -1 ELSE 1 END AS s FROM ({}) GROUP BY k".format


@_query(f"SELECT {B('p.k * 4 + q.k', 'k')}, {B('CASE WHEN p.s * q.s <> 0 THEN p.s * q.s ELSE p.s + q.s END', 'sym')} FROM ({_SYM(sql.basis(3))}) p, ({_SYM(sql.basis(2))}) q")
def pauli_symmetry(spark, d):
    return basis.symmetry(spark, (3, 2)).select(*_long("k", "sym"))


@_query("SELECT CAST(p * 9 + q AS BIGINT) AS k, '\\frac{' || substr('IXYZ', CAST(p + 1 AS INT), 1) || '{\\lambda_{' || q || '}}}{2}' AS label FROM range(4) a(p), range(9) b(q)")
def pauli_labels(spark, d):
    return basis.labels(spark, (2, 3)).select(*_long("k"), "label")


@_query(f"SELECT CAST(k AS BIGINT) AS k, {R('CASE WHEN k = 0 THEN sqrt(5e0 / 8) WHEN k IN (35, 48, 63) THEN sqrt(5e0 / (sqrt(k + 1) * (sqrt(k + 1) - 1))) ELSE 0e0 END', 'value')} FROM range(64) t(k)")
def l0_projector(spark, d):
    return basis.l0_projector(spark, 5, 8).select(*_long("k"), *_real("value"))


def _components(matrices: str, basis_sql: str, scale: str) -> str:
    return f"SELECT {B('m.mat_id', 'mat_id')}, {B('b.k', 'k')}, {R(f'sum(b.re * m.re) * {scale}', 're')}, {R(f'sum(b.im * m.re) * {scale}', 'im')} FROM ({matrices}) m JOIN ({basis_sql}) b ON b.r = m.c AND b.c = m.r GROUP BY 1, 2"


@_query(_components(sql.MATRICES, sql.basis(8), "0.5e0"))
def pauli_components(spark, d):
    return basis.components(fixtures.matrices_emb(spark, d), 8).select(*_long("mat_id", "k"), *_real("re", "im"))


@_query(_components(sql.MATRICES, sql.product(2, 4), "1e0"))
def pauli_components_2x4(spark, d):
    return basis.components(fixtures.matrices_emb(spark, d), (2, 4)).select(*_long("mat_id", "k"), *_real("re", "im"))


@_query(f"SELECT {B('mat_id', 'mat_id')}, {B('r', 'r')}, {B('c', 'c')}, {R('re', 're')}, 0e0 AS im FROM ({sql.MATRICES})")
def pauli_compose(spark, d):
    return basis.compose(basis.components(fixtures.matrices_emb(spark, d), (2, 4)), (2, 4)).select(*_long("mat_id", "r", "c"), *_real("re", "im"))


# components of the leading block are the truncated components
@_query(_components(f"SELECT * FROM ({sql.MATRICES}) WHERE r < 5 AND c < 5", sql.basis(5), "0.5e0"))
def pauli_truncate(spark, d):
    parts = basis.components(fixtures.matrices_emb(spark, d), 8)
    return basis.truncate(parts, 8, 5).select(*_long("mat_id", "k"), *_real("re", "im"))


@_query(_components(f"SELECT mat_id, CAST(r // 4 * 3 + r % 4 AS INT) AS r, CAST(c // 4 * 3 + c % 4 AS INT) AS c, re FROM ({sql.MATRICES}) WHERE r % 4 < 3 AND c % 4 < 3", sql.product(2, 3), "1e0"))
def pauli_truncate_2x4(spark, d):
    parts = basis.components(fixtures.matrices_emb(spark, d), (2, 4))
    return basis.truncate(parts, (2, 4), (2, 3)).select(*_long("mat_id", "k"), *_real("re", "im"))


# --- circuits -------------------------------------------------------------------------------------

_NAME = "CASE event_type WHEN 'click' THEN 'rx' WHEN 'error' THEN 'ry' WHEN 'purchase' THEN 'rz' WHEN 'signup' THEN 'rzz' ELSE 'cz' END"
_GATES = f"SELECT user_id AS circ_id, event_id AS g, {_NAME} AS name, user_id % 6 AS q0, (user_id % 6 + 1) % 6 AS q1, coalesce(value, 0) / 100 AS angle FROM events"
_TOTALS = f"""SELECT 0 AS circ_id, list_position(['rx', 'ry', 'rz', 'rzz', 'cz'], name) * 6 + q0 AS g, name, q0, (q0 + 1) % 6 AS q1, cents / 1e4 AS angle FROM (
  SELECT {_NAME} AS name, user_id % 6 AS q0, CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) AS BIGINT) % 100000 AS cents FROM events GROUP BY 1, 2)"""


def _flat(gates: str) -> str:
    return f"""SELECT circ_id, g * 3 AS g, name, CASE WHEN name = 'rzz' THEN (1::BIGINT << q0) + (1::BIGINT << q1) ELSE 1::BIGINT << q0 END AS mask, angle FROM ({gates}) WHERE name <> 'cz'
UNION ALL SELECT circ_id, g * 3, 'rzz', (1::BIGINT << q0) + (1::BIGINT << q1), pi() / 2 FROM ({gates}) WHERE name = 'cz'
UNION ALL SELECT circ_id, g * 3 + 1, 'rz', 1::BIGINT << q0, -pi() / 2 FROM ({gates}) WHERE name = 'cz'
UNION ALL SELECT circ_id, g * 3 + 2, 'rz', 1::BIGINT << q1, -pi() / 2 FROM ({gates}) WHERE name = 'cz'"""


def _masks(gates: str) -> str:
    return f"SELECT circ_id, g, CASE WHEN name IN ('rx', 'ry') THEN mask ELSE 0 END AS x, CASE WHEN name = 'rx' THEN 0 ELSE mask END AS z, cos(-angle * 0.5) AS cos, sin(-angle * 0.5) AS sin FROM ({_flat(gates)})"


@_query(f"SELECT {B('circ_id', 'circ_id')}, {B('g', 'g')}, {B('x', 'x')}, {B('z', 'z')}, {R('cos', 'cos')}, {R('sin', 'sin')} FROM ({_masks(_GATES)})")
def circuit_compile(spark, d):
    return circuit.compile_gates(fixtures.gates_events(spark, d)).select(*_long("circ_id", "g", "x", "z"), *_real("cos", "sin"))


@_query(f"SELECT {B('circ_id', 'circ_id')}, {B('g', 'g')}, name, {B('mask', 'mask')}, {R('angle', 'angle')} FROM ({_flat(_GATES)})")
def circuit_cz_decompose(spark, d):
    mask = F.aggregate("qubits", F.lit(0).cast("long"), lambda m, q: m + F.call_function("shiftleft", F.lit(1).cast("long"), q))
    return circuit.decompose_cz(fixtures.gates_events(spark, d)).select(*_long("circ_id", "g"), "name", mask.alias("mask"), *_real("angle"))


@_query("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i = 5 THEN 1e0 ELSE 0e0 END AS re FROM range(64) t(i)")
def onehot_state(spark, d):
    return circuit.one_hot(spark, 6, 5).select("i", "re")


def _one_gate(name: str, qubits: list[int], angle: float | None) -> Callable:
    def run(spark, d):
        out = fixtures.vectors_emb(spark, d)
        gates = circuit.gates_from_list(spark, [(name, qubits, angle) if angle is not None else (name, qubits)])
        for g in circuit.compile_gates(gates).orderBy("g").collect():  # at most three
            out = circuit.apply_gate(out, g["x"], g["z"], g["cos"], g["sin"], ["vec_id"])
        return out.select("vec_id", "i", *_real("re", "im"))

    return run


for _name, _x, _z in (("x", 4, 0), ("y", 4, 4), ("z", 0, 4)):
    _query(sql.gate(_x, _z, "0e0", "-1e0"), f"gate_{_name}")(_one_gate(_name, [2], None))
for _name, _q, _x, _z in (("rx", [2], 4, 0), ("ry", [2], 4, 4), ("rz", [2], 0, 4), ("rzz", [1, 3], 0, 10)):
    _query(sql.gate(_x, _z, "cos(-0.35e0)", "sin(-0.35e0)"), f"gate_{_name}")(_one_gate(_name, _q, 0.7))
_CZ = f"({sql.sign('2', 'i')} + {sql.sign('8', 'i')} - {sql.sign('10', 'i')}) * pi() / 4"
_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {R(f'cos({_CZ}) * re', 're')}, {R(f'sin({_CZ}) * re', 'im')} FROM ({sql.VECTORS})", "gate_cz")(_one_gate("cz", [1, 3], None))


@_query(sql.gate(38, 52, "cos(-0.6e0)", "sin(-0.6e0)"))
def gate_apply(spark, d):
    return circuit.apply_gate(fixtures.vectors_emb(spark, d), 38, 52, math.cos(-0.6), math.sin(-0.6), ["vec_id"]).select("vec_id", "i", *_real("re", "im"))


@_query("SELECT CAST(2 AS BIGINT) AS nonzero")
def ghz_nonzero(spark, d):
    return circuit.svsim(fixtures.gates_ghz(spark, 5)).agg(F.count_if(F.hypot("re", "im") > 1e-9).alias("nonzero"))


@_query("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i IN (0, 31) THEN 0.5e0 ELSE 0e0 END AS prob FROM range(32) t(i)")
def svsim_ghz(spark, d):
    return circuit.svsim(fixtures.gates_ghz(spark, 5)).select("i", rounded(F.expr("re * re + im * im")).alias("prob"))


def _run_gates(gates: str) -> str:
    """circ_id, i, re, im: the six-qubit state of each circuit, one gate a recursion over the whole list of amplitudes."""
    mate, odd = "xor(i, x) + 1", "(1 - 2 * (bit_count(z & i) % 2)) * sin"
    t_re, t_im = (f"CASE bit_count(x & z) % 4 WHEN 0 THEN {a}[{mate}] WHEN 1 THEN {b}[{mate}] WHEN 2 THEN -{a}[{mate}] ELSE -{b}[{mate}] END" for a, b in (("re", "im"), ("im", "-re")))
    t_im = f"CASE bit_count(x & z) % 4 WHEN 0 THEN im[{mate}] WHEN 1 THEN -re[{mate}] WHEN 2 THEN -im[{mate}] ELSE re[{mate}] END"
    return f"""WITH RECURSIVE gates AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY circ_id ORDER BY g) AS n, count(*) OVER (PARTITION BY circ_id) AS last FROM ({_masks(gates)})),
run AS (SELECT circ_id, 0::BIGINT AS n, list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 1e0 ELSE 0e0 END) AS re, list_transform(range(64), lambda i: 0e0) AS im FROM (SELECT DISTINCT circ_id FROM gates) UNION ALL
  SELECT circ_id, n, list_transform(range(64), lambda i: cos * re[i + 1] - {odd} * ({t_im})), list_transform(range(64), lambda i: cos * im[i + 1] + {odd} * ({t_re}))
  FROM (SELECT r.circ_id, g.n, g.x, g.z, g.cos, g.sin, r.re, r.im FROM run r JOIN gates g ON g.circ_id = r.circ_id AND g.n = r.n + 1))
SELECT circ_id, unnest(range(64)) AS i, unnest(re) AS re, unnest(im) AS im FROM run JOIN (SELECT DISTINCT circ_id, last FROM gates) USING (circ_id) WHERE n = last"""


def _event_states(spark, d) -> DataFrame:
    """circ_id, i, re, im: every user's circuit from |0>."""
    gates = fixtures.gates_events(spark, d)
    zero = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.when(i == 0, 1.0).otherwise(0.0).alias("re"), F.lit(0.0).alias("im")))
    done = circuit.simulate_arrays(gates, gates.select("circ_id").distinct().select("circ_id", zero.alias("amps")))
    return done.select("circ_id", F.posexplode("amps").alias("i", "v")).select("circ_id", F.col("i").cast("long").alias("i"), "v.re", "v.im")


@_query("SELECT user_id AS circ_id, 1e0 AS norm, CAST(64 AS BIGINT) AS entries FROM events GROUP BY 1")
def svsim_norm(spark, d):
    return _event_states(spark, d).groupBy("circ_id").agg(rounded(F.sum(F.expr("re * re + im * im"))).alias("norm"), F.count(F.lit(1)).alias("entries"))


@_query(f"SELECT {B('circ_id', 'circ_id')}, {B('i', 'i')}, {_RE_IM} FROM ({_run_gates(_GATES)})")
def svsim_events(spark, d):
    return _event_states(spark, d).select("circ_id", "i", *_real("re", "im"))


@_query(f"SELECT {B('i', 'i')}, {_RE_IM} FROM ({_run_gates(_TOTALS)})")
def svsim_rows_events(spark, d):
    return circuit.simulate_rows(fixtures.gates_totals(spark, d), circuit.one_hot(spark, 6)).select("i", *_real("re", "im"))


# --- matrix functions -----------------------------------------------------------------------------

_HERM = f"SELECT a.mat_id, a.r, a.c, (a.re + b.re) / 2 AS re FROM ({sql.MATRICES}) a JOIN ({sql.MATRICES}) b ON a.mat_id = b.mat_id AND a.r = b.c AND a.c = b.r"


# f(M) for f(l) = l^2 is M M
@_query(f"SELECT {B('a.mat_id', 'mat_id')}, {B('a.r', 'r')}, {B('b.c', 'c')}, {R('sum(a.re * b.re)', 're')}, 0e0 AS im FROM ({_HERM}) a JOIN ({_HERM}) b ON a.mat_id = b.mat_id AND a.c = b.r GROUP BY 1, 2, 3")
def matrix_ufunc(spark, d):
    return matfun.matrix_ufunc(lambda v: v * v, fixtures.hermitian_emb(spark, d), 8, hermitian=1).select(*_long("mat_id", "r", "c"), *_real("re", "im"))


_LISTS = f"SELECT mat_id, list(re ORDER BY r, c) AS m FROM ({_HERM}) GROUP BY 1"


def _times(a: str, b: str, scale: str) -> str:
    """Product of two matrices that are lists, row by row."""
    return f"list_transform(range(64), lambda p: {scale} * list_sum(list_transform(range(8), lambda k: {a}[p // 8 * 8 + k + 1] * {b}[k * 8 + p % 8 + 1])))"


_UNIT = "list_transform(range(64), lambda p: CASE WHEN p % 9 = 0 THEN 1e0 ELSE 0e0 END)"
_ENTRIES = f"SELECT {B('mat_id', 'mat_id')}, CAST(p // 8 AS BIGINT) AS r, CAST(p % 8 AS BIGINT) AS c, {R('v', 're')}, 0e0 AS im FROM (SELECT mat_id, unnest(range(64)) AS p, unnest({{}}) AS v FROM {{}})".format
# the exponential by its series
_EXP = f"""WITH RECURSIVE s AS (SELECT 0 AS n, mat_id, m, {_UNIT} AS t, {_UNIT} AS total FROM ({_LISTS}) UNION ALL
  SELECT n + 1, mat_id, m, u, list_transform(range(64), lambda p: total[p + 1] + u[p + 1]) FROM (SELECT *, {_times('t', 'm', '1e0 / (n + 1)')} AS u FROM s WHERE n < 60)) {_ENTRIES('total', 's WHERE n = 60')}"""
# the angle of a real eigenvalue is pi below zero: (1 - sign(M)) pi / 2, the sign by Newton and Schulz
_ANGLE = f"""WITH RECURSIVE s AS (SELECT 0 AS n, mat_id, list_transform(m, lambda v: v / size) AS x FROM (SELECT *, sqrt(list_sum(list_transform(m, lambda v: v * v))) AS size FROM ({_LISTS})) UNION ALL
  SELECT n + 1, mat_id, {_times('x', 'y', '0.5e0')} FROM (SELECT n, mat_id, x, list_transform(range(64), lambda p: CASE WHEN p % 9 = 0 THEN 3e0 ELSE 0e0 END - q[p + 1]) AS y FROM (SELECT *, {_times('x', 'x', '1e0')} AS q FROM s WHERE n < 60)))
  {_ENTRIES("list_transform(range(64), lambda p: (CASE WHEN p % 9 = 0 THEN 1e0 ELSE 0e0 END - x[p + 1]) * pi() / 2)", 's WHERE n = 60')}"""


@_query(_EXP)
def matrix_exp(spark, d):
    return matfun.matrix_exp(fixtures.hermitian_emb(spark, d), 8, hermitian=1).select(*_long("mat_id", "r", "c"), *_real("re", "im"))


@_query(_ANGLE)
def matrix_angle(spark, d):
    return matfun.matrix_angle(fixtures.hermitian_emb(spark, d), 8, hermitian=1).select(*_long("mat_id", "r", "c"), *_real("re", "im"))


# --- presentation -----------------------------------------------------------------------------------

_CPLX = "SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS re, CAST(unnest(embedding[2:64] || embedding[1:1]) AS DOUBLE) AS im FROM embeddings"


def _complex(spark, d) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    both = F.arrays_zip(e.alias("re"), F.concat(F.slice(e, 2, 63), F.slice(e, 1, 1)).alias("im"))
    return fixtures.table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v")["re"].alias("re"), F.col("v")["im"].alias("im"))


_WRAP = "({0} - floor({0} / (2 * pi())) * 2 * pi())".format


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {R('sqrt(re * re + im * im)', 'amp')}, {R(_WRAP('atan2(im, re)'), 'phase')}, {R(_WRAP('atan2(im, re)') + ' / pi()', 'phase_pi')} FROM ({_CPLX})")
def polar_form(spark, d):
    c = _complex(spark, d).withColumn("phase", phase_0_2pi(F.col("re"), F.col("im")))
    return c.select("vec_id", "i", rounded(F.hypot("re", "im")).alias("amp"), rounded(F.col("phase")).alias("phase"), rounded(F.col("phase") / _PI).alias("phase_pi"))


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {R('sqrt(re * re + im * im) / 2', 'amp')} FROM ({_CPLX})")
def amp_norm(spark, d):
    return _complex(spark, d).select("vec_id", "i", rounded(F.hypot("re", "im") / pretty.Style(amp_norm=2).norm).alias("amp"))


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {R(_WRAP('(atan2(im, re) - avg(atan2(im, re)) OVER (PARTITION BY vec_id))'), 'phase')} FROM ({_CPLX})")
def global_phase_mean(spark, d):
    from pyspark.sql import Window

    angle = F.atan2("im", "re")
    return _complex(spark, d).select("vec_id", "i", rounded(wrap(angle - F.avg(angle).over(Window.partitionBy("vec_id")))).alias("phase"))


_AXIS = "SELECT p_partkey, atan2(CAST(p_size // 5 % 5 - 2 AS DOUBLE), CAST(p_size % 5 - 2 AS DOUBLE)) AS a FROM part"
_TURN = f"SELECT p_partkey, {_WRAP('a')} / (pi() / 2) AS t FROM ({_AXIS})"
_NEAR = f"SELECT p_partkey, CASE WHEN abs(round_even(t, 0) - t) <= 1e-8 + 1e-5 * abs(t) THEN CAST(round_even(t, 0) AS BIGINT) % 4 ELSE -1 END AS axis FROM ({_TURN})"


@_query(f"SELECT {B('p_partkey', 'p_partkey')}, {B('axis', 'axis')}, CAST(CASE WHEN axis >= 2 THEN -1 ELSE 1 END AS BIGINT) AS sign, CASE WHEN axis = -1 THEN 'n' WHEN axis % 2 = 1 THEN '/' ELSE '0' END AS symbol FROM ({_NEAR})")
def axis_projection(spark, d):
    p = fixtures.table(spark, d, "part")
    angle = phase_0_2pi((F.col("p_size") % 5 - 2).cast("double"), (F.floor(F.col("p_size") / 5) % 5 - 2).cast("double"))
    near = near_integer(angle / (_PI / 2))
    p = p.select("p_partkey", F.when(near >= 0, near % 4).otherwise(near).alias("axis"))
    return p.select("p_partkey", *_long("axis"), F.when(F.col("axis") >= 2, -1).otherwise(1).cast("long").alias("sign"), F.when(F.col("axis") == -1, "n").when(F.col("axis") % 2 == 1, "/").otherwise("0").alias("symbol"))


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {R('re', 're')} FROM (SELECT *, max(abs(re)) OVER (PARTITION BY vec_id) AS m FROM ({sql.VECTORS})) WHERE abs(re) > m * 0.25e0 + 1e-5 * abs(re)")
def amp_cutoff(spark, d):
    v = fixtures.vectors_emb(spark, d)
    return pretty.terms(v, pretty.Style(amp_cutoff=0.25), ["vec_id"]).select("vec_id", "i", *_real("re"))


# real entries: on the real axis, so no phase; amplitude as an integer where it is one
def _amp(e: str) -> str:
    return f"CASE WHEN abs(round_even({e}, 0) - {e}) <= 1e-8 + 1e-5 * {e} THEN CAST(CAST(round_even({e}, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.3f', {e}) END"


_SHOWN = f"SELECT vec_id, i, CASE WHEN re < 0 THEN -1 ELSE 1 END AS sign, {_amp('abs(re)')} AS amp FROM (SELECT *, max(abs(re)) OVER (PARTITION BY vec_id) AS m FROM ({sql.VECTORS})) WHERE abs(re) > m * 1e-6 + 1e-5 * abs(re)"


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('i', 'i')}, {B('sign', 'sign')}, amp, '0' AS phase FROM ({_SHOWN})")
def qprint_terms(spark, d):
    return pretty.terms(fixtures.vectors_emb(spark, d), pretty.Style(), ["vec_id"]).select("vec_id", "i", *_long("sign"), "amp", "phase")


_JOINT = "CASE WHEN n = 1 THEN CASE WHEN sign = -1 THEN '-' ELSE '' END WHEN sign = -1 THEN ' - ' ELSE ' + ' END || CASE WHEN amp = '1' THEN '' ELSE amp END"


@_query(f"SELECT {B('vec_id', 'vec_id')}, {B('(n - 1) // 8', 'line')}, string_agg({_JOINT} || '|' || i // 16 || ',' || i // 4 % 4 || ',' || i % 4 || '>', '' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS n FROM ({_SHOWN})) GROUP BY 1, 2")
def qprint_lines(spark, d):
    v = fixtures.vectors_emb(spark, d).select("vec_id", F.col("i").alias("r"), F.lit(0).alias("c"), "re", "im")
    return pretty.braket_lines(v, pretty.ObjectType.KET, (4, 4, 4), pretty.Style(terms_per_row=8), keys=["vec_id"]).select("vec_id", *_long("line"), "text")


@_query("SELECT CAST(i AS BIGINT) AS i, i // 12 || ',' || i // 4 % 3 || ',' || i % 4 AS label FROM range(24) t(i)")
def braket_labels(spark, d):
    return spark.range(24).select(F.col("id").alias("i"), pretty.state_label(F.col("id"), (2, 3, 4)).alias("label"))


_PARTS = f"SELECT m.mat_id, b.k, sum(b.re * m.re) * 0.5e0 AS re, sum(b.im * m.re) * 0.5e0 AS im FROM ({sql.MATRICES}) m JOIN ({sql.basis(8)}) b ON b.r = m.c AND b.c = m.r GROUP BY 1, 2"
_PTERMS = f"SELECT mat_id, k, CASE WHEN re < 0 OR im < 0 THEN -1 ELSE 1 END AS sign, {_amp('a')} AS amp, CASE WHEN im <> 0 THEN 'i' ELSE '' END AS ph FROM (SELECT *, max(a) OVER (PARTITION BY mat_id) AS m FROM (SELECT *, sqrt(re * re + im * im) AS a FROM ({_PARTS}))) WHERE a > m * 1e-6 + 1e-5 * a"


@_query(f"SELECT {B('mat_id', 'mat_id')}, string_agg({_JOINT} || ph || '*λ' || k, '' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY mat_id ORDER BY k) AS n FROM ({_PTERMS})) GROUP BY 1")
def qprint_pauli(spark, d):
    parts = basis.components(fixtures.matrices_emb(spark, d), 8)
    return pretty.pauli_lines(parts, 8, pretty.Style(), keys=["mat_id"]).select("mat_id", "text")


_CELLS = f"SELECT mat_id, r, c, CASE WHEN a > m * 1e-6 + 1e-5 * a THEN CASE WHEN re < 0 THEN '-' ELSE '' END || {_amp('a')} ELSE '0' END AS e FROM (SELECT *, abs(re) AS a, max(abs(re)) OVER (PARTITION BY mat_id) AS m FROM ({sql.MATRICES}))"


@_query(f"SELECT {B('mat_id', 'mat_id')}, {B('r', 'line')}, CASE r WHEN 0 THEN '⎛' WHEN 7 THEN '⎝' ELSE '⎜' END || string_agg(lpad(e, CAST(w AS INT), ' '), ' ' ORDER BY c) || CASE r WHEN 0 THEN '⎞' WHEN 7 THEN '⎠' ELSE '⎟' END AS text FROM (SELECT *, max(length(e)) OVER (PARTITION BY mat_id) AS w FROM ({_CELLS})) GROUP BY 1, 2, r")
def qprint_matrix(spark, d):
    return pretty.matrix_lines(fixtures.matrices_emb(spark, d), 8, pretty.Style(), keys=["mat_id"]).select("mat_id", *_long("line"), "text")
