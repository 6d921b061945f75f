"""Pieces of the SQL twins (DuckDB dialect) that several queries share."""

from __future__ import annotations

STATES = "SELECT DISTINCT l_orderkey AS s FROM lineitem"
RING8 = "SELECT DISTINCT l_partkey % 256 AS s FROM lineitem"


def scattered(number: str, low: int) -> str:
    return f"((({number}) * 2654435761) % 4294967296 // {low}) % 4096"


TERMS12 = f"""SELECT x, z,
  CASE bit_count(x & z) % 4 WHEN 0 THEN c WHEN 2 THEN -c ELSE 0e0 END AS re,
  CASE bit_count(x & z) % 4 WHEN 1 THEN -c WHEN 3 THEN c ELSE 0e0 END AS im
FROM (SELECT CASE WHEN p_size % 10 = 0 THEN 0 ELSE {scattered("CAST(p_size % 10 AS BIGINT)", 1_048_576)} END AS x, {scattered("p_partkey % 5 + 1", 256)} AS z, sum((p_partkey % 17 - 8) / 8e0) AS c
      FROM part GROUP BY 1, 2) t WHERE c <> 0"""

_LETTERS = " || ".join(f"substr('IXZY', CAST(1 + (x >> {q}) % 2 + 2 * ((z >> {q}) % 2) AS INT), 1)" for q in range(11, -1, -1))
PAULI_STRINGS = f"""SELECT CAST(0 AS BIGINT) AS ham_id, {_LETTERS} AS pauli, x, z, c AS re FROM (
  SELECT {scattered("p_partkey % 1000", 1_048_576)} AS x, {scattered("p_partkey % 1000", 256)} AS z,
    CASE WHEN p_partkey % 1000 % 3 = 0 THEN CASE WHEN p_partkey // 1000 % 2 = 0 THEN 1e0 ELSE -1e0 END * (p_partkey % 1000 % 17 - 8) / 8 ELSE (p_size % 17 - 8) / 8e0 END AS c FROM part)"""

EMB = "SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS re FROM embeddings"
MATRICES = f"SELECT vec_id AS mat_id, CAST(pos // 8 AS INT) AS r, CAST(pos % 8 AS INT) AS c, re FROM ({EMB})"
VECTORS = f"SELECT vec_id, pos AS i, re FROM ({EMB})"


def tfim(n: int, h: float) -> str:
    return f"SELECT CAST(0 AS BIGINT) AS x, (1::BIGINT << q) | (1::BIGINT << ((q + 1) % {n})) AS z, -1e0 AS re, 0e0 AS im FROM range({n}) t(q) UNION ALL SELECT 1::BIGINT << q, 0, {h}e0, 0e0 FROM range({n}) t(q)"


def sign(z: str, s: str) -> str:
    return f"(1 - 2 * (bit_count(({z}) & ({s})) % 2))"


def basis(d: int) -> str:
    """k, r, c, re, im of the generalised Pauli matrices."""
    return f"""SELECT 0 AS k, i AS r, i AS c, sqrt(2e0 / {d}) AS re, 0e0 AS im FROM range({d}) t(i)
UNION ALL SELECT b * b + 2 * a, a, b, 1e0, 0e0 FROM range(1, {d}) t(b), range({d}) u(a) WHERE a < b
UNION ALL SELECT b * b + 2 * a, b, a, 1e0, 0e0 FROM range(1, {d}) t(b), range({d}) u(a) WHERE a < b
UNION ALL SELECT b * b + 2 * a + 1, a, b, 0e0, -1e0 FROM range(1, {d}) t(b), range({d}) u(a) WHERE a < b
UNION ALL SELECT b * b + 2 * a + 1, b, a, 0e0, 1e0 FROM range(1, {d}) t(b), range({d}) u(a) WHERE a < b
UNION ALL SELECT (m + 1) * (m + 1) - 1, i, i, CASE WHEN i < m THEN 1e0 ELSE -m END * sqrt(2e0 / (m * (m + 1))), 0e0 FROM range(1, {d}) t(m), range({d}) u(i) WHERE i <= m"""


def product(d1: int, d2: int) -> str:
    return f"""SELECT p.k * {d2 * d2} + q.k AS k, p.r * {d2} + q.r AS r, p.c * {d2} + q.c AS c, (p.re * q.re - p.im * q.im) / 2 AS re, (p.re * q.im + p.im * q.re) / 2 AS im
FROM ({basis(d1)}) p, ({basis(d2)}) q"""


def hproj(states: str, terms: str) -> str:
    return f"""SELECT a.s AS r, b.s AS c, sum(t.re * {sign('t.z', 'a.s')}) AS re, sum(t.im * {sign('t.z', 'a.s')}) AS im
FROM ({states}) a, ({terms}) t, ({states}) b WHERE b.s = xor(a.s, t.x) GROUP BY 1, 2 HAVING sum(t.re * {sign('t.z', 'a.s')}) <> 0 OR sum(t.im * {sign('t.z', 'a.s')}) <> 0"""


def r6(e: str) -> str:
    return f"round({e}, 6) + 0e0"


def gate(x: int, z: int, cos: str, sin: str) -> str:
    """One rotation on the embedding vectors."""
    k = (x & z).bit_count() % 4
    s = sign(str(z), "a.i")
    # (-i)^k b, b real
    t_re, t_im = {0: ("b.re", "0e0"), 1: ("0e0", "-b.re"), 2: ("-b.re", "0e0"), 3: ("0e0", "b.re")}[k]
    return f"SELECT a.vec_id, CAST(a.i AS BIGINT) AS i, {r6(f'({cos}) * a.re - ({sin}) * {s} * ({t_im})')} AS re, {r6(f'({sin}) * {s} * ({t_re})')} AS im FROM ({VECTORS}) a JOIN ({VECTORS}) b ON b.vec_id = a.vec_id AND b.i = xor(a.i, {x})"
