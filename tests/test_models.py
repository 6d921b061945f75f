"""Operators against dense numpy models, closed forms and their errors."""

import functools
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketframe.functions import limbs
from ketframe.operators import basis, circuit, matfun, pauli_sum, pretty, solver, subspace
from ketframe.sources import fixtures

LETTER = {"I": np.eye(2), "X": np.array([[0, 1], [1, 0]]), "Y": np.array([[0, -1j], [1j, 0]]), "Z": np.diag([1, -1])}


def dense(strings, coeffs):
    return sum(c * functools.reduce(np.kron, [LETTER[p] for p in s]) for s, c in zip(strings, coeffs, strict=True))


def matrix(rows, n):
    out = np.zeros((n, n), complex)
    for r in rows:
        out[r["r"], r["c"]] += complex(r["re"], r["im"])
    return out


def vector(rows, n, key="i"):
    out = np.zeros(n, complex)
    for r in rows:
        out[r[key]] += complex(r["re"], r["im"])
    return out


def coo(spark, m, mat_id=0):
    return spark.createDataFrame([(mat_id, r, c, float(m[r, c].real), float(m[r, c].imag)) for r in range(len(m)) for c in range(len(m))], "mat_id long, r int, c int, re double, im double")


def test_every_three_letter_string(spark):
    strings = ["".join(p) for p in itertools.product("IXYZ", repeat=3)]
    coeffs = [1 + i / 8 for i in range(64)]
    terms = pauli_sum.from_paulisum(spark, strings, coeffs)
    h = subspace.hproj(spark.range(8).select(F.col("id").alias("s")), terms)
    assert np.allclose(matrix(h.collect(), 8), dense(strings, coeffs))


def test_matmul_and_apply(spark):
    strings, coeffs = ["XYZ", "YYI", "ZIX", "IZY"], [0.5, -1.25, 2.0, 0.75]
    m, v = dense(strings, coeffs), np.arange(8) - 3.0
    terms = pauli_sum.from_paulisum(spark, strings, coeffs)
    rows = spark.createDataFrame([(i, float(v[i]), 0.0) for i in range(8)], "i long, re double, im double")
    assert np.allclose(vector(pauli_sum.matmul(terms, rows).collect(), 8), m @ v)
    states = spark.range(8).select(F.col("id").alias("s"))
    assert np.allclose(vector(subspace.apply_h(states, terms, rows.withColumnRenamed("i", "s")).collect(), 8, "s"), m @ v)


def test_pauli_sum_errors(spark):
    for strings, coeffs in ((["XX"], [1, 2]), (["XX", "X"], [1, 2]), (["XQ"], [1])):
        with pytest.raises(ValueError):
            pauli_sum.from_paulisum(spark, strings, coeffs)
    terms, rows = pauli_sum.from_paulisum(spark, ["XYZ"], [1]), spark.createDataFrame([(8, 1.0, 0.0)], "i long, re double, im double")
    with pytest.raises(ValueError):
        pauli_sum.matmul(terms, rows, num_qubits=3)
    bad = spark.createDataFrame([(0, "XA", 1.0, 0.0)], pauli_sum.STRINGS)
    with pytest.raises(Exception, match="not a Pauli string"):
        pauli_sum.parse(bad).collect()


def test_consolidation_drops_what_cancels(spark):
    assert pauli_sum.from_paulisum(spark, ["XX", "xx", "ZI"], [1, -1, 2]).select("x", "z", "re").collect() == [(0, 2, 2.0)]


def test_force_real_warns(spark):
    with pytest.warns(UserWarning):
        assert pauli_sum.from_paulisum(spark, ["X"], [1 + 1j], force_real=True).first()["im"] == 0
    assert not np.iscomplexobj(pauli_sum.arrays(pauli_sum.from_paulisum(spark, ["X"], [1]))[2])


def test_more_qubits_than_a_long_holds(spark):
    """Strings of 70 letters whose middle is the identity, on a subspace whose middle qubits are 0, against the short ones."""
    strings, coeffs = ["XYZI", "ZZIX", "IIXX", "YIIY", "IIII", "IYYZ"], [1, 2j, -1, 0.5, 3, 1 - 1j]
    m = dense(strings, coeffs)
    terms = pauli_sum.from_paulisum(spark, [s[:2] + "I" * 66 + s[2:] for s in strings], coeffs)
    number = lambda limb: (limb[0] << 62) + limb[1]
    short = {(i >> 2 << 68) + (i & 3): i for i in range(16)}
    few = [i for i in range(16) if i not in (3, 8, 9)]
    states = spark.createDataFrame([(format((i >> 2 << 68) + (i & 3), "070b"),) for i in [*few, few[0]]], "b string").select(limbs.of_mask(F.col("b")).alias("s"))
    want = {(r, c): m[r, c] for r in few for c in few if abs(m[r, c]) > 1e-12}
    got = {(short[number(x["r"])], short[number(x["c"])]): complex(x["re"], x["im"]) for x in subspace.hproj(states, terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    v = subspace.distinct_states(states).select("s", F.element_at("s", -1).cast("double").alias("re"), F.lit(1.0).alias("im"))
    full = np.array([(i & 3) + 1j if i in few else 0 for i in range(16)])
    out = {short[number(x["s"])]: complex(x["re"], x["im"]) for x in subspace.apply_h(states, terms, v).collect()}
    assert all(abs(out.get(i, 0) - (m @ full)[i]) < 1e-12 for i in few)


def test_limbs(spark):
    a, b = "1" * 70 + "01", "01" * 36
    row = spark.range(1).select(limbs.xor(limbs.of_mask(F.lit(a)), limbs.of_mask(F.lit(b))).alias("x"), limbs.of_mask(F.lit(bin(int(a, 2) ^ int(b, 2))[2:].zfill(72))).alias("y"), limbs.parity_sign(limbs.of_mask(F.lit(a)), limbs.of_mask(F.lit(b))).alias("p")).first()
    assert row["x"] == row["y"]
    assert row["p"] == (-1) ** (int(a, 2) & int(b, 2)).bit_count()


@pytest.mark.parametrize("dim", [2, 3, (2, 2), (2, 3), (2, 2, 2)])
def test_basis_is_orthogonal(spark, dim):
    n = basis.paulis_shape(dim)[-1]
    rows = basis.paulis(spark, dim).collect()
    by = {k: matrix([r for r in rows if r["k"] == k], n) for k in {r["k"] for r in rows}}
    s = len(basis.dims(dim))
    assert len(by) == n * n
    for k, a in by.items():
        assert np.isclose(np.trace(a @ a), 2.0 ** (2 - s))
        assert np.allclose(a, a.conj().T)
    flat = np.array([by[k].ravel() for k in sorted(by)])
    gram = flat.conj() @ flat.T
    assert np.allclose(gram, np.eye(n * n) * 2.0 ** (2 - s))


def test_components_round_trip_and_truncation(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(9, 9)) + 1j * rng.normal(size=(9, 9))
    parts = basis.components(coo(spark, m), (3, 3))
    assert np.allclose(matrix(basis.compose(parts, (3, 3)).collect(), 9), m)
    keep = [0, 1, 3, 4]
    cut = {r["k"]: complex(r["re"], r["im"]) for r in basis.truncate(parts, (3, 3), (2, 2)).collect()}
    want = {r["k"]: complex(r["re"], r["im"]) for r in basis.components(coo(spark, m[np.ix_(keep, keep)]), (2, 2)).collect()}
    assert all(np.isclose(cut.get(k, 0), want.get(k, 0)) for k in range(16))
    assert basis.truncate(parts, (3, 3), (3, 3)) is parts
    with pytest.raises(ValueError):
        basis.truncate(parts, (3, 3), (4, 3))
    with pytest.raises(ValueError):
        basis.check_matrix_dim(9, (2, 3))


def test_projector_and_labels(spark):
    p = {r["k"]: r["value"] for r in basis.l0_projector(spark, 2, 4).collect()}
    assert {k: v for k, v in p.items() if v} == pytest.approx({0: math.sqrt(2 / 4), 8: math.sqrt(2 / 6), 15: math.sqrt(2 / 12)})
    with pytest.raises(ValueError):
        basis.l0_projector(spark, 5, 4)
    text = [r["label"] for r in basis.labels(spark, (2, 4), fmt="text").orderBy("k").collect()]
    assert text[:2] == ["Iλ0/2", "Iλ1/2"]
    plain = [r["label"] for r in basis.labels(spark, (3, 3), symbol="", delimiter=",", norm=False).orderBy("k").collect()]
    assert plain[10] == "1,1"
    assert basis.labels(spark, (2, 2, 2), fmt="latex-text").orderBy("k").first()["label"] == r"\textstyle{\frac{III}{2^{2}}}"


def rotation(name, angle):
    p = {"rx": LETTER["X"], "ry": LETTER["Y"], "rz": LETTER["Z"]}[name]
    return math.cos(angle / 2) * np.eye(2) - 1j * math.sin(angle / 2) * p


def on(gate, q, n):
    return functools.reduce(np.kron, [gate if k == q else np.eye(2) for k in range(n - 1, -1, -1)])


def test_circuit_against_kron(spark):
    n, gates = 3, [("rx", 0, 0.3), ("ry", 1, -0.8), ("rz", 2, 1.1), ("x", 1), ("y", 2), ("z", 0), ("rzz", [0, 2], 0.5), ("cz", [0, 1]), ("ry", 0, 0.4)]
    v = np.eye(8)[1].astype(complex)
    diag = np.arange(8)
    for name, q, *angle in gates:
        if name in "xyz":
            u = -1j * on(LETTER[name.upper()], q, n)
        elif name == "rzz":
            u = np.diag(np.exp(-0.5j * angle[0] * (1 - 2 * (((diag >> 0) ^ (diag >> 2)) & 1))))
        elif name == "cz":
            u = np.diag(np.where((diag & 3) == 3, -1, 1))
        else:
            u = on(rotation(name, angle[0]), q, n)
        v = u @ v
    table = circuit.gates_from_list(spark, gates)
    folded = vector(circuit.svsim(table, n, 1).collect(), 8)
    joined = vector(circuit.simulate_rows(table, circuit.one_hot(spark, n, 1), every=3).collect(), 8)
    assert np.isclose(abs(np.vdot(folded, v)), 1)
    assert np.allclose(folded, joined)


def test_gate_errors(spark):
    for bad in ([("h", 0)], [("rx", 0)]):
        with pytest.raises(ValueError):
            circuit.gates_from_list(spark, bad)
    unknown = spark.createDataFrame([(0, 0, "swap", [0, 1], None)], circuit.GATES)
    with pytest.raises(Exception, match="unsupported gate"):
        circuit.compile_gates(unknown).collect()


def test_matrix_functions(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4))
    h = a + a.conj().T
    w, u = np.linalg.eigh(h)
    got = matrix(matfun.matrix_exp(coo(spark, h), 4, hermitian=1).collect(), 4)
    assert np.allclose(got, u @ np.diag(np.exp(w)) @ u.conj().T)
    anti = matrix(matfun.matrix_exp(coo(spark, 1j * h), 4, hermitian=-1).collect(), 4)
    assert np.allclose(anti, u @ np.diag(np.exp(1j * w)) @ u.conj().T)
    unitary = u @ np.diag(np.exp(1j * np.array([0.5, 0.5, -1.0, 2.0]))) @ u.conj().T  # a repeated eigenvalue
    angle = matrix(matfun.matrix_angle(coo(spark, unitary), 4).collect(), 4)
    assert np.allclose(angle, u @ np.diag([0.5, 0.5, -1.0, 2.0]) @ u.conj().T, atol=1e-7)
    more = matfun.matrix_exp(coo(spark, h), 4, hermitian=1, with_diagonals=True).filter("r < 0").collect()
    assert sorted(r["re"] for r in more) == pytest.approx(sorted(np.exp(w)))


@pytest.mark.parametrize("h", [0.5, 1.0, 2.0])
def test_local_and_distributed_ground_states(spark, h):
    states = spark.range(16).select(F.col("id").alias("s"))
    terms = fixtures.terms_tfim(spark, 4, h)
    want = -sum(math.sqrt(1 + h * h + 2 * h * math.cos((2 * m + 1) * math.pi / 4)) for m in range(4))
    energy, v, known = solver.sqd(terms, states)
    assert energy == pytest.approx(want, abs=1e-9)
    rows = v.collect()
    x = vector(rows, 16, "s")
    m = matrix(subspace.hproj(states, terms).collect(), 16)
    assert np.linalg.norm(m @ x - energy * x) < 1e-6
    if h == 1.0:
        assert solver.sqd(terms, states, solver.SQDOptions(False, (0, 0), tol=1e-9)) == pytest.approx(want, abs=1e-8)


def test_gap_and_deflation():
    from numpy.linalg import eigh

    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    m = a + a.T
    w, _ = eigh(m)
    e0, v0, _ = solver.lowest(lambda v: m @ v, rng.normal(size=30))
    e1, v1, _ = solver.lowest(lambda v: m @ v, rng.normal(size=30), [v0])
    assert (e0, e1) == pytest.approx((w[0], w[1]), abs=1e-8)
    assert abs(v0 @ v1) < 1e-8
    e, v, history = solver.lowest(lambda v: m @ v, v0)  # an exact start stops at once
    assert e == pytest.approx(w[0]) and len(history) <= 3


def test_options_and_start(spark):
    with pytest.raises(ValueError):
        solver.SQDOptions(cache_strategy=(2, 5))
    states = spark.createDataFrame([(3,), (5,), (5,)], "s long")
    assert subspace.start_state(states, pauli_sum.from_paulisum(spark, ["XII"], [1.0])).first()["s"] == 3
    assert subspace.start_state(states, pauli_sum.from_paulisum(spark, ["IZI"], [1.0])).first()["s"] == 3


def test_eigenvalues_of_small_matrices(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, rng.normal(size=6))) for _ in range(50)] + [(0.0, 1.0, 2.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    for r in df.select("*", solver.eigenvalue_3x3(*"abcdef").alias("v"), solver.eigenvalue_2x2("a", "b", "d", "e").alias("w")).collect():
        m = np.array([[r.a, r.d, r.e], [r.d, r.b, r.f], [r.e, r.f, r.c]])
        assert r.v == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-7)
        assert r.w == pytest.approx(np.linalg.eigvalsh(np.array([[r.a, r.d + 1j * r.e], [r.d - 1j * r.e, r.b]]))[0], abs=1e-9)


@pytest.mark.parametrize("strategy", [(x, z) for x in (0, 1) for z in (0, 1, 2)])
def test_products_by_what_is_kept(spark, strategy):
    strings, coeffs = ["XYZ", "ZZI", "IIX", "YIY", "III", "XYI"], [1, 2j, -1, 0.5, 3, 1 - 1j]
    few = [0, 1, 2, 5, 6, 7]
    m, v = dense(strings, coeffs), np.array([i + 1j if i in few else 0 for i in range(8)])
    states = spark.createDataFrame([(i,) for i in few], "s long")
    rows = spark.createDataFrame([(i, float(i), 1.0) for i in few], "s long, re double, im double")
    product = subspace.cached_product(states, pauli_sum.from_paulisum(spark, strings, coeffs), strategy)
    got = vector(product(rows).collect(), 8, "s")
    assert np.allclose(got[few], (m @ v)[few]) and np.allclose(np.delete(got, few), 0)


def test_small_eigenvectors(spark):
    """Complex Hermitian matrices, and such with equal eigenvalues: M v = value v, v of length 1."""
    rng = np.random.default_rng(8)
    rows = [tuple(float(x) for x in rng.standard_normal(9)) for _ in range(40)]
    rows += [(1.0, 0.0, 5.0, *[0.0] * 6), (2.0, 2.0, 2.0, *[0.0] * 6), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 3.0, *[0.0] * 6), (2.0, 1.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (0.0, 3.0, 0.0, *[0.0] * 6), (3.0, 0.0, 0.0, *[0.0] * 6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in "abcdefghi"))
    df = df.withColumns({"v3": solver.eigenvalue_3x3(*"abcdefghi"), "v2": solver.eigenvalue_2x2("a", "b", "d", "g")})
    for r in df.select("*", solver.eigenvector_3x3(*"abcdef", "v3", *"ghi").alias("x3"), solver.eigenvector_2x2("a", "b", "d", "g", "v2").alias("x2")).collect():
        u, w, v = complex(r.d, r.g), complex(r.e, r.h), complex(r.f, r.i)
        m = np.array([[r.a, u, w], [u.conjugate(), r.b, v], [w.conjugate(), v.conjugate(), r.c]])
        for matrix_, value, vector_ in ((m, r.v3, r.x3), (m[:2, :2], r.v2, r.x2)):
            x = np.array([complex(p["re"], p["im"]) for p in vector_])
            assert value == pytest.approx(np.linalg.eigvalsh(matrix_)[0], abs=1e-7)
            assert np.linalg.norm(x) == pytest.approx(1)
            assert np.linalg.norm(matrix_ @ x - value * x) < 1e-5


def test_qprint(spark):
    text = lambda a, **k: pretty.qprint(spark, np.array(a), output="text", **k)
    assert text([1, 1, 0]).strip() == "|0> + |1>"
    assert text([1, -1j, 0.5], lhs_label="ψ").strip() == "|ψ> = |0> - i|1> + 0.500|2>"
    assert text([[1, 0], [0, 1j]]).strip() == "|0><0| + i|1><1|"
    assert text([0.5, 0, 0, 0.5], dim=(2, 2), binary=True).strip() == "0.500|0,0> + 0.500|1,1>"
    assert text([np.exp(0.25j * math.pi), 0]).strip() == "[0.25π]|0>"
    assert text([0.0, 0.0]).strip() == "0"
    assert text([2, 2], amp_norm=(2, "√4")).startswith("√4 (|0> + |1>")
    m = np.kron(np.kron(LETTER["X"], LETTER["Y"]), LETTER["Z"])
    assert text(m, fmt="pauli", dim=(2, 2, 2)).strip() == "4*XYZ/2**2"
    assert text([[1, 0], [0, -2]], fmt="matrix") == "⎛ 1  0⎞\n⎝ 0 -2⎠"
    latex = pretty.qprint(spark, np.array([1, -1, 1j, 1]), terms_per_row=2)
    assert latex == r"\begin{split} & | 0 \rangle - | 1 \rangle \\ &  + i| 2 \rangle + | 3 \rangle \end{split}"
    assert pretty.qprint(spark, np.array([[0, 2], [3, 0]]), fmt="matrix", env=None) == r"\begin{pmatrix}0 & 2 \\ 3 & 0\end{pmatrix}"
    # just below a full turn is on the real axis
    assert text([complex(1, -1e-9), 0]).strip() == "|0>"


def test_qprint_errors(spark):
    with pytest.raises(NotImplementedError):
        pretty.qprint(spark, np.eye(2), fmt="other")
    with pytest.raises(NotImplementedError):
        pretty.qprint(spark, "text")
    with pytest.raises(ValueError):
        pretty.qprint(spark, np.ones(4), dim=(3, 2))
    with pytest.raises(ValueError):
        pretty.qprint(spark, np.ones(3), binary=True)
    with pytest.raises(ValueError):
        pretty.qprint(spark, np.ones((2, 3)), fmt="matrix")
    with pytest.raises(ValueError):
        pretty.qprint(spark, np.ones(5), fmt="pauli")


def test_number_format_is_pythons(spark):
    got = spark.createDataFrame([(0.0625,), (2.5,), (1e-9,)], "v double").select(pretty.formatted(F.col("v"), ".3f").alias("t")).collect()
    assert [r["t"] for r in got] == ["0.062", "2.500", "0.000"]


def test_sinks_and_generators(spark, tmp_path):
    from ketframe.sources import generators, sinks

    states = generators.random_states(spark, 12, 500, seed=3)
    assert states.collect() == generators.random_states(spark, 12, 500, seed=3).collect()
    assert 0 <= states.agg(F.min("s")).first()[0] and states.agg(F.max("s")).first()[0] < 4096
    strings = generators.random_paulisum(spark, 6, 20, seed=4)
    terms = pauli_sum.fold_phase(pauli_sum.symplectic(pauli_sum.consolidate(strings))).drop("ham_id")
    x, z, c = pauli_sum.arrays(terms)
    assert len(x) == len(z) == len(c) == terms.count()
    h = subspace.hproj(states.select((F.col("s") % 64).alias("s")), terms)
    sinks.write(h, f"{tmp_path}/h", "matrix")
    back = sinks.read(spark, f"{tmp_path}/h", "matrix")
    assert sorted(back.collect()) == sorted(h.collect())
    rows = strings.collect()
    m = dense([r["pauli"] for r in rows], [r["re"] for r in rows])
    assert np.allclose(matrix(back.collect(), 64), m)
    with pytest.raises(ValueError):
        sinks.write(h, f"{tmp_path}/x", "vector")
    # the ground state of a Hermitian sum found from one state is that of what is connected to it
    e, v, _ = solver.lowest_of_matrix(m, 0)
    assert np.linalg.norm(m @ v - e * v) < 1e-6 and e >= np.linalg.eigvalsh(m)[0] - 1e-9
    with pytest.raises(ValueError):
        solver.lowest_of_matrix(np.ones((2, 3)))


def test_state_operators(spark):
    states = spark.createDataFrame([(s,) for s in (5, 1, 5, 70, 4096 * 9, 1)], "s long")
    assert [(r["s"], r["idx"]) for r in subspace.state_index(states).orderBy("idx").collect()] == [(1, 0), (5, 1), (70, 2), (36864, 3)]
    assert {r["s"]: r["first"] for r in subspace.first_positions(states.withColumn("p", F.monotonically_increasing_id()), "p").collect()}.keys() == {1, 5, 70, 36864}
    bits = spark.createDataFrame([([1, 0, 1],), ([0, 1, 1],)], "bits array<int>")
    assert [r["s"] for r in subspace.pack(bits).collect()] == [5, 3]
    with pytest.raises(ValueError):
        subspace.unpack(states, 63)
    assert subspace.hproj(states.limit(0), pauli_sum.from_paulisum(spark, ["X"], [1.0])).count() == 0


def test_documents_of_several_lines(spark):
    ket = np.array([1, -1, 1j, 1, 2])
    text = pretty.qprint(spark, ket, output="text", terms_per_row=2, amp_norm=(1, "c"), lhs_label="a")
    assert text == "|a> = c (|0> - |1>\n" + " " * 9 + " + i|2> + |3>\n" + " " * 9 + " + 2|4>)"
    latex = pretty.qprint(spark, ket, terms_per_row=2, amp_norm=(1, "c"))
    assert latex == r"\begin{split} c &  \left( | 0 \rangle - | 1 \rangle \right. \\ &  + i| 2 \rangle + | 3 \rangle \\ & \left.  + 2| 4 \rangle \right) \end{split}"
    assert pretty.qprint(spark, np.array([2, 2]), amp_norm=(2, "c"), env=None) == r"c  \left( | 0 \rangle + | 1 \rangle \right)"
    # many objects at once
    rows = spark.createDataFrame([(k, r, 0, 1.0, 0.0) for k in (1, 2) for r in range(k + 1)], "id int, r int, c int, re double, im double")
    style = pretty.Style()
    got = pretty.documents(pretty.braket_lines(rows, pretty.ObjectType.KET, (4,), style, "text", ["id"]), "text", "v", keys=["id"])
    assert {r["id"]: r["document"] for r in got.collect()} == {1: "v = |0> + |1>\n", 2: "v = |0> + |1> + |2>\n"}
