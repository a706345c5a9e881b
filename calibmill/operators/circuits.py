"""Small circuits as gate tables, and their simulation with noise.

Conventions of this engine: qubit 0 is the rightmost character of a bitstring; the ansatz is layers of RY and RZ
on every qubit with a chain of CX between them; a random Clifford layer is a uniformly drawn Clifford operation, written in
H, S, CX, X and Z. Up to ``MOST_QUBITS`` qubits states are density matrices and results exact; beyond, shots are drawn from state
vectors whose noise operators are drawn too, shot by shot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibmill.operators.channels import NOISELESS

GATES_DDL = "circuit_id int, circuit_name string, n_qubits int, pos int, gate string, qubits array<int>, theta double"
#: Qubits up to which a state is a matrix of 4^n numbers in one task; beyond it is a vector of 2^n, so many numbers of which fit a batch of shots.
MOST_QUBITS, BATCH_NUMBERS = 8, 1 << 22

Gate = tuple[str, list[int], float | None]


def ghz(n: int) -> tuple[str, int, list[Gate]]:
    if n < 2:
        raise ValueError("a GHZ state needs two qubits")
    return f"ghz_n{n}", n, [("h", [0], None), *[("cx", [0, i], None) for i in range(1, n)]]


def qft(n: int) -> tuple[str, int, list[Gate]]:
    if n < 1:
        raise ValueError("a Fourier transform needs a qubit")
    return f"qft_n{n}", n, [("qft", list(range(n)), None)]


def _clear(x: np.ndarray, z: np.ndarray, row: int, at: list[int], gates: list[Gate]) -> None:
    """Gates that bring a Pauli (row of x and z bits) on the qubits ``at`` to X on the first of them; both rows follow."""

    def do(kind: str, *q: int) -> None:
        gates.append((kind, list(q), None))
        if kind == "h":
            x[:, q[0]], z[:, q[0]] = z[:, q[0]].copy(), x[:, q[0]].copy()
        elif kind == "s":
            z[:, q[0]] ^= x[:, q[0]]
        else:
            x[:, q[1]] ^= x[:, q[0]]
            z[:, q[0]] ^= z[:, q[1]]

    for q in at:
        if z[row, q]:
            do("s" if x[row, q] else "h", q)
    live = [q for q in at if x[row, q]]
    while len(live) > 1:
        for c, t in zip(live[::2], live[1::2]):
            do("cx", c, t)
        live = live[::2]
    if live[0] != at[0]:
        for c, t in ((live[0], at[0]), (at[0], live[0]), (live[0], at[0])):
            do("cx", c, t)


def uniform_clifford(n: int, rng: np.random.Generator) -> list[Gate]:
    """A Clifford operation on n qubits, drawn uniformly.

    Qubit by qubit a random pair of anticommuting Paulis on the qubits left is drawn, and the gates that map it to X and Z of
    one qubit are written down; random signs are Paulis behind them.
    """
    gates: list[Gate] = []
    for first in range(n):
        at = list(range(first, n))
        while True:
            x, z = np.zeros((2, n), int), np.zeros((2, n), int)
            x[:, at], z[:, at] = rng.integers(0, 2, (2, len(at))), rng.integers(0, 2, (2, len(at)))
            if (x[0] @ z[1] + z[0] @ x[1]) % 2:
                break
        _clear(x, z, 0, at, gates)
        if x[1].any() or z[1].sum() != 1 or not z[1, first]:
            for step in range(2):  # exchange X and Z of this qubit, clear the second Pauli to X, exchange back
                gates.append(("h", [first], None))
                x[:, first], z[:, first] = z[:, first].copy(), x[:, first].copy()
                if not step:
                    _clear(x, z, 1, at, gates)
        gates += [(kind, [first], None) for kind in ("x", "z") if rng.integers(2)]
    return gates


def random_clifford(n: int, depth: int, seed: int | None = None) -> tuple[str, int, list[Gate]]:
    """So many layers, each an independent uniform Clifford on all qubits."""
    if n < 1 or depth < 1:
        raise ValueError("qubits and depth must be above 0")
    rng = np.random.default_rng(seed)
    return f"random_clifford_n{n}_d{depth}", n, [gate for _ in range(depth) for gate in uniform_clifford(n, rng)]


def ansatz(n: int, reps: int, seed: int | None = None) -> tuple[str, int, list[Gate]]:
    if n < 1 or reps < 1:
        raise ValueError("qubits and repetitions must be above 0")
    angles, gates = iter(np.random.default_rng(seed).standard_normal(2 * n * (reps + 1)).tolist()), []
    for layer in range(reps + 1):
        gates += [(kind, [q], next(angles)) for kind in ("ry", "rz") for q in range(n)]
        if layer < reps:
            gates += [("cx", [q, q + 1], None) for q in range(n - 1)]
    return f"vqe_su2_n{n}_r{reps}", n, gates


def gate_table(spark: SparkSession, *circuits: tuple[str, int, list[Gate]]) -> DataFrame:
    rows = [(c, name, n, pos, gate, qubits, theta) for c, (name, n, gates) in enumerate(circuits) for pos, (gate, qubits, theta) in enumerate(gates)]
    return spark.createDataFrame(rows, GATES_DDL)


def unitary(gate: str, n: int, theta: float | None) -> np.ndarray:
    r = 1 / math.sqrt(2)
    if gate == "qft":
        k = np.arange(2**n)
        return np.exp(2j * np.pi * np.outer(k, k) / 2**n) / math.sqrt(2**n)
    if gate in ("ry", "rz"):
        c, s = math.cos(theta / 2), math.sin(theta / 2)
        return np.array([[c, -s], [s, c]], dtype=complex) if gate == "ry" else np.diag([np.exp(-0.5j * theta), np.exp(0.5j * theta)])
    table = {"h": [[r, r], [r, -r]], "x": [[0, 1], [1, 0]], "z": [[1, 0], [0, -1]], "s": [[1, 0], [0, 1j]], "id": [[1, 0], [0, 1]], "cx": [[1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0], [0, 1, 0, 0]]}
    if gate not in table:
        raise ValueError(f"no such gate: {gate!r}")
    return np.array(table[gate], dtype=complex)


def spread(matrix: np.ndarray, qubits: list[int], n: int) -> np.ndarray:
    """A matrix on some qubits (the first of them its lowest bit) as one on all n."""
    rest = [q for q in range(n) if q not in qubits]
    full = np.kron(np.eye(2 ** len(rest)), matrix)
    order = list(qubits) + rest
    index = np.array([sum(((b >> q) & 1) << order.index(q) for q in range(n)) for b in range(2**n)])
    return full[np.ix_(index, index)]


def run(gates: list[Gate], n: int, gamma: float, lam: float) -> np.ndarray:
    """The state after all gates from |0..0>, with damping behind each single-qubit gate."""
    if n > MOST_QUBITS:
        raise ValueError(f"{n} qubits; density matrices go up to {MOST_QUBITS}, beyond only shots are simulated")
    rho = np.zeros((2**n, 2**n), dtype=complex)
    rho[0, 0] = 1
    gamma, lam = min(max(gamma, 0.0), 1.0), min(max(lam, 0.0), 1.0)
    damp = [np.diag([1, math.sqrt(1 - gamma)]), np.array([[0, math.sqrt(gamma)], [0, 0]])]
    dephase = [np.diag([1, math.sqrt(1 - lam)]), np.diag([0, math.sqrt(lam)])]
    for gate, qubits, theta in gates:
        if gate in NOISELESS:
            continue
        u = spread(unitary(gate, len(qubits), theta), qubits, n)
        rho = u @ rho @ u.conj().T
        if len(qubits) == 1 and (gamma or lam):
            ops = [spread(a @ b, qubits, n) for a in damp for b in dephase]
            rho = sum(k @ rho @ k.conj().T for k in ops)
    return rho


def _apply(states: np.ndarray, matrix: np.ndarray, qubits: list[int], n: int) -> np.ndarray:
    """A matrix on some qubits (the first of them its lowest bit) applied to state vectors (rows); one matrix for all, or one each."""
    k = len(qubits)
    axes = [n - q for q in reversed(qubits)]  # axis 0 counts the vectors, axis n is qubit 0
    moved = np.moveaxis(states.reshape(-1, *[2] * n), axes, range(1, k + 1))
    done = matrix @ moved.reshape(len(states), 2**k, -1)
    return np.moveaxis(done.reshape(moved.shape), range(1, k + 1), axes).reshape(len(states), -1)


def sample(gates: list[Gate], n: int, gamma: float, lam: float, shots: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of the 2^n outcomes over so many shots, by state vectors: behind each single-qubit gate one of the noise operators is
    drawn for every shot with the probability it has in that shot's state. Without noise one vector serves all shots."""
    gamma, lam = min(max(gamma, 0.0), 1.0), min(max(lam, 0.0), 1.0)
    noisy = bool(gamma or lam)
    damp = [np.diag([1, math.sqrt(1 - gamma)]), np.array([[0, math.sqrt(gamma)], [0, 0]])]
    dephase = [np.diag([1, math.sqrt(1 - lam)]), np.diag([0, math.sqrt(lam)])]
    noise = np.array([a @ b for a in damp for b in dephase], dtype=complex)
    counts = np.zeros(2**n, dtype=np.int64)
    at_once = max(1, min(shots, BATCH_NUMBERS >> n)) if noisy else 1
    for start in range(0, shots if noisy else 1, at_once):
        m = min(at_once, shots - start) if noisy else 1
        states = np.zeros((m, 2**n), dtype=complex)
        states[:, 0] = 1
        for gate, qubits, theta in gates:
            if gate in NOISELESS:
                continue
            if gate == "qft" and qubits == list(range(n)):
                states = np.fft.ifft(states, norm="ortho")
            else:
                states = _apply(states, unitary(gate, len(qubits), theta), qubits, n)
            if len(qubits) == 1 and noisy:
                q = np.moveaxis(states.reshape(-1, *[2] * n), n - qubits[0], 1).reshape(m, 2, -1)
                rho = np.einsum("mij,mkj->mik", q, q.conj())  # the qubit's own state in each shot
                p = np.clip(np.einsum("kab,mbc,kac->mk", noise, rho, noise.conj()).real, 0, None)
                edges = np.cumsum(p, axis=1)
                pick = (rng.random(m)[:, None] * edges[:, -1:] > edges[:, :-1]).sum(1)
                states = _apply(states, noise[pick], qubits, n)
                states /= np.linalg.norm(states, axis=1, keepdims=True)
        p = np.abs(states) ** 2
        p /= p.sum(1, keepdims=True)
        if not noisy:
            return rng.multinomial(shots, p[0])
        edges = np.cumsum(p, axis=1)
        drawn = [int(np.searchsorted(e, r * e[-1], "right")) for e, r in zip(edges, rng.random(m))]
        counts += np.bincount(np.minimum(drawn, 2**n - 1), minlength=2**n)
    return counts


#: The most gates of all circuits together: circuits are parameters of a run, members are its rows.
MOST_GATES = 100_000


def _programs(gates: DataFrame) -> list[tuple[int, str, int, list[Gate]]]:
    """The circuits of a gate table, which must be a bounded one."""
    rows = gates.select("circuit_id", "circuit_name", "n_qubits", "pos", "gate", "qubits", "theta").limit(MOST_GATES + 1).collect()
    if len(rows) > MOST_GATES:
        raise ValueError(f"more than {MOST_GATES} gates")
    out: dict[int, tuple[int, str, int, list[Gate]]] = {}
    for r in sorted(rows, key=lambda r: (r["circuit_id"], r["pos"])):
        out.setdefault(r["circuit_id"], (r["circuit_id"], r["circuit_name"], r["n_qubits"], []))[3].append((r["gate"], list(r["qubits"]), r["theta"]))
    return list(out.values())


def simulate(gates: DataFrame, members: DataFrame, shots: int | None = None, seed: int = 0) -> DataFrame:
    """Outcomes of every circuit for every member: circuit_id, circuit_name, member, bitstring, probability, count.

    members: member, gamma, lam, however many rows. Without shots the probabilities are exact and count is NULL; with them counts
    are drawn, seeded by circuit and member, so a task that is run again gives the same. Circuits of more than ``MOST_QUBITS`` qubits need
    shots; their probability is the share of shots, and outcomes without shots give no row.
    """
    programs = _programs(gates)

    def batches(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                for circuit, name, n, program in programs:
                    rng = np.random.default_rng([seed, int(circuit), int(r.member)])
                    if n > MOST_QUBITS and shots:
                        drawn = sample(program, n, r.gamma, r.lam, shots, rng)
                        out += [(circuit, name, r.member, format(i, f"0{n}b"), float(drawn[i] / shots), int(drawn[i])) for i in np.flatnonzero(drawn)]
                        continue
                    p = np.clip(np.real(np.diag(run(program, n, r.gamma, r.lam))), 0, None)
                    p = p / p.sum()
                    counts = rng.multinomial(shots, p) if shots else [None] * len(p)
                    out += [(circuit, name, r.member, format(i, f"0{n}b"), float(p[i]), None if counts[i] is None else int(counts[i])) for i in range(len(p)) if not shots or counts[i]]
            yield pd.DataFrame(out, columns=["circuit_id", "circuit_name", "member", "bitstring", "probability", "count"]).astype({"count": "Int64"})

    return members.select("member", "gamma", "lam").mapInPandas(batches, "circuit_id int, circuit_name string, member int, bitstring string, probability double, count bigint")


def states(gates: DataFrame, members: DataFrame) -> DataFrame:
    """The density matrix of every circuit and member as rows: circuit_id, member, i, j, re, im (zero entries left out)."""
    programs = _programs(gates)

    def batches(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                for circuit, _, n, program in programs:
                    rho = run(program, n, r.gamma, r.lam)
                    out += [(circuit, r.member, int(i), int(j), float(rho[i, j].real), float(rho[i, j].imag)) for i, j in zip(*np.nonzero(np.abs(rho) > 1e-15))]
            yield pd.DataFrame(out, columns=["circuit_id", "member", "i", "j", "re", "im"])

    return members.select("member", "gamma", "lam").mapInPandas(batches, "circuit_id int, member int, i int, j int, re double, im double")


def apply_by_rows(state: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """One gate or channel on density matrices held as rows: rho' = sum over k of K rho K^H, as two equi-joins and sums.

    state: keys, i, j, re, im. matrix: k, i, j, re, im (the operators spread to the state's size). The relational cross-check of
    the Python simulation.
    """
    m = matrix
    left = state.alias("s").join(m.alias("m"), F.col("m.j") == F.col("s.i")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("m.k").alias("k"), F.col("m.i").alias("i"), F.col("s.j").alias("j")).agg(F.sum(F.col("m.re") * F.col("s.re") - F.col("m.im") * F.col("s.im")).alias("re"), F.sum(F.col("m.re") * F.col("s.im") + F.col("m.im") * F.col("s.re")).alias("im"))
    return left.alias("s").join(m.alias("m"), (F.col("m.j") == F.col("s.j")) & (F.col("m.k") == F.col("s.k"))).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.i").alias("i"), F.col("m.i").alias("j")).agg(F.sum(F.col("m.re") * F.col("s.re") + F.col("m.im") * F.col("s.im")).alias("re"), F.sum(F.col("m.re") * F.col("s.im") - F.col("m.im") * F.col("s.re")).alias("im"))
