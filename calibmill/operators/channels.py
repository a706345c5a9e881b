"""Noise channels of single-qubit gates from rule outputs, as columns and as rows.

A channel is amplitude damping (gamma) together with phase damping (lambda): four 2 x 2 operators, products of the two
channels' operators. All entries are real, kept as expressions of the two parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates that carry no noise.
NOISELESS = ("", "barrier", "measure", "reset")

Matrix = list[list[Column]]


def _unit(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def amplitude_damping(gamma: Column) -> list[Matrix]:
    g, zero, one = _unit(gamma), F.lit(0.0), F.lit(1.0)
    return [[[one, zero], [zero, F.sqrt(1 - g)]], [[zero, F.sqrt(g)], [zero, zero]]]


def phase_damping(lam: Column) -> list[Matrix]:
    l, zero, one = _unit(lam), F.lit(0.0), F.lit(1.0)
    return [[[one, zero], [zero, F.sqrt(1 - l)]], [[zero, zero], [zero, F.sqrt(l)]]]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] for j in range(2)] for i in range(2)]


def compose(first: list[Matrix], second: list[Matrix]) -> list[Matrix]:
    """All products of an operator of one channel with one of the other, the second varying fastest."""
    return [_times(a, b) for a in first for b in second]


def kraus(gamma: Column, lam: Column) -> Column:
    """The channel as an array of four 2 x 2 arrays."""
    return F.array(*[F.array(*[F.array(*row) for row in m]) for m in compose(amplitude_damping(gamma), phase_damping(lam))])


def project(rows: DataFrame, params: str = "params", qubits: str = "qubits") -> DataFrame:
    """``rows`` with ``kraus`` and ``channel_status``.

    params is an array whose first two entries are gamma and lambda (more are ignored), qubits the array of a gate's qubits.
    Gates on other than one qubit and rows with fewer than two parameters have no channel, and the status says why.
    """
    status = F.when(F.col(qubits).isNull() | (F.size(qubits) != 1), "not a single-qubit gate").when(F.col(params).isNull() | (F.size(params) < 2), "two parameters needed").otherwise("ok")
    return rows.withColumn("channel_status", status).withColumn("kraus", F.when(F.col("channel_status") == "ok", kraus(F.try_element_at(params, F.lit(1)), F.try_element_at(params, F.lit(2)))))


def kraus_rows(rows: DataFrame, *keys: str, column: str = "kraus") -> DataFrame:
    """A channel's entries as rows: keys, k, i, j, re, im."""
    return (
        rows.where(F.col(column).isNotNull())
        .select(*keys, F.posexplode(column).alias("k", "_m"))
        .select(*keys, "k", F.posexplode("_m").alias("i", "_r"))
        .select(*keys, "k", "i", F.posexplode("_r").alias("j", "re"))
        .withColumn("im", F.lit(0.0))
    )


def completeness(rows: DataFrame, column: str = "kraus") -> Column:
    """How far the sum of K^T K is from the identity (largest entry)."""
    entry = lambda i, j: F.aggregate(column, F.lit(0.0), lambda s, m: s + m[0][i] * m[0][j] + m[1][i] * m[1][j])
    return F.greatest(F.abs(entry(0, 0) - 1), F.abs(entry(1, 1) - 1), F.abs(entry(0, 1)))


def install_after_gates(gates: DataFrame, channels: DataFrame) -> DataFrame:
    """Noise attached behind the gates of circuits: each (circuit_id, gate, qubits) once, at its first place, with its channel.

    gates: circuit_id, pos, gate, qubits. channels: qubit, params. Noiseless gates are left out, gates without a usable
    channel stay without noise (``kraus`` NULL). The circuits themselves don't change.
    """
    noisy = gates.where(~F.coalesce(F.lower("gate"), F.lit("")).isin(*NOISELESS))
    first = noisy.groupBy("circuit_id", "gate", "qubits").agg(F.min("pos").alias("pos"))
    single = first.withColumn("_q", F.when(F.size("qubits") == 1, F.col("qubits")[0]))
    return project(single.join(channels.select(F.col("qubit").alias("_q"), "params"), "_q", "left")).drop("_q")


def unsupported(what: str) -> None:
    """Variants that are declared but have no defined result: projection to the nearest channel, derivative-based
    normalisation, noise before or between gates."""
    raise NotImplementedError(f"{what} has no defined result")


def no_normalisation(column: Column) -> Column:
    """Channels made here are complete by construction; nothing to normalise."""
    return column
