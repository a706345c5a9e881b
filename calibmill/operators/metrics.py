"""Outcome counts of runs, and how far apart two runs are.

Counts are long rows (run, bitstring, count); a pair of runs is compared over the union of their bitstrings, the missing side
counting zero. All metrics of a pair come from one aggregation over that union.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNT_METRICS = ("hellinger_distance", "kl_divergence", "r2_score")


def sum_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts added over members: keys, bitstring, count."""
    return counts.groupBy(*keys, "bitstring").agg(F.sum("count").alias("count"))


def mean_counts(counts: DataFrame, *keys: str, member: str = "member") -> DataFrame:
    """Counts averaged over all members of a key, those without the bitstring counting zero, rounded half to even.

    Members are counted over the whole key; keys without members give no rows.
    """
    per_member = counts.groupBy(*keys, "bitstring", member).agg(F.sum("count").alias("count"))
    totals = per_member.groupBy(*keys, "bitstring").agg(F.sum("count").alias("total"))
    members = counts.groupBy(*keys).agg(F.countDistinct(member).alias("members"))
    joined = totals.join(members, list(keys)) if keys else totals.withColumn("members", F.lit(members.first()["members"]))
    return joined.select(*keys, "bitstring", F.bround(F.col("total") / F.col("members")).cast("bigint").alias("count"))


def probabilities(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts with their share ``p`` of the run's total, NULL where the total is zero. Without keys all rows are one run, whose total
    is added up first."""
    if not keys:
        return counts.withColumn("p", F.try_divide(F.col("count").cast("double"), F.lit(counts.agg(F.sum("count")).first()[0]).cast("double")))
    return counts.withColumn("p", F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy(*keys))))


def aligned(engine: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Both runs' shares over their joint support: keys, bitstring, p (engine), q (reference).

    Zero counts belong to the support. A run whose total is zero has NULL shares. Runs without counts (states) are refused.
    """
    if not {"bitstring", "count"} <= set(engine.columns) & set(reference.columns):
        raise ValueError("both runs need counts")
    one, two = sum_counts(engine, *keys), sum_counts(reference, *keys)
    a = probabilities(one, *keys).select(*keys, "bitstring", F.col("p").alias("_p"), F.lit(1).alias("_a"))
    b = probabilities(two, *keys).select(*keys, "bitstring", F.col("p").alias("_q"), F.lit(1).alias("_b"))
    joined = a.join(b, [*keys, "bitstring"], "full")
    return joined.select(*keys, "bitstring", F.when(F.col("_a").isNull(), 0.0).otherwise(F.col("_p")).alias("p"), F.when(F.col("_b").isNull(), 0.0).otherwise(F.col("_q")).alias("q"))


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(F.sum(F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2.0)))) / F.sqrt(F.lit(2.0))


def kl(p: Column, q: Column, epsilon: float = 1e-12) -> Column:
    """Sum of p ln(p / q) with both floored at epsilon (not renormalised)."""
    if epsilon <= 0:
        raise ValueError("epsilon must be above 0")
    a, b = F.greatest(p, F.lit(epsilon)), F.greatest(q, F.lit(epsilon))
    return F.sum(a * F.ln(a / b))


def r2(p: Column, q: Column) -> Column:
    """1 - residual / total squares of q about its mean over the support; for a constant q 1 if equal, else 0."""
    residual = F.sum(F.pow(p - q, F.lit(2.0)))
    spread = F.var_pop(q) * F.count(q)
    flat = F.max(q) == F.min(q)
    return F.when(flat, F.when(F.max(F.abs(p - q)) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(residual, spread))


#: A metric of two runs: an aggregate over their aligned shares p and q.
Metrics = dict[str, Callable[[Column, Column], Column]]


def compare_counts(engine: DataFrame, reference: DataFrame, keys: list[str], metrics: Metrics | None = None) -> DataFrame:
    """keys and the metrics (the three count metrics if none are given); NaN where a run has no counts to speak of."""
    metrics = dict(zip(COUNT_METRICS, (hellinger, kl, r2))) if metrics is None else metrics
    p, q = F.col("p"), F.col("q")
    ok = (F.count(p) == F.count("*")) & (F.count(q) == F.count("*"))
    bad = F.lit(float("nan"))
    pairs = aligned(engine, reference, keys).groupBy(*keys)
    return pairs.agg(*[F.when(ok, m(p, q)).otherwise(bad).alias(name) for name, m in metrics.items()])


def benchmark(engine: DataFrame, reference: DataFrame, metrics: Metrics | None = None, states: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The metric grid: circuit_id, circuit_name, metric_id, metric_name, engine_value, reference_value, delta.

    Circuits pair by ``circuit_id`` (names may repeat); unnamed ones are called 'circuit'. metrics: own ones by name instead of the three
    count metrics, in their order. states: both runs' states (circuit_id, i, j, re, im), which add the state fidelity. The
    reference's own value is that metric of the reference against itself. What can't be computed is NaN, and so is its delta.
    """
    names = reference.groupBy("circuit_id").agg(F.max(F.coalesce(F.nullif("circuit_name", F.lit("")), F.lit("circuit"))).alias("circuit_name"))
    ours, own = compare_counts(engine, reference, ["circuit_id"], metrics), compare_counts(reference, reference, ["circuit_id"], metrics)
    columns = ours.columns[1:]
    if states is not None:
        ours = ours.join(fidelity(*states), "circuit_id", "left")
        own = own.join(fidelity(states[1], states[1]), "circuit_id", "left")
        columns = [*columns, "state_fidelity"]
    own = own.select("circuit_id", *[F.col(m).alias(f"own_{m}") for m in columns])
    nan = F.lit(float("nan"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("metric_id"), F.lit(m).alias("metric_name"), F.coalesce(m, nan).alias("engine_value"), F.coalesce(f"own_{m}", nan).alias("reference_value")) for i, m in enumerate(columns)])).alias("m")
    return ours.join(own, "circuit_id").join(names, "circuit_id").select("circuit_id", "circuit_name", rows).select("circuit_id", "circuit_name", "m.*", (F.col("m.engine_value") - F.col("m.reference_value")).alias("delta"))


def fidelity_qubit(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Fidelity of two one-qubit states (p00, p11, re01, im01 each): Tr(ab) + 2 sqrt(det a det b)."""
    trace = a[0] * b[0] + a[1] * b[1] + 2 * (a[2] * b[2] + a[3] * b[3])
    det = lambda s: F.greatest(s[0] * s[1] - s[2] * s[2] - s[3] * s[3], F.lit(0.0))
    return trace + 2 * F.sqrt(det(a) * det(b))


def _root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.conj().T) / 2)
    return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.conj().T


def fidelity_of(rho: np.ndarray, sigma: np.ndarray) -> float:
    """(Tr sqrt(sqrt(rho) sigma sqrt(rho)))^2"""
    root = _root(rho)
    inner = root @ sigma @ root
    return float(np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.conj().T) / 2), 0, None)).sum() ** 2)


def fidelity(engine: DataFrame, reference: DataFrame, key: str = "circuit_id") -> DataFrame:
    """Fidelity per key of two states given as rows (key, i, j, re, im): key, state_fidelity.

    A state is one group of 4^n rows for n qubits and is computed in one task. Keys on one side only, and states of
    different size, give NaN.
    """

    def one(key_values: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def matrix(rows: pd.DataFrame) -> np.ndarray:
            n = int(rows[["i", "j"]].to_numpy().max()) + 1 if len(rows) else 0
            m = np.zeros((n, n), dtype=complex)
            m[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
            return m

        rho, sigma = matrix(a), matrix(b)
        value = fidelity_of(rho, sigma) if rho.shape == sigma.shape and len(rho) else float("nan")
        return pd.DataFrame({key: [key_values[0]], "state_fidelity": [value]})

    kind = dict(engine.dtypes)[key]
    return engine.groupBy(key).cogroup(reference.groupBy(key)).applyInPandas(one, f"{key} {kind}, state_fidelity double")
