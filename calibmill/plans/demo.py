"""A demo job: the preset over a snapshot, ensembles of growing size on a Fourier transform, averaged counts, and a longer run."""

from __future__ import annotations

import argparse
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibmill.operators import circuits, metrics, parsing, rules
from calibmill.session import get_spark
from calibmill.sources.archive import synthetic_body

#: Shots of the last run, a single member's.
LONG_RUN = 8192


def snapshot_features(spark: SparkSession, path: str | None = None) -> DataFrame:
    """path and the three features of a snapshot file, or of a synthetic snapshot. Numbers are taken as they are written: the preset
    knows seconds, and its synthetic snapshot states no units."""
    bodies = spark.createDataFrame([("synthetic", synthetic_body(datetime(2026, 5, 1, tzinfo=UTC)))], "path string, body string") if path is None else parsing.read_bodies(spark, path)
    rows = parsing.nduv_rows(parsing.strict(parsing.parse_snapshots(bodies))).where("name is not null")
    return parsing.feature_vector(rows.select("path", "name", parsing.number_of(F.col("value")).alias("number")), "path")


def preset_members(spark: SparkSession, size: int, path: str | None = None) -> DataFrame:
    """Members of the preset's ensemble for a snapshot (synthetic: T1 = T2 = 50e-6 s, readout error 0.01); an identity channel fails."""
    done = rules.ensemble(rules.strict(rules.guard_identity(rules.defuzzify(snapshot_features(spark, path), rules.preset_base(), ["path"]))), size)
    member = F.when(F.col("degenerate"), F.raise_error(F.lit("the rules give an identity channel"))).otherwise(F.col("member"))
    return done.select(member.alias("member"), F.col("out_0").alias("gamma"), F.col("out_1").alias("lam"))


def ensemble_times(spark: SparkSession, sizes: tuple[int, ...] = (1, 8, 16), shots: int = 1024, qubits: int = 2, path: str | None = None) -> dict[int, float]:
    """Seconds per ensemble size to simulate a Fourier transform of so many qubits and average the counts."""
    gates = circuits.gate_table(spark, circuits.qft(qubits))
    out = {}
    for size in sizes:
        began = time.time()
        counts = metrics.mean_counts(circuits.simulate(gates, preset_members(spark, size, path), shots=shots), "circuit_id")
        print(size, {r["bitstring"]: r["count"] for r in counts.collect()})  # one circuit's outcomes
        out[size] = time.time() - began
    return out


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--qubits", type=int, default=2)
    p.add_argument("--shots", type=int, default=1024)
    p.add_argument("--snapshot", help="a snapshot file (JSON); without it a synthetic one")
    args = p.parse_args()
    spark = get_spark("demo")
    for size, seconds in ensemble_times(spark, shots=args.shots, qubits=args.qubits, path=args.snapshot).items():
        print(f"{size} members: {seconds:.2f} s")
    print("one member, a longer run:")
    ensemble_times(spark, (1,), LONG_RUN, args.qubits, args.snapshot)


if __name__ == "__main__":
    main()
