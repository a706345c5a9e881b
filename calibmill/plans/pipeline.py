"""The noise pipeline with every stage exchangeable: the extension surface of the engine.

Each stage is a function over DataFrames or columns, so an own one stays inside the plan as long as it is made of built-in
functions; where it can't be, it may use vectorised Python functions like any DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibmill.functions import squash as squashing
from calibmill.operators import channels, metrics, parsing, rules


class FeatureExtractor(Protocol):
    """Entries (keys, name, number) to one row per key with a column per feature."""

    def __call__(self, entries: DataFrame, *keys: str) -> DataFrame: ...


class Evaluate(Protocol):
    """Rows with the rules' inputs to raw and squashed outputs (raw_0, out_0, ..., status) per key."""

    def __call__(self, rows: DataFrame, base: rules.RuleBase, keys: Sequence[str], method: str | rules.Defuzzifier, squash: squashing.Squash) -> DataFrame: ...


class Project(Protocol):
    """Rows with ``params`` and ``qubits`` to rows with ``kraus`` and ``channel_status``."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Install(Protocol):
    """Gates and channels to the gates that carry noise."""

    def __call__(self, gates: DataFrame, channels: DataFrame) -> DataFrame: ...


class Metric(Protocol):
    """An aggregate over two aligned distributions p and q."""

    def __call__(self, p: Column, q: Column) -> Column: ...


#: Stages by name; the names of None have no defined result.
NAMED = {
    "project": {"damping": channels.project, "nearest channel": None},
    "normalise": {"none": channels.no_normalisation, "derivative": None},
    "install": {"after gates": channels.install_after_gates, "before gates": None, "between gates": None},
}


@dataclass
class NoisePipeline:
    """The pipeline. ``project``, ``normalise`` and ``install`` are functions or one of the names of ``NAMED``; names without a defined
    result raise NotImplementedError. ``method`` is a name or an own defuzzifier."""

    base: rules.RuleBase
    extract: FeatureExtractor = parsing.feature_vector
    evaluate: Evaluate = rules.defuzzify
    method: str | rules.Defuzzifier = "weighted"
    squash: squashing.Squash = squashing.clip
    project: Project | str = channels.project
    normalise: Callable[[Column], Column] | str = channels.no_normalisation
    install: Install | str = channels.install_after_gates
    metrics: dict[str, Metric] = field(default_factory=lambda: {"hellinger_distance": metrics.hellinger, "kl_divergence": metrics.kl, "r2_score": metrics.r2})

    def __post_init__(self) -> None:
        for stage, known in NAMED.items():
            name = getattr(self, stage)
            if isinstance(name, str):
                if name not in known:
                    raise ValueError(f"no such {stage}: {name!r}")
                setattr(self, stage, known[name] or channels.unsupported(name))

    def parameters(self, entries: DataFrame, *keys: str) -> DataFrame:
        """Per key the outputs of the rules, as an array ``params``, and a status."""
        rows = self.extract(entries, *keys)
        inputs = [c for c in self.base.inputs if c in rows.columns]
        done = self.evaluate(rows.select(*keys, *inputs), self.base, list(keys), self.method, self.squash)
        return parsing.hold(done, params=F.when(F.col("status") == rules.OK, F.array(*[F.col(f"out_{o}") for o in range(self.base.outputs)])))

    def channels(self, entries: DataFrame, *keys: str) -> DataFrame:
        """Per key the channel of its parameters on a single qubit."""
        rows = self.project(self.parameters(entries, *keys).withColumn("qubits", F.array(F.lit(0))))
        return parsing.hold(rows.withColumnRenamed("kraus", "_kraus"), kraus=self.normalise(F.col("_kraus"))).drop("_kraus")

    def compare(self, engine: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
        """keys and every metric of the pipeline over two runs' counts."""
        return metrics.compare_counts(engine, reference, keys, self.metrics)

    def benchmark(self, engine: DataFrame, reference: DataFrame, states: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """The metric grid over the pipeline's metrics, with the state fidelity where both runs' states are given."""
        return metrics.benchmark(engine, reference, self.metrics, states)
