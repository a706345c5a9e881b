"""calibmill: a Spark-first engine for device-calibration data under uncertainty."""

from calibmill.functions.membership import Custom, Gaussian, IntervalGaussian, Shape, TanhPulse, Trapezoidal, Triangular
from calibmill.operators.metrics import benchmark, compare_counts
from calibmill.operators.parsing import parse_qubits, parse_snapshots, read_bodies
from calibmill.operators.rules import RuleBase, defuzzify, ensemble, firing
from calibmill.plans.pipeline import NoisePipeline
from calibmill.session import get_spark
from calibmill.sources.archive import archive_table, list_timestamps, load_one, save_if_new

__version__ = "0.2.0"
__all__ = [
    "Custom", "Gaussian", "IntervalGaussian", "NoisePipeline", "RuleBase", "Shape", "TanhPulse", "Trapezoidal", "Triangular", "archive_table",
    "benchmark", "compare_counts", "defuzzify", "ensemble", "firing", "get_spark", "list_timestamps", "load_one", "parse_qubits", "parse_snapshots",
    "read_bodies", "save_if_new",
]
