"""Squashing of raw outputs to probabilities, elementwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Squash = Callable[[Column], Column]


def identity(x: Column) -> Column:
    return x


def clip(x: Column) -> Column:
    """x within 0..1; NaN stays NaN (Spark's least and greatest would swallow it)."""
    return F.when(F.isnan(x), x).otherwise(F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x))


def sigmoid(x: Column) -> Column:
    """The logistic function in the branch whose exponential can't overflow."""
    down = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + down)).otherwise(down / (1.0 + down))


def over_array(squash: Squash) -> Squash:
    return lambda xs: F.transform(xs, squash)
