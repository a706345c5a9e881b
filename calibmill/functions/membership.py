"""Membership functions over a scalar column, as native expressions.

A membership is a pair (low, high) of columns with 0 <= low <= high <= 1; both are the same for Type-1 shapes.
Parameters are literals, so Catalyst folds them and a shape stays inside whole-stage code generation. Invalid
parameters raise ValueError on the driver. NULL gives NULL; NaN gives NULL except for the tanh shape, whose
clipping makes it 1.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Membership(NamedTuple):
    """Degrees of membership: the same column twice where they are crisp."""

    low: Column
    high: Column

    @property
    def midpoint(self) -> Column:
        return 0.5 * (self.low + self.high)

    @property
    def width(self) -> Column:
        return self.high - self.low

    @property
    def is_crisp(self) -> Column:
        return self.low == self.high

    @property
    def is_valid(self) -> Column:
        """Whether 0 <= low <= high <= 1; false for NULL and NaN."""
        return F.coalesce((self.low >= 0) & (self.low <= self.high) & (self.high <= 1), F.lit(False))

    def struct(self) -> Column:
        return F.struct(self.low.alias("low"), self.high.alias("high"))


class Shape(ABC):
    """What a membership function has to provide; subclass it to bring your own."""

    #: Whether low and high differ.
    interval: bool = False

    def __init__(self, *values: float) -> None:
        self.set_parameters(values)

    @property
    def parameters(self) -> tuple[float, ...]:
        return self._values

    @property
    def parameter_count(self) -> int:
        return len(self._values)

    def set_parameters(self, values: Sequence[float]) -> None:
        values = tuple(float(v) for v in values)
        self.check(values)
        self._values = values

    @abstractmethod
    def check(self, values: tuple[float, ...]) -> None:
        """Raise ValueError for parameters that make no shape."""

    @abstractmethod
    def degree(self, x: Column) -> Membership: ...


def _need(values: tuple, names: str, ok: bool, what: str) -> None:
    if len(values) != len(names.split()) or not ok:
        raise ValueError(f"({names}) = {values}: {what}")


def _number(x: Column, y: Column) -> Column:
    """y where x is a number, NULL where it is NaN or NULL."""
    return F.when(~F.isnan(x), y)


def _bell(x: Column, center: float, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow((x - center) / sigma, F.lit(2.0)))


class Gaussian(Shape):
    """center, sigma > 0"""

    def check(self, values: tuple[float, ...]) -> None:
        _need(values, "center sigma", len(values) == 2 and values[1] > 0, "sigma must be above 0")

    def degree(self, x: Column) -> Membership:
        mu = _number(x, _bell(x, *self.parameters))
        return Membership(mu, mu)


class Triangular(Shape):
    """a < b < c: 0 at a and c and beyond, 1 at b"""

    def check(self, values: tuple[float, ...]) -> None:
        _need(values, "a b c", len(values) == 3 and values[0] < values[1] < values[2], "a < b < c must hold")

    def degree(self, x: Column) -> Membership:
        a, b, c = self.parameters
        mu = _number(x, F.when((x <= a) | (x >= c), 0.0).when(x <= b, (x - a) / (b - a)).otherwise((c - x) / (c - b)))
        return Membership(mu, mu)


class Trapezoidal(Shape):
    """a < b <= c < d: 1 from b to c, 0 at a and d and beyond"""

    def check(self, values: tuple[float, ...]) -> None:
        _need(values, "a b c d", len(values) == 4 and values[0] < values[1] <= values[2] < values[3], "a < b <= c < d must hold")

    def degree(self, x: Column) -> Membership:
        a, b, c, d = self.parameters
        mu = _number(x, F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c)))
        return Membership(mu, mu)


class TanhPulse(Shape):
    """left < right, two slopes > 0: the difference of two tanh steps, halved and clipped to 0..1"""

    def check(self, values: tuple[float, ...]) -> None:
        _need(values, "left right slope_left slope_right", len(values) == 4 and values[0] < values[1] and values[2] > 0 and values[3] > 0, "left < right and slopes above 0 must hold")

    def degree(self, x: Column) -> Membership:
        left, right, rise, fall = self.parameters
        raw = 0.5 * (F.tanh(rise * (x - left)) - F.tanh(fall * (x - right)))
        mu = F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
        return Membership(mu, mu)


class IntervalGaussian(Shape):
    """center, 0 < sigma_low < sigma_high: a band between two bells"""

    interval = True

    def check(self, values: tuple[float, ...]) -> None:
        _need(values, "center sigma_low sigma_high", len(values) == 3 and 0 < values[1] < values[2], "0 < sigma_low < sigma_high must hold")

    def degree(self, x: Column) -> Membership:
        center, narrow, wide = self.parameters
        return Membership(_number(x, _bell(x, center, narrow)), _number(x, _bell(x, center, wide)))


class Custom(Shape):
    """A shape given by a vectorised Python function of a pandas Series: the slow path for what expressions can't say."""

    def __init__(self, function: Callable[[pd.Series], pd.Series], *values: float) -> None:
        self._udf = F.pandas_udf(function, "double")
        super().__init__(*values)

    def check(self, values: tuple[float, ...]) -> None:
        if any(math.isnan(v) for v in values):
            raise ValueError("a parameter is NaN")

    def degree(self, x: Column) -> Membership:
        mu = self._udf(x)
        return Membership(mu, mu)
