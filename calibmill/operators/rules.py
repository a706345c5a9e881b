"""First-order Takagi-Sugeno-Kang rules over the rows of a table.

Two forms give the same results, row by row and without a shuffle. The compiled form writes a small rule base into expressions:
every membership degree is one column shared by all rules, and the sums over rules are nested input by input. The array form
keeps rules and consequents as constant arrays that vectorised code folds over, batch by batch; it suits large bases, whose
expressions would outgrow compiled code. A base is small by the count of its rules, known before anything runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibmill.functions.membership import Shape
from calibmill.functions.squash import Squash, clip

#: Rules up to which a base is compiled into expressions.
COMPILE_UP_TO = 64


@dataclass(frozen=True)
class RuleBase:
    """Shapes per input, the shapes each rule uses, and each rule's consequent (outputs x (inputs + 1), the last a constant)."""

    inputs: tuple[str, ...]
    shapes: tuple[tuple[Shape, ...], ...]
    rules: tuple[tuple[int, ...], ...]
    consequents: np.ndarray = field(repr=False)

    def __post_init__(self) -> None:
        if not self.rules:
            raise ValueError("a rule base needs a rule")
        if not self.inputs or len(self.inputs) != len(self.shapes) or not all(self.shapes):
            raise ValueError("every input needs a shape")
        for rule in self.rules:
            if len(rule) != len(self.inputs) or not all(0 <= i < len(s) for i, s in zip(rule, self.shapes)):
                raise ValueError(f"rule {rule} doesn't fit {len(self.inputs)} inputs")
        c = np.asarray(self.consequents, dtype=float)
        if c.ndim != 3 or c.shape[0] != len(self.rules) or c.shape[2] != len(self.inputs) + 1:
            raise ValueError(f"consequents have shape {c.shape}; (rules, outputs, inputs + 1) is needed")
        object.__setattr__(self, "consequents", c)

    @classmethod
    def grid(cls, shapes: dict[str, Sequence[Shape]], outputs: int, start: str = "zeros", seed: int | None = None) -> RuleBase:
        """Every combination of shapes, the last input's varying fastest; consequents zero or small seeded normal numbers."""
        if start not in ("zeros", "random"):
            raise ValueError(f"consequents start as zeros or random, not {start!r}")
        rules = tuple(product(*(range(len(s)) for s in shapes.values())))
        size = (len(rules), outputs, len(shapes) + 1)
        numbers = np.zeros(size) if start == "zeros" else np.random.default_rng(seed).standard_normal(size) * 0.1
        return cls(tuple(shapes), tuple(tuple(s) for s in shapes.values()), rules, numbers)

    @property
    def outputs(self) -> int:
        return self.consequents.shape[1]

    @property
    def interval(self) -> bool:
        return any(self.shapes[i][k].interval for rule in self.rules for i, k in enumerate(rule))

    # -- compiled -----------------------------------------------------------------------------------------------

    def with_degrees(self, rows: DataFrame) -> DataFrame:
        """The rows with a low and a high degree per input and shape: _mf_<input>_<shape>_lo / _hi.

        Degrees of missing inputs are 0 here and the inputs themselves 0 in ``_x_<input>``: columns that can't be NULL keep the
        code of all rules free of NULL checks. Whoever uses them masks such rows (``missing``).
        """
        columns: dict[str, Column] = {f"_x_{i}": F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for i, name in enumerate(self.inputs)}
        for i, name in enumerate(self.inputs):
            for k, shape in enumerate(self.shapes[i]):
                degree = shape.degree(F.col(name))
                columns[f"_mf_{i}_{k}_lo"] = F.coalesce(degree.low, F.lit(0.0))
                if shape.interval:
                    columns[f"_mf_{i}_{k}_hi"] = F.coalesce(degree.high, F.lit(0.0))
        return rows.withColumns(columns)

    def _side(self, i: int, k: int, side: str) -> Column:
        return F.col(f"_mf_{i}_{k}_{side if self.shapes[i][k].interval else 'lo'}")

    def strengths(self, rule: int) -> tuple[Column, Column]:
        """Lower and upper firing strength of a rule: the product of its degrees."""
        times = lambda side: reduce(lambda a, b: a * b, (self._side(i, k, side) for i, k in enumerate(self.rules[rule])))
        low = times("lo")
        return low, times("hi") if self.interval else low

    def consequent(self, rule: int, output: int) -> Column:
        *slopes, constant = self.consequents[rule, output].tolist()
        return sum((F.lit(a) * F.col(f"_x_{i}") for i, a in enumerate(slopes)), F.lit(constant))

    def missing(self) -> Column:
        """Whether an input is NULL or NaN."""
        return reduce(lambda a, b: a | b, (F.col(x).isNull() | F.isnan(F.col(x).cast("double")) for x in self.inputs))

    def nested(self, side: str, leaf: Callable[[int], Column | None], rules: Sequence[int] | None = None, i: int = 0) -> Column | None:
        """The sum over rules of firing strength times ``leaf``, input by input: each degree times the sum of what lies below it.

        A leaf of None stands for 1.
        """
        rules = range(len(self.rules)) if rules is None else rules
        if i == len(self.inputs):
            leaves = [leaf(r) for r in rules]
            return reduce(lambda a, b: a + b, leaves) if leaves[0] is not None else F.lit(float(len(leaves))) if len(leaves) > 1 else None
        groups: dict[int, list[int]] = {}
        for r in rules:
            groups.setdefault(self.rules[r][i], []).append(r)
        below = {k: self.nested(side, leaf, group, i + 1) for k, group in groups.items()}
        return reduce(lambda a, b: a + b, (self._side(i, k, side) if x is None else self._side(i, k, side) * x for k, x in below.items()))

    # -- as an array --------------------------------------------------------------------------------------------

    def table(self, spark: SparkSession) -> DataFrame:
        """rule_id, mf_ids, consequent: the base as rows."""
        return spark.range(1).select(F.explode(self.literal()).alias("r")).select("r.*")

    @property
    def form(self) -> str:
        """The form that suits the base's size."""
        return "compiled" if len(self.rules) <= COMPILE_UP_TO else "array"

    def arrays(self) -> list[Column]:
        """Columns for meeting the rules one by one: inputs with a 1 behind them, and low and high degrees per input."""
        degrees = lambda side: F.array(*[F.array(*[self._side(i, k, side) for k in range(len(s))]) for i, s in enumerate(self.shapes)])
        return [F.array(*[F.col(f"_x_{i}") for i in range(len(self.inputs))], F.lit(1.0)).alias("_x"), degrees("lo").alias("_lo"), degrees("hi").alias("_hi")]

    def numbers(self, bounds: Sequence[str]) -> list[Column]:
        """What ``folded`` reads: inputs, then the degrees of each bound, input by input."""
        return [F.col(f"_x_{i}") for i in range(len(self.inputs))] + [self._side(i, k, b) for b in bounds for i, s in enumerate(self.shapes) for k in range(len(s))]

    def folded(self, bounds: Sequence[str]) -> Callable[[str], Column]:
        """The sums of strengths and of weighted consequents of each bound over all rules, vectorised over rows and taken rule by rule,
        so that memory doesn't grow with the base."""
        n, sizes = len(self.inputs), [len(s) for s in self.shapes]
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist()
        rules, consequents, outputs, each = self.rules, self.consequents, self.outputs, sum(sizes)

        @F.pandas_udf("array<double>")
        def fold(rows: pd.Series) -> pd.Series:
            v = np.stack(rows.to_numpy()) if len(rows) else np.empty((0, n + each * len(bounds)))
            v = np.ascontiguousarray(v.T)
            x = np.vstack([v[:n], np.ones(v.shape[1])])
            out = np.zeros((len(bounds) * (1 + outputs), v.shape[1]))
            for rule, consequent in zip(rules, consequents):
                y = consequent @ x
                for b in range(len(bounds)):
                    f = np.prod(v[[n + b * each + first[i] + k for i, k in enumerate(rule)]], axis=0)
                    out[b] += f
                    at = len(bounds) + b * outputs
                    out[at : at + outputs] += f * y
            return pd.Series(list(out.T))

        return fold

    def literal(self) -> Column:
        """The rules as one constant array, so that rows meet rules by exploding it, without a join."""
        rows = [{"rule_id": r, "mf_ids": list(rule), "consequent": self.consequents[r].tolist()} for r, rule in enumerate(self.rules)]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:int,mf_ids:array<int>,consequent:array<array<double>>>>")


def _strength(rule: Column, degrees: str) -> Column:
    """The product of the degrees of a rule (a struct of ``literal``)."""
    return F.aggregate(F.zip_with(F.col(degrees), rule["mf_ids"], lambda d, k: d[k]), F.lit(1.0), lambda a, d: a * d)


def _line(consequent: Column) -> Column:
    """One output of a consequent at the row's inputs."""
    return F.aggregate(F.zip_with(consequent, "_x", lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v)


def firing(rows: DataFrame, base: RuleBase, keys: Sequence[str], form: str | None = None) -> DataFrame:
    """A row per row and rule: keys, rule_id, f, f_low, f_high, y. ``f`` is the midpoint for interval bases, whose bounds
    are kept; for others the bounds are NULL. A row with a NULL or NaN input fires with NULL. Small bases are written out
    rule by rule, which compiles; large ones are a constant array that rows meet by exploding it."""
    form = form or base.form
    degrees = base.with_degrees(rows.select(*keys, *[c for c in base.inputs if c not in keys])).withColumn("_missing", base.missing())
    if form == "compiled":
        numbers: dict[str, Column] = {}
        for r in range(len(base.rules)):
            low, high = base.strengths(r)
            numbers |= {f"_l_{r}": low} | ({f"_h_{r}": high} if base.interval else {}) | {f"_y_{r}_{o}": base.consequent(r, o) for o in range(base.outputs)}
        structs = [F.struct(F.lit(r).alias("rule_id"), F.col(f"_l_{r}").alias("_l"), F.col(f"_h_{r}" if base.interval else f"_l_{r}").alias("_h"), F.array(*[F.col(f"_y_{r}_{o}") for o in range(base.outputs)]).alias("y")) for r in range(len(base.rules))]
        held = list(dict.fromkeys([*keys, "_missing"]))
        out = degrees.select(*held, *[c.alias(n) for n, c in numbers.items()]).select(*held, F.explode(F.array(*structs)).alias("_r")).select(*held, "_r.*")
    else:
        met = degrees.select(*keys, "_missing", *base.arrays(), F.explode(base.literal()).alias("_r"))
        r = F.col("_r")
        out = met.select(*keys, "_missing", r["rule_id"].alias("rule_id"), _strength(r, "_lo").alias("_l"), _strength(r, "_hi").alias("_h"), F.transform(r["consequent"], _line).alias("y"))
    there = lambda c: F.when(~F.col("_missing"), c)
    y = there(F.col("y")).alias("y")
    if base.interval:
        return out.select(*keys, "rule_id", there(0.5 * (F.col("_l") + F.col("_h"))).alias("f"), there(F.col("_l")).alias("f_low"), there(F.col("_h")).alias("f_high"), y)
    none = F.lit(None).cast("double")
    return out.select(*keys, "rule_id", there(F.col("_l")).alias("f"), none.alias("f_low"), none.alias("f_high"), y)


OK, NO_INPUT, NO_FIRING, NOT_INTERVAL = "ok", "missing input", "no rule fires", "bounds need interval rules"


#: An own way from the rules' sums to an output: it gets the total strengths t_low and t_high and the weighted consequents w_low and w_high.
Defuzzifier = Callable[[dict[str, Column]], Column]


def defuzzify(rows: DataFrame, base: RuleBase, keys: Sequence[str], method: str | Defuzzifier = "weighted", squash: Squash = clip, form: str | None = None) -> DataFrame:
    """Outputs out_0, out_1, ... per row, squashed, with raw_<i> before squashing and a status.

    method 'weighted': the average of the consequents by firing strength. 'two_bound': the mean of the averages by lower and
    by upper strength, each normalised by itself; it needs an interval base. An own method makes each output of the sums. Rows that can't be computed have NULLs and say
    why in ``status``. form: 'compiled', 'array' or by size; both give a row per row, whatever the keys.
    """
    if method not in ("weighted", "two_bound") and not callable(method):
        raise ValueError(f"no such method: {method!r}")
    form = form or base.form
    sides = ("mid",) if method == "weighted" else ("low", "high")
    bounds = ("lo", "hi") if base.interval else ("lo",)
    missing = base.missing()
    degrees = base.with_degrees(rows)
    if form == "compiled":
        ys = degrees.withColumns({f"_y_{r}_{o}": base.consequent(r, o) for r in range(len(base.rules)) for o in range(base.outputs)})
        # The sums of each bound come out of a generator of one row. It keeps their code apart in methods that the JVM still
        # compiles, and a later filter on status or outputs can't be pushed beneath it, where it would write the base out again.
        sums = ys.withColumn("_missing", missing)
        for b in bounds:
            part = {f"_t_{b}": base.nested(b, lambda r: None)} | {f"_w_{b}_{o}": base.nested(b, lambda r: F.col(f"_y_{r}_{o}")) for o in range(base.outputs)}  # noqa: B023
            sums = sums.withColumns(part).withColumn(f"_s_{b}", F.explode(F.array(F.struct(*part)))).drop(*part)
        sums = sums.select(*keys, "_missing", *[f"_s_{b}.*" for b in bounds])
    else:
        values = degrees.select(*keys, missing.alias("_missing"), F.array(*base.numbers(bounds)).alias("_v"))
        done = [f"_t_{b}" for b in bounds] + [f"_w_{b}_{o}" for b in bounds for o in range(base.outputs)]
        sums = values.withColumn("_s", base.folded(bounds)("_v")).select(*keys, "_missing", *[F.col("_s")[i].alias(name) for i, name in enumerate(done)])
    of = {"low": "lo", "high": bounds[-1]}
    part = lambda kind, s, o="": F.col(f"_{kind}_{of[s]}{o}") if s in of else sum((F.col(f"_{kind}_{b}{o}") for b in bounds[1:]), F.col(f"_{kind}_lo{o}")) / len(bounds)
    sums = sums.select(*keys, "_missing", *[part("t", s).alias(f"_t_{s}") for s in sides], *[part("w", s, f"_{o}").alias(f"_w_{s}_{o}") for s in sides for o in range(base.outputs)])
    raw = {}
    for o in range(base.outputs):
        parts = [F.try_divide(F.col(f"_w_{s}_{o}"), F.col(f"_t_{s}")) for s in sides]
        if callable(method):
            raw[o] = method({f"t_{s}": F.col(f"_t_{s}") for s in sides} | {f"w_{s}": F.col(f"_w_{s}_{o}") for s in sides})
        else:
            raw[o] = parts[0] if len(parts) == 1 else 0.5 * (parts[0] + parts[1])
    silent = reduce(lambda a, b: a | b, (F.col(f"_t_{s}") == 0 for s in sides))
    status = F.when(F.col("_missing"), NO_INPUT).when(F.lit(method == "two_bound" and not base.interval), NOT_INTERVAL).when(F.coalesce(silent, F.lit(True)), NO_FIRING).otherwise(OK)
    out = sums.withColumn("status", status).withColumns({f"raw_{o}": F.when(F.col("status") == OK, raw[o]) for o in raw})
    return out.select(*keys, *[f"raw_{o}" for o in raw], *[squash(F.col(f"raw_{o}")).alias(f"out_{o}") for o in raw], "status")


def strict(rows: DataFrame, status: str = "status") -> DataFrame:
    """The same rows, but the job fails at one whose status isn't ok."""
    return rows.withColumn(status, F.when(F.col(status) == OK, F.col(status)).otherwise(F.raise_error(F.col(status))))


# The preset's range of each feature.
PRESET_SCALES = {"mean_T1": (0.0, 100e-6), "mean_T2": (0.0, 100e-6), "mean_readout_error": (0.0, 0.1)}


def preset_base(seed: int = 0) -> RuleBase:
    """Eight rules over mean T1, T2 (seconds) and readout error: two bells per feature, seeded random consequents, two outputs."""
    from calibmill.functions.membership import Gaussian

    shapes = {name: [Gaussian(lo, (hi - lo) / 4), Gaussian(lo + (hi - lo) / 2, (hi - lo) / 4)] for name, (lo, hi) in PRESET_SCALES.items()}
    return RuleBase.grid(shapes, outputs=2, start="random", seed=seed)


def guard_identity(rows: DataFrame) -> DataFrame:
    """Marks rows whose first two outputs are not above 0, an identity channel: column ``degenerate``."""
    return rows.withColumn("degenerate", ~F.coalesce((F.col("out_0") > 0) | (F.col("out_1") > 0), F.lit(False)))


def ensemble(rows: DataFrame, size: int = 32) -> DataFrame:
    """Each row once per member. Members are identical, so the pipeline is computed once and its result repeated."""
    if size <= 0:
        raise ValueError("an ensemble needs a member")
    return rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
