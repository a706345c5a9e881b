"""Implausible readings: physical limits, spikes and stuck values, by an isolation forest per source.

A reading is described relative to its own source: its level (distance from the typical value of its backend,
campaign and qubit), its difference from the nearer of its neighbours in time, its distance from the source's usual level at
that hour, and the length of its run of equal readings. Each feature is cut into ordinal codes, and one
isolation forest per backend is grown over the counts of all its readings by code. Splits are drawn within a node's
box of the code domain, not of the readings, so gaps are cut often and a code that no reading has is isolated too. A branch ends
where it holds no more than a small share of the readings, so a cluster of like faults counts as isolated, like a single one.
With a few codes a feature the forest's score is the same for all readings in one cell of the code grid, so it is
tabulated over the whole grid once and looked up for every reading inside the JVM.

A source's score limit lies in the widest gap of the scores that its readings have, within the range where isolated and usual
readings meet. Only readings above it are candidates; they are then checked exactly. Physical limits are rules of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibmill.operators.units import t1_in_seconds
from calibmill.session import stage

FIELDS = ("t1_seconds", "t2_seconds", "prob_meas0_prep1")
#: A reading is a spike beyond so many times the usual scatter: sound ones stay within 5, spikes lie beyond 10.
SPIKE, RUN = 8.0, 6
#: Scatters per code of level, difference and seasonal distance (sizes without sign), and the codes of each; run lengths are their
#: own codes, the last one for longer runs too.
WIDTHS, SHAPE = (1.0, 3.0, 4.0), (17, 6, 5, RUN + 1)
#: The forest: trees, readings per tree, greatest depth, the share of a tree's readings up to which a branch counts as isolated, and
#: the depth that scores one half.
TREES, PER_TREE, DEPTH, ISOLATED, HALF_DEPTH = 200, 256, 24, 0.05, 6.0
#: The scores among which the limit is sought, its place in the widest gap, and the share of readings below which a cell doesn't
#: bound a gap.
LIMIT_RANGE, IN_GAP, RARE = (0.5, 0.65), 0.4, 2e-4
#: Sources with fewer rows share a forest; the most bytes broadcast.
LEAST_ROWS, BROADCAST_BYTES = 150, 64 << 20
MODEL_DDL = "pool string, score_limit float, scores array<float>"


def grow_forest(cells: np.ndarray, counts: np.ndarray, seed: int = 7, trees: int = TREES, per_tree: int = PER_TREE) -> np.ndarray:
    """Isolation scores (0..1, higher is more isolated) of every cell of the code grid, from the counts of readings by cell."""
    rng = np.random.default_rng(seed)
    codes, total = np.stack(np.unravel_index(cells, SHAPE), axis=1), np.zeros(SHAPE)
    n = int(counts.sum())
    size = min(per_tree, n)
    for _ in range(trees):
        sample = codes[np.repeat(np.arange(len(codes)), rng.multivariate_hypergeometric(counts, size, method="marginals"))] if size < n else np.repeat(codes, counts, axis=0)
        todo = [(tuple(slice(0, k) for k in SHAPE), sample, 0)]
        while todo:
            box, rows, level = todo.pop()
            open_axes = [a for a, s in enumerate(box) if s.stop - s.start > 1]
            if level == DEPTH or len(rows) <= ISOLATED * size or not open_axes:
                total[box] += level
                continue
            axis = open_axes[rng.integers(len(open_axes))]
            cut = int(rng.integers(box[axis].start + 1, box[axis].stop))
            left = rows[:, axis] < cut
            for part, keep in ((slice(box[axis].start, cut), left), (slice(cut, box[axis].stop), ~left)):
                todo.append((box[:axis] + (part,) + box[axis + 1 :], rows[keep], level + 1))
    return np.power(2.0, -total / trees / HALF_DEPTH)


def score_limit(scores: np.ndarray, counts: np.ndarray) -> float:
    """Where candidates begin: within the widest gap between the scores of cells that hold more than a rare reading."""
    low, high = LIMIT_RANGE
    met = scores[(counts > RARE * counts.sum()) & (scores > low) & (scores < high)]
    edges = np.unique(np.concatenate([[low], met, [high]]))
    at = int(np.argmax(np.diff(edges)))
    return float(edges[at] + IN_GAP * (edges[at + 1] - edges[at]))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cell")  # the same forest whatever order the rows come in
    cells, counts = pdf["cell"].to_numpy(), pdf["n"].to_numpy()
    scores = grow_forest(cells, counts).astype(np.float32).ravel()
    return pd.DataFrame({"pool": [pdf["pool"].iloc[0]], "score_limit": [score_limit(scores[cells], counts)], "scores": [scores]})


def _cell(sizes: tuple[Column, Column, Column], run: Column) -> Column:
    """The grid cell of a reading; unknown distances count as none. Few operations, so that it compiles well."""
    out = F.lit(0)
    for x, width, codes in zip(sizes, WIDTHS, SHAPE):
        out = out * codes + F.least(F.coalesce(F.floor(F.abs(x) / width), F.lit(0)), F.lit(codes - 1)).cast("int")
    return out * SHAPE[3] + F.least(F.coalesce(run, F.lit(1)), F.lit(SHAPE[3])).cast("int") - 1


def first_rows(calibration: DataFrame) -> DataFrame:
    """Calibration rows with a mark ``_first`` of those that don't repeat a (snapshot_id, qubit).

    Rows without a snapshot_id repeat none. A snapshot_id belongs to one backend, campaign and ts.
    """
    along = Window.partitionBy("backend", "campaign", "qubit").orderBy("ts", "snapshot_id", "row_id")
    return calibration.withColumn("_first", ~F.coalesce(F.lag("snapshot_id").over(along) == F.col("snapshot_id"), F.lit(False)))


def readings(calibration: DataFrame) -> DataFrame:
    """One row per first row: for each field its impossible mark, deviation, difference, run, and its group's spread.

    All windows share one partitioning and order, so the rows are shuffled and sorted once. A run's length is known at
    its end, as the readings counted there less those counted before its start, and handed back by the next end ahead.
    """
    base = t1_in_seconds(calibration.select("row_id", "snapshot_id", "backend", "campaign", "qubit", "ts", "t1_seconds", "t2_seconds", "prob_meas0_prep1", "note"))
    base = base.select("row_id", "snapshot_id", "backend", "campaign", "qubit", "ts", F.col("t1_common").alias("t1_seconds"), "t2_seconds", "prob_meas0_prep1")
    group, inf = ["backend", "campaign", "qubit"], float("inf")
    order = ["ts", "snapshot_id", "row_id"]
    along = Window.partitionBy(*group).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value, bad = (lambda f: F.col(f"v_{f}")), lambda f: F.col(f"bad_{f}")
    rows = first_rows(base).select("row_id", *group, "ts", "snapshot_id", "_first", *[F.when(F.col("_first") & ~F.isnan(f), F.col(f)).alias(f"v_{f}") for f in FIELDS])
    rows = rows.withColumns({f"bad_{f}": (F.abs(value(f)) == inf) | ((value(f) < 0) | (value(f) > 1) if f.startswith("prob") else value(f) <= 0) for f in FIELDS})
    spec = f"over (partition by {', '.join(group)} order by {', '.join(order)})"
    rows = rows.withColumns(
        {f"b_{f}": F.expr(f"lag(v_{f}, 1) ignore nulls {spec}") for f in FIELDS}
        | {f"a_{f}": F.expr(f"lead(v_{f}, 1) ignore nulls {spec}") for f in FIELDS}
        | {f"n_{f}": F.count(value(f)).over(so_far) for f in FIELDS}
        | {f"q_{f}": F.percentile_approx(F.when(~bad(f), value(f)), [0.25, 0.5, 0.75], 10000).over(Window.partitionBy(*group)) for f in FIELDS}
    )
    differs = lambda f, side: value(f).isNotNull() & ~F.coalesce(F.col(f"{side}_{f}") == value(f), F.lit(False))
    rows = rows.withColumns({f"s_{f}": F.max(F.when(differs(f, "b"), F.col(f"n_{f}"))).over(so_far) for f in FIELDS})
    rows = rows.withColumns({f"r_{f}": F.when(differs(f, "a"), F.col(f"n_{f}") - F.col(f"s_{f}") + 1) for f in FIELDS})
    rows = rows.withColumns({f"e_{f}": F.expr(f"lead(r_{f}, 1) ignore nulls {spec}") for f in FIELDS})

    out = [F.col("row_id"), F.coalesce("backend", F.lit("")).alias("source"), F.hour("ts").cast("tinyint").alias("hour"), (value("t2_seconds") > 2 * value("t1_seconds")).alias("over")]
    for f in FIELDS:
        middle = F.when(F.col(f"q_{f}")[1] > 0, F.col(f"q_{f}")[1])
        sound = F.when(~bad(f), value(f))
        apart = lambda side: F.when(F.abs(F.col(f"{side}_{f}")) < inf, F.abs(sound - F.col(f"{side}_{f}")))  # noqa: B023, E731
        out += [
            bad(f),
            F.try_divide(sound, middle).cast("float").alias(f"ratio_{f}"),
            F.try_divide(F.least(apart("b"), apart("a")), middle).cast("float").alias(f"step_{f}"),
            F.when(value(f).isNotNull(), F.least(F.coalesce(f"r_{f}", f"e_{f}"), F.lit(SHAPE[3]))).cast("tinyint").alias(f"run_{f}"),
            F.when(sound.isNotNull(), F.try_divide(F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0], 1.349 * middle)).cast("float").alias(f"spread_{f}"),
        ]
    return rows.where("_first").select(*out)


def source_scale(rows: DataFrame) -> DataFrame:
    """Per source the forest it belongs to (``pool``) and, per field, its usual relative scatter: the median over readings of
    their group's spread."""
    scatter = [F.percentile_approx(F.when(F.col(f"spread_{f}") > 0, F.col(f"spread_{f}")), 0.5, 1000).alias(f"scatter_{f}") for f in FIELDS]
    return rows.groupBy("source").agg(F.when(F.count("*") >= LEAST_ROWS, F.first("source")).otherwise("").alias("pool"), *scatter)


def _scaled(rows: DataFrame, scale: DataFrame) -> DataFrame:
    return rows.join(scale, "source").withColumns({f"z_{f}": F.try_divide(F.col(f"ratio_{f}").cast("double") - 1, F.col(f"scatter_{f}").cast("double")) for f in FIELDS})


def season(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Per source and hour of day the mean level in scatters, each reading counting for 3 at most."""
    return _scaled(rows, scale).groupBy("source", "hour").agg(*[F.avg(F.least(F.greatest(f"z_{f}", F.lit(-3.0)), F.lit(3.0))).alias(f"season_{f}") for f in FIELDS])


def featured(rows: DataFrame, scale: DataFrame, seasons: DataFrame) -> DataFrame:
    """Readings with their level ``z_``, run and grid cell ``cell_`` per field. ``scale`` and ``seasons`` have a row (24 rows) per source."""
    out = _scaled(rows, scale).join(seasons, ["source", "hour"], "left")
    cells = [F.when(F.col(f"run_{f}") > 0, _cell((F.col(f"z_{f}"), F.try_divide(F.col(f"step_{f}").cast("double"), F.col(f"scatter_{f}").cast("double")), F.col(f"z_{f}") - F.col(f"season_{f}")), F.col(f"run_{f}"))).cast("smallint").alias(f"cell_{f}") for f in FIELDS]
    return out.select("row_id", "source", "pool", "over", *[c for f in FIELDS for c in (f"bad_{f}", f"z_{f}", f"run_{f}")], *cells)


def forests(features: DataFrame) -> DataFrame:
    """A forest per pool as its score table and limit, grown on the counts of all its readings by cell.

    Counts are aggregated before they are shuffled: a pool is as many rows as the grid has cells at most.
    """
    cells = features.select("pool", F.explode(F.array_compact(F.array(*[F.col(f"cell_{f}") for f in FIELDS]))).alias("cell"))
    counts = cells.groupBy("pool", "cell").agg(F.count("*").alias("n"))
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't merged: a forest costs much more than its few rows
    return counts.repartition(tasks, "pool").groupBy("pool").applyInPandas(_fit, MODEL_DDL)


def scored(features: DataFrame, model: DataFrame) -> DataFrame:
    """Every reading with its isolation scores ``score_`` and candidate marks ``cand_``.

    The score tables are broadcast while pools x table size stays below ``BROADCAST_BYTES``; beyond, the join shuffles.
    """
    small = model.count() * int(np.prod(SHAPE)) * 4 <= BROADCAST_BYTES
    joined = features.join(F.broadcast(model) if small else model, "pool", "left")
    out = joined.withColumns({f"score_{f}": F.col("scores")[F.col(f"cell_{f}").cast("int")] for f in FIELDS})
    return out.withColumns({f"cand_{f}": F.coalesce(F.col(f"score_{f}") >= F.col("score_limit"), F.lit(False)) for f in FIELDS}).drop("scores")


def scores(calibration: DataFrame, fit: Callable[[DataFrame], DataFrame] = forests) -> DataFrame:
    """Scores and exact checks of every reading (see ``found_spikes``), per row and field in wide form. ``fit`` makes the model of
    the features, as ``forests`` does."""
    rows = stage(readings(calibration))
    scale = stage(source_scale(rows))
    features = stage(featured(rows, scale, stage(season(rows, scale))))
    out = scored(features, stage(fit(features)))
    for f in FIELDS:
        faulty = F.coalesce(F.abs(f"z_{f}") > SPIKE, F.lit(False)) | F.coalesce(F.col(f"run_{f}") >= RUN, F.lit(False))
        out = out.withColumn(f"case_{f}", F.coalesce(F.col(f"bad_{f}"), F.lit(False)) | (F.col(f"cand_{f}") & faulty))
    return out.withColumn("case_t2_seconds", F.col("case_t2_seconds") | (F.coalesce(F.col("over"), F.lit(False)) & ~F.col("case_t1_seconds")))


def found_spikes(calibration: DataFrame) -> DataFrame:
    """(row_id, field) of faulty cells among the first rows of each (snapshot_id, qubit).

    Cases: physically impossible values; candidates of the forest further than ``SPIKE`` scatters from the typical value of
    their backend, campaign and qubit; candidates in runs of ``RUN`` or more equal readings. T1 is taken in seconds. NULL
    and NaN are missing and never cases; a group without a positive median or a source without scatter has no spikes.
    """
    cells = F.array(*[F.when(F.col(f"case_{f}"), F.lit(f)) for f in FIELDS])
    return scores(calibration).select("row_id", F.explode(F.array_compact(cells)).alias("field"))
