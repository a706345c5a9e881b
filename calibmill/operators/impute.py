"""Missing cells filled from similar records, with provenance.

Dependencies are mined from complete records and verified on others. Every set of up to three key columns is tried as determinant
of every field: dictionaries are made on most records, and the share of the records held out that they predict is the
dependency's confidence. Formulas between quantities of one dimension are tried as well. What holds and has no part that
holds by itself fills first (its dictionary left-joined), in the order of how sure it is; rows that repeat a (snapshot_id, qubit)
lie side by side in a window, so that dictionary is read there. What they leave is filled from the group: the nearest readings
in time of the same qubit, then the level of the qubit, of the backend, of all. Every filled cell carries the source of its value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibmill.operators.units import t1_in_seconds
from calibmill.session import stage

NUMERIC, PROBABILITIES = ("t1_seconds", "t2_seconds", "readout_error"), ("prob_meas0_prep1", "prob_meas1_prep0")
LABEL = "readout_line"
#: Columns that determinants are made of, and one record in so many is held out to verify them.
KEYS, HELD_OUT = ("backend", "campaign", "qubit", "loader"), 4
#: Least share of tested records that a dependency must predict, and how near a number must be predicted.
LEAST_CONFIDENCE, NUMBER_TOLERANCE = 0.9, 0.05
#: Readings looked at before and after a gap in time.
NEAREST = 3
# Words that stand for "not known" (lower case). Texts without any letter or digit do so too.
UNKNOWN_WORDS = ("n/a", "na", "n.a.", "n.a", "nan", "none", "null", "nil", "unknown", "unk", "not known", "not available", "undefined", "unspecified", "missing", "tbd", "tba", "unbekannt", "inconnu", "desconocido", "#n/a")


def label_missing(label: Column) -> Column:
    """NULL, blank, or a word or sign that stands for 'not known'."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"^[\s\(\[<\"']+|[\s\)\]>\"']+$", "")))
    return label.isNull() | ~label.rlike(r"[\p{L}\p{N}]") | bare.isin(*UNKNOWN_WORDS)


def number_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def _code(target: str) -> Column:
    """A cell's content as a text that equal content shares: labels themselves, numbers in steps of the tolerance."""
    if target == LABEL:
        return F.when(~F.col(f"m_{LABEL}"), F.trim(LABEL))
    return F.round(F.log(F.col(f"v_{target}")) / math.log1p(NUMBER_TOLERANCE)).cast("string")


def content_counts(rows: DataFrame) -> DataFrame:
    """How often each content of each field is met per combination of keys, in the records to learn from and in those held out.

    rows: ``candidates``. (the keys, target, code, n_fit, n_held). Records are split by a hash of their snapshot, so rows that repeat
    another stay on its side. Counts are aggregated before they are shuffled.
    """
    held = F.pmod(F.xxhash64("snapshot_id", F.lit(17)), F.lit(HELD_OUT)) == 0
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), _code(t).alias("code")) for t in (*NUMERIC, LABEL)])).alias("c")
    flat = rows.select(*KEYS, held.alias("_held"), cells).select(*KEYS, "_held", "c.*").where("code is not null")
    return flat.groupBy(*KEYS, "target", "code").agg(F.count_if(~F.col("_held")).alias("n_fit"), F.count_if(F.col("_held")).alias("n_held"))


def determinants() -> list[tuple[str, ...]]:
    """Every set of up to three key columns, smaller ones first."""
    return [c for n in range(1, 4) for c in combinations(KEYS, n)]


def dictionaries(counts: DataFrame) -> DataFrame:
    """For every determinant set and key the commonest content: determinant, the keys, target, code, n_fit, and how many of the
    key's held out records there are (``tested``) and are predicted (``hit``). One pass of grouping sets over the counts."""
    sets = determinants()
    grouped = counts.groupingSets([[*s, "target", "code"] for s in sets], *KEYS, "target", "code").agg(F.grouping_id().alias("_set"), F.sum("n_fit").alias("n_fit"), F.sum("n_held").alias("n_held"))
    per_key = grouped.groupBy("_set", *KEYS, "target").agg(F.max_by(F.struct("code", "n_fit", "n_held"), F.struct("n_fit", "code")).alias("_best"), F.sum("n_held").alias("n_held"))
    # a set's number has a bit for each column it leaves out, the last column's the lowest
    name = F.create_map(*[F.lit(x) for s in sets for x in (sum(1 << (len(KEYS) + 1 - i) for i, k in enumerate(KEYS) if k not in s), ",".join(s))])
    known = F.col("_best.n_fit") > 0
    return per_key.select(name[F.col("_set").cast("int")].alias("determinant"), *KEYS, "target", F.when(known, F.col("_best.code")).alias("code"), F.col("n_held").alias("tested"), F.when(known, F.col("_best.n_held")).otherwise(0).alias("hit"))


def mine(dictionary: DataFrame) -> DataFrame:
    """(determinant, target, tested, confidence) of every determinant set and field: the share of held out records predicted.

    Records whose key was never met among those learnt from count as not predicted, so keys of a few rows earn nothing.
    """
    found = dictionary.groupBy("determinant", "target").agg(F.sum("tested").alias("tested"), F.sum("hit").alias("hit"))
    return found.select("determinant", "target", "tested", F.try_divide(F.col("hit").cast("double"), F.col("tested")).alias("confidence"))


def holding(found: list, target: str) -> list[tuple[float, tuple[str, ...]]]:
    """The verified determinants of a field without a part that holds by itself, as (confidence, columns), the surest first."""
    good = {tuple(r["determinant"].split(",")): r["confidence"] for r in found if r["target"] == target and r["tested"] and r["confidence"] >= LEAST_CONFIDENCE}
    least = [c for c in good if not any(set(d) < set(c) for d in good)]
    return sorted(((good[c], c) for c in least), key=lambda x: (-x[0], x[1]))


def label_spread(rows: DataFrame) -> DataFrame:
    """Every text met as label: n, the backends' qubits it is met on, those where it is the commonest, and whether it counts as missing.

    A label that many qubits have and none has most often is no real one, whatever it says.
    """
    met = rows.where(f"{LABEL} is not null").groupBy("backend", "qubit", F.trim(LABEL).alias("label")).agg(F.count("*").alias("n"))
    top = F.col("n") == F.max("n").over(Window.partitionBy("backend", "qubit"))
    spread = met.withColumn("_top", top).groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("qubits"), F.count_if("_top").alias("commonest_on"))
    return spread.withColumn("counts_as_missing", label_missing(F.col("label")))


def _middle(values: list[Column]) -> Column:
    """The median of the non-null ones of a few columns, the mean of the middle two among an even number."""
    kept = F.sort_array(F.array_compact(F.array(*values)))
    n = F.size(kept)
    return F.when(n > 0, (F.element_at(kept, ((n + 1) / 2).cast("int")) + F.element_at(kept, (n / 2).cast("int") + 1)) / 2)


def candidates(calibration: DataFrame) -> DataFrame:
    """For every row its missing marks, the tests of each dependency on complete cells, and candidates for missing cells.

    Rows are shuffled and sorted once, by (backend, campaign, qubit) in time; rows repeating a (snapshot_id, qubit) are
    neighbours there, so that determinant's dictionary is the neighbouring row.
    """
    cols = ["row_id", "snapshot_id", *KEYS, "ts", *NUMERIC, "prob_meas0_prep1", "prob_meas1_prep0", LABEL, "note"]
    rows = t1_in_seconds(calibration.select(*cols)).withColumn("s_t1_seconds", F.col("t1_common"))
    rows = rows.withColumns({"s_t2_seconds": F.col("t2_seconds"), "s_readout_error": F.col("readout_error")})
    rows = rows.withColumns({f"m_{f}": number_missing(F.col(f)) for f in NUMERIC} | {f"m_{LABEL}": label_missing(F.col(LABEL))})
    inf = float("inf")
    rows = rows.withColumns({f"v_{f}": F.when(~F.col(f"m_{f}") & (F.col(f"s_{f}") > 0) & (F.col(f"s_{f}") < inf), F.col(f"s_{f}")) for f in NUMERIC})
    rows = rows.drop("t1_unit", "t1_common", "t1_posterior", "t1_uncertain", "note")
    order = "over (partition by backend, campaign, qubit order by ts, snapshot_id, row_id)"
    near: dict[str, Column] = {}
    for f in NUMERIC:
        for k in range(1, NEAREST + 1):
            near[f"b{k}_{f}"] = F.expr(f"lag(v_{f}, {k}) ignore nulls {order}")
            near[f"a{k}_{f}"] = F.expr(f"lead(v_{f}, {k}) ignore nulls {order}")
        near[f"sb_{f}"] = F.expr(f"lag(if(v_{f} is null, null, snapshot_id), 1) ignore nulls {order}")
        near[f"sa_{f}"] = F.expr(f"lead(if(v_{f} is null, null, snapshot_id), 1) ignore nulls {order}")
    rows = rows.withColumns(near)
    out = [F.col(c) for c in ("row_id", "snapshot_id", *KEYS, *NUMERIC, LABEL)] + [F.col(f"m_{f}") for f in (*NUMERIC, LABEL)]
    for f in NUMERIC:
        twin = F.when(F.col(f"sb_{f}") == F.col("snapshot_id"), F.col(f"b1_{f}")).when(F.col(f"sa_{f}") == F.col("snapshot_id"), F.col(f"a1_{f}"))
        nearest = _middle([F.col(f"{s}{k}_{f}") for k in range(1, NEAREST + 1) for s in "ba"])
        out += [F.when(F.col(f"m_{f}"), twin).alias(f"twin_{f}"), F.when(F.col(f"m_{f}"), nearest).alias(f"near_{f}"), _close(twin, f).alias(f"t_twin_{f}"), F.col(f"v_{f}")]
    good = lambda c: F.when(~number_missing(F.col(c)) & F.col(c).between(0.0, 1.0), F.col(c))
    return rows.select(*out, *[good(c).alias(f"v_{c}") for c in PROBABILITIES])


def formulas(target: str) -> dict[str, Column]:
    """Formulas that may give a field: of each quantity of its dimension itself, twice, and half, of each pair mean, sum, product, distance."""
    alike = [c for c in (("t1_seconds", "t2_seconds") if target.startswith("t") else ("readout_error", *PROBABILITIES)) if c != target]
    v = lambda c: F.col(f"v_{c}")
    out = {}
    for c in alike:
        out |= {c: v(c), f"twice {c}": 2 * v(c), f"half of {c}": v(c) / 2}
    for c, d in combinations(alike, 2):
        out |= {f"mean of {c} and {d}": (v(c) + v(d)) / 2, f"sum of {c} and {d}": v(c) + v(d), f"product of {c} and {d}": v(c) * v(d), f"distance of {c} and {d}": F.abs(v(c) - v(d))}
    return out


def _close(guess: Column, target: str) -> Column:
    return F.abs(guess - F.col(f"v_{target}")) <= NUMBER_TOLERANCE * F.col(f"v_{target}")


def verify_numbers(rows: DataFrame) -> DataFrame:
    """Support and confidence of repeated rows and of every formula, over all records they can be tested on."""
    tests = [("snapshot_id,qubit", f, F.col(f"t_twin_{f}")) for f in NUMERIC] + [(name, f, _close(guess, f)) for f in NUMERIC for name, guess in formulas(f).items()]
    flat = rows.agg(*[F.count(t).alias(f"n{i}") for i, (_, _, t) in enumerate(tests)], *[F.avg(t.cast("int")).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(d).alias("determinant"), F.lit(f).alias("target"), F.col(f"n{i}").alias("tested"), F.col(f"c{i}").alias("confidence")) for i, (d, f, _) in enumerate(tests)])).alias("d")).select("d.*")


def _levels(rows: DataFrame, *keys: str) -> DataFrame:
    """The geometric mean of each numeric field per key (one row for all without keys)."""
    return rows.groupBy(*keys).agg(*[F.exp(F.avg(F.log(F.col(f"v_{f}")))).alias(f"{'_'.join(keys) or 'all'}_{f}") for f in NUMERIC])


def _meet(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of a table keyed by ``keys``; null keys meet."""
    table = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(table, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(table[f"_{k}"]) for k in keys]), "left").drop(*[f"_{k}" for k in keys])


def impute(calibration: DataFrame) -> DataFrame:
    """The rows of ``calibration`` by row_id, with t1_seconds, t2_seconds, readout_error and readout_line filled.

    Columns: row_id, backend, qubit, the four fields, and for each ``<field>_from``: null for a cell that was there, else
    where its value comes from: a determinant ('backend,qubit', 'snapshot_id,qubit', ...), a formula ('mean of ... and ...'), 'time',
    'qubit level', 'backend level', 'overall level', for a label without a verified determinant 'most frequent', or 'unfilled' if
    the table holds no value at all. Present cells stay as they are; a filled t1_seconds is in seconds. NULL and NaN numbers
    are missing; infinite and non-positive ones are present but fill nothing. Extra columns of the input are not carried along:
    join on row_id.
    """
    rows = stage(candidates(calibration))
    dictionary = stage(dictionaries(content_counts(rows)))
    mined = mine(dictionary).collect()  # a row per determinant set and field
    tested = verify_numbers(rows).collect()  # a row per field and formula
    out = rows
    for keys in (["backend", "qubit"], ["backend"]):
        out = _meet(out, stage(_levels(rows, *keys)), keys)  # of known size, so that rows needn't be shuffled to meet it
    overall = _levels(rows).first()  # one row
    picks: dict[str, Column] = {}
    for f in (*NUMERIC, LABEL):
        options = []
        for confidence, keys in holding(mined, f):
            name = f"fd_{f}_{'_'.join(keys)}"
            known = dictionary.where((F.col("determinant") == ",".join(keys)) & (F.col("target") == f) & F.col("code").isNotNull())
            value = F.col("code") if f == LABEL else F.exp(F.col("code").cast("double") * math.log1p(NUMBER_TOLERANCE))
            out = _meet(out, stage(known.select(*keys, value.alias(name))), keys)
            options.append((confidence, F.col(name), ",".join(keys)))
        if f != LABEL:
            guesses = formulas(f) | {"snapshot_id,qubit": F.col(f"twin_{f}")}
            options += [(r["confidence"], guesses[r["determinant"]], r["determinant"]) for r in tested if r["target"] == f and r["tested"] and r["confidence"] >= LEAST_CONFIDENCE]
            rest = [(F.col(f"near_{f}"), "time"), (F.col(f"backend_qubit_{f}"), "qubit level"), (F.col(f"backend_{f}"), "backend level"), (F.lit(overall[f"all_{f}"]).cast("double"), "overall level")]
        else:
            usual = dictionary.where((F.col("determinant") == "backend,qubit") & (F.col("target") == f) & F.col("code").isNotNull())
            out = _meet(out, stage(usual.select("backend", "qubit", F.col("code").alias("_usual"))), ["backend", "qubit"])
            rest = [(F.col("_usual"), "most frequent")]
        options.sort(key=lambda o: (-o[0], o[2]))
        ladder = [o[1:] for o in options] + rest
        none = F.lit(None).cast("string" if f == LABEL else "double")
        pick = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source"))) for c, name in ladder], F.struct(none.alias("value"), F.lit("unfilled").alias("source")))
        picks[f] = F.when(F.col(f"m_{f}"), pick)
    out = out.withColumns({f"_p_{f}": p for f, p in picks.items()})
    return out.select("row_id", "backend", "qubit", *[F.when(F.col(f"m_{f}"), F.col(f"_p_{f}.value")).otherwise(F.col(f)).alias(f) for f in picks], *[F.col(f"_p_{f}.source").alias(f"{f}_from") for f in picks])


def accuracy(calibration: DataFrame, one_in: int = 50) -> DataFrame:
    """How well hidden cells come back: (field, source, cells, right, median_error).

    One present cell in so many is hidden, by hash, and filled; ``right`` is the share of labels that come back as they were and of
    numbers within the tolerance, ``median_error`` the middle relative error of numbers.
    """
    base = calibration.select("row_id", "snapshot_id", *KEYS, "ts", *NUMERIC, *PROBABILITIES, LABEL, "note")
    hide = lambda f: F.pmod(F.xxhash64("row_id", F.lit(f)), F.lit(one_in)) == 0
    filled = impute(base.select(*[F.when(~hide(c), F.col(c)).alias(c) if c in (*NUMERIC, LABEL) else c for c in base.columns]))
    true = t1_in_seconds(base).select("row_id", F.col("t1_common").alias("_t1_seconds"), F.col("t2_seconds").alias("_t2_seconds"), F.col("readout_error").alias("_readout_error"), F.trim(LABEL).alias(f"_{LABEL}"))
    joined = filled.join(true, "row_id")
    cells = []
    for f in (*NUMERIC, LABEL):
        there = ~(label_missing(F.col(f"_{f}")) if f == LABEL else number_missing(F.col(f"_{f}")) | (F.col(f"_{f}") <= 0))
        off = F.when(F.col(f) == F.col(f"_{f}"), 0.0).otherwise(1.0) if f == LABEL else F.abs(F.col(f) / F.col(f"_{f}") - 1)
        cells.append(F.when(hide(f) & there, F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("source"), off.alias("off"))))
    flat = joined.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    return flat.groupBy("field", "source").agg(F.count("*").alias("cells"), F.avg((F.col("off") <= NUMBER_TOLERANCE).cast("int")).alias("right"), F.percentile_approx(F.when(F.col("field") != LABEL, F.col("off")), 0.5, 1000).alias("median_error"))


def found_missing(calibration: DataFrame) -> DataFrame:
    """(row_id, field) of every cell that ``impute`` marks."""
    marks = F.array(*[F.when(F.col(f"{f}_from").isNotNull(), F.lit(f)) for f in (*NUMERIC, LABEL)])
    return impute(calibration).select("row_id", F.explode(F.array_compact(marks)).alias("field"))
