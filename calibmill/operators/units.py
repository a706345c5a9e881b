"""Quantities recorded in different units, brought to common units.

Where a unit is stated it holds. Where none is, a mixture on the log scale decides: per source and
field one level and spread (in the common unit) and one component for each unit the field occurs in,
offset by the unit's known conversion factor, beside a broad component for outliers. The mixture is
fitted by EM over a histogram of log values per source and field - a few hundred bins however many
rows there are - and each value gets the unit with the greatest posterior. Values whose posterior stays
below ``CERTAIN`` are flagged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibmill.functions.lexicon import FIELD_PRIOR, FIELD_UNITS
from calibmill.operators import entries as E
from calibmill.session import stage

BINS_PER_DECADE = 50
CERTAIN = 0.99
ROUNDS = 60
#: Weight of the outlier component and its spread in decades; weight of the prior on level and mixing shares in rows.
OUTLIERS, OUTLIER_SPREAD, PRIOR_ROWS = 0.01, 3.0, 2.0
#: The least spread of a component in decades, and the odds that a remark gives to the unit it names.
LEAST_SPREAD, HINT_ODDS = 0.05, 50.0

MODEL_DDL = "source string, field string, mu double, sigma double, shares map<string,double>"


def fit_mixture(field: str, centers: np.ndarray, weights: np.ndarray, units: np.ndarray, dt_ns: float | None) -> tuple[float, float, dict[str, float]]:
    """Level and spread of log10 in the common unit, and the share of each unit among values without a stated one.

    centers: log10 of numbers as written; weights: rows; units: the stated unit, or ''. Rows with a stated unit
    belong to its component. The start is chosen, among the prior level and every unit's median, by likelihood.
    """
    offsets = unit_offsets(field, dt_ns)
    names = list(offsets)
    shift = np.array([offsets[u] for u in names])
    mean0, spread0 = FIELD_PRIOR[field]
    owner = np.array([names.index(u) if u in offsets else -1 for u in units])
    log_level = centers[:, None] + shift[None, :]  # in the common unit, were it written in that unit
    fixed = owner >= 0
    best = None
    starts = {mean0}
    if fixed.any():
        starts = {float(np.average(log_level[fixed, owner[fixed]], weights=weights[fixed]))}
    elif len(centers):
        order = np.argsort(centers)
        cum = np.cumsum(weights[order])
        mid = centers[order][np.searchsorted(cum, cum[-1] / 2)]
        starts |= {float(m) for m in mid + shift if abs(m - mean0) < 2 * spread0}
    for start in sorted(starts):
        mu, sigma, share = start, 0.3, np.full(len(names), 1 / len(names))
        score = -math.inf
        for _ in range(ROUNDS):
            dense = share * np.exp(-0.5 * ((log_level - mu) / sigma) ** 2) / sigma
            wild = OUTLIERS * np.exp(-0.5 * ((log_level[:, :1] - mu) / OUTLIER_SPREAD) ** 2) / OUTLIER_SPREAD
            dense = np.where(fixed[:, None], np.eye(len(names))[owner] * np.exp(-0.5 * ((log_level - mu) / sigma) ** 2) / sigma, dense)
            total = dense.sum(1, keepdims=True) + wild + 1e-300
            post = dense / total * weights[:, None]
            free = post[~fixed].sum(0)
            share = (free + PRIOR_ROWS / len(names)) / (free.sum() + PRIOR_ROWS)
            n = post.sum()
            mu_new = ((post * log_level).sum() + 0.1 * mean0) / (n + 0.1)
            sigma = max(LEAST_SPREAD, math.sqrt(((post * (log_level - mu_new) ** 2).sum() + PRIOR_ROWS * 0.2**2) / (n + PRIOR_ROWS)))
            fit = float((weights * np.log(total[:, 0])).sum()) - 0.5 * ((mu_new - mean0) / spread0) ** 2
            done = abs(fit - score) < 1e-9 * max(1.0, abs(fit)) and abs(mu_new - mu) < 1e-9
            mu, score = mu_new, fit
            if done:
                break
        if best is None or score > best[0]:
            best = (score, mu, sigma, dict(zip(names, share.tolist())))
    return best[1:]


def unit_offsets(field: str, dt_ns: float | None) -> dict[str, float]:
    """log10 of each unit as a multiple of the field's common unit; the device clock only where it is known."""
    return {u: math.log10(f if f is not None else dt_ns) for u, f in FIELD_UNITS[field].items() if f is not None or dt_ns}


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    source, field = pdf["source"].iloc[0], pdf["field"].iloc[0]
    if field not in FIELD_UNITS:
        return pd.DataFrame(columns=["source", "field", "mu", "sigma", "shares"])
    mu, sigma, shares = fit_mixture(field, pdf["bin"].to_numpy() / BINS_PER_DECADE, pdf["n"].to_numpy(float), pdf["unit"].fillna("").to_numpy(), clock if (clock := pdf["dt_ns"].max()) > 0 else None)
    return pd.DataFrame({"source": [source], "field": [field], "mu": [mu], "sigma": [sigma], "shares": [shares]})


def fit_units(values: DataFrame) -> DataFrame:
    """A model per (source, field) from (source, field, number, unit): counts per bin, then EM over the bins.

    Where values have their device's clock (``clock_ns``), cycles are a component too, at the source's largest clock.

    The histogram is aggregated before it is shuffled, so a source holding most rows costs no more than another;
    a group is at most (decades x bins x units) rows. Zero, null, NaN and infinite numbers don't count. The model is
    staged: its size is known when it is joined, so values needn't be shuffled by source to meet a few rows.
    """
    size = F.abs("number")
    clock = F.col("clock_ns") if "clock_ns" in values.columns else F.lit(None).cast("double")
    bins = (
        values.where(F.col("number").isNotNull() & ~F.isnan("number") & (size > 0) & (size < float("inf")))
        .groupBy(F.coalesce("source", F.lit("")).alias("source"), "field", "unit", F.round(F.log10(size) * BINS_PER_DECADE).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.max(clock).alias("dt_ns"))
    )
    return stage(bins.groupBy("source", "field").applyInPandas(_fit, MODEL_DDL))


def _log_density(field: str, unit: str, offset: Column) -> Column:
    x = F.log10(F.abs("number")) + offset
    return F.log(F.coalesce(F.try_element_at("shares", F.lit(unit)), F.lit(1e-9))) - 0.5 * F.pow((x - F.col("mu")) / F.col("sigma"), 2)


def assign_units(values: DataFrame, model: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``values`` with ``unit_used``, ``unit_from`` ('stated', 'posterior', 'default'), ``posterior``, ``uncertain``.

    A stated unit holds if the field occurs in it. Numbers that have no logarithm (zero, infinite, missing) get the
    field's common unit by default. Within a posterior a unit named by ``hint`` has its odds raised. Device cycles are
    among a posterior's units where the value's clock is known (``clock_ns``).
    """
    joined = values.join(model, (F.coalesce(values["source"], F.lit("")) == model["source"]) & (values["field"] == model["field"]), "left").drop(model["source"]).drop(model["field"])
    has_log = F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") > 0) & (F.abs("number") < float("inf"))
    out = None
    for field in fields:
        table = FIELD_UNITS[field]
        common = next(iter(table))
        offsets = {u: F.lit(math.log10(f)) for u, f in table.items() if f is not None}
        if "clock_ns" in values.columns:
            offsets |= {u: F.when(F.col("clock_ns") > 0, F.log10("clock_ns")) for u, f in table.items() if f is None}
        density = lambda u: F.coalesce(_log_density(field, u, offsets[u]), F.lit(-math.inf))  # noqa: B023, E731
        scores = [F.struct((density(u) + F.when(F.col("hint") == u, math.log(HINT_ODDS)).otherwise(0.0)).alias("s"), F.lit(-i).alias("i"), F.lit(u).alias("u")) for i, u in enumerate(table) if u in offsets]
        top = F.array_max(F.array(*scores))
        rest = F.aggregate(F.array(*[s["s"] for s in scores]), F.lit(0.0), lambda acc, s: acc + F.exp(s - top["s"]))  # noqa: B023
        pick = F.when(F.col("unit").isin(*table), F.struct(F.col("unit").alias("u"), F.lit("stated").alias("how"), F.lit(1.0).alias("p"))).when(
            has_log & F.col("mu").isNotNull(), F.struct(top["u"].alias("u"), F.lit("posterior").alias("how"), (1.0 / rest).alias("p"))
        ).otherwise(F.struct(F.lit(common).alias("u"), F.lit("default").alias("how"), F.lit(None).cast("double").alias("p")))
        out = F.when(F.col("field") == field, pick) if out is None else out.when(F.col("field") == field, pick)
    return (
        joined.withColumn("_pick", out)
        .withColumns({"unit_used": F.col("_pick.u"), "unit_from": F.col("_pick.how"), "posterior": F.col("_pick.p"), "uncertain": (F.col("_pick.how") == "posterior") & (F.col("_pick.p") < CERTAIN)})
        .drop("_pick", "mu", "sigma", "shares")
    )


def to_common(field: Column, unit: Column, number: Column, dt_ns: Column) -> Column:
    """The number in the field's common unit."""
    factors = F.create_map(*[F.lit(x) for f, table in FIELD_UNITS.items() for u, m in table.items() if m is not None for x in (f"{f}|{u}", m)])
    factor = F.when(unit == "dt", dt_ns).otherwise(F.try_element_at(factors, F.concat(field, F.lit("|"), unit)))
    return number * factor


def convert_entries(parsed: DataFrame, backends: DataFrame) -> DataFrame:
    """Entries of the archive with their unit and their value in the common unit.

    parsed: staged ``parse_archive``. Columns: archive_id, source (backend), qubit, field, state, number, unit
    (as stated), unit_used, unit_from, posterior, uncertain, common (value in us, ns, GHz or as a fraction).
    The device clock comes from the file's configuration, else from other files of the backend, else from ``backends``: a row
    per backend, so entries meet it without being moved. An archive row that repeats an archive_id gives its entries again.
    """
    stated = backends.groupBy(F.col("backend").alias("source")).agg(F.max(F.when(~F.isnan("dt_ns"), F.col("dt_ns"))).alias("dt_ns"))
    seen = parsed.where("kind = 'file' and source is not null").groupBy("source").agg(F.max("config_dt_ns").alias("any_dt_ns"))
    clocks = stage(seen.join(stated, "source", "left").select(F.col("source").alias("_source"), F.coalesce("any_dt_ns", "dt_ns").alias("_clock")))
    entries = parsed.where("kind = 'entry'")
    values = entries.join(clocks, entries["source"] == clocks["_source"], "left").select("archive_id", "source", F.coalesce("config_dt_ns", "_clock").alias("clock_ns"), "qubit", "field", "state", "number", "unit", "hint")
    fields = tuple(f for f in FIELD_UNITS if f != "t1_seconds")
    done = assign_units(values, fit_units(values), fields)
    return done.withColumn("common", to_common(F.col("field"), F.col("unit_used"), F.col("number"), F.col("clock_ns")))


#: A note that names a time unit for T1 (the word T1, a unit word, and no word that makes it about something else).
T1_NOTE = r"(?i)(\bt1\b|relaxation)"
MICRO_MARK = r"^\s*[µμ]s!?\s*$"


def t1_note_unit(note: Column) -> Column:
    """The unit that a free note states for T1, else ''. Notes on other quantities state none."""
    low = F.lower(note)
    about = note.rlike(T1_NOTE) | note.rlike(MICRO_MARK)
    unit = (
        F.when(low.rlike(r"(?<![a-z])(ns|nsec|nano-?s\w*)(?![a-z])"), "ns")
        .when(low.rlike(r"([µμ]s|(?<![a-z])(us|usec|micro-?s\w*)(?![a-z]))"), "us")
        .when(low.rlike(r"(?<![a-z])(ms|msec|milli-?s\w*)(?![a-z])"), "ms")
    )
    return F.coalesce(F.when(about, unit), F.lit(""))


def t1_in_seconds(calibration: DataFrame) -> DataFrame:
    """``calibration`` with ``t1_unit``, ``t1_common`` (seconds), ``t1_posterior`` and ``t1_uncertain``.

    The notes name a unit for the column, but not always the one the number is in (some say it of a number
    already converted), so a note only raises the odds of its unit within the mixture of its backend. NULL,
    NaN, zero and infinite numbers count as seconds. Clashing helper columns of the input are dropped.
    """
    base = calibration.drop("t1_unit", "t1_common", "t1_posterior", "t1_uncertain")
    number = F.col("t1_seconds")
    model = fit_units(base.select(F.col("backend").alias("source"), F.lit("t1_seconds").alias("field"), number.alias("number"), F.lit("").alias("unit")))
    model = model.select(F.col("source").alias("_source"), F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"), F.col("shares").alias("_shares"))
    joined = base.join(model, F.coalesce("backend", F.lit("")) == F.col("_source"), "left")
    has_log = number.isNotNull() & ~F.isnan(number) & (F.abs(number) > 0) & (F.abs(number) < float("inf")) & F.col("_mu").isNotNull()
    x, hint = F.log10(F.abs(number)), t1_note_unit(F.col("note"))
    scored = joined.withColumn("_hint", hint).withColumn("_x", x)
    table = FIELD_UNITS["t1_seconds"]
    scores = [
        (F.log(F.coalesce(F.try_element_at("_shares", F.lit(u)), F.lit(1e-9))) - 0.5 * F.pow((F.col("_x") + math.log10(f) - F.col("_mu")) / F.col("_sigma"), 2) + F.when(F.col("_hint") == u, math.log(HINT_ODDS)).otherwise(0.0)).alias(f"_s_{u}")
        for u, f in table.items()
    ]
    scored = scored.select("*", *scores)
    names = list(table)
    top = F.greatest(*[F.col(f"_s_{u}") for u in names])
    pick = None
    for u in names:
        pick = F.when(F.col(f"_s_{u}") >= top, u) if pick is None else pick.when(F.col(f"_s_{u}") >= top, u)
    unit = F.when(has_log, pick).otherwise("s")
    posterior = F.when(has_log, 1.0 / sum((F.exp(F.col(f"_s_{u}") - top) for u in names[1:]), F.exp(F.col(f"_s_{names[0]}") - top)))
    factor = F.when(F.col("t1_unit") == "ms", 1e-3).when(F.col("t1_unit") == "us", 1e-6).when(F.col("t1_unit") == "ns", 1e-9).otherwise(1.0)
    helpers = ["_source", "_mu", "_sigma", "_shares", "_hint", "_x", *[f"_s_{u}" for u in names]]
    return scored.withColumn("t1_unit", unit).withColumns({"t1_common": F.when(factor == 1.0, number).otherwise(F.round(number * factor, 15)), "t1_posterior": posterior, "t1_uncertain": F.coalesce(posterior < CERTAIN, F.lit(False))}).drop(*helpers)


def found_units(parsed: DataFrame, backends: DataFrame, calibration: DataFrame) -> DataFrame:
    """(origin, rec_id, qubit, field) of values written at another scale than the common one."""
    common = F.create_map(*[F.lit(x) for f, table in FIELD_UNITS.items() for x in (f, next(iter(table)))])
    entries = convert_entries(parsed, backends).where((F.col("state") == E.IS_NUMBER) & (F.col("unit_used") != common[F.col("field")]))
    rows = t1_in_seconds(calibration.select("row_id", "backend", "qubit", "t1_seconds", "note")).where("t1_unit <> 's'")
    return entries.select(F.lit("properties").alias("origin"), F.col("archive_id").alias("rec_id"), "qubit", "field").unionByName(
        rows.select(F.lit("qubit_calibration").alias("origin"), F.col("row_id").alias("rec_id"), F.col("qubit"), F.lit("t1_seconds").alias("field"))
    )
