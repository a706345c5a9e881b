"""Faulty readings and missing cells: small fixtures against brute force and planted cases."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibmill.operators import impute, spikes

DDL = "row_id bigint, snapshot_id string, backend string, campaign string, ts timestamp, qubit int, t1_seconds double, t2_seconds double, readout_error double, prob_meas0_prep1 double, prob_meas1_prep0 double, readout_line string, note string, v_t1_seconds double, loader string"
START = datetime(2022, 5, 1)
NAN = float("nan")


def calibration(spark, n=60, qubits=3, backends=("a", "b"), edit=None):
    rng, rows = np.random.default_rng(3), []
    for b in backends:
        for q in range(qubits):
            for i in range(n):
                p, r = 0.01 * (1 + 0.03 * rng.standard_normal()), 0.006 * (1 + 0.03 * rng.standard_normal())
                rows.append([len(rows), f"{b}:{i}", b, "c", START + timedelta(minutes=20 * i), q, 1e-4 * (q + 1) * (1 + 0.02 * rng.standard_normal()), 8e-5 * (1 + 0.02 * rng.standard_normal()), (p + r) / 2, p, r, f"{b}{q // 2}", None, 9.0, "v1"])
    if edit:
        rows = edit(rows)
    return spark.createDataFrame([tuple(r) for r in rows], DDL)


def found(df):
    return {(r.row_id, r.field) for r in df.collect()}


def test_planted_faults(spark):
    def edit(rows):
        rows[5][6] *= 1.5  # spike: 25 scatters
        rows[7][7] *= 0.7
        rows[9][6], rows[10][6], rows[11][6] = -1e-4, 0.0, float("inf")
        rows[12][9], rows[13][9] = 1.2, -0.1
        rows[14][7] = 2.5 * rows[14][6]  # over twice T1, and a spike anyway
        for i in range(20, 26):
            rows[i][6] = 1.01e-4  # six in a row
        rows[23][6] = NAN  # missing ones are skipped, so five are left
        for i in range(30, 37):
            rows[i][9] = 0.0101
        rows[33][9] = None
        for i in range(40, 45):
            rows[i][7] = 8.01e-5  # five only
        rows[70][6], rows[71][6] = None, NAN
        rows[80][6] *= 1e6  # in microseconds: no case
        again = list(rows[50])
        again[0], again[6] = 10_000, 5e-3  # a repeated row is no first row
        return [*rows, again]

    expected = {(5, "t1_seconds"), (7, "t2_seconds"), (9, "t1_seconds"), (10, "t1_seconds"), (11, "t1_seconds"), (12, "prob_meas0_prep1"), (13, "prob_meas0_prep1"), (14, "t2_seconds")}
    expected |= {(i, "prob_meas0_prep1") for i in range(30, 37) if i != 33}
    assert found(spikes.found_spikes(calibration(spark, edit=edit))) == expected


def test_t2_over_twice_t1(spark):
    def edit(rows):
        for r in rows:
            if r[5] == 0:
                r[7] = 1.9e-4 * (1 + (r[7] / 8e-5 - 1))
        rows[3][6], rows[3][7] = 0.97e-4, 1.96e-4
        return rows

    got = found(spikes.found_spikes(calibration(spark, edit=edit)))
    rows = calibration(spark, edit=edit).collect()
    assert got == {(r.row_id, "t2_seconds") for r in rows if r.t2_seconds > 2 * r.t1_seconds} and (3, "t2_seconds") in got


def test_forest_isolates_what_it_never_saw():
    rng = np.random.default_rng(0)
    codes = np.stack([np.abs(rng.normal(0, 1, 1500)), rng.random(1500), np.zeros(1500), rng.random(1500) < 0.01]).astype(int)
    cells, counts = np.unique(np.ravel_multi_index(tuple(codes), spikes.SHAPE), return_counts=True)
    scores = spikes.grow_forest(cells, counts)
    limit = spikes.score_limit(scores.ravel()[cells], counts)
    assert scores[0, 0, 0, 0] < limit and scores[3, 1, 0, 0] < limit and scores.max() <= 1
    assert scores[11, 0, 0, 0] > limit and scores[16, 5, 4, 0] > limit and scores[0, 0, 0, spikes.RUN - 1] > limit
    assert (spikes.grow_forest(cells, counts) == scores).all()


def planted(rows):
    """Spikes of 12 scatters and more, and stuck runs of 6 to 12, in 2 % of the readings."""
    rng = np.random.default_rng(5)
    for at in rng.choice(len(rows) // 20, 12, replace=False) * 20 + 3:
        rows[at][7] *= float(1 + rng.choice([-1, 1]) * rng.uniform(0.25, 0.6))
    for k, at in enumerate(rng.choice(len(rows) // 20 - 1, 8, replace=False)):
        for i in range(6 + k % 7):
            rows[at * 20 + 5 + i][9] = rows[at * 20 + 5][9]
    return rows


def test_the_forest_alone_finds_spikes_and_stuck_readings(spark):
    out = spikes.scores(calibration(spark, n=400, edit=planted))
    hit, said, true = 0, 0, 0
    for f in spikes.FIELDS:
        fault = F.coalesce((F.abs(f"z_{f}") > spikes.SPIKE) | (F.col(f"run_{f}") >= spikes.RUN), F.lit(False))
        row = out.agg(F.count_if(F.col(f"cand_{f}") & fault), F.count_if(f"cand_{f}"), F.count_if(fault)).first()
        hit, said, true = hit + row[0], said + row[1], true + row[2]
    assert true > 70 and hit / true >= 0.95 and hit / said >= 0.95


def test_nothing_but_the_forest_finds_them(spark):
    size = int(np.prod(spikes.SHAPE))
    constant = lambda features: features.select("pool").distinct().select("pool", F.lit(0.55).cast("float").alias("score_limit"), F.array_repeat(F.lit(0.5).cast("float"), size).alias("scores"))
    df = calibration(spark, n=400, edit=planted)
    out = spikes.scores(df, constant)
    assert out.where(F.col("case_t2_seconds") | F.col("case_prob_meas0_prep1")).where("not over").count() == 0
    assert len(found(spikes.found_spikes(df))) > 70


def test_spikes_of_odd_tables(spark):
    assert spikes.found_spikes(calibration(spark).limit(0)).count() == 0
    same = calibration(spark, n=3, qubits=1, backends=("a",), edit=lambda rows: [[*r[:2], None, None, None, None, 1e-4, None, None, NAN, None, None, None, None, None] for r in rows])
    assert found(spikes.found_spikes(same)) == set()


def test_missing_cells_are_marked_and_filled(spark):
    def edit(rows):
        for k, v in enumerate([None, "", "  ", "?", "n/a", "-", "Unknown", "(none)", "N/A"]):
            rows[k][11] = v
        rows[20][6], rows[21][7], rows[22][8], rows[23][8] = None, NAN, None, NAN
        rows[23][9] = None
        twin = list(rows[24])
        rows[24][6] = NAN
        twin[0] = 5000
        more = [[6000 + k, *rows[k][1:]] for k in range(30, 36)]  # repeated rows on which the dependency is verified
        return [*rows, twin, *more]

    df = calibration(spark, edit=edit)
    assert found(impute.found_missing(df)) == {(k, "readout_line") for k in range(9)} | {(20, "t1_seconds"), (21, "t2_seconds"), (22, "readout_error"), (23, "readout_error"), (24, "t1_seconds")}
    got = {r.row_id: r for r in impute.impute(df).collect()}
    rows = {r.row_id: r for r in df.collect()}
    assert len(got) == len(rows)
    assert {got[k].readout_line for k in range(9)} == {"a0"} and got[0].readout_line_from == "backend,qubit"
    assert got[20].t1_seconds_from == "time" and got[20].t1_seconds == pytest.approx(1e-4, rel=0.05)
    assert got[22].readout_error_from == "mean of prob_meas0_prep1 and prob_meas1_prep0" and got[22].readout_error == pytest.approx((rows[22].prob_meas0_prep1 + rows[22].prob_meas1_prep0) / 2)
    assert got[23].readout_error_from == "time"
    assert (got[24].t1_seconds_from, got[24].t1_seconds) == ("snapshot_id,qubit", rows[5000].t1_seconds)
    assert got[50].t1_seconds_from is None and got[50].t1_seconds == rows[50].t1_seconds


def test_filling_of_odd_tables(spark):
    assert impute.impute(calibration(spark).limit(0)).count() == 0
    bare = calibration(spark, n=2, qubits=1, backends=("a",), edit=lambda rows: [[*r[:2], None, None, None, None, None, NAN, None, None, None, " ", None, None, None] for r in rows])
    got = impute.impute(bare).collect()
    assert {(r.t1_seconds_from, r.readout_line_from) for r in got} == {("unfilled", "unfilled")} and len(got) == 2


def test_hidden_cells_come_back(spark):
    df = calibration(spark, n=200)
    hidden = df.withColumn("t1_seconds", F.when(F.col("row_id") % 17 == 0, None).otherwise(F.col("t1_seconds")))
    errors = [abs(g.t1_seconds / r.t1_seconds - 1) for g, r in zip(impute.impute(hidden).orderBy("row_id").collect(), df.orderBy("row_id").collect()) if r.row_id % 17 == 0]
    assert np.median(errors) < 0.03 and not any(math.isnan(e) for e in errors)


def mined(spark, df):
    return {(r.determinant, r.target): r for r in impute.mine(impute.dictionaries(impute.content_counts(impute.candidates(df)))).collect()}


def test_determinants_are_mined(spark):
    got = mined(spark, calibration(spark).withColumn("loader", F.concat(F.lit("v"), F.col("row_id") % 2)))
    assert len(got) == 4 * 14
    assert got["backend,qubit", "readout_line"].confidence == 1.0 and got["qubit", "readout_line"].confidence < 0.9 and got["backend", "readout_line"].confidence < 0.9
    assert impute.holding(list(got.values()), "readout_line") == [(1.0, ("backend", "qubit"))]  # larger sets hold too, but aren't minimal
    # a column that nobody wrote down as a determinant
    own = calibration(spark).withColumn("loader", F.concat(F.lit("v"), F.col("row_id") % 5)).withColumn("readout_line", F.concat(F.lit("line "), F.col("loader")))
    assert impute.holding(list(mined(spark, own).values()), "readout_line") == [(1.0, ("loader",))]
    hidden = own.withColumn("readout_line", F.when(F.col("row_id") % 7 != 0, F.col("readout_line")))
    filled = impute.impute(hidden).join(own.select("row_id", F.col("readout_line").alias("was")), "row_id")
    assert filled.where("row_id % 7 = 0 and (readout_line <> was or readout_line_from <> 'loader')").count() == 0


def test_keys_of_a_few_rows_earn_nothing(spark):
    """A key that differs in every snapshot predicts what it was made of, but no record held out."""
    df = calibration(spark, edit=lambda rows: [[*r[:3], r[1], *r[4:]] for r in rows]).withColumn("loader", F.lit("v"))
    got = mined(spark, df)
    assert got["backend,campaign,qubit", "readout_line"].confidence == 0.0 and got["backend,qubit", "readout_line"].confidence == 1.0


def test_formulas(spark):
    got = {(r.determinant, r.target): r.confidence for r in impute.verify_numbers(impute.candidates(calibration(spark).withColumn("loader", F.lit("v")))).collect()}
    assert got["mean of prob_meas0_prep1 and prob_meas1_prep0", "readout_error"] == 1.0 and got["sum of prob_meas0_prep1 and prob_meas1_prep0", "readout_error"] < 0.1 and got["twice t2_seconds", "t1_seconds"] < 0.9


def test_labels_by_their_spread(spark):
    df = calibration(spark, edit=lambda rows: [[*r[:11], "tbc" if r[0] % 9 == 4 else r[11], *r[12:]] for r in rows])
    got = {r.label: r for r in impute.label_spread(df).collect()}
    assert got["tbc"].qubits == 6 and got["tbc"].commonest_on == 0 and got["a0"].commonest_on == 2
