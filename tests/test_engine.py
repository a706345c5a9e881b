"""Rules, channels, metrics, parsing and archive: the expectations in numbers."""

import json
import math
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibmill.functions import squash
from calibmill.functions.membership import Custom, Gaussian, IntervalGaussian, TanhPulse, Trapezoidal, Triangular
from calibmill.operators import channels, circuits, metrics, parsing, rules
from calibmill.sources import archive
from calibmill.streaming import poller


def degrees(spark, shape, xs):
    d = shape.degree(F.col("x"))
    return [(r.lo, r.hi) for r in spark.createDataFrame([(x,) for x in xs], "x double").select(d.low.alias("lo"), d.high.alias("hi")).collect()]


def test_shapes(spark):
    assert degrees(spark, Gaussian(2, 0.5), [2.0])[0][0] == 1 and degrees(spark, Gaussian(0, 1), [5.0])[0][0] < 1e-5
    assert [d[0] for d in degrees(spark, Triangular(0, 1, 2), [0.0, 0.5, 1.0, 1.5, 2.0])] == [0, 0.5, 1, 0.5, 0]
    assert [d[0] for d in degrees(spark, Trapezoidal(0, 1, 2, 3), [0.5, 1.0, 1.5, 2.0, 2.5])] == [0.5, 1, 1, 1, 0.5]
    tanh = [d[0] for d in degrees(spark, TanhPulse(-1, 1, 10, 10), [0.0, 3.0, -3.0, float("nan"), None])]
    assert 0.9 <= tanh[0] <= 1 and tanh[1] < 0.05 and tanh[2] < 0.05 and tanh[3] == 1.0 and tanh[4] is None
    (a, b), (c, d) = degrees(spark, IntervalGaussian(0, 0.5, 1), [0.0, 1.0])
    assert (a, b) == (1, 1) and c == pytest.approx(0.135335283237) and d == pytest.approx(0.606530659713)
    assert degrees(spark, Gaussian(0, 1), [float("nan"), None]) == [(None, None), (None, None)]
    own = degrees(spark, Custom(lambda x: 1 / (1 + x * x)), [1.0])
    assert own == [(0.5, 0.5)]


@pytest.mark.parametrize(("kind", "values"), [(Gaussian, (0, 0)), (Triangular, (0, 0, 1)), (Trapezoidal, (0, 2, 1, 3)), (TanhPulse, (1, 0, 1, 1)), (TanhPulse, (0, 1, -1, 1)), (IntervalGaussian, (0, 1, 1)), (IntervalGaussian, (0, 0, 1)), (Gaussian, (1, 2, 3))])
def test_bad_shapes(kind, values):
    with pytest.raises(ValueError):
        kind(*values)


def test_parameters_can_be_set():
    g = Gaussian(0, 1)
    g.set_parameters([1, 2])
    assert g.parameters == (1.0, 2.0) and g.parameter_count == 2 and not g.interval
    with pytest.raises(ValueError):
        g.set_parameters([1, -2])


def table(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double")


def base(interval, consequents=None):
    bell = (lambda c: IntervalGaussian(c, 0.5, 1)) if interval else (lambda c: Gaussian(c, 1))
    grid = rules.RuleBase.grid({"a": [bell(0), bell(1)], "b": [bell(0), bell(1), bell(2)]}, 2)
    assert len(grid.rules) == 6 and grid.rules[1] == (0, 1)
    return rules.RuleBase(grid.inputs, grid.shapes, grid.rules, np.arange(36).reshape(6, 2, 3) / 10 if consequents is None else consequents)


@pytest.mark.parametrize(("interval", "method"), [(False, "weighted"), (True, "weighted"), (True, "two_bound"), (False, "two_bound")])
def test_both_forms_agree(spark, interval, method):
    rows = table(spark, (0.3, 0.4), (1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (1e6, 1e6))
    one, two = (rules.defuzzify(rows, base(interval), ["id"], method, squash.identity, form).orderBy("id").collect() for form in ("compiled", "array"))
    status = [r.status for r in one]
    assert status == [r.status for r in two]
    if method == "two_bound" and not interval:
        assert status[0] == rules.NOT_INTERVAL
    else:
        assert status == ["ok", "ok", "missing input", "missing input", "no rule fires"]
        assert all(x.out_1 == pytest.approx(y.out_1, rel=1e-9) for x, y in zip(one[:2], two[:2]))
        b = base(interval)
        low, high, y = [], [], []
        for r, rule in enumerate(b.rules):
            f = [[math.exp(-0.5 * ((x - b.shapes[i][k].parameters[0]) / s) ** 2) for s in b.shapes[i][k].parameters[1:]] for i, (k, x) in enumerate(zip(rule, (0.3, 0.4)))]
            low.append(f[0][0] * f[1][0])
            high.append(f[0][-1] * f[1][-1])
            y.append(b.consequents[r, 1] @ [0.3, 0.4, 1])
        low, high, y = map(np.array, (low, high, y))
        mid = (low + high) / 2
        want = (mid @ y / mid.sum()) if method == "weighted" else 0.5 * (low @ y / low.sum() + high @ y / high.sum())
        assert one[0].out_1 == pytest.approx(want, rel=1e-12)


def test_consequent_and_checks(spark):
    one = rules.RuleBase(("a", "b"), ((Gaussian(1, 1),), (Gaussian(2, 1),)), ((0, 0),), np.array([[[2.0, 3.0, 5.0]]]))
    assert rules.defuzzify(table(spark, (1.0, 2.0)), one, ["id"], squash=squash.identity).first().out_0 == pytest.approx(13)
    for bad in (lambda: rules.RuleBase(("a",), ((Gaussian(0, 1),),), (), np.zeros((0, 1, 2))), lambda: rules.RuleBase(("a",), ((),), ((0,),), np.zeros((1, 1, 2))), lambda: rules.RuleBase(("a",), ((Gaussian(0, 1),),), ((0,),), np.zeros((1, 1, 3))), lambda: rules.RuleBase.grid({"a": [Gaussian(0, 1)]}, 1, "ones"), lambda: rules.ensemble(None, 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="missing input"):
        rules.strict(rules.defuzzify(table(spark, (None, 2.0)), one, ["id"])).collect()


def test_preset_numbers(spark):
    rows = spark.createDataFrame([(0, 5e-5, 5e-5, 0.01), (1, 105e-6, 85e-6, 0.011), (2, 200.0, 150.0, 0.01)], "id int, mean_T1 double, mean_T2 double, mean_readout_error double")
    got = rules.guard_identity(rules.defuzzify(rows, rules.preset_base(), ["id"])).orderBy("id").collect()
    assert (got[0].raw_0, got[0].raw_1) == (pytest.approx(-0.072778447597), pytest.approx(0.034164004026)) and got[0].out_0 == 0 and not got[0].degenerate
    assert (got[1].raw_0, got[1].raw_1) == (pytest.approx(-0.105858278645), pytest.approx(0.018181436640))
    assert got[2].status == "no rule fires" and got[2].degenerate
    f = rules.firing(rows.where("id = 0"), rules.preset_base(), ["id"]).orderBy("rule_id").collect()
    assert [r.f for r in f] == pytest.approx([0.016907465653, 0.005092430793, 0.124930212199, 0.037628256807, 0.124930212199, 0.037628256807, 0.923116346387, 0.278037300453])


def test_squashing(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.0, 0.5, 3.0, float("nan"), 1000.0, -1000.0)], "x double")
    got = rows.select(squash.clip(F.col("x")).alias("c"), squash.sigmoid(F.col("x")).alias("s")).collect()
    assert [r.c for r in got][:3] == [0, 0.5, 1] and math.isnan(got[3].c) and [got[4].s, got[5].s] == [1.0, 0.0]


def counts(spark, *runs):
    return spark.createDataFrame([(i, f"c{i}", b, n) for i, run in enumerate(runs) for b, n in run.items()], "circuit_id int, circuit_name string, bitstring string, count bigint")


def test_metrics(spark):
    ours = counts(spark, {"00": 50, "11": 50}, {"00": 80, "11": 20}, {"00": 100}, {"00": 60, "11": 40}, {"00": 90, "11": 10}, {"00": 100, "11": 0}, {"00": 0}, {"0": 5, "1": 5})
    ref = counts(spark, {"00": 50, "11": 50}, {"00": 20, "11": 80}, {"11": 100}, {"00": 70, "11": 30}, {"00": 50, "11": 50}, {"00": 50, "11": 50}, {"00": 5}, {"0": 1, "1": 1})
    got = {r.circuit_id: r for r in metrics.compare_counts(ours, ref, ["circuit_id"]).collect()}
    assert (got[0].hellinger_distance, got[0].kl_divergence) == (0, 0)
    assert got[1].hellinger_distance == pytest.approx(0.447213595500) and got[2].hellinger_distance == pytest.approx(1)
    assert got[3].r2_score == pytest.approx(0.75) and got[3].hellinger_distance == pytest.approx(0.0742682, abs=1e-6)
    assert got[4].kl_divergence == pytest.approx(0.368064207168) and got[5].kl_divergence == pytest.approx(0.693147180533)
    assert got[5].r2_score == 0 and got[7].r2_score == 1 and math.isnan(got[6].hellinger_distance)
    grid = metrics.benchmark(ours, ref).where("circuit_id = 3 and metric_name = 'r2_score'").first()
    assert (grid.circuit_name, grid.reference_value) == ("c3", 1.0) and grid.delta == pytest.approx(-0.25)
    with pytest.raises(ValueError):
        metrics.kl(F.col("p"), F.col("q"), 0)
    with pytest.raises(ValueError):
        metrics.aligned(ours, ref.drop("count"), ["circuit_id"])


def test_mean_counts(spark):
    rows = spark.createDataFrame([(0, "0", 9), (0, "1", 6), (1, "0", 3), (1, "1", 0)], "member int, bitstring string, count bigint")
    assert {r.bitstring: r["count"] for r in metrics.mean_counts(rows).collect()} == {"0": 6, "1": 3}
    rows = spark.createDataFrame([(0, "0", 2), (1, "0", 3)], "member int, bitstring string, count bigint")
    assert metrics.mean_counts(rows).first()["count"] == 2


def test_channels(spark):
    rows = spark.createDataFrame([(0, [0.2, 0.3, 9.0], [0]), (1, [2.0, -1.0], [1]), (2, [0.1], [0]), (3, [0.1, 0.1], [0, 1]), (4, None, [0])], "id int, params array<double>, qubits array<int>")
    done = channels.project(rows)
    got = {r.id: r for r in done.withColumn("off", channels.completeness(done)).collect()}
    assert [got[i].channel_status for i in range(5)] == ["ok", "ok", "two parameters needed", "not a single-qubit gate", "two parameters needed"]
    assert got[0].off < 1e-12 and got[1].off < 1e-12 and got[2].kraus is None
    with pytest.raises(NotImplementedError):
        channels.unsupported("noise before gates")


def test_circuits(spark):
    gates = circuits.gate_table(spark, circuits.ghz(2), circuits.qft(2), circuits.ansatz(3, 1, 5), circuits.random_clifford(2, 3, 1))
    members = spark.createDataFrame([(0, 0.2, 0.7), (1, 0.0, 0.0)], "member int, gamma double, lam double")
    p = {(r.circuit_id, r.member, r.bitstring): r.probability for r in circuits.simulate(gates, members).collect()}
    assert p[0, 0, "00"] == pytest.approx(0.6) and p[0, 0, "11"] == pytest.approx(0.4) and p[0, 1, "11"] == pytest.approx(0.5)
    assert p[1, 0, "10"] == pytest.approx(0.25) and sum(v for (c, m, _), v in p.items() if (c, m) == (2, 0)) == pytest.approx(1)
    shots = circuits.simulate(gates, members, shots=100, seed=3)
    assert sorted(map(tuple, shots.collect())) == sorted(map(tuple, shots.collect())) and {r[0] for r in shots.groupBy("circuit_id", "member").agg(F.sum("count")).select("sum(count)").collect()} == {100}
    fid = {r.circuit_id: r.state_fidelity for r in metrics.fidelity(circuits.states(gates, members.where("member = 1")), circuits.states(gates, members.where("member = 1"))).collect()}
    assert all(v == pytest.approx(1, abs=1e-6) for v in fid.values())
    for bad in (lambda: circuits.ghz(1), lambda: circuits.qft(0), lambda: circuits.ansatz(1, 0), lambda: circuits.random_clifford(1, 0), lambda: circuits.run([], 9, 0, 0)):
        with pytest.raises(ValueError):
            bad()


def test_uniform_cliffords():
    seen = {}
    rng = np.random.default_rng(0)
    for _ in range(2400):
        u = np.eye(2, dtype=complex)
        for gate, qubits, _ in circuits.uniform_clifford(1, rng):
            u = circuits.unitary(gate, 1, None) @ u
        first = u.ravel()[np.argmax(np.abs(u.ravel()) > 1e-9)]
        key = tuple(np.round(u * abs(first) / first, 6).ravel() + 0.0)
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 24 and min(seen.values()) > 60 and max(seen.values()) < 145
    _, n, gates = circuits.random_clifford(3, 2, seed=4)
    u = np.eye(8, dtype=complex)
    for gate, qubits, theta in gates:
        u = circuits.spread(circuits.unitary(gate, len(qubits), theta), qubits, n) @ u
    for q in range(3):  # Paulis go to Paulis
        for m in ([[0, 1], [1, 0]], [[1, 0], [0, -1]]):
            image = u @ circuits.spread(np.array(m, complex), [q], n) @ u.conj().T
            assert np.allclose(np.sort(np.abs(image), axis=1)[:, -1], 1) and (np.abs(image) > 1e-9).sum() == 8


def test_drawn_shots_agree_with_density_matrices():
    _, n, gates = circuits.ansatz(3, 2, seed=1)
    gates = [*gates, ("qft", [0, 1, 2], None), ("h", [1], None)]
    for g, l in ((0.0, 0.0), (0.2, 0.3)):
        exact = np.real(np.diag(circuits.run(gates, n, g, l)))
        drawn = circuits.sample(gates, n, g, l, 20000, np.random.default_rng(3)) / 20000
        assert np.abs(drawn - exact).max() < 0.015


def test_wide_circuits(spark):
    gates = circuits.gate_table(spark, circuits.ghz(12), circuits.qft(10))
    got = circuits.simulate(gates, spark.createDataFrame([(0, 0.2, 0.1)], "member int, gamma double, lam double"), shots=400).collect()
    ghz = {r.bitstring: r["count"] for r in got if r.circuit_id == 0}
    assert set(ghz) == {"0" * 12, "1" * 12} and sum(ghz.values()) == 400 and ghz["0" * 12] / 400 == pytest.approx(0.6, abs=0.1)
    assert sum(r["count"] for r in got if r.circuit_id == 1) == 400


def test_relational_simulation_agrees(spark):
    name, n, gates = circuits.ghz(2)
    state = spark.createDataFrame([(0, 0, 0, 1.0, 0.0)], "member int, i int, j int, re double, im double")
    g, l = 0.2, 0.3
    noise = [np.diag([1, math.sqrt(1 - g)]) @ np.diag([1, math.sqrt(1 - l)]), np.diag([1, math.sqrt(1 - g)]) @ np.diag([0, math.sqrt(l)]), np.array([[0, math.sqrt(g)], [0, 0]]) @ np.diag([1, math.sqrt(1 - l)]), np.array([[0, math.sqrt(g)], [0, 0]]) @ np.diag([0, math.sqrt(l)])]
    for gate, qubits, theta in gates:
        ops = [circuits.spread(circuits.unitary(gate, len(qubits), theta), qubits, n)]
        if len(qubits) == 1:
            ops = [circuits.spread(k, qubits, n) @ ops[0] for k in noise]
        rows = [(k, i, j, float(m[i, j].real), float(np.imag(m[i, j]))) for k, m in enumerate(ops) for i in range(4) for j in range(4) if m[i, j]]
        state = circuits.apply_by_rows(state, spark.createDataFrame(rows, "k int, i int, j int, re double, im double"), ["member"])
    got = np.zeros((4, 4), dtype=complex)
    for r in state.collect():
        got[r.i, r.j] = r.re + 1j * r.im
    assert np.allclose(got, circuits.run(gates, n, g, l))


def test_fidelity_numbers():
    zero, plus = np.diag([1.0, 0.0]), np.full((2, 2), 0.5)
    assert metrics.fidelity_of(zero, zero) == pytest.approx(1) and metrics.fidelity_of(zero, np.diag([0.0, 1.0])) == pytest.approx(0) and metrics.fidelity_of(zero, plus) == pytest.approx(0.5)


def nduv(name, value, unit):
    return {"name": name, "value": value, "unit": unit}


FULL = [nduv("T1", 200, "us"), nduv("T2", 150, "us"), nduv("readout_error", 0.01, ""), nduv("prob_meas0_prep1", 0.02, ""), nduv("prob_meas1_prep0", 0.015, ""), nduv("readout_length", 1000, "ns")]


def parse(spark, **bodies):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bodies.items()]
    snaps = parsing.parse_snapshots(spark.createDataFrame(rows, "path string, body string"))
    qubits = parsing.parse_qubits(snaps)
    return {r.path: r for r in snaps.collect()}, {(r.path, r.qubit): r for r in qubits.collect()}, {r.path: r.error for r in parsing.snapshot_errors(snaps, qubits).collect()}, qubits


def test_strict_parser(spark):
    at = "2026-05-13T12:13:22Z"
    body = lambda *qubits, **more: {"backend": "x", "timestamp": at, "properties": {"qubits": list(qubits), "backend_name": "y"}} | more
    snaps, q, errors, frame = parse(
        spark,
        full=body(FULL),
        states=body([], [nduv("T1", None, "us")], [nduv("T1", float("nan"), "us")], [nduv("T1", 300, "us"), nduv("T1", "1_000", "us"), nduv(5, 1, "us"), nduv("other", 1, "zz")]),
        unit=body([nduv("T2", 1, "us")], [nduv("T1", None, "ms"), nduv("T2", "x", "us")]),
        value=body([nduv("T1", "1.0d", "us")]),
        forms=body([nduv("T1", "Infinity", "us"), nduv("T2", True, "us"), nduv("readout_error", " 1e-3 ", "")]),
        gone={"backend": "x", "properties": {}},
        bad=body(timestamp="not a date"),
        clock=body(timestamp="12:00"),
        number=body(timestamp=5),
        dated={"backend": "", "timestamp": 5, "properties": {"qubits": None, "backend_name": "y", "last_update_date": "2026-05-13T15:00:00+03:00"}},
        text=body(properties="oops"),
        inner=body(properties={"qubits": "oops"}),
        broken='{"backend": ',
        odd='{"backend": [}',
        object=body({"name": "T1"}),
    )
    r = q["full", 0]
    assert [r.t1_seconds, r.t2_seconds, r.readout_error, r.prob_meas0_prep1, r.prob_meas1_prep0, r.readout_length_seconds] == pytest.approx([200e-6, 150e-6, 0.01, 0.02, 0.015, 1e-6])
    assert [q["states", i].t1_seconds_state for i in range(4)] == ["absent", "null", "nan", "value"] and q["states", 3].t1_seconds == pytest.approx(1000e-6)
    miss = {(m.path, m.field): (m.absent, m.explicit_null, m.nan_present) for m in parsing.missingness(frame, "path").collect()}
    assert miss["states", "t1_seconds"] == (1, 1, 1) and miss["states", "t2_seconds"] == (4, 0, 0)
    assert errors["full"] is None and errors["states"] is None and errors["forms"] is None and errors["dated"] is None
    assert all(x in errors["unit"] for x in ("unit", "qubit 1", "'T1'", "'ms'", "'us'")) and "no number" in errors["value"]
    assert math.isinf(q["forms", 0].t1_seconds) and q["forms", 0].t2_seconds == pytest.approx(1e-6) and q["forms", 0].readout_error == pytest.approx(1e-3)
    assert "no text" in errors["gone"] and "no time" in errors["bad"] and "no time" in errors["clock"] and "no text" in errors["number"]
    assert snaps["dated"].backend == "y" and snaps["dated"].ts == datetime(2026, 5, 13, 12)
    assert "'properties'" in errors["text"] and "'properties.qubits'" in errors["inner"] and "JSON" in errors["broken"] and "JSON" in errors["odd"] and "not a list" in errors["object"]
    with pytest.raises(Exception, match="not a list|is needed|no number"):
        parsing.strict(frame).collect()


def test_features(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", "T1", 100e-6), ("a", "T1", 110e-6), ("a", "T1", inf), ("a", "T2", nan), ("a", "T2", 80e-6), ("a", "readout_error", 0.01), ("a", "readout_error", 0.012), ("b", "T1", 1.0)], "snap string, name string, number double")
    got = {r.snap: r for r in parsing.feature_vector(rows, "snap").collect()}
    assert got["a"].features == pytest.approx([105e-6, 80e-6, 0.011]) and (got["b"].status, got["b"].features) == ("unusable", None)
    skip = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(parsing.skip_mean(F.col("x")).alias("m")).first().m
    assert skip(None, 100e-6, 200e-6) == skip(nan, 100e-6, 200e-6) == pytest.approx(150e-6) and skip(None, nan) is None and math.isinf(skip(inf, 1.0))


def test_archive_names(spark, tmp_path):
    times = [datetime(2026, 5, d, 12, 0, 0, 123 * (d % 2)) for d in (1, 7, 4)]
    rows = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    got = rows.select("ts", archive.file_stem(F.col("ts")).alias("s"), archive.stem_time(archive.file_stem(F.col("ts"))).alias("b"), archive.cache_key(F.lit("x"), F.col("ts")).alias("k"), archive.path_for("r", F.lit("x"), F.col("ts")).alias("p")).collect()
    assert all(r.ts == r.b for r in got) and got[0].s == "20260501T120000000123Z" and got[0].k == "x:2026-05-01T12:00:00.000123+00:00" and got[2].k == "x:2026-05-04T12:00:00+00:00" and got[2].p == "r/x/20260504T120000000000Z.json"
    folder = tmp_path / "dev"
    folder.mkdir()
    for r in got:
        (folder / f"{r.s}.json").write_text('{"a": 1}')
    (folder / "notes.json").write_text("{}")
    assert [r.ts for r in archive.list_files(spark, str(tmp_path), "dev").collect()] == sorted(times)
    assert archive.list_files(spark, str(tmp_path), "none").count() == 0
    assert json.loads(archive.load_file(spark, str(tmp_path), "dev", times[0]).first().body) == {"a": 1}


def test_save_if_new(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = spark.createDataFrame([("007", datetime(2026, 5, 1), 2, "x"), ("007", datetime(2026, 5, 1), 1, "y"), ("b", datetime(2026, 5, 2), 1, None), (None, datetime(2026, 5, 2), 1, "z")], "backend string, ts timestamp, v int, body string")
    assert archive.save_if_new(rows, root).count() == 2 and archive.save_if_new(rows, root).count() == 0
    assert {(r.backend, r.v, r.body) for r in archive.archive_table(spark, root).collect()} == {("007", 2, "x"), ("b", 1, None)}  # the first in the batch wins
    later = spark.createDataFrame([("c", datetime(2026, 5, 3), 2, "late"), ("c", datetime(2026, 5, 3), 1, "early"), ("b", datetime(2026, 5, 2), 0, "no")], rows.schema)
    assert [r.body for r in archive.save_if_new(later, root, arrival="v").collect()] == ["early"]
    assert [r.ts for r in archive.list_timestamps(spark, root, "007").collect()] == [datetime(2026, 5, 1)]
    got = archive.load_one(spark, root, "b", datetime(2026, 5, 2)).first()
    assert (got.v, got.body) == (1, None) and archive.load_one(spark, root, "b", datetime(2026, 5, 9)).count() == 0
    nowhere = str(tmp_path / "none")
    assert archive.list_timestamps(spark, nowhere, "b").count() == 0 and archive.load_one(spark, nowhere, "b", datetime(2026, 5, 2)).count() == 0


def test_archive_of_many_backends(spark, tmp_path):
    root, none = str(tmp_path / "archive"), str(tmp_path / "none")
    rows = spark.range(3000).select(F.concat(F.lit("q"), F.col("id") % 1500).alias("backend"), F.timestamp_seconds((F.col("id") % 2) * 86400).alias("ts"), F.col("id").alias("v"))
    assert archive.save_if_new(rows.where("v % 3 = 0"), root, arrival="v").count() == 500 and len(list((tmp_path / "archive").rglob("*.parquet"))) < 20
    assert archive.save_if_new(rows, root, arrival="v").count() == 1000 and archive.save_if_new(rows, root).count() == 0
    files = list((tmp_path / "archive").rglob("*.parquet"))
    assert len(files) < 40 and archive.archive_table(spark, root).count() == 1500 and archive.save_if_new(rows.limit(0), none).count() == 0 and archive.archive_table(spark, none) is None
    assert [r.v for r in archive.load_one(spark, root, "q7", datetime(1970, 1, 2)).collect()] == [7] and archive.list_timestamps(spark, root, "q8").count() == 1


def test_archive_keeps_odd_names(spark, tmp_path):
    rows = spark.createDataFrame([("007", datetime(2026, 5, 1), 1), ("", datetime(2026, 5, 1), 2)], "backend string, ts timestamp, v int")
    for names in (["007"], [""], ["007", ""]):
        root = str(tmp_path / f"archive{len(names)}{names[0]}")
        batch = rows.where(F.col("backend").isin(names))
        assert archive.save_if_new(batch, root).count() == len(names) and archive.save_if_new(batch, root).count() == 0
        assert {r.backend for r in archive.archive_table(spark, root).collect()} == set(names)


def test_archive_with_a_folder_per_backend(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = spark.createDataFrame([("a", datetime(2026, 5, 1), 1), ("", datetime(2026, 5, 1), 2)], "backend string, ts timestamp, v int")
    rows.withColumns({"saved_at": F.current_timestamp(), "save_id": F.lit("x")}).write.partitionBy("backend").parquet(root)  # as versions before wrote
    more = rows.unionByName(spark.createDataFrame([("a", datetime(2026, 5, 2), 3), ("c", datetime(2026, 5, 2), 4)], rows.schema))
    assert {r.v for r in archive.save_if_new(more, root).collect()} == {3, 4} and archive.save_if_new(more, root).count() == 0
    assert {(r.backend, r.ts.day, r.v) for r in archive.archive_table(spark, root).collect()} == {("a", 1, 1), ("", 1, 2), ("a", 2, 3), ("c", 2, 4)}
    assert archive.list_timestamps(spark, root, "a").count() == 2


def test_one_of_several_writers_wins(spark, tmp_path):
    root = str(tmp_path / "archive")
    write = lambda i: archive.save_if_new(spark.createDataFrame([("b", datetime(2026, 5, 1), i)], "backend string, ts timestamp, v int"), root).count()
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(write, range(8))) == [0] * 7 + [1]
    assert spark.read.parquet(root).count() == 1 and not (tmp_path / "archive.lock").exists()
    with archive.writing(spark, root), pytest.raises(RuntimeError, match="another writer"):
        archive.save_if_new(spark.createDataFrame([("b", datetime(2026, 5, 2), 1)], "backend string, ts timestamp, v int"), root, wait=0.1)


def test_history(spark):
    start = datetime(2026, 5, 1, tzinfo=UTC)
    assert archive.historical_window(spark, start, start + timedelta(hours=8), 4).count() == 2
    for bad in (lambda: archive.historical_window(spark, start, start, 4), lambda: archive.historical_window(spark, start, start + timedelta(1), 0), lambda: archive.check_history([datetime(2026, 1, 1)], start), lambda: archive.check_history([start - timedelta(days=400)], start)):
        with pytest.raises(ValueError):
            bad()


def test_retries():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return {"a": 1}

    assert archive.fetch_with_retry(flaky, 3, slept.append) == {"a": 1} and slept == [1, 2]
    with pytest.raises(RuntimeError):
        archive.fetch_with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), 1, slept.append)
    with pytest.raises(NotImplementedError):
        archive.fetch_with_retry(lambda: (_ for _ in ()).throw(NotImplementedError()), 3, slept.append)
    encoded = json.loads(json.dumps({"t": datetime(2026, 5, 1), "c": 1 + 2j, "a": np.arange(2)}, cls=archive.SnapshotEncoder))
    assert encoded == {"t": "2026-05-01T00:00:00+00:00", "c": {"__complex__": [1.0, 2.0]}, "a": [0, 1]}


class Service:
    def target(self, backend):
        return {"num_qubits": 1}

    def properties(self, backend, at):
        if backend == "old":
            raise NotImplementedError
        return None if backend == "silent" else {"last_update_date": datetime(2026, 5, 1, 12), "qubits": [], "asked": str(at)} if backend == "good" else {"qubits": []}


def test_poll_source(spark, tmp_path):
    spark.dataSource.register(archive.PollSource)
    read = spark.read.format("calibration_poll").options(service="tests.test_engine:Service", backends="good,old,silent,undated", retries="0").load()
    rows = read.collect()
    assert [(r.backend, r.ts) for r in rows] == [("good", datetime(2026, 5, 1, 12))] and json.loads(rows[0].properties)["asked"] == "None" and rows[0].target == '{"num_qubits": 1}' and rows[0].configuration is None
    past = spark.read.format("calibration_poll").options(service="tests.test_engine:Service", backends="good", instants="2026-05-01T00:00:00Z").load().first()
    assert past.target is None and json.loads(past.properties)["asked"].startswith("2026-05-01")
    args = ["--backend", "good", "--data-dir", str(tmp_path / "a"), "--log-dir", str(tmp_path / "log"), "--service", "tests.test_engine:Service"]
    assert poller.main(args) == 0 and poller.main(args) == 0 and spark.read.parquet(str(tmp_path / "a")).count() == 1
    assert poller.main([*args, "--historical", "2026-05-02", "2026-05-01", "4"]) == 1


class Historian:
    def __init__(self, channel=None, token=None):
        self.channel, self.token = channel, token

    def properties(self, backend, at):
        return {"last_update_date": at or datetime(2026, 5, 1, 12), "channel": self.channel, "token": self.token}

    def target(self, backend):
        raise OSError("gone")

    def target_history(self, backend, at):
        return {"at": at}

    def configuration(self, backend):
        class Odd:
            n_qubits = 5

            def to_dict(self):
                raise TypeError

        return Odd()


def test_history_and_configuration(spark, tmp_path, monkeypatch):
    now = datetime.now(UTC).replace(microsecond=0)
    rows = {r.ts: r for r in poller.poll_once(spark, ["b"], str(tmp_path / "a"), [now - timedelta(days=3)], service="tests.test_engine:Historian", channel="x").collect()}
    past, current = rows[(now - timedelta(days=3)).replace(tzinfo=None)], rows[datetime(2026, 5, 1, 12)]
    assert json.loads(past.target)["at"] == (now - timedelta(days=3)).isoformat() and past.configuration is None
    assert current.target is None and json.loads(current.configuration) == {"n_qubits": 5} and json.loads(current.properties)["channel"] == "x"
    with pytest.raises(ValueError, match="days old"):
        poller.poll_once(spark, ["b"], str(tmp_path / "a"), [now - timedelta(days=31)], service="tests.test_engine:Historian")
    monkeypatch.setenv("CALIBMILL_MAX_HISTORICAL_DAYS", "7")
    monkeypatch.setenv("CALIBMILL_RETRIES", "1")
    args = poller._parser().parse_args(["--backend", "b"])
    assert (args.max_historical_days, args.retries) == (7, 1)


def test_bad_snapshots_are_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"timestamp": "nonsense"}')
    poller.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "out.quarantine")).first()
    assert row.body == '{"timestamp": "nonsense"}' and "no time" in row.error and row.path.endswith("x.json")


def test_late_rows_and_state(spark, tmp_path):
    """Rows late within the watermark still count; rows behind it don't, as their window's state is gone."""
    source = tmp_path / "events"
    day = lambda d, h: datetime(2026, 5, d, h)
    levels = lambda: poller.windowed_levels(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(source)), "1 day")
    batches = [[(day(1, 5), "a", 1.0)], [(day(1, 6), "a", 3.0), (day(4, 1), "a", 5.0)], [(day(4, 2), "a", 5.0)], [(day(1, 7), "a", 100.0), (day(3, 23), "a", 7.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.mode("append").parquet(str(source))
        poller.keep_levels(levels(), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.window_start: (r.n, r.mean_value) for r in poller.latest_levels(spark, str(tmp_path / "out")).collect()}
    assert got == {day(1, 0): (2, 2.0), day(4, 0): (2, 5.0), day(3, 0): (1, 7.0)}


def test_session_folders(spark, tmp_path):
    from types import SimpleNamespace

    from calibmill import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(cluster)
    staged = session.stage(spark.range(3))
    assert staged.count() == 3 and session.release(spark) >= 1
    with pytest.raises(Exception, match="does not exist|DOES_NOT_EXIST|NOT_EXIST"):
        spark.read.parquet(staged.inputFiles()[0])


def test_ingest_is_idempotent(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    write = lambda name, ts: (landing / name).write_text(json.dumps({"backend": "b", "timestamp": ts, "properties": {"qubits": []}}))
    write("1.json", "2026-05-01T00:00:00Z")
    write("2.json", "2026-05-01T00:00:00Z")
    write("3.json", "nonsense")
    run = lambda log: poller.ingest_files(spark, str(landing), str(tmp_path / "out"), str(tmp_path / log))
    run("log")
    run("log")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    write("4.json", "2026-05-02T00:00:00Z")
    run("log")
    run("another")  # all files once more
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_custom_and_native_shape_agree(spark):
    native, own = Gaussian(1, 2), Custom(lambda x: pd.Series(np.exp(-0.5 * ((x - 1) / 2) ** 2)))
    assert [d[0] for d in degrees(spark, native, [0.0, 1.5])] == pytest.approx([d[0] for d in degrees(spark, own, [0.0, 1.5])])


def test_pipeline_stages_can_be_exchanged(spark):
    from calibmill.plans.pipeline import NoisePipeline

    rows = spark.createDataFrame([("a", "T1", 1.0), ("a", "T2", 1.0), ("a", "readout_error", 0.5), ("b", "T1", 1.0)], "snap string, name string, number double")
    grid = rules.RuleBase.grid({f: [Gaussian(0, 1), Gaussian(1, 1)] for f in parsing.FEATURES}, 2)
    got = {r.snap: r for r in NoisePipeline(grid, squash=squash.sigmoid).channels(rows, "snap").collect()}
    assert got["a"].params == [0.5, 0.5] and got["a"].channel_status == "ok" and got["b"].status == "missing input" and got["b"].kraus is None
    with pytest.raises(NotImplementedError):
        NoisePipeline(grid, install="before gates")
    with pytest.raises(NotImplementedError):
        NoisePipeline(grid, normalise="derivative")
    with pytest.raises(ValueError):
        NoisePipeline(grid, project="else")
    assert NoisePipeline(grid, install="after gates", method=lambda s: s["w_low"] / s["t_low"]).channels(rows, "snap").count() == 2
    state = spark.createDataFrame([("c", 0, 0, 1.0, 0.0), ("c", 1, 1, 0.0, 0.0)], "circuit_id string, i int, j int, re double, im double")
    grid_rows = {r.metric_name: r for r in NoisePipeline(grid, metrics={"tv": lambda p, q: F.sum(F.abs(p - q)) / 2}).benchmark(counts(spark, {"0": 1, "1": 1}), counts(spark, {"0": 1})).collect()}
    assert set(grid_rows) == {"tv"} and grid_rows["tv"].delta == 0.5 and state.count() == 2
    own = NoisePipeline(grid, metrics={"total_variation": lambda p, q: F.sum(F.abs(p - q)) / 2})
    assert own.compare(counts(spark, {"0": 1, "1": 1}), counts(spark, {"0": 1}), ["circuit_id"]).first().total_variation == 0.5


def test_target_projection(spark):
    text = json.dumps({"num_qubits": 2, "physical_qubits": [0, 1], "operations": [{"name": "x", "qargs": [0], "duration": "long", "error": 0.1}, 5, None, {"name": "cx", "instances": [None, {"qargs": [0, 1], "duration": 1}]}, {"name": "id"}]})
    got = [r.t for r in spark.createDataFrame([(text,), (None,), ("[1]",), ("{",)], "x string").select(archive.project_target(F.col("x")).alias("t")).collect()]
    assert got[1:] == [None, None, None]
    assert json.loads(got[0])["operations"] == [{"name": "x", "qargs": [0], "error": 0.1}, {"name": "cx", "qargs": [0, 1], "duration": 1.0}, {"name": "id"}]


def test_times_without_zone_can_be_errors(spark):
    rows = spark.createDataFrame([("a", '{"timestamp": "2026-05-01T00:00:00"}'), ("b", '{"timestamp": "2026-05-01T00:00:00Z"}')], "path string, body string")
    assert {r.path: r.error is None for r in parsing.parse_snapshots(rows, naive_is_error=True).collect()} == {"a": False, "b": True}


def test_demo(spark, capsys):
    from calibmill.plans import demo

    times = demo.ensemble_times(spark, sizes=(1, 2), shots=64)
    assert set(times) == {1, 2} and all(t > 0 for t in times.values())
    snaps, q, errors, _ = parse(spark, synthetic=archive.synthetic_body(datetime(2026, 5, 1, tzinfo=UTC)))
    assert "is needed" in errors["synthetic"] and snaps["synthetic"].backend == "synthetic"
