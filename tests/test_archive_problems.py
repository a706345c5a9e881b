"""Units, drift and changes between snapshots on small archives, against brute force."""

import json
import math
from datetime import datetime, timedelta

import pytest

from calibmill.functions.lexicon import common_name, split_quantity, stated_time_unit, unit_of
from calibmill.operators import drift, entries, snapdiff, units
from calibmill.session import stage

DDL = "archive_id bigint, file_name string, campaign string, backend string, ts timestamp, schema_version string, properties string, target string, configuration string, body_backend string"
BACKENDS = "backend string, family string, num_qubits int, poll_minutes int, dt_ns double, online_since timestamp"
START = datetime(2022, 5, 1)


def entry(name, value, unit="", **more):
    return {"name": name, "value": value, "unit": unit} | more


def archive(spark, docs, backend="b", config='{"dt": 2e-9}'):
    rows = []
    for i, d in enumerate(docs):
        doc, ts, dev = (d if isinstance(d, tuple) else (d, i, backend))
        rows.append((i + 1, f"b/{i}.json", "c", dev, START + timedelta(hours=ts), "1.0", doc if doc is None or isinstance(doc, str) else json.dumps(doc), None, config, "clash"))
    return spark.createDataFrame(rows, DDL)


def backends(spark):
    return spark.createDataFrame([("b", None, 2, 10, None, None)], BACKENDS)


def test_lexicon():
    assert split_quantity("66,7438 μs") == (66.7438, "μs") and split_quantity("9.5e-05seconds") == (9.5e-05, "seconds") and split_quantity("n/a") is None
    assert math.isnan(split_quantity("NaN")[0])
    assert [unit_of(u) for u in ("µs", " US ", "", None, "furlong", "‰", "Per Mille")] == ["us", "us", "", "", None, "‰", "‰"]
    assert common_name("prob_meas0prep1") == common_name("P_0_given_1") == "prob_meas0_prep1" and common_name(5) is None
    assert stated_time_unit("T1, T2 in µs as usual") == "us" and stated_time_unit("SI units (s) for T1, T2") == "s" and stated_time_unit("ns or us") is None


def test_quantity_states():
    q = entries.quantity
    assert q(None, "us") == ("null", None, "us") and q(" ", None)[0] == "null" and q(float("nan"), "ms") == ("nan", None, "ms")
    assert q("0.15 ms", "us") == ("number", 0.15, "ms") and q(True, "")[0] == "other" and q("x", "")[0] == "other" and q({}, "")[0] == "other"
    assert q(5, "parsec") == ("number", 5.0, "?") and q("5 parsec", "us") == ("number", 5.0, "us")


def test_units_without_statement(spark):
    docs = []
    for i in range(12):
        scale = {9: 1e-3, 10: 1e3, 11: 1e-6}.get(i, 1.0)
        docs.append({"qubits": [[entry("T1", round(100.0 + i, 6) * scale), entry("readout_error", 0.01), entry("frequency", 5.1 if i else 5.1e9, None), entry("readout_length", 300, "dt"), entry("T1_time", None) if i == 3 else entry("leakage", 1)]]})
    docs.append({"qubits": [[entry("T2", "80 us", "ms"), entry("T2", 0.08, "ms")], entry("T1", "0.1ms")]})
    rows = archive(spark, docs)
    parsed = stage(entries.parse_archive(rows), "kind")
    done = {(r.archive_id, r.qubit, r.field): r for r in units.convert_entries(parsed, backends(spark)).collect()}
    assert {done[i + 1, 0, "T1"].unit_used for i in range(9) if i != 3} == {"us"}
    assert [done[i, 0, "T1"].unit_used for i in (10, 11, 12)] == ["ms", "ns", "s"]
    assert done[4, 0, "T1"].state == "null"  # the last entry of a name holds, whatever it is called
    assert done[1, 0, "frequency"].unit_used == "Hz" and done[2, 0, "readout_length"].common == pytest.approx(600)
    assert done[13, 0, "T2"].common == pytest.approx(80) and done[13, 1, "T1"].common == pytest.approx(100)
    qc = spark.createDataFrame([(1, "b", 0, 1e-4, None)], "row_id bigint, backend string, qubit int, t1_seconds double, note string")
    found = {tuple(r) for r in units.found_units(parsed, backends(spark), qc).collect()}
    assert ("properties", 10, 0, "T1") in found and ("properties", 1, 0, "readout_length") in found and ("properties", 2, 0, "frequency") not in found
    assert ("properties", 13, 0, "T2") in found and ("properties", 4, 0, "T1") not in found


def test_t1_in_seconds(spark):
    rows = [(i, "b", 1e-4 * (1 + i / 100), None, "x") for i in range(50)]
    rows += [(50, "b", 0.1, "T1 given in ms", "x"), (51, "b", 101.0, None, "x"), (52, "b", 1.2e5, "T1 ns", "x"), (53, "b", None, None, "x"), (54, "b", float("nan"), "µs!", "x"), (55, "b", -1e-4, None, "x"), (56, "b", 0.0, "readout window 1 us", "x"), (57, "b", float("inf"), None, "x"), (58, None, 1e-4, None, "x")]
    got = {r.row_id: r for r in units.t1_in_seconds(spark.createDataFrame(rows, "row_id bigint, backend string, t1_seconds double, note string, t1_unit string")).collect()}
    assert len(got) == 59
    assert [got[i].t1_unit for i in (0, 50, 51, 52, 53, 54, 55, 56, 57, 58)] == ["s", "ms", "us", "ns", "s", "s", "s", "s", "s", "s"]
    assert got[50].t1_common == pytest.approx(1e-4) and got[51].t1_common == pytest.approx(1.01e-4)
    assert units.t1_in_seconds(spark.createDataFrame([], "row_id bigint, backend string, t1_seconds double, note string")).count() == 0


def test_drift(spark):
    base = {"gates": [{"gate": "x", "qubits": [0]}], "n_qubits": 5, "qubits": [[entry("T1", 1.0), entry("T2", "2")]]}
    second = {"gate_list": [{"gate": "x", "qubits": [0]}], "n_qubits": "5", "qubits": [[{"name": "T1_time", "val": "1.0", "unit": "us"}, {"name": "T2", "val": "2", "unit": None}]], "chip": {}}
    docs = [base, '{"qubits": [[', second, base | {"zz_relax": 1}, (base, 2.5, ""), (base, 3, "b")]
    rows = archive(spark, docs)
    found = {tuple(r) for r in drift.found_drift(rows, stage(drift.catalogue(rows), "kind")).collect()}
    # file 5 has no backend column and no body backend: its file name says b, so it lies between 3 and 4
    third = {(3, "properties.gates", "properties.gate_list", "renamed"), (3, "properties.n_qubits", "properties.n_qubits", "retyped"), (3, "entry.value", "entry.val", "renamed"), (3, "entry.value", "entry.val", "retyped"), (3, "name.T1", "name.T1_time", "renamed"), (3, "", "properties.chip", "added")}
    assert {f for f in found if f[0] == 3} == third - {(3, "entry.value", "entry.val", "retyped")} or {f for f in found if f[0] == 3} == third
    assert {(5, "properties.chip", "", "removed"), (5, "name.T1_time", "name.T1", "renamed"), (5, "properties.gate_list", "properties.gates", "renamed")} <= found
    assert {f for f in found if f[0] == 4} == {(4, "", "properties.zz_relax", "added")}
    assert not {f for f in found if f[0] in (1, 2, 6)}  # the first, an unreadable one, a second delivery
    assert drift.found_drift(rows.limit(0), drift.catalogue(rows.limit(0))).count() == 0


def test_unknown_rename_by_content(spark):
    one = {"qubits": [[entry("T1", 100.0), entry("leakage", 1e-4)]], "note_a": "2022-05-01"}
    two = {"qubits": [[entry("relax_T", 101.0), entry("leakage", 1e-4)]], "note_b": "2022-05-02"}
    rows = archive(spark, [one, two])
    found = {tuple(r)[1:] for r in drift.found_drift(rows, drift.catalogue(rows)).collect()}
    assert {("name.T1", "name.relax_T", "renamed"), ("properties.note_a", "properties.note_b", "renamed")} == found
    learnt = {(r.path, r.common, r.support) for r in drift.alias_table(rows, drift.catalogue(rows)).where("learnt").collect()}
    assert learnt == {("name.relax_T", "T1", 1), ("properties.note_b", "note_a", 1)}


def test_renames_learnt_elsewhere(spark):
    """A rename that content shows for one producer is known for another, whose values are null."""
    one, two = ({"qubits": [[entry("T1", 100.0, "us", **{key: 3.5})]]} for key in ("made_at", "created"))
    null = [json.loads(json.dumps(d).replace("3.5", "null")) for d in (one, two)]
    rows = archive(spark, [one, two, (null[0], 0, "c"), (null[1], 1, "c"), ({"qubits": [[entry("T1", 100.0, "us", created=9e9)]]}, 2, "c"), ({"qubits": [[entry("T1", 100.0, "us", other=1.0)]]}, 3, "c")])
    found = {tuple(r) for r in drift.found_drift(rows, drift.catalogue(rows)).collect()}
    assert {f for f in found if f[0] in (2, 4)} == {(2, "entry.made_at", "entry.created", "renamed"), (4, "entry.made_at", "entry.created", "renamed")}
    assert {f for f in found if f[0] == 6} == {(6, "entry.created", "", "removed"), (6, "", "entry.other", "added")}


def test_equally_common_types():
    assert drift.types_of(["a", 1, None, "b", 2.0])[0] == "number" and drift.types_of([None])[0] is None and drift.types_of([[], {}])[0] == "array"


def brute_changes(snaps):
    """snaps: list of {key: value}; None, nan or number."""
    out = set()
    for i in range(1, len(snaps)):
        a, b = snaps[i - 1], snaps[i]
        for key in a.keys() | b.keys():
            if key not in a:
                out.add((i, *key, "added"))
            elif key not in b:
                out.add((i, *key, "removed"))
            else:
                x, y = a[key], b[key]
                kinds = ["null" if v is None else "nan" if v != v else "n" for v in (x, y)]
                if kinds[0] != kinds[1] or kinds[0] == "n" and abs(x - y) > 1e-5 * max(abs(x), abs(y)):
                    out.add((i, *key, "changed"))
    return out


def test_changes(spark):
    nan = float("nan")
    series = [100.0, 100.0, 100.0005, 101.0, None, None, nan, nan, 101.0, "gone", "gone", 101.0, 101.0]
    snaps, docs = [], []
    for i, v in enumerate(series):
        unit = "us" if i % 2 else "ms"
        snap = {} if v == "gone" else {(0, "T1"): v}
        q0 = [] if v == "gone" else [entry("T1", 5.0, "us"), entry("T1" if i % 3 else "t1", None if v is None else v if unit == "us" or v != v else v / 1000, unit)]
        q1 = [entry("prob_meas1prep0", "1.5 %")] if i % 4 else [entry("p_1_given_0", 0.015)]
        if i != 6:
            snap[1, "prob_meas1_prep0"] = 0.015
        snaps.append(snap)
        docs.append({"qubits": [q0, q1 if i != 6 else []]})
    rows = archive(spark, docs)
    parsed = stage(entries.parse_archive(rows), "kind")
    found = {tuple(r) for r in snapdiff.found_changes(parsed, backends(spark)).collect()}
    assert found == {(i + 1, *rest) for i, *rest in brute_changes(snaps)}
    spans = snapdiff.validity(snapdiff.archive_records(parsed, backends(spark)), ["backend", "campaign", "qubit", "field"]).where("qubit = 0").orderBy("from_idx").collect()
    assert [(r.from_idx, r.to_idx) for r in spans] == [(0, 2), (3, 3), (4, 5), (6, 7), (8, 8), (11, 12)]
