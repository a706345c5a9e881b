"""Shredding: levels by hand, tables against brute force, dirty texts."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from calibmill.functions.jsontext import UNREADABLE, read_json
from calibmill.operators import shred

DDL = "archive_id bigint, properties string, target string, note string"


def lists(v):
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def brute(rows):
    out = set()
    for key, properties, target, *_ in rows:
        p, t = read_json(properties), read_json(target)
        if isinstance(p, dict):
            out |= {(key, "entry", q, i) for q, x in enumerate(lists(p.get("qubits"))) for i, e in enumerate(lists(x)) if isinstance(e, dict)}
            for name in ("gates", "gate_list", "gate_props", "stuff"):
                for i, g in enumerate(lists(p.get(name))):
                    if isinstance(g, dict):
                        out.add((key, "gate", -1, i))
                        out |= {(key, "gate_parameter", i, j) for j, x in enumerate(lists(g.get("parameters"))) if isinstance(x, dict)}
            out |= {(key, "general", -1, i) for i, g in enumerate(lists(p.get("general"))) if isinstance(g, dict)}
        if isinstance(t, dict):
            for i, o in enumerate(lists(t.get("operations"))):
                if isinstance(o, dict):
                    out.add((key, "operation", -1, i))
                    out |= {(key, "instance", i, j) for j, x in enumerate(lists(o.get("instances"))) if isinstance(x, dict)}
    return out


def test_levels_of_a_path():
    root = shred.Shredder({"qubits", "qubits[]"}).shred({"qubits": [[{"name": "a"}, None], None, [], [{"value": 1}]]})
    entry = next(c for c in root.columns() if c.path == "qubits[][]")
    assert entry.reps == [0, 2, 1, 1, 1]
    assert entry.full == 5 and entry.defs == [5, 4, 2, 3, 5]
    name = next(c for c in root.columns() if c.path == "qubits[][].name")
    assert (name.reps, name.values) == (entry.reps, ["a", None, None, None, None])
    value = next(c for c in root.columns() if c.path == "qubits[][].value")
    assert value.reps == entry.reps and value.values[-1] == "1" and value.types[0] == shred.ABSENT
    reps = np.array(entry.reps)
    assert shred.positions(reps, 1).tolist() == [0, 0, 1, 2, 3] and shred.positions(reps, 2).tolist() == [0, 1, 0, 0, 0]


def test_dirty_texts(spark):
    entry = {"name": "T1", "value": 1.5, "unit": "us"}
    docs = [
        {"qubits": [[entry, None, {"name": "T1"}], entry, None, []], "general": {"name": "x"}},
        {"qubits": None, "gate_list": [{"gate": "cx", "qubits": [0, 1], "parameters": {"name": "e"}}, None, {"gate": "x", "qubits": [0]}]},
        {"stuff": [{"gate": "h", "parameters": [None, {"name": "e"}]}], "qubits": "oops"},
        [],
        5,
    ]
    rows = [(i, json.dumps(d), json.dumps({"operations": [{"name": "x", "instances": [None, {"qargs": [0]}]}, {"name": "y", "instances": {"qargs": []}}, None]}), "extra") for i, d in enumerate(docs)]
    rows += [(10, json.dumps(json.dumps(docs[0])), None, None), (11, None, "", None), (12, '{"qubits": [[{"name": "T1"', "{}", None), (13, '{"qubits": [[{"value": NaN}]]}', "null", None), (10, json.dumps(docs[0]), None, None)]
    found = [tuple(r) for r in shred.found_children(spark.createDataFrame(rows, DDL)).collect()]
    assert set(found) == brute(rows)
    assert sum(r[0] == 10 for r in found) == 2 * sum(r[0] == 0 and r[1] in ("entry", "general") for r in found)  # repeated rows count again
    assert shred.found_children(spark.createDataFrame([], DDL)).count() == 0


def test_values_come_back(spark):
    doc = {"qubits": [[{"name": "T1", "value": None, "flags": ["a"]}, {"value": "x", "deep": {"y": 1}}]]}
    rows = shred.leaf_tables(shred.shred_levels(spark.createDataFrame([(1, json.dumps(doc), None, None)], DDL))).collect()
    got = {(r.pos, r.key): (r.json_type, r.value) for r in rows}
    assert got == {(0, "name"): ("string", "T1"), (0, "value"): ("null", None), (0, "flags"): ("array", None), (1, "value"): ("string", "x"), (1, "deep"): ("object", None)}


_json = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["qubits", "a", "b"]), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["qubits", "general", "z"]), _json, max_size=3))
def test_every_column_has_a_level_per_record_of_its_parent(doc):
    root = shred.Shredder(shred.LISTS["properties"]).shred(doc)
    for col in root.columns():
        assert len(col.reps) == len(col.defs) == len(col.types) == len(col.values)
        for kid in col.kids.values():
            assert kid.reps == col.reps
        if col.elem is not None:
            assert [r for r in col.elem.reps if r <= col.rep] == col.reps and max(col.elem.defs) <= col.elem.full


def test_unreadable():
    assert read_json("[1, 2") is UNREADABLE and read_json(None) is UNREADABLE and read_json('"{\\"a\\": 1}"') == {"a": 1}
    assert read_json("[" * 100_000) is UNREADABLE
