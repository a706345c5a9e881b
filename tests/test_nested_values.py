"""Children come back whole from the rows of their flat tables."""

import json
import random
import re

from calibmill.operators import shred

DDL = "archive_id bigint, properties string, target string"


def rebuilt(rows):
    """The objects of {(archive_id, child, parent_pos, pos)} from their rows, shortest paths first."""
    out = {}
    for r in sorted(rows, key=lambda r: (len(re.findall(r"(?:\\.|[^\\.\[])+|\[\]", r.below)), r.item_pos)):
        steps, item = [r.key], iter(r.item_pos)
        for step in re.findall(r"\[\]|\.((?:\\.|[^\\.\[])*)", r.below):
            steps.append(shred.key_of(step))
        kinds = re.findall(r"\[\]|\.(?:\\.|[^\\.\[])*", r.below)
        steps[1:] = [next(item) if kind == "[]" else step for kind, step in zip(kinds, steps[1:])]
        value = {"array": list, "object": dict}.get(r.json_type, lambda: r.value if r.json_type == "string" else json.loads(r.value or "null"))()
        at = out.setdefault((r.archive_id, r.child, r.parent_pos, r.pos), {})
        for step in steps[:-1]:
            at = at[step]
        if isinstance(at, list):
            assert len(at) == steps[-1]
            at.append(value)
        else:
            assert steps[-1] not in at
            at[steps[-1]] = value
    return out


def tables(spark, rows):
    return shred.leaf_tables(shred.shred_levels(spark.createDataFrame(rows, DDL)), nested=True).collect()


def test_lists_objects_and_odd_keys(spark):
    entry = {"name": "T1", "flags": ["a", None, 2], "a.b": 1, "a": {"b": [[], [{"c": 3}]]}, "[]": "x", "": 0, "back\\slash": [None]}
    gates = [{"gate": "cx", "qubits": [0, 1], "parameters": [None, 5, {"name": "e", "at": [9]}]}, {"gate": "x", "qubits": []}]
    target = {"operations": [{"name": "x", "qargs": [[0, 1], [2]], "instances": [{"qargs": [0, 1]}, {"qargs": 3}]}]}
    rows = [(1, json.dumps({"qubits": [[entry, None, {"flags": 7}]], "gates": gates}), json.dumps(target)), (2, json.dumps({"qubits": [[entry]]}), None)]
    got = tables(spark, rows)
    back = {(r.archive_id, r.child, r.parent_pos, r.pos) for r in got}
    assert back == {(1, "entry", 0, 0), (1, "entry", 0, 2), (1, "gate", -1, 0), (1, "gate", -1, 1), (1, "gate_parameter", 0, 2), (1, "operation", -1, 0), (1, "instance", 0, 0), (1, "instance", 0, 1), (2, "entry", 0, 0)}
    qubits = sorted((r.pos, r.item_pos, r.value) for r in got if r.child == "gate" and r.key == "qubits" and r.below == "[]")
    assert qubits == [(0, [0], "0"), (0, [1], "1")]
    parts = rebuilt([r for r in got if r.key not in ("parameters", "instances")])
    assert parts[1, "entry", 0, 0] == parts[2, "entry", 0, 0] == entry and parts[1, "entry", 0, 2] == {"flags": 7}
    assert parts[1, "gate_parameter", 0, 2] == {"name": "e", "at": [9]} and parts[1, "instance", 0, 1] == {"qargs": 3}
    assert parts[1, "operation", -1, 0] == {"name": "x", "qargs": [[0, 1], [2]]}
    assert [(r.item_pos, r.json_type, r.value) for r in got if r.key == "parameters" and r.below] == [([0], "null", None), ([1], "number", "5")]


def test_random_entries_come_back(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, rng.randrange(9), rng.random(), rng.choice("abc")][kind]
        return [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 5 else {k: value(depth - 1) for k in rng.sample(["a", "b", "a.b", ".", "\\"], rng.randrange(4))}

    docs = {i: [[{k: value(3) for k in rng.sample(["a", "b", "c.d"], 2)} for _ in range(3)] for _ in range(2)] for i in range(40)}
    got = rebuilt(tables(spark, [(i, json.dumps({"qubits": d}), None) for i, d in docs.items()]))
    assert got == {(i, "entry", q, p): e for i, d in docs.items() for q, entries in enumerate(d) for p, e in enumerate(entries)}
