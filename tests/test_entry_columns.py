"""The consistent entry table keeps every key of an entry, whatever its layout calls it."""

import json

from calibmill.operators import drift
from calibmill.session import stage
from tests.test_archive_problems import archive, entry


def whole(rows):
    return drift.consistent_entries(rows, stage(drift.catalogue(rows), "kind"))


def test_no_key_is_lost(spark):
    nan = float("nan")
    docs = [
        {"qubits": [[entry("T1", 1.0, "us", flags=["auto", None], stderr=0.5, method="echo"), entry("T2", "2 ms", "parsec", date="soon", extra={"a": [1]}, stderr=None, val=7)]]},
        json.dumps({"qubits": [[entry("T1", None, "us", stderr=nan, flags=[], method={"m": 1}, none=None), {"name": 5, "stderr": "0.1 us"}]]}),
    ]
    rows = archive(spark, docs)
    got = {(r.archive_id, r.pos): r for r in whole(rows.union(rows.limit(1))).collect()}
    one, two, three, four = (got[k] for k in ((1, 0), (1, 1), (2, 0), (2, 1)))
    assert (json.loads(one.flags), one.stderr, one.method, one.more) == (["auto", None], 0.5, "echo", {})
    assert (two.value, two.unit, two.flags, two.stderr) == (2.0, "ms", None, None)
    assert two.more == {"unit": '"parsec"', "date": '"soon"', "extra": '{"a": [1]}', "val": "7"}
    assert (three.flags, json.loads(three.method), three.more) == ("[]", {"m": 1}, {"none": "null"}) and three.stderr != three.stderr
    assert (four.stderr, four.more) == (0.1, {"name": "5", "stderr": '"0.1 us"'})


def test_keys_the_alias_table_lacks(spark):
    one = {"qubits": [[entry("T1", 100.0, "us", stderr=1e-5), entry("leakage", 120.0)]]}
    two = {"qubits": [[{"name": "T1", "grade": 101.0, "unit": "us", "spread": 1e-5, "z": 1}, {"name": "leakage", "grade": 119.0}]]}
    rows = archive(spark, [one, two, (two, 1, "b"), (two, 2, "b"), (two, 0, "other")])  # also a second delivery, a later file, another producer
    got = {(r.archive_id, r.pos): r for r in whole(rows).collect()}
    assert [got[i, 0].value for i in range(1, 6)] == [100.0, 101.0, 101.0, 101.0, 101.0]
    assert [got[i, 0].stderr for i in range(1, 6)] == [1e-5] * 5 and [got[i, 1].value for i in range(2, 6)] == [119.0] * 4
    assert [got[i, 0].more for i in range(2, 6)] == [{"z": "1"}] * 4
