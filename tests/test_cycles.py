"""Readout lengths in device cycles without a unit."""

import pytest

from calibmill.operators import entries, units
from calibmill.session import stage
from tests.test_archive_problems import archive, backends, entry


@pytest.mark.parametrize("config", ['{"dt": 2e-10}', "{}"])
def test_cycles_without_statement(spark, config):
    # file 31 has no unit, and 1500 cycles of 0.2 ns are 300 ns; file 32 has ns without a unit, file 33 states cycles
    docs = [{"qubits": [[entry("readout_length", 300 + i % 3, "ns")]]} for i in range(30)]
    docs += [{"qubits": [[entry("readout_length", x, unit)]]} for x, unit in ((1500, ""), (301, ""), (1505, "dt"))]
    rows = archive(spark, docs, config=config)
    parsed = stage(entries.parse_archive(rows), "kind")
    done = {r.archive_id: r for r in units.convert_entries(parsed, backends(spark)).collect()}
    known = config != "{}"
    assert [done[i].unit_used for i in (30, 31, 32, 33)] == ["ns", "dt" if known else "ns", "ns", "dt"]
    if known:
        assert [done[i].common for i in (31, 32, 33)] == pytest.approx([300, 301, 301])
    qc = spark.createDataFrame([], "row_id bigint, backend string, qubit int, t1_seconds double, note string")
    found = {r.rec_id for r in units.found_units(parsed, backends(spark), qc).collect()}
    assert found == ({31, 33} if known else {33})
