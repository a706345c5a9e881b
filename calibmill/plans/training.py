"""Queries p1 to p6: data problems of calibration archives, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibmill.functions import lexicon
from calibmill.operators import drift, entries, impute, shred, snapdiff, spikes, units
from calibmill.session import stage, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.found_children(table(spark, sf, "raw_archive"))


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables in long form, with values and what lists and objects below a child hold."""
    return shred.leaf_tables(shred.shred_levels(table(spark, sf, "raw_archive")), nested=True)


def _leaves(spark: SparkSession, sf: str, part: str) -> DataFrame:
    return shred.leaf_tables(shred.shred_levels(table(spark, sf, "raw_archive"), {part: None}), nested=True)


def p1_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of gates, with the qubits each acts on."""
    rows = shred.flat_table(_leaves(spark, sf, "properties"), "gate")
    return rows.select("archive_id", "pos", "gate", "name", F.array_join(F.transform("qubits", lambda q: q.cast("string")), ",", "null").alias("qubits"))


def p1_instances(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of instances, with their operation's position and the qubits each acts on."""
    rows = shred.flat_table(_leaves(spark, sf, "target"), "instance")
    return rows.select("archive_id", "parent_pos", "pos", "duration", "error", F.array_join(F.transform("qargs", lambda q: q.cast("string")), ",", "null").alias("qargs"))


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return shred.child_counts(p1_found(spark, sf))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return stage(entries.parse_archive(table(spark, sf, "raw_archive")), "kind")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.found_units(_parsed(spark, sf), table(spark, sf, "backends"), table(spark, sf, "qubit_calibration"))


def p2_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in us, ns, GHz and fractions, with the unit used, where it comes from and whether it is uncertain."""
    done = units.convert_entries(_parsed(spark, sf), table(spark, sf, "backends"))
    return done.select("archive_id", "source", "qubit", "field", "state", "number", "unit", "unit_used", "unit_from", "posterior", "uncertain", "common")


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry's unit and its value in the common unit."""
    done = units.convert_entries(_parsed(spark, sf), table(spark, sf, "backends"))
    return done.select("archive_id", "qubit", "field", "state", F.when(F.col("state") == entries.IS_NUMBER, F.col("unit_used")).alias("unit"), F.round(F.when(F.col("state") == entries.IS_NUMBER, F.col("common")), 6).alias("common"))


def p2_t1_units(spark: SparkSession, sf: str) -> DataFrame:
    """The unit each t1_seconds is in, and its seconds (in billionths of one)."""
    return units.t1_in_seconds(table(spark, sf, "qubit_calibration").select("row_id", "backend", "t1_seconds", "note")).select("row_id", "t1_unit", F.round(F.col("t1_common") * 1e9, 3).alias("t1_ns"))


def p2_t1_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """t1_seconds in seconds, with the unit each number was in."""
    return units.t1_in_seconds(table(spark, sf, "qubit_calibration").select("row_id", "backend", "t1_seconds", "note")).select("row_id", "t1_unit", F.col("t1_common").alias("t1_seconds"), "t1_posterior", "t1_uncertain")


def _footers(spark: SparkSession, sf: str) -> DataFrame:
    return stage(drift.catalogue(table(spark, sf, "raw_archive")), "kind")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.found_drift(table(spark, sf, "raw_archive"), _footers(spark, sf))


def p3_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return drift.lifespans(_footers(spark, sf))


def p3_casts(spark: SparkSession, sf: str) -> DataFrame:
    """The columns and casts that bring every path and type into one table."""
    archive, footers = table(spark, sf, "raw_archive"), _footers(spark, sf)
    return drift.casts(footers, drift.alias_table(archive, footers))


def p3_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The alias table: common names, and names learnt from renames with their support."""
    return drift.alias_table(table(spark, sf, "raw_archive"), _footers(spark, sf))


def p3_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One consistent entry table over every layout."""
    return drift.consistent_entries(table(spark, sf, "raw_archive"), _footers(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapdiff.found_changes(_parsed(spark, sf), table(spark, sf, "backends"))


def p4_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Validity intervals of every record."""
    records = snapdiff.archive_records(_parsed(spark, sf), table(spark, sf, "backends"))
    return snapdiff.validity(records, ["backend", "campaign", "qubit", "field"]).withColumn("number", F.round("number", 6))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.found_spikes(table(spark, sf, "qubit_calibration"))


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with its level, isolation score and case mark."""
    wide = spikes.scores(table(spark, sf, "qubit_calibration"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"z_{f}").alias("level"), F.col(f"run_{f}").cast("int").alias("run"), F.col(f"score_{f}").alias("score"), F.col(f"case_{f}").alias("faulty")) for f in spikes.FIELDS])).alias("c")
    return wide.select("row_id", "source", cells).select("row_id", "source", "c.*").where("run is not null")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return impute.found_missing(table(spark, sf, "qubit_calibration"))


def p6_filled(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(table(spark, sf, "qubit_calibration"))


def p6_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Every dependency tried, with the records it was tested on and its confidence, those that don't hold too."""
    rows = stage(impute.candidates(table(spark, sf, "qubit_calibration")))
    return impute.mine(impute.dictionaries(impute.content_counts(rows))).unionByName(impute.verify_numbers(rows))


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The texts met as readout_line, with how far they spread over qubits and whether they count as missing."""
    return impute.label_spread(table(spark, sf, "qubit_calibration"))


def p6_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How well one cell in fifty comes back when hidden, by field and by where its filling comes from."""
    return impute.accuracy(table(spark, sf, "qubit_calibration"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_tables, p1_gates, p1_instances, p1_counts, p2_found, p2_entries, p2_values, p2_t1_units, p2_t1_seconds, p3_found, p3_lifespans, p3_casts, p3_aliases, p3_entries, p4_found, p4_validity, p5_found, p5_scores, p6_found, p6_filled, p6_dependencies, p6_labels, p6_accuracy)}

_UNKNOWN = "'n/a', 'na', 'nan', 'none', 'null', 'unknown', 'unk', '?', '-', 'tbd', 'missing', 'not known'"


def _objects(x: str) -> str:
    """A JSON value as a list: a lone object counts as one of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _unwrapped(part: str) -> str:
    """d_<part>: (archive_id, d), the complete JSON objects of a column, texts wrapped once or twice more taken out."""
    step = lambda before, n: f"w{n}_{part} AS (SELECT archive_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN t::JSON->>'$' ELSE t END END AS t FROM {before})"
    return f"w0_{part} AS (SELECT archive_id, {part} AS t FROM raw_archive), {step(f'w0_{part}', 1)}, {step(f'w1_{part}', 2)}, d_{part} AS MATERIALIZED (SELECT archive_id, t::JSON AS d FROM w2_{part} WHERE json_valid(t) AND json_type(t) = 'OBJECT')"


def _each(source: str, lists: str, keep: str = "") -> str:
    """Rows of ``source`` once per element of a list, with the element ``v`` and its position ``pos``."""
    return f"SELECT archive_id{keep}, unnest(l) AS v, unnest(range(len(l)))::INT AS pos FROM (SELECT archive_id{keep}, {lists} AS l FROM {source})"


_CHILDREN = f"""WITH {_unwrapped("properties")}, {_unwrapped("target")},
q AS ({_each("d_properties", _objects("(d->'qubits')"))}),
e AS (SELECT archive_id, 'entry' AS child, parent_pos, pos, v FROM ({_each("(SELECT archive_id, pos AS parent_pos, v FROM q)", _objects("v"), ", parent_pos")})),
k AS (SELECT archive_id, key, value FROM d_properties, json_each(d) j),
g AS (SELECT archive_id, 'gate' AS child, -1 AS parent_pos, pos, v FROM ({_each("(SELECT * FROM k WHERE key <> 'qubits' AND list_bool_or(list_transform(" + _objects("value") + ", lambda x: json_exists(x, '$.gate'))))", _objects("value"))})),
p AS (SELECT archive_id, 'gate_parameter' AS child, parent_pos, pos, v FROM ({_each("(SELECT archive_id, pos AS parent_pos, v FROM g WHERE json_type(v) = 'OBJECT')", _objects("(v->'parameters')"), ", parent_pos")})),
n AS (SELECT archive_id, 'general' AS child, -1 AS parent_pos, pos, v FROM ({_each("d_properties", _objects("(d->'general')"))})),
o AS (SELECT archive_id, 'operation' AS child, -1 AS parent_pos, pos, v FROM ({_each("d_target", _objects("(d->'operations')"))})),
i AS (SELECT archive_id, 'instance' AS child, parent_pos, pos, v FROM ({_each("(SELECT archive_id, pos AS parent_pos, v FROM o WHERE json_type(v) = 'OBJECT')", _objects("(v->'instances')"), ", parent_pos")})),
c AS (SELECT archive_id, child, parent_pos::INT AS parent_pos, pos, v FROM (SELECT * FROM e UNION ALL SELECT * FROM g UNION ALL SELECT * FROM p UNION ALL SELECT * FROM n UNION ALL SELECT * FROM o UNION ALL SELECT * FROM i) WHERE json_type(v) = 'OBJECT')"""

#: Faulty cells by their definition: T1 in the unit nearest to its backend's level, spikes beyond ten scatters.
_FAULTS = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, qubit ORDER BY row_id) AS rn, median(CASE WHEN t1_seconds > 0 AND isfinite(t1_seconds) THEN log10(t1_seconds) END) OVER (PARTITION BY backend) AS usual FROM qubit_calibration),
s AS (SELECT row_id, snapshot_id, backend, campaign, qubit, ts, t2_seconds, prob_meas0_prep1, CASE WHEN t1_seconds > 0 AND isfinite(t1_seconds) THEN t1_seconds / power(1000, least(greatest(round((log10(t1_seconds) - usual) / 3), 0), 3)) ELSE t1_seconds END AS t1_seconds FROM f WHERE rn = 1),
c AS (SELECT row_id, snapshot_id, backend, campaign, qubit, ts, unnest([{'field': 't1_seconds', 'v': t1_seconds}, {'field': 't2_seconds', 'v': t2_seconds}, {'field': 'prob_meas0_prep1', 'v': prob_meas0_prep1}]) AS x, t1_seconds, t2_seconds FROM s),
v AS (SELECT row_id, snapshot_id, backend, campaign, qubit, ts, x.field AS field, x.v AS v, NOT isfinite(x.v) OR CASE WHEN x.field LIKE 'prob%' THEN x.v < 0 OR x.v > 1 ELSE x.v <= 0 END AS bad, x.field = 't2_seconds' AND t2_seconds > 2 * t1_seconds AS over FROM c WHERE x.v IS NOT NULL AND NOT isnan(x.v)),
m AS (SELECT field, backend, campaign, qubit, quantile_disc(v, 0.5) AS mid, (quantile_disc(v, 0.75) - quantile_disc(v, 0.25)) / 1.349 / nullif(quantile_disc(v, 0.5), 0) AS spread FROM v WHERE NOT bad GROUP BY ALL),
u AS (SELECT field, backend, quantile_disc(spread, 0.5) AS scatter FROM v JOIN m USING (field, backend, campaign, qubit) WHERE NOT bad AND spread > 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS starts FROM v WINDOW w AS (PARTITION BY field, backend, campaign, qubit ORDER BY ts, snapshot_id, row_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY field, backend, campaign, qubit ORDER BY i) AS island FROM o),
z AS (SELECT r.*, count(*) OVER (PARTITION BY field, backend, campaign, qubit, island) AS run FROM r),
t AS (SELECT row_id, field, over, bad OR run >= 6 OR coalesce(abs(v / nullif(mid, 0) - 1) > 10 * scatter, false) AS faulty FROM z LEFT JOIN m USING (field, backend, campaign, qubit) LEFT JOIN u USING (field, backend))
SELECT row_id, field FROM t WHERE faulty OR (coalesce(over, false) AND row_id NOT IN (SELECT row_id FROM t WHERE faulty AND field = 't1_seconds'))"""

def _case(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v) for k, v in table.items()) + f" ELSE {other} END"


_KIND = "CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"

#: Files in their sequences (s: archive_id, source, campaign, idx, last_idx) and entries with what they call name, value and unit (n).
_ARCHIVE = f"""WITH {_unwrapped("properties")},
f AS (SELECT r.archive_id, r.campaign, r.ts, w.t IS NOT NULL AND json_valid(w.t) AS readable,
  coalesce(nullif(trim(r.backend), ''), nullif(trim(d.d->>'backend_name'), ''), nullif(CASE WHEN w.t IS NULL THEN regexp_extract(r.properties, '"backend_name\\\\*":\\s*\\\\*"([^"\\\\]+)', 1) END, ''), nullif(trim(regexp_extract(r.file_name, '^([^/]+)/', 1)), '')) AS source
  FROM raw_archive r JOIN w2_properties w ON w.archive_id = r.archive_id LEFT JOIN d_properties d ON d.archive_id = r.archive_id),
m AS (SELECT source, ts, arg_min({{'archive_id': archive_id, 'campaign': campaign, 'readable': readable}}, archive_id) AS f FROM f WHERE source IS NOT NULL AND ts IS NOT NULL GROUP BY source, ts),
s AS MATERIALIZED (SELECT f.archive_id AS archive_id, source, f.campaign AS campaign, row_number() OVER (PARTITION BY source, f.campaign ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY source, f.campaign) - 1 AS last_idx FROM m WHERE f.readable),
q AS ({_each("d_properties", _objects("(d->'qubits')"))}),
e AS MATERIALIZED (SELECT archive_id, qubit, pos, v FROM ({_each("(SELECT archive_id, pos AS qubit, v FROM q)", _objects("v"), ", qubit")}) WHERE json_type(v) = 'OBJECT'),
n AS MATERIALIZED (SELECT archive_id, qubit, pos, coalesce({", ".join(f"v->>'{k}'" for k in lexicon.ENTRY_KEY_ALIASES["name"])}) AS name, coalesce({", ".join(f"v->'{k}'" for k in lexicon.ENTRY_KEY_ALIASES["value"])}) AS value, coalesce({", ".join(f"v->>'{k}'" for k in lexicon.ENTRY_KEY_ALIASES["unit"])}) AS unit FROM e)"""

#: Layouts: every path of every file of a sequence with its commonest type (p), and what changes between neighbours (x).
_LAYOUTS = f"""{_ARCHIVE},
a AS (SELECT archive_id, 'properties' AS space, key, json_type(value) AS t FROM d_properties, json_each(d) j UNION ALL SELECT archive_id, 'entry', key, json_type(value) FROM e, json_each(v) j UNION ALL SELECT archive_id, 'name', name, json_type(value) FROM n WHERE name IS NOT NULL),
c AS (SELECT archive_id, space, space || '.' || key AS path, key, {_KIND.format(t="t")} AS kind, count(*) AS k FROM a GROUP BY ALL),
p AS MATERIALIZED (SELECT s.source AS backend, s.campaign, s.idx, s.last_idx, c.space, c.path,
  CASE c.space WHEN 'properties' THEN {_case("key", lexicon.TOP_KEYS, "key")} WHEN 'entry' THEN {_case("key", lexicon.ENTRY_KEYS, "key")} ELSE {_case("key", lexicon.NAMES, "key")} END AS common,
  arg_min(kind, {{'n': -k, 'kind': kind}}) FILTER (WHERE kind IS NOT NULL) AS json_type FROM c JOIN s ON s.archive_id = c.archive_id GROUP BY ALL),
w AS (SELECT *, lag(idx) OVER o AS before, lag(json_type) OVER o AS type_before, lead(idx) OVER o AS after FROM p WINDOW o AS (PARTITION BY backend, campaign, path ORDER BY idx)),
b AS (SELECT backend, campaign, space, path, common, json_type, idx, 'start' AS event FROM w WHERE idx > 0 AND before IS DISTINCT FROM idx - 1 UNION ALL SELECT backend, campaign, space, path, common, json_type, idx + 1, 'end' FROM w WHERE idx < last_idx AND after IS DISTINCT FROM idx + 1),
g AS (SELECT *, row_number() OVER (PARTITION BY backend, campaign, idx, space, common, event ORDER BY path) AS place FROM b),
x AS (SELECT coalesce(o.backend, n.backend) AS backend, coalesce(o.campaign, n.campaign) AS campaign, coalesce(o.idx, n.idx) AS idx, coalesce(o.path, '') AS old_path, coalesce(n.path, '') AS new_path,
  CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' ELSE 'renamed' END AS change_kind, o.space <> 'name' AND o.json_type <> n.json_type AS retyped
  FROM (SELECT * FROM g WHERE event = 'end') o FULL JOIN (SELECT * FROM g WHERE event = 'start') n USING (backend, campaign, idx, space, common, place))"""

_NUMBER = r"^\s*([+-]?(?:\d[\d_]*(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?|[+-]?(?:[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?))\s*((?s).*?)\s*$"
_UNIT = {s: u for u, spellings in lexicon.UNIT_SPELLINGS.items() for s in spellings}
_FIELD = {"".join(x for x in k.lower() if x.isalnum()): v for k, v in lexicon.NAMES.items()}
_FACTOR = {f"{f}|{u}": m for f, table in lexicon.FIELD_UNITS.items() for u, m in table.items() if m is not None}


def _unit_sql(x: str) -> str:
    return _case(f"rtrim(lower(trim(replace({x}, 'µ', 'μ'))), '.')", _UNIT, "NULL")


#: The last entry of every field with its state and its number in common units (y). A number without a unit is taken to be in the unit that
#: brings it nearest to the level of its backend's stated ones.
_VALUES = f"""{_ARCHIVE},
l AS (SELECT *, row_number() OVER (PARTITION BY archive_id, qubit, field ORDER BY pos DESC) AS back FROM (SELECT *, {_case("regexp_replace(lower(name), '[^a-z0-9]', '', 'g')", _FIELD, "NULL")} AS field FROM n) WHERE field IS NOT NULL),
t AS (SELECT archive_id, qubit, field, unit AS beside, coalesce(json_type(value), 'NULL') AS kind, value->>'$' AS text FROM l WHERE back = 1),
k AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN regexp_extract(text, '{_NUMBER}', 1) WHEN kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN text END AS digits, CASE WHEN kind = 'VARCHAR' THEN nullif(regexp_extract(text, '{_NUMBER}', 2), '') END AS tail FROM t),
z AS (SELECT *, try_cast(replace(replace(lower(digits), ',', '.'), '_', '') AS DOUBLE) AS number, coalesce({_unit_sql("tail")}, {_unit_sql("beside")}) AS stated FROM k),
u AS (SELECT z.archive_id, qubit, field, CASE WHEN kind = 'NULL' OR kind = 'VARCHAR' AND trim(text) = '' THEN 'null' WHEN number IS NULL THEN 'other' WHEN isnan(number) THEN 'nan' ELSE 'number' END AS state, number, stated, f.source, h.dt AS clock
  FROM z JOIN f ON f.archive_id = z.archive_id LEFT JOIN (SELECT archive_id, CASE WHEN json_valid(configuration) AND json_type(configuration) = 'OBJECT' THEN CAST(configuration::JSON->>'dt' AS DOUBLE) * 1e9 END AS dt FROM raw_archive) h ON h.archive_id = z.archive_id),
o AS (SELECT source, max(clock) AS clock FROM u GROUP BY source),
v AS (SELECT u.* EXCLUDE (clock), coalesce(u.clock, o.clock, b.dt_ns) AS clock, map_from_entries([{", ".join(f"({chr(39)}{k}{chr(39)}, {m!r}::DOUBLE)" for k, m in _FACTOR.items())}]) AS factors FROM u LEFT JOIN o ON o.source = u.source LEFT JOIN backends b ON b.backend = u.source),
r AS (SELECT source, field, median(log10(abs(number) * CASE stated WHEN 'dt' THEN clock ELSE factors[field || '|' || stated] END)) AS level FROM v WHERE state = 'number' AND abs(number) > 0 AND isfinite(number) AND stated IS NOT NULL GROUP BY ALL),
i AS (SELECT v.*, coalesce(r.level, {_case("v.field", {f: str(m) for f, (m, _) in lexicon.FIELD_PRIOR.items()}, "NULL")}::DOUBLE) AS level FROM v LEFT JOIN r ON r.source = v.source AND r.field = v.field),
y AS MATERIALIZED (SELECT archive_id, source, qubit, field, state, number, CASE WHEN factors[field || '|' || stated] IS NOT NULL OR stated = 'dt' AND field = 'readout_length' THEN stated
  ELSE list_sort(list_transform(list_filter(map_keys(factors), lambda w: starts_with(w, field || '|')), lambda w: {{'off': abs(coalesce(log10(nullif(abs(number), 0)), level) + log10(factors[w]) - level), 'unit': split_part(w, '|', 2)}}))[1].unit END AS used, clock, factors FROM i)"""
_COMMON_UNIT = _case("field", {f: next(iter(t)) for f, t in lexicon.FIELD_UNITS.items()}, "NULL")

#: Records of files in sequences with their neighbours in time (w).
_RECORDS = f"""{_VALUES},
j AS (SELECT s.source AS backend, s.campaign, s.idx, s.last_idx, y.qubit, y.field, y.state, CASE WHEN y.state = 'number' THEN y.number * CASE used WHEN 'dt' THEN clock ELSE factors[y.field || '|' || used] END END AS number FROM y JOIN s ON s.archive_id = y.archive_id),
w AS (SELECT *, lag(idx) OVER o AS before, lag(state) OVER o AS state_before, lag(number) OVER o AS number_before, lead(idx) OVER o AS after FROM j WINDOW o AS (PARTITION BY backend, campaign, qubit, field ORDER BY idx)),
x AS (SELECT *, before IS NOT DISTINCT FROM idx - 1 AS adjacent, state <> state_before OR coalesce(state = 'number' AND abs(number - number_before) > 1e-5 * greatest(abs(number), abs(number_before)), false) AS differs FROM w)"""

ORACLES = {
    "p2_values": f"""{_VALUES} SELECT archive_id, qubit, field, state, CASE WHEN state = 'number' THEN used END AS unit, round(CASE WHEN state = 'number' THEN number * CASE used WHEN 'dt' THEN clock ELSE factors[field || '|' || used] END END, 6) AS common FROM y""",
    "p2_t1_units": """WITH h AS (SELECT row_id, t1_seconds AS x, median(CASE WHEN t1_seconds > 0 AND isfinite(t1_seconds) THEN log10(t1_seconds) END) OVER (PARTITION BY backend) AS usual FROM qubit_calibration),
u AS (SELECT row_id, x, CASE WHEN abs(x) > 0 AND isfinite(x) THEN least(greatest(round((log10(abs(x)) - usual) / 3), 0), 3)::INT ELSE 0 END AS k FROM h)
SELECT row_id, ['s', 'ms', 'us', 'ns'][k + 1] AS t1_unit, round(CASE k WHEN 0 THEN x ELSE round(x * [1, 1e-3, 1e-6, 1e-9][k + 1]::DOUBLE, 15) END * 1e9, 3) AS t1_ns FROM u""",
    "p2_found": f"""{_VALUES}, h AS (SELECT row_id, qubit, t1_seconds AS x, median(CASE WHEN t1_seconds > 0 AND isfinite(t1_seconds) THEN log10(t1_seconds) END) OVER (PARTITION BY backend) AS usual FROM qubit_calibration)
SELECT 'properties' AS origin, archive_id AS rec_id, qubit, field FROM y WHERE state = 'number' AND used <> {_COMMON_UNIT}
UNION ALL SELECT 'qubit_calibration', row_id, qubit, 't1_seconds' FROM h WHERE abs(x) > 0 AND isfinite(x) AND round((log10(abs(x)) - usual) / 3) BETWEEN 1 AND 3""",
    "p3_found": f"""{_LAYOUTS}, z AS (SELECT backend, campaign, idx, old_path, new_path, change_kind FROM x UNION ALL SELECT backend, campaign, idx, old_path, new_path, 'retyped' FROM x WHERE change_kind = 'renamed' AND retyped
  UNION ALL SELECT backend, campaign, idx, path, path, 'retyped' FROM w WHERE before = idx - 1 AND space <> 'name' AND json_type <> type_before)
SELECT s.archive_id, old_path, new_path, change_kind FROM z JOIN s ON s.source = z.backend AND s.campaign IS NOT DISTINCT FROM z.campaign AND s.idx = z.idx""",
    "p3_lifespans": f"""{_LAYOUTS}, i AS (SELECT *, sum(CASE WHEN before = idx - 1 AND json_type IS NOT DISTINCT FROM type_before THEN 0 ELSE 1 END) OVER (PARTITION BY backend, campaign, path ORDER BY idx) AS island FROM w)
SELECT backend, campaign, space, path, CAST(island AS BIGINT) AS island, any_value(json_type) AS json_type, CAST(min(idx) AS INT) AS from_idx, CAST(max(idx) AS INT) AS to_idx, count(*) AS files FROM i GROUP BY backend, campaign, space, path, island""",
    "p4_found": f"""{_RECORDS}, found AS (SELECT backend, campaign, idx, qubit, field, CASE WHEN adjacent THEN 'changed' ELSE 'added' END AS change_kind FROM x WHERE idx > 0 AND (NOT adjacent OR differs)
  UNION ALL SELECT backend, campaign, idx + 1, qubit, field, 'removed' FROM x WHERE idx < last_idx AND after IS DISTINCT FROM idx + 1)
SELECT s.archive_id, qubit, field, change_kind FROM found z JOIN s ON s.source = z.backend AND s.campaign IS NOT DISTINCT FROM z.campaign AND s.idx = z.idx""",
    "p4_validity": f"""{_RECORDS}, spans AS (SELECT *, sum(CASE WHEN adjacent AND NOT differs THEN 0 ELSE 1 END) OVER (PARTITION BY backend, campaign, qubit, field ORDER BY idx) AS island FROM x)
SELECT backend, campaign, qubit, field, CAST(island AS BIGINT) AS island, CAST(min(idx) AS INT) AS from_idx, CAST(max(idx) AS INT) AS to_idx, arg_min(state, idx) AS state, round(arg_min_null(number, idx), 6) AS number, CAST(max(last_idx) AS INT) AS last_idx FROM spans GROUP BY backend, campaign, qubit, field, island""",
    "p1_found": f"{_CHILDREN} SELECT archive_id, child, parent_pos, pos FROM c",
    "p1_gates": f"{_CHILDREN} SELECT archive_id, pos, v->>'gate' AS gate, v->>'name' AS name, CASE WHEN json_type(v->'qubits') = 'ARRAY' THEN array_to_string(json_extract(v, '$.qubits[*]')::VARCHAR[], ',') END AS qubits FROM c WHERE child = 'gate'",
    "p1_instances": f"{_CHILDREN} SELECT archive_id, parent_pos, pos, try_cast(v->>'duration' AS DOUBLE) AS duration, try_cast(v->>'error' AS DOUBLE) AS error, CASE WHEN json_type(v->'qargs') = 'ARRAY' THEN array_to_string(json_extract(v, '$.qargs[*]')::VARCHAR[], ',') END AS qargs FROM c WHERE child = 'instance'",
    "p1_counts": f"{_CHILDREN} SELECT archive_id, child, count(*) AS n FROM c GROUP BY ALL",
    "p5_found": _FAULTS,
    "p6_labels": f"""WITH m AS (SELECT backend, qubit, trim(readout_line, ' ') AS label, count(*) AS n FROM qubit_calibration WHERE readout_line IS NOT NULL GROUP BY ALL),
t AS (SELECT *, n = max(n) OVER (PARTITION BY backend, qubit) AS top FROM m)
SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS qubits, count(*) FILTER (WHERE top) AS commonest_on, NOT regexp_matches(label, '[\\p{{L}}\\p{{N}}]') OR lower(label) IN ({_UNKNOWN}) AS counts_as_missing FROM t GROUP BY label""",
    "p6_found": f"""
WITH m AS (SELECT row_id,
  t1_seconds IS NULL OR isnan(t1_seconds) AS a, t2_seconds IS NULL OR isnan(t2_seconds) AS b,
  readout_error IS NULL OR isnan(readout_error) AS c,
  readout_line IS NULL OR NOT regexp_matches(readout_line, '[\\p{{L}}\\p{{N}}]') OR lower(trim(readout_line)) IN ({_UNKNOWN}) AS d
  FROM qubit_calibration)
SELECT row_id, 't1_seconds' AS field FROM m WHERE a UNION ALL SELECT row_id, 't2_seconds' FROM m WHERE b
UNION ALL SELECT row_id, 'readout_error' FROM m WHERE c UNION ALL SELECT row_id, 'readout_line' FROM m WHERE d""",
}
