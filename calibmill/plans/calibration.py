"""Queries of the calibration engine's own operators, with the SQL that gives the same rows.

Where a query needs measured entries the ``events`` table stands in for them: a day is a snapshot, a user a qubit, an event type a
measured name (click T1, view T2, error readout error) and the event id the order; props.k says which values are null or NaN.
Results are rounded to six digits so that orders of summation don't show.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibmill.functions import squash
from calibmill.functions.membership import Custom, Gaussian, IntervalGaussian, Shape, TanhPulse, Trapezoidal, Triangular
from calibmill.operators import channels, circuits, metrics, parsing, rules
from calibmill.plans.pipeline import NoisePipeline
from calibmill.session import scratch, table
from calibmill.sources import archive
from calibmill.streaming import poller

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep or kind != "double" else r6(F.col(c)).alias(c) for c, kind in df.dtypes])


# -- measured entries -----------------------------------------------------------------------------------------------


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """day, qubit, pos, name, number, k of events."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "T1").when(kind == "view", "T2").when(kind == "error", "readout_error").otherwise(kind)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("qubit"), F.col("event_id").alias("pos"), name.alias("name"), F.when(k % 10 == 0, None).when(k % 10 == 1, float("nan")).otherwise(F.col("value")).alias("number"), k.alias("k"))


_ENTRIES = """
e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS qubit, event_id AS pos,
  CASE event_type WHEN 'click' THEN 'T1' WHEN 'view' THEN 'T2' WHEN 'error' THEN 'readout_error' ELSE event_type END AS name,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 10 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE value END AS number,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
_NAMES = ("T1", "T2", "readout_error")
_LAST = (
    "WITH "
    + _ENTRIES
    + ", w AS (SELECT day, qubit, "
    + ", ".join(f"arg_max_null(number, pos) FILTER (WHERE name = '{n}') AS \"{n}\", count(*) FILTER (WHERE name = '{n}') > 0 AS has_{n}" for n in _NAMES)
    + " FROM e GROUP BY day, qubit)"
)


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf)
    last = [F.max_by(F.when(F.col("name") == n, F.struct("number")), F.when(F.col("name") == n, F.col("pos"))).alias(f"_{n}") for n in _NAMES]
    return rows.groupBy("day", "qubit").agg(*last)


@query(_LAST + ' SELECT day, qubit, round("T1", 6) + 0.0 AS t1, round("T2", 6) + 0.0 AS t2, round(readout_error, 6) + 0.0 AS readout_error FROM w')
def nduv_last_wins_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The last entry of each name of a qubit, explicit nulls included."""
    return last_wins(spark, sf).select("day", "qubit", r6(F.col("_T1.number")).alias("t1"), r6(F.col("_T2.number")).alias("t2"), r6(F.col("_readout_error.number")).alias("readout_error"))


def _parsed_events(spark: SparkSession, sf: str) -> DataFrame:
    wide = last_wins(spark, sf)
    columns = []
    for name, _, scale, column in parsing.EXPECTED:
        e = F.col(f"_{name}") if name in _NAMES else F.lit(None).cast("struct<number:double>")
        columns += [(e["number"] * scale).alias(column), F.when(e.isNull(), "absent").when(e["number"].isNull(), "null").when(F.isnan(e["number"]), "nan").otherwise("value").alias(f"{column}_state")]
    return wide.select("day", "qubit", *columns)


@query(_LAST + ' SELECT day, qubit, round("T1" * 1e-6 * 1e6, 6) + 0.0 AS t1_us, round("T2" * 1e-6 * 1e6, 6) + 0.0 AS t2_us, round(readout_error * 1.0::DOUBLE, 6) + 0.0 AS readout_error FROM w')
def unit_scale_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Fields scaled to SI units by the unit table (shown in us)."""
    p = _parsed_events(spark, sf)
    return p.select("day", "qubit", r6(F.col("t1_seconds") * 1e6).alias("t1_us"), r6(F.col("t2_seconds") * 1e6).alias("t2_us"), r6(F.col("readout_error")).alias("readout_error"))


@query(
    """SELECT event_id, CASE WHEN k % 10 IN (0, 1, 2) THEN NULL ELSE round(value, 6) + 0.0 END AS number
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
)
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Finite numbers only: texts that are none, NaN and infinities become NULL."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(k % 10 == 0, "none").when(k % 10 == 1, "NaN").when(k % 10 == 2, "-Infinity").otherwise(F.col("value").cast("string"))
    number = parsing.number_of(F.try_parse_json(F.concat(F.lit('"'), text, F.lit('"'))))
    return table(spark, sf, "events").select("event_id", r6(parsing.finite(number)).alias("number"))


@query(
    _LAST
    + " UNION ALL ".join(
        f" SELECT day, '{c}' AS field, count(*) FILTER (WHERE NOT has_{n}) AS absent, count(*) FILTER (WHERE has_{n} AND \"{n}\" IS NULL) AS explicit_null, count(*) FILTER (WHERE isnan(\"{n}\")) AS nan_present FROM w GROUP BY day"
        if n in _NAMES
        else f" SELECT day, '{c}' AS field, count(*) AS absent, 0 AS explicit_null, 0 AS nan_present FROM w GROUP BY day"
        for n, _, _, c in parsing.EXPECTED
    )
)
def missingness_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Absent, null and NaN counts of the six fields per snapshot."""
    return parsing.missingness(_parsed_events(spark, sf), "day")


_FEATURES = "WITH " + _ENTRIES + """, m AS (SELECT day, avg(number) FILTER (WHERE name = 'T1' AND isfinite(number)) AS a,
avg(number) FILTER (WHERE name = 'T2' AND isfinite(number)) AS b, avg(number) FILTER (WHERE name = 'readout_error' AND isfinite(number)) AS c FROM e GROUP BY day)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.feature_vector(entries(spark, sf), "day")


@query(_FEATURES + """ SELECT day, round(a, 6) + 0.0 AS "mean_T1", round(b, 6) + 0.0 AS "mean_T2", round(c, 6) + 0.0 AS mean_readout_error,
CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'unusable' ELSE 'ok' END AS status FROM m""")
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(spark, sf).drop("features"))


@query(_LAST + ' SELECT day, round(avg(CASE WHEN NOT isnan("T1") THEN "T1" END), 6) + 0.0 AS mean_t1, round(avg(CASE WHEN NOT isnan("T2") THEN "T2" END), 6) + 0.0 AS mean_t2 FROM w GROUP BY day')
def skip_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means over qubits that skip what is missing (shown in us)."""
    p = _parsed_events(spark, sf)
    return p.groupBy("day").agg(r6(parsing.skip_mean(F.col("t1_seconds") * 1e6)).alias("mean_t1"), r6(parsing.skip_mean(F.col("t2_seconds") * 1e6)).alias("mean_t2"))


_WORD = "CASE json_type({v}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
#: Archive rows as the files they were (``_bodies``), read with SQL: h (path, JSON b, properties p, qubits q, error) and e (path, qubit, entries).
_SNAPSHOTS = f"""f AS MATERIALIZED (SELECT concat_ws('#', file_name, archive_id) AS path,
  '{{"backend": ' || coalesce(to_json(backend)::VARCHAR, 'null') || ', "timestamp": ' || coalesce('"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"', 'null') || ', "schema_version": ' || coalesce(to_json(schema_version)::VARCHAR, 'null')
  || ', "properties": ' || coalesce(properties, 'null') || ', "target": ' || coalesce(target, 'null') || ', "configuration": ' || coalesce(configuration, 'null') || '}}' AS body FROM raw_archive),
g AS (SELECT path, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM f),
k AS (SELECT path, b, b->'properties' AS p, b->'properties'->'qubits' AS q, coalesce(json_type(b->'properties'), 'NULL') AS kp, coalesce(json_type(b->'properties'->'qubits'), 'NULL') AS kq,
  CASE WHEN json_type(b->'timestamp') = 'VARCHAR' THEN b->>'timestamp' WHEN json_type(b->'properties'->'last_update_date') = 'VARCHAR' THEN b->'properties'->>'last_update_date' END AS stamp FROM g),
h AS MATERIALIZED (SELECT *, CASE WHEN b IS NULL THEN 'not valid JSON'
  WHEN kp NOT IN ('NULL', 'OBJECT') THEN chr(39) || 'properties' || chr(39) || ' should be an object, not of type ' || {_WORD.format(v="p")}
  WHEN kq NOT IN ('NULL', 'ARRAY') THEN chr(39) || 'properties.qubits' || chr(39) || ' should be an array, not of type ' || {_WORD.format(v="q")}
  WHEN stamp IS NULL THEN 'no text as timestamp' WHEN try_cast(stamp AS TIMESTAMPTZ) IS NULL THEN 'no time in timestamp ' || chr(39) || stamp || chr(39) END AS error FROM k),
l AS (SELECT path, unnest(json_extract(q, '$[*]')) AS v, unnest(range(json_array_length(q)::BIGINT))::INT AS qubit FROM h WHERE error IS NULL AND kq = 'ARRAY'),
e AS MATERIALIZED (SELECT path, qubit, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') END AS entries FROM l)"""


def _number_sql(v: str) -> str:
    text = f"({v}->>'$')"
    plain = f"lower(trim(replace({text}, '_', '')))"
    word = f"CASE WHEN {plain} LIKE '%nan' THEN 'nan'::DOUBLE WHEN {plain} LIKE '-inf%' THEN '-inf'::DOUBLE WHEN {plain} LIKE '%inf%' THEN 'inf'::DOUBLE ELSE try_cast({plain} AS DOUBLE) END"
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN CASE WHEN regexp_matches({text}, '{parsing.NUMBER_TEXT}') THEN {word} END WHEN 'BOOLEAN' THEN ({v}::BOOLEAN)::INT::DOUBLE WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL ELSE try_cast({text} AS DOUBLE) END"


def _qubits_sql() -> str:
    """w: path, qubit, the six fields with their states, and the qubit's error."""
    quoted = lambda x: f"chr(39) || {x} || chr(39)"
    last = ", ".join(f"list_filter(entries, lambda x: json_type(x->'name') = 'VARCHAR' AND x->>'name' = '{n}')[-1] AS e_{n}" for n, *_ in parsing.EXPECTED)
    parts = ", ".join(f"e_{n} IS NOT NULL AS there_{n}, coalesce(json_type(e_{n}->'value'), 'NULL') = 'NULL' AS null_{n}, " + _number_sql(f"(e_{n}->'value')") + f" AS number_{n}, CASE WHEN json_type(e_{n}->'unit') = 'VARCHAR' THEN e_{n}->>'unit' END AS unit_{n}" for n, *_ in parsing.EXPECTED)
    columns, errors = [], ["CASE WHEN bad THEN path || ': qubit ' || qubit || ' is not a list' END"]
    for n, unit, scale, column in parsing.EXPECTED:
        columns.append(f"CASE WHEN there_{n} AND NOT null_{n} THEN number_{n} * {scale!r}::DOUBLE END AS {column}, CASE WHEN NOT there_{n} THEN 'absent' WHEN null_{n} THEN 'null' WHEN isnan(number_{n}) THEN 'nan' ELSE 'value' END AS {column}_state")
        name, text = quoted(f"'{n}'"), quoted(f"unit_{n}")
        errors.append(f"CASE WHEN there_{n} AND unit_{n} IS DISTINCT FROM '{unit}' THEN path || ': qubit ' || qubit || ' has ' || {name} || ' in unit ' || coalesce({text}, 'none') || ' where ' || {quoted(repr(unit))} || ' is needed' WHEN there_{n} AND NOT null_{n} AND number_{n} IS NULL THEN path || ': qubit ' || qubit || ' has no number as ' || {name} END")
    return f"{_SNAPSHOTS}, m AS (SELECT path, qubit, entries IS NULL AS bad, {last} FROM e), n AS (SELECT path, qubit, bad, {parts} FROM m), w AS (SELECT path, qubit, {', '.join(columns)}, coalesce({', '.join(errors)}) AS error FROM n)"


@query(f"WITH {_qubits_sql()} SELECT * FROM w")
def snapshot_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The strict parser over the whole raw archive: every qubit with its fields, states and error."""
    return parsing.parse_qubits(parsing.parse_snapshots(_bodies(spark, sf)))


@query(f"WITH {_qubits_sql()}, x AS (SELECT path, arg_min(error, qubit) AS error FROM w WHERE error IS NOT NULL GROUP BY path) SELECT h.path, coalesce(h.path || ': ' || h.error, x.error) AS error FROM h LEFT JOIN x ON x.path = h.path")
def snapshot_errors(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parsing.parse_snapshots(_bodies(spark, sf))
    return parsing.snapshot_errors(parsed, parsing.parse_qubits(parsed))


@query(f"WITH {_qubits_sql()}" + " UNION ALL ".join(f" SELECT path, '{c}' AS field, count(*) FILTER (WHERE {c}_state = 'absent') AS absent, count(*) FILTER (WHERE {c}_state = 'null') AS explicit_null, count(*) FILTER (WHERE {c}_state = 'nan') AS nan_present FROM w GROUP BY path" for c in parsing.FIELD_COLUMNS))
def snapshot_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.missingness(parsing.parse_qubits(parsing.parse_snapshots(_bodies(spark, sf))), "path")


@query(f"""WITH {_SNAPSHOTS}, u AS (SELECT path, qubit, unnest(entries) AS v, unnest(range(len(entries)))::INT AS pos FROM e)
SELECT path, qubit, pos, v->>'name' AS name, CASE WHEN json_type(v->'unit') = 'VARCHAR' THEN v->>'unit' END AS unit, {_number_sql("(v->'value')")} AS number FROM u WHERE json_type(v->'name') = 'VARCHAR'""")
def snapshot_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every named entry of every readable qubit list, duplicates included, with its unit and number."""
    rows = parsing.nduv_rows(parsing.parse_snapshots(_bodies(spark, sf))).where("name is not null")
    return rows.select("path", "qubit", "pos", "name", parsing.text_of(F.col("unit")).alias("unit"), parsing.number_of(F.col("value")).alias("number"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Archive rows as the files they were: path and body."""
    rows = table(spark, sf, "raw_archive")
    head = F.to_json(F.struct("backend", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "schema_version"), {"ignoreNullFields": "false"})
    parts = [x for c in ("properties", "target", "configuration") for x in (F.lit(f', "{c}": '), F.coalesce(c, F.lit("null")))]
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *parts, F.lit("}"))
    return rows.select(F.concat_ws("#", "file_name", "archive_id").alias("path"), text.alias("body"))


# -- archive --------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%f') || 'Z' AS stem, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS back FROM events""")
def timestamp_stem_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", archive.file_stem(F.col("ts")).alias("stem"))
    return rows.withColumn("back", F.date_format(archive.stem_time(F.col("stem")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""SELECT event_id, 'q' || user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS key,
'data/q' || user_id || '/' || strftime(ts, '%Y%m%dT%H%M%S%f') || 'Z.json' AS path FROM events""")
def archive_key(spark: SparkSession, sf: str) -> DataFrame:
    backend = F.concat(F.lit("q"), F.col("user_id"))
    return table(spark, sf, "events").select("event_id", archive.cache_key(backend, F.col("ts")).alias("key"), archive.path_for("data", backend, F.col("ts")).alias("path"))


@query("SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT unnest(range(TIMESTAMP '2026-05-01', TIMESTAMP '2026-05-08 01:00:00', INTERVAL 4 HOUR)) AS t)")
def historical_window(spark: SparkSession, sf: str) -> DataFrame:
    out = archive.historical_window(spark, datetime(2026, 5, 1, tzinfo=UTC), datetime(2026, 5, 8, 1, tzinfo=UTC), 4)
    return out.select(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""WITH n AS (SELECT 'q' || user_id AS backend, date_trunc('day', ts) AS ts, event_id FROM events)
SELECT backend, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM n
WHERE (backend, ts) NOT IN (SELECT (backend, ts) FROM n WHERE event_id % 2 = 0) GROUP BY backend, ts""")
def save_if_new(spark: SparkSession, sf: str) -> DataFrame:
    """What a second delivery adds to an archive that has the even events' keys already."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("q"), F.col("user_id")).alias("backend"), F.date_trunc("day", "ts").alias("ts"), "event_id")
    root = scratch(spark, "archive")
    archive.save_if_new(rows.where("event_id % 2 = 0"), root)
    return archive.save_if_new(rows, root, arrival="event_id").select("backend", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, row_number() OVER (ORDER BY ts) - 1 AS place, arg_min(properties, archive_id) AS properties
FROM raw_archive WHERE backend = (SELECT min(backend) FROM raw_archive WHERE backend <> '') GROUP BY ts""")
def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What an archive lists and loads of one backend after all deliveries were saved in two batches: the first delivery of each time."""
    rows = table(spark, sf, "raw_archive").select("backend", "ts", "archive_id", "properties")
    root = scratch(spark, "archive")
    middle = rows.agg(F.percentile_approx("archive_id", 0.5)).first()[0]
    for part in (rows.where(F.col("archive_id") <= middle), rows.where(F.col("archive_id") > middle)):
        archive.save_if_new(part, root, arrival="archive_id")
    name = rows.where("backend <> ''").agg(F.min("backend")).first()[0]
    if name is None:
        return spark.createDataFrame([], "ts string, place int, properties string")
    listed = archive.list_timestamps(spark, root, name).withColumn("place", F.row_number().over(Window.orderBy("ts")) - 1)  # one backend's times
    kept = archive.archive_table(spark, root).where(F.col("backend") == name).select(F.col("ts").cast("timestamp").alias("ts"), "properties")
    return listed.join(kept, "ts").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "place", "properties")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY ALL""")
def stream_daily_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The watermarked stream over events, run through once."""
    folder = scratch(spark, "stream")
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    poller.keep_levels(poller.windowed_levels(source, watermark="10 days"), f"{folder}/out", f"{folder}/log").awaitTermination()
    out = poller.latest_levels(spark, f"{folder}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


# -- membership and rules -------------------------------------------------------------------------------------------

_KEY = ("l_orderkey", "l_linenumber")


def _gauss(x: str, c: float, s: float) -> str:
    return f"exp(-0.5 * power(({x} - {c!r}::DOUBLE) / {s!r}::DOUBLE, 2))"


def _shape_sql(shape: Shape, x: str) -> tuple[str, str]:
    p = [f"{v!r}::DOUBLE" for v in shape.parameters]
    if isinstance(shape, Gaussian):
        low = _gauss(x, *shape.parameters)
        return low, low
    if isinstance(shape, IntervalGaussian):
        c, a, b = shape.parameters
        return _gauss(x, c, a), _gauss(x, c, b)
    if isinstance(shape, Triangular):
        low = f"CASE WHEN {x} <= {p[0]} OR {x} >= {p[2]} THEN 0.0::DOUBLE WHEN {x} <= {p[1]} THEN ({x} - {p[0]}) / ({p[1]} - {p[0]}) ELSE ({p[2]} - {x}) / ({p[2]} - {p[1]}) END"
    elif isinstance(shape, Trapezoidal):
        low = f"CASE WHEN {x} <= {p[0]} OR {x} >= {p[3]} THEN 0.0::DOUBLE WHEN {x} < {p[1]} THEN ({x} - {p[0]}) / ({p[1]} - {p[0]}) WHEN {x} <= {p[2]} THEN 1.0::DOUBLE ELSE ({p[3]} - {x}) / ({p[3]} - {p[2]}) END"
    else:
        low = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 * (tanh({p[2]} * ({x} - {p[0]})) - tanh({p[3]} * ({x} - {p[1]})))))"
    return low, low


def _membership(name: str, shape: Shape) -> None:
    low, high = _shape_sql(shape, "l_quantity")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = shape.degree(F.col("l_quantity"))
        return table(spark, sf, "lineitem").select(*_KEY, r6(d.low).alias("low"), r6(d.high).alias("high"), r6(d.midpoint).alias("midpoint"), r6(d.width).alias("width"), d.is_crisp.alias("crisp"), d.is_valid.alias("valid"))

    run.__name__, run.__doc__ = name, f"Degrees of lineitem quantities in a {type(shape).__name__}."
    query(f"WITH d AS (SELECT l_orderkey, l_linenumber, {low} AS lo, {high} AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high, round(0.5 * (lo + hi), 6) + 0.0 AS midpoint, round(hi - lo, 6) + 0.0 AS width, lo = hi AS crisp, lo >= 0 AND lo <= hi AND hi <= 1 AS valid FROM d")(run)


for _name, _shape in {"mf_gaussian": Gaussian(25, 12.5), "mf_triangular": Triangular(5, 20, 45), "mf_trapezoidal": Trapezoidal(5, 15, 30, 45), "mf_tanh": TanhPulse(10, 40, 0.3, 0.5), "mf_interval_gaussian": IntervalGaussian(25, 8, 16)}.items():
    _membership(_name, _shape)


@query(f"SELECT l_orderkey, l_linenumber, round({_gauss('l_quantity', 25, 12.5)}, 6) + 0.0 AS low FROM lineitem")
def udf_membership(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own shape as a vectorised Python function."""
    own = Custom(lambda x: np.exp(-0.5 * ((x - 25.0) / 12.5) ** 2))
    return table(spark, sf, "lineitem").select(*_KEY, r6(own.degree(F.col("l_quantity")).low).alias("low"))


def _numbers(n: int, outputs: int, inputs: int) -> np.ndarray:
    r, o, j = np.ogrid[:n, :outputs, : inputs + 1]
    return ((7 * r + 3 * o + 5 * j) % 11) / 10 - 0.4


def base(interval: bool) -> rules.RuleBase:
    """27 rules over quantity, discount and tax."""
    bell = (lambda c, s: IntervalGaussian(c, 0.75 * s, 1.25 * s)) if interval else Gaussian
    shapes = {"l_quantity": [bell(c, 12.5) for c in (0, 25, 50)], "l_discount": [bell(c, 0.025) for c in (0, 0.05, 0.1)], "l_tax": [bell(c, 0.02) for c in (0, 0.04, 0.08)]}
    grid = rules.RuleBase.grid(shapes, 2)
    return rules.RuleBase(grid.inputs, grid.shapes, grid.rules, _numbers(27, 2, 3))


def large_base() -> rules.RuleBase:
    """81 rules over quantity, discount, tax and price: beyond the size that is written out."""
    small = base(True)
    shapes = dict(zip(small.inputs, small.shapes)) | {"l_extendedprice": [Gaussian(c, 30_000) for c in (0, 50_000, 100_000)]}
    grid = rules.RuleBase.grid(shapes, 2)
    return rules.RuleBase(grid.inputs, grid.shapes, grid.rules, _numbers(81, 2, 4) / 10)


def _rules_sql(b: rules.RuleBase) -> str:
    """Rows (key, rule_id, lo, hi, y0, y1) of a base, written out rule by rule."""
    degrees = {(i, k): _shape_sql(s, x) for i, (x, shapes) in enumerate(zip(b.inputs, b.shapes)) for k, s in enumerate(shapes)}
    columns = ", ".join(f"{lo} AS lo_{i}_{k}, {hi} AS hi_{i}_{k}" for (i, k), (lo, hi) in degrees.items())
    f, terms = {}, []
    for r, rule in enumerate(b.rules):
        for side in ("lo", "hi"):
            f[side] = " * ".join(f"{side}_{i}_{k}" for i, k in enumerate(rule))
        y = [" + ".join(f"{a!r}::DOUBLE * {x}" for a, x in zip(b.consequents[r, o].tolist(), b.inputs)) + f" + {float(b.consequents[r, o, -1])!r}::DOUBLE" for o in range(b.outputs)]
        terms.append(f"{{'r': {r}, 'lo': {f['lo']}, 'hi': {f['hi']}, 'y0': {y[0]}, 'y1': {y[1]}}}")
    return f"WITH d AS (SELECT *, row_number() OVER () AS rn, {columns} FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, rn, unnest([{', '.join(terms)}]) AS t FROM d), g AS (SELECT l_orderkey, l_linenumber, rn, t.r AS rule_id, t.lo AS lo, t.hi AS hi, t.y0 AS y0, t.y1 AS y1 FROM f)"


def _clip_sql(x: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 6) + 0.0"


def _tsk(name: str, interval: bool, method: str) -> None:
    b = base(interval)
    if method == "two_bound":
        out = [f"0.5 * (sum(lo * y{o}) / nullif(sum(lo), 0) + sum(hi * y{o}) / nullif(sum(hi), 0))" for o in (0, 1)]
    else:
        out = [f"sum(0.5 * (lo + hi) * y{o}) / nullif(sum(0.5 * (lo + hi)), 0)" for o in (0, 1)]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        done = rules.defuzzify(table(spark, sf, "lineitem"), b, _KEY, method)
        return done.select(*_KEY, r6(F.col("raw_0")).alias("raw_0"), r6(F.col("raw_1")).alias("raw_1"), r6(F.col("out_0")).alias("out_0"), r6(F.col("out_1")).alias("out_1"), "status")

    run.__name__, run.__doc__ = name, f"27 rules over every lineitem, {'interval' if interval else 'crisp'}, {method}."
    query(f"{_rules_sql(b)}, s AS (SELECT l_orderkey, l_linenumber, rn, {out[0]} AS r0, {out[1]} AS r1 FROM g GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(r0, 6) + 0.0 AS raw_0, round(r1, 6) + 0.0 AS raw_1, {_clip_sql('r0')} AS out_0, {_clip_sql('r1')} AS out_1, CASE WHEN r0 IS NULL THEN 'no rule fires' ELSE 'ok' END AS status FROM s")(run)


_tsk("tsk_t1", False, "weighted")
_tsk("tsk_it2_weighted", True, "weighted")
_tsk("tsk_it2_two_bound", True, "two_bound")


def _large_sql() -> str:
    out = [f"0.5 * (sum(lo * y{o}) / nullif(sum(lo), 0) + sum(hi * y{o}) / nullif(sum(hi), 0))" for o in (0, 1)]
    return f"{_rules_sql(large_base())}, s AS (SELECT l_orderkey, rn, {out[0]} AS r0, {out[1]} AS r1 FROM g GROUP BY ALL) SELECT l_orderkey, round(r0, 4) + 0.0 AS raw_0, round(r1, 4) + 0.0 AS raw_1, CASE WHEN r0 IS NULL THEN 'no rule fires' ELSE 'ok' END AS status FROM s"


@query(_large_sql())
def tsk_81_rules(spark: SparkSession, sf: str) -> DataFrame:
    """81 interval rules over every lineitem, keyed by its order alone: keys repeat, rows don't merge."""
    done = rules.defuzzify(table(spark, sf, "lineitem"), large_base(), ["l_orderkey"], "two_bound")
    return done.select("l_orderkey", *[(F.round(f"raw_{o}", 4) + F.lit(0.0)).alias(f"raw_{o}") for o in (0, 1)], "status")


@query(f"{_rules_sql(base(True))}, s AS (SELECT l_orderkey, l_linenumber, rn, sum(hi * y0) / nullif(sum(hi), 0) - 0.5 * (sum(hi) - sum(lo)) AS r0 FROM g GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(r0, 6) + 0.0 AS raw_0 FROM s")
def tsk_own_defuzzifier(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own defuzzifier: the average by upper strengths less half the width of the total strength."""
    own = lambda s: F.try_divide(s["w_high"], s["t_high"]) - 0.5 * (s["t_high"] - s["t_low"])
    return rules.defuzzify(table(spark, sf, "lineitem"), base(True), _KEY, own, squash.identity).select(*_KEY, r6(F.col("raw_0")).alias("raw_0"))


def _millionths_sql(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def _millionths(x: Column) -> Column:
    """x to six digits without decimal arithmetic: for results of many rows."""
    return F.floor(x * 1e6 + 0.5) / 1e6


@query(f"{_rules_sql(base(True))} SELECT l_orderkey, l_linenumber, rule_id, {_millionths_sql('0.5 * (lo + hi)')} AS f, {_millionths_sql('lo')} AS f_low, {_millionths_sql('hi')} AS f_high, {_millionths_sql('y0')} AS y0, {_millionths_sql('y1')} AS y1 FROM g")
def rule_firing(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths and consequents by rule: a row per lineitem and rule."""
    rows = rules.firing(table(spark, sf, "lineitem"), base(True), _KEY)
    return rows.select(*_KEY, "rule_id", *[_millionths(F.col(c)).alias(c) for c in ("f", "f_low", "f_high")], _millionths(F.col("y")[0]).alias("y0"), _millionths(F.col("y")[1]).alias("y1"))


@query("SELECT CAST(a * 9 + b * 3 + c AS INT) AS rule_id, CAST(a AS INT) AS mf_0, CAST(b AS INT) AS mf_1, CAST(c AS INT) AS mf_2 FROM range(3) t(a), range(3) u(b), range(3) v(c)")
def rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    return base(False).table(spark).select("rule_id", *[F.col("mf_ids")[i].alias(f"mf_{i}") for i in range(3)])


def _squashing(name: str, f: squash.Squash, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", r6(f(F.col("x").cast("double") * 4)).alias("y"))

    run.__name__, run.__doc__ = name, f"{f.__name__} of every embedding entry times four."
    query(f"WITH e AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE * 4 AS x FROM embeddings) SELECT vec_id, pos, round({sql}, 6) + 0.0 AS y FROM e")(run)


_squashing("squash_identity", squash.identity, "x")
_squashing("squash_clip", squash.clip, "greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))")
_squashing("squash_sigmoid", squash.sigmoid, "1 / (1 + exp(-x))")


# -- flagship -------------------------------------------------------------------------------------------------------


def _flagship_base() -> rules.RuleBase:
    grid = rules.RuleBase.grid({f: [Gaussian(0, 25), Gaussian(50, 25)] for f in parsing.FEATURES}, 2)
    return rules.RuleBase(grid.inputs, grid.shapes, grid.rules, _numbers(8, 2, 3) / 100)


def _flagship_sql() -> str:
    b = _flagship_base()
    x = ["a", "b", "c"]
    f = [" * ".join(_gauss(x[i], (0, 50)[k], 25) for i, k in enumerate(rule)) for rule in b.rules]
    raw = []
    for o in range(2):
        y = [" + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(b.consequents[r, o].tolist(), x)) + f" + {float(b.consequents[r, o, -1])!r}::DOUBLE" for r in range(8)]
        raw.append("(" + " + ".join(f"({s}) * ({t})" for s, t in zip(f, y)) + ") / nullif(" + " + ".join(f"({s})" for s in f) + ", 0)")
    return f"{_FEATURES}, r AS (SELECT day, a, b, c, {raw[0]} AS r0, {raw[1]} AS r1 FROM m) SELECT day, round(a, 6) + 0.0 AS mean_t1, round(b, 6) + 0.0 AS mean_t2, round(c, 6) + 0.0 AS mean_readout, {_clip_sql('r0')} AS p_amp, {_clip_sql('r1')} AS p_phase, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'missing input' WHEN r0 IS NULL THEN 'no rule fires' ELSE 'ok' END AS status FROM r"


def noise_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return rules.defuzzify(features(spark, sf).drop("status"), _flagship_base(), ["day", *parsing.FEATURES])


@query(_flagship_sql())
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot: features, eight rules, average, clipped channel parameters. One shuffle."""
    return noise_parameters(spark, sf).select("day", r6(F.col("mean_T1")).alias("mean_t1"), r6(F.col("mean_T2")).alias("mean_t2"), r6(F.col("mean_readout_error")).alias("mean_readout"), r6(F.col("out_0")).alias("p_amp"), r6(F.col("out_1")).alias("p_phase"), "status")


def _rule_average_sql(b: rules.RuleBase, x: list[str]) -> list[str]:
    """The averages of a crisp base of bells over SQL expressions, an expression per output; NULL where no rule fires."""
    f = [" * ".join(f"({_shape_sql(b.shapes[i][k], x[i])[0]})" for i, k in enumerate(rule)) for rule in b.rules]
    out = []
    for o in range(b.outputs):
        y = [" + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(b.consequents[r, o].tolist(), x)) + f" + {float(b.consequents[r, o, -1])!r}::DOUBLE" for r in range(len(b.rules))]
        out.append("(" + " + ".join(f"({s}) * ({t})" for s, t in zip(f, y)) + ") / nullif(" + " + ".join(f"({s})" for s in f) + ", 0)")
    return out


def _preset_sql() -> str:
    r0, r1 = _rule_average_sql(rules.preset_base(), ["a", "b", "c"])
    missing = " OR ".join(f"{x} IS NULL OR isnan({x})" for x in "abc")
    return f"""WITH m AS (SELECT snapshot_id, features[1] AS a, features[2] AS b, features[3] AS c FROM snapshot_feature),
r AS (SELECT snapshot_id, {missing} AS gone, {r0} AS r0, {r1} AS r1 FROM m),
s AS (SELECT snapshot_id, CASE WHEN NOT gone THEN r0 END AS r0, CASE WHEN NOT gone THEN r1 END AS r1, CASE WHEN gone THEN 'missing input' WHEN r0 IS NULL THEN 'no rule fires' ELSE 'ok' END AS status FROM r)
SELECT snapshot_id, round(r0, 6) + 0.0 AS raw_0, round(r1, 6) + 0.0 AS raw_1, CASE WHEN r0 IS NOT NULL THEN {_clip_sql('r0')} END AS out_0, CASE WHEN r1 IS NOT NULL THEN {_clip_sql('r1')} END AS out_1, status,
NOT coalesce(r0 > 0 OR r1 > 0, false) AS degenerate, k::INT AS member FROM s, range(8) t(k)"""


@query(_preset_sql())
def preset_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """The preset's eight seeded rules over stored snapshot features, as an ensemble of eight members."""
    rows = table(spark, sf, "snapshot_feature").select("snapshot_id", *[F.col("features")[i].alias(f) for i, f in enumerate(rules.PRESET_SCALES)])
    done = rules.guard_identity(rules.defuzzify(rows, rules.preset_base(), ["snapshot_id"]))
    return rounded(rules.ensemble(done, 8))


def _channels_sql() -> str:
    r0, r1 = (f"1 / (1 + exp(-({x})))" for x in _rule_average_sql(_flagship_base(), ["a", "b", "c"]))
    return f"""{_FEATURES}, p AS (SELECT day, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL ELSE {r0} END AS g, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL ELSE {r1} END AS l FROM m),
t AS (SELECT day, g, l, unnest([[0, 0, 0], [0, 1, 1], [1, 1, 1], [2, 0, 1], [3, 0, 1]]) AS x FROM p WHERE g IS NOT NULL)
SELECT day, x[1]::INT AS k, x[2]::INT AS i, x[3]::INT AS j, round(CASE WHEN x[1] = 0 AND x[2] = 0 THEN 1 WHEN x[1] = 0 THEN sqrt(1 - g) * sqrt(1 - l) WHEN x[1] = 1 THEN sqrt(1 - g) * sqrt(l) WHEN x[1] = 2 THEN sqrt(g) * sqrt(1 - l) ELSE sqrt(g) * sqrt(l) END, 6) + 0.0 AS re FROM t"""


@query(_channels_sql())
def pipeline_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline with an exchanged stage: sigmoid instead of clipping, down to the entries of the channel per snapshot that aren't 0."""
    done = NoisePipeline(_flagship_base(), squash=squash.sigmoid).channels(entries(spark, sf), "day")
    return channels.kraus_rows(done, "day").where("re <> 0").select("day", "k", "i", "j", r6(F.col("re")).alias("re"))


_LIST = "CASE json_type({x}) WHEN 'ARRAY' THEN list_filter(json_extract({x}, '$[*]'), lambda y: json_type(y) = 'OBJECT') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _number_or_null_sql(x: str) -> str:
    return f"CASE WHEN json_type({x}) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN try_cast({x}->>'$' AS DOUBLE) END"


@query(f"""WITH v AS (SELECT archive_id, CASE WHEN json_valid(target) AND json_type(target) = 'OBJECT' THEN target::JSON END AS t FROM raw_archive),
o AS (SELECT archive_id, unnest({_LIST.format(x="(t->'operations')")}) AS o FROM v WHERE t IS NOT NULL),
i AS (SELECT archive_id, o->>'name' AS name, unnest(CASE WHEN len({_LIST.format(x="(o->'instances')")}) > 0 THEN {_LIST.format(x="(o->'instances')")} ELSE [o] END) AS i FROM o)
SELECT archive_id, name, array_to_string(CAST(json_extract_string(i, '$.qargs[*]') AS VARCHAR[]), ',') AS qargs, {_number_or_null_sql("(i->'duration')")} AS duration, {_number_or_null_sql("(i->'error')")} AS error FROM i""")
def target_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of the archive as flat operations with numeric durations and errors, read back from their JSON."""
    done = table(spark, sf, "raw_archive").select("archive_id", archive.project_target(F.col("target")).alias("target"))
    rows = done.select("archive_id", F.from_json("target", "operations array<struct<name:string,qargs:array<int>,duration:double,error:double>>").alias("t")).select("archive_id", F.explode("t.operations").alias("o"))
    return rows.select("archive_id", F.col("o.name").alias("name"), F.coalesce(F.array_join(F.transform("o.qargs", lambda q: q.cast("string")), ","), F.lit("")).alias("qargs"), F.col("o.duration").alias("duration"), F.col("o.error").alias("error"))


# -- channels, circuits ---------------------------------------------------------------------------------------------

_PARAMS = "SELECT DISTINCT l_discount AS g, l_tax AS l FROM lineitem"


def _params(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_discount").alias("g"), F.col("l_tax").alias("l")).distinct()


@query(f"""WITH p AS ({_PARAMS}), a AS (SELECT g, l, unnest([{{'k': 0, 'i': 0, 'j': 0, 're': 1.0::DOUBLE}}, {{'k': 0, 'i': 1, 'j': 1, 're': sqrt(1 - g) * sqrt(1 - l)}},
{{'k': 1, 'i': 1, 'j': 1, 're': sqrt(1 - g) * sqrt(l)}}, {{'k': 2, 'i': 0, 'j': 1, 're': sqrt(g) * sqrt(1 - l)}}, {{'k': 3, 'i': 0, 'j': 1, 're': sqrt(g) * sqrt(l)}}]) AS t FROM p)
SELECT g, l, q.k, q.i, q.j, round(coalesce(max(t.re), 0), 6) + 0.0 AS re, 0.0::DOUBLE AS im
FROM (SELECT g, l, k::INT AS k, i::INT AS i, j::INT AS j FROM p, range(4) x(k), range(2) y(i), range(2) z(j)) q
LEFT JOIN (SELECT g, l, t FROM a) b ON b.g = q.g AND b.l = q.l AND t.k = q.k AND t.i = q.i AND t.j = q.j GROUP BY q.g, q.l, q.k, q.i, q.j""".replace("SELECT g, l, q.k", "SELECT q.g, q.l, q.k"))
def kraus_channel(spark: SparkSession, sf: str) -> DataFrame:
    """The operators of damping channels as rows."""
    rows = _params(spark, sf).withColumn("kraus", channels.kraus(F.col("g"), F.col("l")))
    return channels.kraus_rows(rows, "g", "l").select("g", "l", "k", "i", "j", r6(F.col("re")).alias("re"), "im")


@query(f"SELECT g, l, true AS complete FROM ({_PARAMS})")
def kraus_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = _params(spark, sf).withColumn("kraus", channels.kraus(F.col("g"), F.col("l")))
    return rows.select("g", "l", (channels.completeness(rows) < 1e-12).alias("complete"))


_GATES = {"click": "h", "view": "x", "error": "cx", "purchase": "measure", "signup": "s"}


@query("""WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS circuit_id, event_id AS pos,
CASE event_type WHEN 'click' THEN 'h' WHEN 'view' THEN 'x' WHEN 'error' THEN 'cx' WHEN 'purchase' THEN 'measure' WHEN 'signup' THEN 's' ELSE event_type END AS gate,
CASE event_type WHEN 'error' THEN [user_id % 8, (user_id + 1) % 8] ELSE [user_id % 8] END AS qubits FROM events),
f AS (SELECT circuit_id, gate, qubits, min(pos) AS pos FROM g WHERE gate NOT IN ('', 'barrier', 'measure', 'reset') GROUP BY ALL)
SELECT circuit_id, gate, array_to_string(qubits, ',') AS qubits, pos, CASE WHEN len(qubits) <> 1 THEN 'not a single-qubit gate' WHEN qubits[1] >= 6 THEN 'two parameters needed' ELSE 'ok' END AS channel_status,
CASE WHEN len(qubits) = 1 AND qubits[1] < 6 THEN round(sqrt(1 - qubits[1] / 20.0::DOUBLE) * sqrt(1 - qubits[1] / 40.0::DOUBLE), 6) + 0.0 END AS k0_11 FROM f""")
def gate_install(spark: SparkSession, sf: str) -> DataFrame:
    """Noise behind each distinct gate of a circuit (a day of events)."""
    gate = reduce(lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), _GATES.items(), F).otherwise(F.col("event_type"))
    q = F.col("user_id") % 8
    gates = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("circuit_id"), F.col("event_id").alias("pos"), gate.alias("gate"), F.when(F.col("event_type") == "error", F.array(q, (F.col("user_id") + 1) % 8)).otherwise(F.array(q)).alias("qubits"))
    noise = spark.range(6).select(F.col("id").alias("qubit"), F.array(F.col("id") / 20, F.col("id") / 40).alias("params"))
    done = channels.install_after_gates(gates, noise)
    return done.select("circuit_id", "gate", F.array_join(F.transform("qubits", lambda x: x.cast("string")), ",").alias("qubits"), "pos", "channel_status", r6(F.col("kraus")[0][1][1]).alias("k0_11"))


def _members(spark: SparkSession, n: int, gamma: float, lam: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("member"), F.lit(gamma).alias("gamma"), F.lit(lam).alias("lam"))


@query("SELECT m::INT AS member, b AS bitstring, round(p, 6) + 0.0 AS probability FROM range(4) t(m), (VALUES ('00', 0.6::DOUBLE), ('11', 0.4::DOUBLE), ('01', 0.0::DOUBLE), ('10', 0.0::DOUBLE)) u(b, p)")
def circuit_ghz(spark: SparkSession, sf: str) -> DataFrame:
    """A noisy GHZ pair: damping behind the H gate shifts the outcomes by (1 +- gamma) / 2."""
    done = circuits.simulate(circuits.gate_table(spark, circuits.ghz(2)), _members(spark, 4, 0.2, 0.3))
    return done.select("member", "bitstring", r6(F.col("probability")).alias("probability"))


@query("SELECT i::INT AS outcome, round(1 / 8.0::DOUBLE, 6) + 0.0 AS probability FROM range(8) t(i)")
def circuit_qft(spark: SparkSession, sf: str) -> DataFrame:
    """The Fourier transform of |000>: all outcomes alike."""
    done = circuits.simulate(circuits.gate_table(spark, circuits.qft(3)), _members(spark, 1, 0.0, 0.0))
    return done.select(F.conv("bitstring", 2, 10).cast("int").alias("outcome"), r6(F.col("probability")).alias("probability"))


def _benchmark_circuits(spark: SparkSession) -> DataFrame:
    return circuits.gate_table(spark, circuits.ghz(3), circuits.qft(3), circuits.random_clifford(3, 4, seed=1), circuits.ansatz(3, 2, seed=2))


@query()
def circuit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded shots of four benchmark circuits for eight members, added up per circuit."""
    done = circuits.simulate(_benchmark_circuits(spark), _members(spark, 8, 0.05, 0.02), shots=1024)
    return metrics.sum_counts(done, "circuit_id", "circuit_name")


@query()
def circuit_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The metric grid of the noisy ensemble against a noiseless reference."""
    gates = _benchmark_circuits(spark)
    run = lambda n, g, l: circuits.simulate(gates, _members(spark, n, g, l), shots=1024)
    state = lambda g, l: circuits.states(gates, _members(spark, 1, g, l)).drop("member")
    return metrics.benchmark(run(8, 0.05, 0.02), run(1, 0.0, 0.0), states=(state(0.05, 0.02), state(0.0, 0.0)))


@query()
def circuit_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """State fidelity of noisy against noiseless circuits of three qubits."""
    gates = _benchmark_circuits(spark)
    return metrics.fidelity(circuits.states(gates, _members(spark, 1, 0.05, 0.02)), circuits.states(gates, _members(spark, 1, 0.0, 0.0)))


# -- counts and metrics ---------------------------------------------------------------------------------------------


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run: a day is a circuit, a user a member, an event type an outcome."""
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("member"), F.col("event_type").alias("bitstring")).agg(F.count("*").alias("count"))


_COUNTS = "c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS member, event_type AS bitstring, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_COUNTS} SELECT day, bitstring, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY ALL")
def counts_sum(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sum_counts(_counts(spark, sf), "day")


@query(f"WITH {_COUNTS}, t AS (SELECT bitstring, member % 4 AS member, sum(n) AS n FROM c GROUP BY ALL) SELECT bitstring, CAST(round_even(sum(n)::DOUBLE / 4, 0) AS BIGINT) AS count FROM t GROUP BY ALL")
def counts_mean_halfeven(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_counts(_counts(spark, sf).withColumn("member", F.col("member") % 4))


@query(f"WITH {_COUNTS}, t AS (SELECT day, bitstring, sum(n) AS n FROM c GROUP BY ALL) SELECT day, bitstring, CAST(n AS BIGINT) AS count, round(n::DOUBLE / sum(n) OVER (PARTITION BY day), 6) + 0.0 AS p FROM t")
def counts_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    done = metrics.probabilities(metrics.sum_counts(_counts(spark, sf), "day"), "day")
    return done.select("day", "bitstring", "count", r6(F.col("p")).alias("p"))


def _against_all(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each day's counts, and for each day the counts of all days."""
    ours = metrics.sum_counts(_counts(spark, sf), "day")
    whole = ours.groupBy("bitstring").agg(F.sum("count").alias("count"))
    every = ours.select("day").distinct().join(whole.agg(F.collect_list(F.struct("bitstring", "count")).alias("_w")).withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"))  # five outcomes, met by every day
    return ours, every.select("day", F.explode("_w").alias("_w")).select("day", "_w.*")


_PAIRS = f"""WITH {_COUNTS}, e AS (SELECT day, bitstring, sum(n) AS n FROM c GROUP BY ALL), r AS (SELECT d.day, b.bitstring, b.n FROM (SELECT DISTINCT day FROM e) d, (SELECT bitstring, sum(n) AS n FROM e GROUP BY ALL) b),
ep AS (SELECT day, bitstring, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS p FROM e), rp AS (SELECT day, bitstring, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS q FROM r),
j AS (SELECT day, bitstring, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM ep FULL JOIN rp USING (day, bitstring)), w AS (SELECT *, avg(q) OVER (PARTITION BY day) AS mq FROM j),
s AS (SELECT day, sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2) AS hellinger_distance, sum(greatest(p, 1e-12::DOUBLE) * ln(greatest(p, 1e-12::DOUBLE) / greatest(q, 1e-12::DOUBLE))) AS kl_divergence,
1 - sum(power(p - q, 2)) / nullif(sum(power(q - mq, 2)), 0) AS r2_score FROM w GROUP BY day)"""


@query(_PAIRS + " SELECT day, round(hellinger_distance, 6) + 0.0 AS hellinger_distance, round(kl_divergence, 6) + 0.0 AS kl_divergence, round(r2_score, 6) + 0.0 AS r2_score FROM s")
def count_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hellinger distance, KL divergence and R2 of each day against all days."""
    return rounded(metrics.compare_counts(*_against_all(spark, sf), ["day"]))


@query(_PAIRS + """ SELECT day AS circuit_id, day AS circuit_name, m.i AS metric_id, m.k AS metric_name, round(m.v, 6) + 0.0 AS engine_value, m.o AS reference_value, round(m.v - m.o, 6) + 0.0 AS delta
FROM (SELECT day, unnest([{'i': 0, 'k': 'hellinger_distance', 'v': hellinger_distance, 'o': 0.0::DOUBLE}, {'i': 1, 'k': 'kl_divergence', 'v': kl_divergence, 'o': 0.0::DOUBLE}, {'i': 2, 'k': 'r2_score', 'v': r2_score, 'o': 1.0::DOUBLE}]) AS m FROM s)""")
def benchmark_grid(spark: SparkSession, sf: str) -> DataFrame:
    ours, whole = _against_all(spark, sf)
    named = lambda d: d.select(F.col("day").alias("circuit_id"), F.col("day").alias("circuit_name"), "bitstring", "count")
    return rounded(metrics.benchmark(named(ours), named(whole)))


@query("""WITH v AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS a, embedding[5:8]::DOUBLE[] AS b FROM embeddings),
s AS (SELECT vec_id, 0.5 * (1 + tanh(a[1])) AS p, 0.5 * (1 + tanh(b[1])) AS q, a, b FROM v),
t AS (SELECT vec_id, p, q, 0.5 * sqrt(p * (1 - p)) * cos(a[2]) AS pr, 0.5 * sqrt(p * (1 - p)) * sin(a[2]) AS pi, 0.5 * sqrt(q * (1 - q)) * cos(b[2]) AS qr, 0.5 * sqrt(q * (1 - q)) * sin(b[2]) AS qi FROM s)
SELECT vec_id, round(p * q + (1 - p) * (1 - q) + 2 * (pr * qr + pi * qi) + 2 * sqrt(greatest(p * (1 - p) - pr * pr - pi * pi, 0) * greatest(q * (1 - q) - qr * qr - qi * qi, 0)), 6) + 0.0 AS fidelity FROM t""")
def state_fidelity_2x2(spark: SparkSession, sf: str) -> DataFrame:
    """Fidelity of pairs of one-qubit states made of embedding entries."""
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings").select("vec_id", (0.5 * (1 + F.tanh(e(0)))).alias("p"), (0.5 * (1 + F.tanh(e(4)))).alias("q"), e(1).alias("x"), e(5).alias("y"))

    def state(p: str, angle: str) -> tuple[Column, Column, Column, Column]:
        size = 0.5 * F.sqrt(F.col(p) * (1 - F.col(p)))
        return F.col(p), 1 - F.col(p), size * F.cos(angle), size * F.sin(angle)

    return rows.select("vec_id", r6(metrics.fidelity_qubit(state("p", "x"), state("q", "y"))).alias("fidelity"))
