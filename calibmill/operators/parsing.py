"""Strict parsing of archived snapshots: typed qubits with four-state values, missingness counts and features.

Bodies are read as VARIANT, so JSON types survive (a number is not a text, bare NaN is a number, an explicit null is not an
absent key). Nothing fails a job by itself: a snapshot that breaks a rule gets an error text, that of its lowest qubit and
first field; ``strict`` turns errors into failures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parsed fields in their order, the unit each must have, its scale to SI, and the parsed column.
EXPECTED = (
    ("T1", "us", 1e-6, "t1_seconds"),
    ("T2", "us", 1e-6, "t2_seconds"),
    ("readout_error", "", 1.0, "readout_error"),
    ("prob_meas0_prep1", "", 1.0, "prob_meas0_prep1"),
    ("prob_meas1_prep0", "", 1.0, "prob_meas1_prep0"),
    ("readout_length", "ns", 1e-9, "readout_length_seconds"),
)
FIELD_COLUMNS = tuple(column for _, _, _, column in EXPECTED)
BODY_DDL = "backend VARIANT, timestamp VARIANT, schema_version VARIANT, properties VARIANT, target VARIANT, configuration VARIANT"
#: Texts that Python's float() takes; Spark's cast would also take '1.0d' and refuse '1_000'.
NUMBER_TEXT = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def kind_of(v: Column) -> Column:
    """The JSON type of a variant: VOID for an explicit null, NULL for a missing key."""
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    """A variant's text where it is a string, else NULL."""
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    """A variant as a number the way Python's float() reads it; NULL where it isn't one."""
    text = text_of(v)
    plain = F.lower(F.trim(F.regexp_replace(text, "_", "")))
    word = F.when(plain.rlike("nan$"), float("nan")).when(plain.rlike("^-inf"), float("-inf")).when(plain.rlike("inf"), float("inf"))
    from_text = F.when(text.rlike(NUMBER_TEXT), F.coalesce(word, plain.try_cast("double")))
    kind = kind_of(v)
    return F.when(kind == "STRING", from_text).when(kind.isin("VOID") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), None).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))


def timestamp_of(text: Column) -> Column:
    """An ISO timestamp in UTC (naive ones are UTC), also the compact form; NULL for other texts, times without a date included."""
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), text.try_cast("timestamp"))
    compact = F.when(text.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(dated, compact)


def read_bodies(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(path, body) of every JSON file under a path or glob, a file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def hold(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once: they come out of a generator of one row, through which later
    projections and filters can't pull copies of their expressions."""
    held = rows.select("*", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_held"))
    return held.select(*rows.columns, "_held.*")


def json_word(v: Column) -> Column:
    """What JSON calls the type of a variant."""
    kind = kind_of(v)
    words = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    return reduce(lambda c, w: c.when(kind.startswith(w[0]), w[1]), words.items(), F).otherwise("number")


def parse_snapshots(bodies: DataFrame, naive_is_error: bool = False) -> DataFrame:
    """(path, backend, ts, schema_version, qubits, error) of bodies (path, body); ``qubits`` is an array of variants.

    Properties that are missing or null count as empty, a missing list of qubits too; other types are errors, and so are a
    timestamp that is no text or no time, and a body that is no JSON. The timestamp is that of the body, else the properties'
    last_update_date; a bad first one is not replaced by the second. A time without a zone is UTC, or an error on request.
    A body is parsed once; the type of its properties is looked at only where they hold no list of qubits. Extra columns of
    ``bodies`` are kept.
    """
    body = hold(bodies, _b=F.from_json("body", BODY_DDL))
    part = lambda path, kind: F.try_variant_get(F.col("_b.properties"), path, kind)
    read = hold(body, _list=part("$.qubits", "array<variant>"), _updated=text_of(part("$.last_update_date", "variant")), _named=text_of(part("$.backend_name", "variant")), _stamp=text_of(F.col("_b.timestamp")))
    top, p = ("backend", "timestamp", "schema_version", "properties", "target", "configuration"), F.col("_b.properties")
    inner = part("$.qubits", "variant")
    is_null = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))
    listless = F.col("_list").isNull()
    stamp = F.coalesce("_stamp", "_updated")
    empty = reduce(lambda a, b: a & b, (F.col(f"_b.{c}").isNull() for c in top))
    error = (
        F.when(F.col("_b").isNull() | (empty & F.try_parse_json("body").isNull()), "not valid JSON")
        .when(listless & ~is_null(p) & ~kind_of(p).startswith("OBJECT"), F.concat(F.lit("'properties' should be an object, not of type "), json_word(p)))
        .when(listless & ~is_null(inner), F.concat(F.lit("'properties.qubits' should be an array, not of type "), json_word(inner)))
        .when(stamp.isNull(), "no text as timestamp")
        .when(timestamp_of(stamp).isNull(), F.concat(F.lit("no time in timestamp '"), stamp, F.lit("'")))
        .when(F.lit(naive_is_error) & ~stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.concat(F.lit("no zone in timestamp '"), stamp, F.lit("'")))
    )
    there = lambda c: F.nullif(c, F.lit(""))
    done = hold(read, _backend=F.coalesce(there(text_of(F.col("_b.backend"))), there(F.col("_named")), F.lit("")), _ts=timestamp_of(stamp), _version=text_of(F.col("_b.schema_version")), _error=error)
    extra = [c for c in bodies.columns if c not in ("path", "body", "backend", "ts", "schema_version", "qubits", "error")]
    return done.select("path", F.col("_backend").alias("backend"), F.col("_ts").alias("ts"), F.col("_version").alias("schema_version"), F.when(F.col("_error").isNull(), F.col("_list")).alias("qubits"), F.when(F.col("_error").isNotNull(), F.concat_ws(": ", "path", "_error")).alias("error"), *extra)


def _listed(snapshots: DataFrame) -> DataFrame:
    """path, qubit, and ``_entries``: the qubit's entries that have a text as name, NULL where the qubit isn't a list."""
    qubits = snapshots.select("path", F.posexplode("qubits").alias("qubit", "_q"))
    each = lambda e, i: F.struct(i.alias("pos"), text_of(F.try_variant_get(e, "$.name", "variant")).alias("name"), e.alias("entry"))
    named = hold(qubits, _all=F.transform(F.try_variant_get("_q", "$", "array<variant>"), each))
    return named.select("path", "qubit", F.filter("_all", lambda e: e["name"].isNotNull()).alias("_entries"))


def nduv_rows(snapshots: DataFrame) -> DataFrame:
    """A row per entry: path, qubit, pos, bad_qubit, name, unit, value (variants kept); qubits without entries give one with NULL name.

    A qubit that isn't a list gives ``bad_qubit``; entries whose name is no text are left out, as they are no fields.
    """
    rows = _listed(snapshots).select("path", "qubit", F.col("_entries").isNull().alias("bad_qubit"), F.explode_outer("_entries").alias("_e"))
    get = lambda path: F.try_variant_get(F.col("_e.entry"), path, "variant")
    return rows.select("path", "qubit", F.col("_e.pos").alias("pos"), "bad_qubit", F.col("_e.name").alias("name"), get("$.unit").alias("unit"), get("$.value").alias("value"))


def parse_qubits(snapshots: DataFrame) -> DataFrame:
    """path, qubit, the six parsed fields in SI units, their states, and the qubit's first error.

    The last entry of a name counts. A state is absent, null, nan or value; the unit is checked before the value, also
    where the value is null; a value that is no number is an error. All is done within the row; nothing is shuffled.
    """
    rows = _listed(snapshots).withColumn("_bad", F.col("_entries").isNull())
    last = {name: F.try_element_at(F.filter("_entries", lambda e: e["name"] == name), F.lit(-1)) for name, *_ in EXPECTED}  # noqa: B023
    rows = hold(rows, **{f"_e_{n}": e["entry"] for n, e in last.items()}).drop("_entries")
    rows = hold(rows, **{f"_{k}_{n}": F.try_variant_get(F.col(f"_e_{n}"), f"$.{k}", "variant") for n in last for k in ("value", "unit")})
    # what is known of the six values and units comes from one expression over an array of each, which keeps generated code small
    facts = F.transform(F.array(*[F.col(f"_value_{n}") for n in last]), lambda v: F.struct((v.isNull() | F.is_variant_null(v)).alias("null"), number_of(v).alias("number")))
    texts = F.transform(F.array(*[F.col(f"_unit_{n}") for n in last]), text_of)
    rows = hold(rows, _facts=facts, _texts=texts)
    place = {n: i for i, n in enumerate(last)}
    columns, errors = [], [F.when(F.col("_bad"), F.format_string("%s: qubit %d is not a list", "path", "qubit"))]
    for name, unit, scale, column in EXPECTED:
        fact, text = F.col("_facts")[place[name]], F.col("_texts")[place[name]]
        absent, null, number = F.col(f"_e_{name}").isNull(), fact["null"], fact["number"]
        columns.append(F.when(~absent & ~null, number * scale).alias(column))
        columns.append(F.when(absent, "absent").when(null, "null").when(F.isnan(number), "nan").otherwise("value").alias(f"{column}_state"))
        shown = F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("none"))
        errors.append(F.when(~absent & ~F.coalesce(text == unit, F.lit(False)), F.format_string(f"%s: qubit %d has '{name}' in unit %s where '{unit}' is needed", F.col("path"), F.col("qubit"), shown)).when(~absent & ~null & number.isNull(), F.format_string(f"%s: qubit %d has no number as '{name}'", "path", "qubit")))
    return hold(rows, _error=F.coalesce(*errors)).select("path", "qubit", *columns, F.col("_error").alias("error"))


def snapshot_errors(snapshots: DataFrame, qubits: DataFrame) -> DataFrame:
    """path and the snapshot's error: its own, else that of its lowest qubit with one, else NULL."""
    first = qubits.where("error is not null").groupBy("path").agg(F.min_by("error", "qubit").alias("_q"))
    return snapshots.select("path", "error").join(first, "path", "left").select("path", F.coalesce("error", "_q").alias("error"))


def strict(rows: DataFrame, error: str = "error") -> DataFrame:
    """The same rows, but the job fails at one with an error."""
    return rows.withColumn(error, F.when(F.col(error).isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.col(error))))


def missingness(qubits: DataFrame, *keys: str) -> DataFrame:
    """keys, field, absent, explicit_null, nan_present: over the qubits of parsed snapshots, from their states."""
    states = qubits.groupBy(*keys).agg(*[F.count_if(F.col(f"{c}_state") == s).alias(f"{c}|{s}") for c in FIELD_COLUMNS for s in ("absent", "null", "nan")])
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}|absent").alias("absent"), F.col(f"{c}|null").alias("explicit_null"), F.col(f"{c}|nan").alias("nan_present")) for c in FIELD_COLUMNS])).alias("m")
    return states.select(*keys, fields).select(*keys, "m.*")


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


# The features and the names they average.
FEATURES = {"mean_T1": "T1", "mean_T2": "T2", "mean_readout_error": "readout_error"}


def feature_vector(rows: DataFrame, *keys: str, name: str = "name", number: str = "number") -> DataFrame:
    """keys, mean_T1, mean_T2, mean_readout_error, features, status: means of all finite numbers of a name, duplicates counted,
    in the units they are in. A name without a finite number makes the vector unusable."""
    means = rows.groupBy(*keys).agg(*[F.avg(F.when(F.col(name) == n, finite(F.col(number)))).alias(f) for f, n in FEATURES.items()])
    usable = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in FEATURES))
    return means.withColumn("features", F.when(usable, F.array(*FEATURES))).withColumn("status", F.when(usable, "ok").otherwise("unusable"))


def skip_mean(x: Column) -> Column:
    """The mean of what is neither NULL nor NaN; infinities count; NULL of nothing."""
    return F.avg(F.when(~F.isnan(x), x))
