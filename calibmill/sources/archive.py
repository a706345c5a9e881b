"""The archive of raw snapshots: names, scans, and a sink that writes each (backend, timestamp) once."""

from __future__ import annotations

import inspect
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from calibmill.session import exists, file_system, stage

STEM = "yyyyMMdd'T'HHmmssSSSSSS'Z'"
#: The oldest instant that may be asked for, in days.
MAX_HISTORY_DAYS = 30


def file_stem(ts: Column) -> Column:
    """The name of a snapshot's file without its ending, from its UTC time."""
    return F.date_format(ts, STEM)


def stem_time(stem: Column) -> Column:
    """The time in a file's stem, NULL for other names. One to six digits of a second may be there."""
    padded = F.concat(F.substring_index(stem, "Z", 1), F.lit("000000"))
    return F.when(stem.rlike(r"^\d{8}T\d{6}\d{1,6}Z$"), F.try_to_timestamp(F.concat(F.substring(padded, 1, 21), F.lit("Z")), F.lit(STEM)))


def cache_key(backend: Column, ts: Column) -> Column:
    """backend:ISO time; the fraction of a second only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(backend, F.lit(":"), whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def path_for(root: str, backend: Column, ts: Column) -> Column:
    return F.concat_ws("/", F.lit(root), backend, F.concat(file_stem(ts), F.lit(".json")))


def list_files(spark: SparkSession, root: str, backend: str) -> DataFrame:
    """The times of a backend's snapshot files (JSON under root/backend) in order, from their names alone; other files are skipped, a
    missing folder is empty."""
    if not exists(spark, f"{root}/{backend}"):
        return spark.createDataFrame([], "ts timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/{backend}").select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.select(stem_time(stem).alias("ts")).where("ts is not null").orderBy("ts")


def load_file(spark: SparkSession, root: str, backend: str, ts: datetime) -> DataFrame:
    """One snapshot file by (backend, time): path, ts (of the file name, not of the body), body."""
    at = (ts if ts.tzinfo else ts.replace(tzinfo=UTC)).astimezone(UTC)
    path = f"{root}/{backend}/{at:%Y%m%dT%H%M%S%f}Z.json"
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(at).alias("ts"), F.col("value").alias("body"))


#: Columns that tell archived rows of one key apart: when their write began, and which write it was.
SAVED = ("saved_at", "save_id")


def _saved(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows written to ``root``. None where there are none.

    Archives of earlier versions have a folder per backend; these are read too. There an empty name was stored as NULL.
    """
    if not exists(spark, root):
        return None
    found = [len(system.globStatus(where)) > 0 for system, where in (file_system(spark, f"{root}/{x}") for x in ("part-*", "backend=*"))]
    reader = spark.read.option("mergeSchema", "true")
    if not found[1]:
        return reader.parquet(root) if found[0] else None
    old = reader.option("basePath", root).parquet(f"{root}/backend=*").withColumn("backend", F.coalesce(F.col("backend").cast("string"), F.lit("")))
    return old.unionByName(spark.read.option("mergeSchema", "true").parquet(f"{root}/part-*"), allowMissingColumns=True) if found[0] else old


def archive_table(spark: SparkSession, root: str) -> DataFrame | None:
    """What ``save_if_new`` wrote to ``root``, each (backend, ts) once: its first write. None where there is no archive yet."""
    rows = _saved(spark, root)
    if rows is None:
        return None
    first = Window.partitionBy("backend", "ts").orderBy(*SAVED)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def list_timestamps(spark: SparkSession, root: str, backend: str) -> DataFrame:
    """The archived times of a backend in order; without an archive there are none. Files are sorted by backend, so other backends' keys are mostly skipped."""
    found = archive_table(spark, root)
    if found is None:
        return spark.createDataFrame([], "ts timestamp")
    return found.where(F.col("backend") == backend).select(F.col("ts").cast("timestamp").alias("ts")).orderBy("ts")


def load_one(spark: SparkSession, root: str, backend: str, ts: datetime) -> DataFrame:
    """The archived row of (backend, time), with the columns it was saved with; no row if there is none."""
    at = (ts if ts.tzinfo else ts.replace(tzinfo=UTC)).astimezone(UTC)
    found = archive_table(spark, root)
    if found is None:
        return spark.createDataFrame([], "backend string, ts timestamp")
    return found.where((F.col("backend") == backend) & (F.col("ts").cast("timestamp") == F.lit(at))).drop(*SAVED)


@contextmanager
def writing(spark: SparkSession, root: str, wait: float = 60.0) -> Iterator[None]:
    """The sole right to append to an archive: a lock file beside it, made only where there is none; others wait and then fail.

    Exclusive creation is atomic on local folders and HDFS; on stores without it only one writer may be scheduled.
    """
    lock, until = f"{root.rstrip('/')}.lock", time.monotonic() + wait
    system, where = file_system(spark, lock)
    local = system.getScheme() == "file"
    plain = where.toUri().getPath()
    while True:
        try:
            if local:
                os.makedirs(os.path.dirname(plain) or ".", exist_ok=True)
                os.close(os.open(plain, os.O_CREAT | os.O_EXCL))
            else:
                system.create(where, False).close()
            break
        except (FileExistsError, Py4JJavaError) as problem:
            if isinstance(problem, Py4JJavaError) and not system.exists(where):
                raise
            if time.monotonic() > until:
                raise RuntimeError(f"another writer holds {lock}") from problem
            time.sleep(0.05)
    try:
        yield
    finally:
        os.unlink(plain) if local else system.delete(where, False)


def save_if_new(new: DataFrame, root: str, arrival: str | None = None, wait: float = 60.0) -> DataFrame:
    """Append the snapshots whose (backend, ts) the archive at ``root`` doesn't have, one for each; returns those it wrote.

    new: backend, ts, and whatever else; rows without either are left out. The archive is Parquet, each file sorted by backend and time; a
    batch adds a few files, however many backends it has, and none if nothing is new. Of several new
    rows of one key the first by ``arrival`` is kept, or without it the first in the order of the rows. Writers take turns
    (``writing``). Only the batch's stretches of backends and of time are looked up in the archive.
    """
    spark = new.sparkSession
    order = F.col(arrival) if arrival else F.monotonically_increasing_id()
    rest = [c for c in new.columns if c not in ("backend", "ts")]
    numbered = new.where("backend is not null and ts is not null").withColumn("_order", order)
    first = numbered.groupBy("backend", "ts").agg(F.min(F.struct("_order", *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])).alias("_r"))
    one = stage(first.select("backend", "ts", *[F.col("_r")[f"_{i}"].alias(c) for i, c in enumerate(rest)]))
    span = one.agg(F.min("ts"), F.max("ts"), F.min("backend"), F.max("backend")).first()
    with writing(spark, root, wait):
        there = _saved(spark, root)
        kept = one
        if there is not None:
            there = there.where(F.col("ts").between(F.lit(span[0]), F.lit(span[1])) & F.col("backend").between(F.lit(span[2]), F.lit(span[3])))
            kept = stage(one.join(there.select("backend", "ts"), ["backend", "ts"], "left_anti"))  # what is written must not depend on the folder it is written to
        stamped = kept.withColumns({SAVED[0]: F.lit(datetime.now(UTC)), SAVED[1]: F.lit(uuid.uuid4().hex)})
        if not kept.isEmpty():
            stamped.sortWithinPartitions("backend", "ts").write.mode("append").parquet(root)
    return kept


def historical_window(spark: SparkSession, start: datetime, end: datetime, step_hours: int) -> DataFrame:
    """The instants from start, every so many hours, before end."""
    if step_hours <= 0:
        raise ValueError("the step must be above 0 hours")
    aware = [t if t.tzinfo else t.replace(tzinfo=UTC) for t in (start, end)]
    if aware[0] >= aware[1]:
        raise ValueError("start must lie before end")
    a, b = (F.timestamp_micros(F.lit(int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)))) for t in aware)
    grid = spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval {step_hours} hours"))).alias("ts"), b.alias("_end"))
    return grid.where("ts < _end").select("ts")


def check_history(instants: list[datetime], now: datetime, max_days: int = MAX_HISTORY_DAYS) -> None:
    """Raise ValueError for naive instants and those older than so many days."""
    for t in instants:
        if t.tzinfo is None:
            raise ValueError(f"{t} has no time zone")
        if now - t > timedelta(days=max_days):
            raise ValueError(f"{t} is more than {max_days} days old")


def synthetic_body(ts: datetime, backend: str = "synthetic") -> str:
    """A snapshot of one qubit with T1 = T2 = 50e-6 and a readout error of 0.01, without units (the strict parser refuses it)."""
    entries = [{"name": "T1", "value": 50e-6}, {"name": "T2", "value": 50e-6}, {"name": "readout_error", "value": 0.01}]
    return json.dumps({"backend": backend, "timestamp": ts, "schema_version": "1.0", "properties": {"qubits": [entries]}}, cls=SnapshotEncoder)


def target_json(target: Column) -> Column:
    """A target projection as JSON: num_qubits, physical_qubits, operations (name, qargs, duration?, error?); NULL fields left out."""
    return F.when(target.isNotNull(), F.to_json(target))


def project_target(text: Column) -> Column:
    """The projection of a target's JSON text, as JSON: operations with name and qargs, duration and error only where they are
    numbers; operations that are no objects are skipped, and instances listed under an operation become operations of its name.
    NULL for NULL and for texts that are no JSON object."""
    v = F.try_parse_json(text)
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    number = lambda x, path: F.when(~F.coalesce(F.schema_of_variant(get(x, path, "variant")).isin("STRING", "BOOLEAN", "VOID"), F.lit(True)), get(x, path, "double"))
    one = lambda name, x: F.struct(name.alias("name"), get(x, "$.qargs", "array<int>").alias("qargs"), number(x, "$.duration").alias("duration"), number(x, "$.error").alias("error"))
    listed = lambda x, path: F.coalesce(get(x, path, "array<variant>"), F.when(F.schema_of_variant(get(x, path, "variant")).startswith("OBJECT"), F.array(get(x, path, "variant"))), F.array().cast("array<variant>"))
    objects = lambda xs: F.filter(xs, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    named = lambda x: get(x, "$.name", "string")
    flat = F.flatten(F.transform(objects(listed(v, "$.operations")), lambda o: F.when(F.size(objects(listed(o, "$.instances"))) > 0, F.transform(objects(listed(o, "$.instances")), lambda i: one(named(o), i))).otherwise(F.array(one(named(o), o)))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(F.struct(get(v, "$.num_qubits", "int").alias("num_qubits"), get(v, "$.physical_qubits", "array<int>").alias("physical_qubits"), flat.alias("operations"))))


def configuration_json(configuration: Column) -> Column:
    return F.when(configuration.isNotNull(), F.to_json(configuration))


class SnapshotEncoder(json.JSONEncoder):
    """Times in UTC ISO form, complex numbers as {"__complex__": [re, im]}, arrays and array scalars as plain JSON."""

    def default(self, o: object) -> object:
        if isinstance(o, datetime):
            return (o if o.tzinfo else o.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
        if isinstance(o, complex):
            return {"__complex__": [o.real, o.imag]}
        if hasattr(o, "tolist"):
            return o.tolist()
        return super().default(o)


def fetch_with_retry(fetch: Callable[[], dict | None], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The result of ``fetch``; RuntimeErrors are tried again after 1, 2, 4, ... seconds, the last is raised; NotImplementedError at once."""
    for attempt in range(retries + 1):
        try:
            return fetch()
        except NotImplementedError:
            raise
        except RuntimeError:
            if attempt == retries:
                raise
            sleep(2**attempt)
    return None


# What is kept of a configuration that can't give itself as a dict.
CONFIGURATION_PARTS = ("backend_name", "backend_version", "n_qubits", "basis_gates", "coupling_map", "max_shots", "max_experiments")


def plain_configuration(configuration: object) -> dict | None:
    """A configuration as a dict: a mapping itself, its to_dict(), else those of ``CONFIGURATION_PARTS`` that it has."""
    if configuration is None or isinstance(configuration, dict):
        return configuration
    try:
        return dict(configuration.to_dict())
    except Exception:  # noqa: BLE001  whatever a client's own conversion raises, its parts may still be there
        return {part: value for part in CONFIGURATION_PARTS if (value := _part(configuration, part)) is not _NONE}


_NONE = object()


def _part(thing: object, name: str) -> object:
    try:
        return getattr(thing, name, _NONE)
    except Exception:  # noqa: BLE001
        return _NONE


class PollSource(DataSource):
    """spark.read.format('calibration_poll'): one row per backend and instant that the service has properties for.

    Options: ``service`` (import path module:callable giving an object with properties(backend, at), and if it likes
    target(backend), target_history(backend, at) and configuration(backend)), ``channel``, ``token``, ``instance`` (handed to that
    callable if it takes them), ``backends`` (comma separated), ``instants`` (comma separated ISO times; empty: now), ``retries``.
    Every (backend, instant) is a partition. The time of a row is the one its properties were last updated at, not the one
    asked for. Rows of the past have the target of their time where the service keeps a history, and no configuration.
    """

    @classmethod
    def name(cls) -> str:
        return "calibration_poll"

    def schema(self) -> str:
        return "backend string, ts timestamp, schema_version string, properties string, target string, configuration string"

    def reader(self, schema: object) -> DataSourceReader:
        return PollReader(dict(self.options))


class PollPartition(InputPartition):
    def __init__(self, backend: str, at: str) -> None:
        self.backend, self.at = backend, at


def connect(options: dict) -> object:
    """The service of a poll's options."""
    import importlib

    module, _, name = options["service"].partition(":")
    factory = getattr(importlib.import_module(module), name)
    given = {k: options[k] for k in ("channel", "token", "instance") if options.get(k)}
    takes = inspect.signature(factory).parameters
    open_ended = any(p.kind is p.VAR_KEYWORD for p in takes.values())
    return factory(**{k: v for k, v in given.items() if open_ended or k in takes})


def utc(stamp: object) -> datetime | None:
    """A time or ISO text in UTC (naive ones are UTC); None for anything else."""
    if isinstance(stamp, str):
        try:
            stamp = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
        except ValueError:
            return None
    if not isinstance(stamp, datetime):
        return None
    return stamp.astimezone(UTC) if stamp.tzinfo else stamp.replace(tzinfo=UTC)


class PollReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[PollPartition]:
        instants = [t for t in self.options.get("instants", "").split(",") if t] or [""]
        instants += [""] if self.options.get("current") == "true" and instants != [""] else []
        return [PollPartition(b.strip(), t.strip()) for b in self.options["backends"].split(",") if b.strip() for t in instants]

    def read(self, partition: PollPartition) -> Iterator[tuple]:
        service, backend, at = connect(self.options), partition.backend, utc(partition.at)
        try:
            found = fetch_with_retry(lambda: service.properties(backend, at), int(self.options.get("retries", "3")))
        except NotImplementedError:
            return
        stamp = utc(found.get("last_update_date")) if isinstance(found, dict) else None
        if stamp is None:
            return
        text = lambda x: None if x is None else json.dumps(x, cls=SnapshotEncoder, sort_keys=True)
        if at is None:
            target, configuration = self.optional(service, "target", backend), plain_configuration(self.optional(service, "configuration", backend))
        else:
            target, configuration = self.optional(service, "target_history", backend, at), None
        yield backend, stamp, str(self.options.get("schema_version", "1.0")), text(found), text(target), text(configuration)

    @staticmethod
    def optional(service: object, part: str, *of: object) -> object:
        """What the service has of a part; None where it has no such part or fails to give it, whatever it raises: a snapshot's
        properties are worth keeping without it."""
        try:
            return getattr(service, part)(*of)
        except Exception:  # noqa: BLE001
            return None
