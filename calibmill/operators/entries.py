"""Calibration entries: the last entry of each measured name in each qubit of each archived file."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibmill.functions.jsontext import UNREADABLE, entry_keys, entry_part, named_backend, qubit_entries, read_json
from calibmill.functions.lexicon import common_name, split_quantity, stated_time_unit, unit_of

#: States of an entry's value. A missing value key counts as null.
IS_NULL, IS_NAN, IS_NUMBER, IS_OTHER = "null", "nan", "number", "other"

#: What every archive row says about itself, as columns of 'file' rows.
FILE_DDL = "kind string, archive_id bigint, readable boolean, source string, campaign string, ts timestamp_ntz"
FILE_FIELDS = [("kind", pa.string()), ("archive_id", pa.int64()), ("readable", pa.bool_()), ("source", pa.string()), ("campaign", pa.string()), ("ts", pa.timestamp("us"))]
DDL = FILE_DDL + ", config_dt_ns double, qubit int, field string, pos int, state string, number double, unit string, hint string"
SCHEMA = pa.schema([*FILE_FIELDS, ("config_dt_ns", pa.float64()), ("qubit", pa.int32()), ("field", pa.string()), ("pos", pa.int32()), ("state", pa.string()), ("number", pa.float64()), ("unit", pa.string()), ("hint", pa.string())])


def quantity(value: object, unit: object) -> tuple[str, float | None, str]:
    """(state, number, unit) of an entry's value and unit; a unit in the value's text goes before the one beside it.

    The unit is '' where none is stated and '?' where its spelling is unknown. Booleans, objects, lists and
    texts without a number are 'other'; blank texts are null.
    """
    spelled = unit
    if isinstance(value, str):
        if not value.strip():
            return IS_NULL, None, ""
        parts = split_quantity(value)
        if parts is None:
            return IS_OTHER, None, ""
        value, tail = parts
        spelled = tail or unit
    elif value is None:
        return IS_NULL, None, unit_of(unit) or ""
    elif isinstance(value, bool) or not isinstance(value, (int, float)):
        return IS_OTHER, None, ""
    try:
        number = float(value)
    except OverflowError:
        return IS_OTHER, None, ""
    known = unit_of(spelled)
    if known is None:
        known = "?" if spelled is unit else unit_of(unit) or "?"
    return (IS_NAN, None, known) if math.isnan(number) else (IS_NUMBER, number, known)


def true_backend(backend: str | None, named: str | None, file_name: str | None) -> str | None:
    """The backend of an archive row: its column, else the one its (perhaps cut off) text names, else the folder of its file name."""
    folder, slash, _ = (file_name or "").partition("/")
    return next((x.strip(" ") for x in (backend, named, folder if slash else None) if x and x.strip(" ")), None)


def file_columns(archive: DataFrame, *texts: str) -> DataFrame:
    """What ``file_rows`` and a parser of these texts need of archive rows."""
    return archive.select("archive_id", "campaign", "backend", "file_name", F.col("ts").cast("timestamp_ntz").alias("ts"), *texts)


def file_rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, object, dict]]:
    """For every archive row of a batch of ``file_columns`` its 'file' row, the value of its properties, and all its columns."""
    for row in batch.to_pylist():
        doc = read_json(row["properties"])
        source = true_backend(row["backend"], named_backend(row["properties"], doc), row["file_name"])
        yield ("file", row["archive_id"], doc is not UNREADABLE, source, row["campaign"], row["ts"]), doc, row


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for file, doc, row in file_rows(batch):
            config = read_json(row["configuration"])
            dt = config.get("dt") if isinstance(config, dict) else None
            dt_ns = dt * 1e9 if isinstance(dt, (int, float)) and not isinstance(dt, bool) and dt > 0 else None
            rows.append((*file, dt_ns, *[None] * 7))
            entries = qubit_entries(doc)
            if not entries:
                continue
            keys = entry_keys([e for _, _, e in entries])
            hint = stated_time_unit(doc.get("remarks"))
            last: dict[tuple[int, str], tuple[int, dict]] = {}
            for qubit, pos, entry in entries:
                name = entry_part(entry, "name")
                field = common_name(name if isinstance(name, str) else entry.get(keys.get("name")))
                if field is not None:
                    last[qubit, field] = pos, entry
            for (qubit, field), (pos, entry) in last.items():
                rows.append(("entry", file[1], None, file[3], None, None, dt_ns, qubit, field, pos, *quantity(entry_part(entry, "value"), entry_part(entry, "unit")), hint if field in ("T1", "T2") else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def parse_archive(archive: DataFrame) -> DataFrame:
    """Files and entries of raw archive rows, told apart by ``kind``.

    kind 'file': a row per archive row, with whether its properties are readable, its backend (``source``), campaign, ts and the
    clock of its configuration. kind 'entry': for each qubit and common field name the last entry, with its
    value's state and number and the unit stated for it; ``hint`` is the unit a remark states for T1 and T2.
    """
    return file_columns(archive, "properties", "configuration").mapInArrow(_parse, DDL)


def sequences(files: DataFrame) -> DataFrame:
    """The place of each file ('file' rows) in its sequence: (archive_id, backend, campaign, ts, idx, last_idx).

    Of several deliveries of one (backend, ts) only the lowest archive_id counts; unreadable files are skipped
    and the next is compared with the last readable one, so ``idx`` numbers the readable files of a
    (backend, campaign) by ts. Rows without a backend or ts belong to no sequence.
    """
    placed = (
        files.where("source is not null and ts is not null")
        .groupBy(F.col("source").alias("backend"), "ts")
        .agg(F.min(F.struct("archive_id", "campaign", "readable")).alias("f"))
        .where("f.readable")
        .select("f.archive_id", "backend", "f.campaign", "ts")
    )
    by = Window.partitionBy("backend", "campaign")
    return placed.withColumn("idx", F.row_number().over(by.orderBy("ts", "archive_id")) - 1).withColumn("last_idx", F.max("idx").over(by))
