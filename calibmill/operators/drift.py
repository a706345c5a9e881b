"""Schemas that drift between files: a catalogue of column lifespans.

Each file's layout is read as footer metadata: a row per path with the commonest type of its values. Along a producer's
sequence of files the paths form islands (lifespans); starts and endings are logged, and a changed type inside a lifespan
(or over a rename) is a retyping. A start and an ending at one file are a rename if the alias table puts both under one common
key, or if the two paths hold the same content there. The alias table starts with the common names and learns from
renames by content wherever they happen; each entry of it has its support. From it and the types met the casts follow that
read every layout into one table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibmill.functions.jsontext import entry_keys, entry_part, json_type, qubit_entries, read_json
from calibmill.functions.lexicon import ENTRY_KEYS, NAMES, OTHER_ENTRY_KEYS, OTHER_NAMES, OTHER_TOP_KEYS, TOP_KEYS, common_name, split_quantity, unit_of
from calibmill.operators import entries as E
from calibmill.session import stage

DDL = E.FILE_DDL + ", space string, path string, common string, known boolean, json_type string, types array<string>, n_values bigint"
SCHEMA = pa.schema([*E.FILE_FIELDS, ("space", pa.string()), ("path", pa.string()), ("common", pa.string()), ("known", pa.bool_()), ("json_type", pa.string()), ("types", pa.list_(pa.string())), ("n_values", pa.int64())])
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Order among equally common types.
TYPE_ORDER = ("array", "boolean", "number", "object", "string")
#: Decades by which the middle magnitudes of the same content may differ between two files.
SAME_SIZE = 0.5


_TYPES = {int: "number", float: "number", str: "string", bool: "boolean", dict: "object", list: "array"}


def types_of(values: list) -> tuple[str | None, list[str]]:
    """The commonest JSON type of non-null values (NaN is a number), the first of ``TYPE_ORDER`` among equals, and all types."""
    kinds: Counter = Counter()
    for kind, n in Counter(map(type, values)).items():
        if kind in _TYPES:
            kinds[_TYPES[kind]] += n
    return min(kinds, key=lambda t: (-kinds[t], TYPE_ORDER.index(t)), default=None), list(kinds)


def content(values: list) -> tuple[float | None, str | None]:
    """What values look like, whatever they are called: (middle magnitude of numbers, or None; commonest shape of others, or None).

    Numbers written as texts count as numbers. A text's shape has its letters and digits run together; an object's
    is its keys, a list's the keys of all objects in it. Whichever kind is the more frequent is given.
    """
    sizes, shapes = [], Counter()
    for v in values:
        if isinstance(v, str):
            parts = split_quantity(v)
            if parts and not re.match(r"\s*\d{4}-\d\d", v):
                v = parts[0]
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            if math.isfinite(v) and v:
                sizes.append(math.log10(abs(v)))
        elif isinstance(v, bool):
            shapes["?"] += 1
        elif isinstance(v, str):
            shapes[re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "9", v))] += 1
        elif isinstance(v, dict):
            shapes["{" + ",".join(sorted(v))] += 1
        elif isinstance(v, list):
            shapes["[" + ",".join(sorted({k for x in v if isinstance(x, dict) for k in x}))] += 1
    if sizes and len(sizes) >= sum(shapes.values()):
        return sorted(sizes)[len(sizes) // 2], None
    return None, min(shapes, key=lambda s: (-shapes[s], s), default=None)


def paths_of(doc: object) -> list[tuple[str, str, str, bool, list]]:
    """(space, path, common key, whether the common names have it, values) of every path of one document."""
    if not isinstance(doc, dict):
        return []
    out = []
    for key, value in doc.items():
        out.append(("properties", key, TOP_KEYS.get(key, key), key in TOP_KEYS or key in OTHER_TOP_KEYS, [value]))
    entries = [e for _, _, e in qubit_entries(doc)]
    columns: dict[str, list] = {}
    for entry in entries:
        for key, value in entry.items():
            columns.setdefault(key, []).append(value)
    for key, values in columns.items():
        out.append(("entry", key, ENTRY_KEYS.get(key, key), key in ENTRY_ROLES, values))
    keys = entry_keys(entries)
    names: dict[str, list] = {}
    for entry in entries:
        name = entry_part(entry, "name")
        name = name if isinstance(name, str) else entry.get(keys.get("name"))
        if isinstance(name, str):
            names.setdefault(name, []).append(entry_part(entry, "value"))
    for name, values in names.items():
        out.append(("name", name, common_name(name) or name, name in NAMES or name in OTHER_NAMES, values))
    return [(space, f"{space}.{path}", common, known, values) for space, path, common, known, values in out]


#: Keys of an entry that have a column of their own, by common key.
ENTRY_ROLES = ENTRY_KEYS | {key: key for key in OTHER_ENTRY_KEYS}


def _catalogue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for file, doc, _ in E.file_rows(batch):
            rows.append((*file, *[None] * 7))
            rows.extend(("path", file[1], None, None, None, None, space, path, common, known, *types_of(values), len(values) - values.count(None)) for space, path, common, known, values in paths_of(doc))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def catalogue(archive: DataFrame) -> DataFrame:
    """Footer metadata of every archive row: a 'file' row each and a 'path' row for each path in it."""
    return E.file_columns(archive, "properties").mapInArrow(_catalogue, DDL)


def lifespans(footers: DataFrame) -> DataFrame:
    """Every path's islands along its producer's files: producer, path, json_type, from_idx, to_idx, files."""
    producer = ["backend", "campaign", "space", "path"]
    along = Window.partitionBy(*producer).orderBy("idx")
    rows = _placed(footers)
    opens = ~(F.coalesce(F.lag("idx").over(along) == F.col("idx") - 1, F.lit(False)) & F.lag("json_type").over(along).eqNullSafe(F.col("json_type")))
    return rows.withColumn("island", F.sum(opens.cast("int")).over(along)).groupBy(*producer, "island").agg(F.first("json_type").alias("json_type"), F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"), F.count("*").alias("files"))


def _placed(footers: DataFrame, files: DataFrame | None = None) -> DataFrame:
    files = E.sequences(footers.where("kind = 'file'")) if files is None else files
    along = Window.partitionBy("backend", "campaign", "space", "path").orderBy("idx")
    rows = footers.where("kind = 'path'").select("archive_id", "space", "path", "common", "known", "json_type", "n_values").join(files.select("archive_id", "backend", "campaign", "idx", "last_idx"), "archive_id")
    # a row that repeats an archive_id is the same file; the windows behind this one share its partitioning and order
    return rows.withColumn("_again", F.coalesce(F.lag("idx").over(along) == F.col("idx"), F.lit(False))).where("not _again").drop("_again")


def layout_events(footers: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Starts, endings and retypings of paths: (backend, campaign, idx, archive_id, space, path, common, known, event, old/new type).

    ``idx`` is the later file of the pair, ``archive_id`` the file that has the path (for retypings the later one). One window
    per producer and path; nothing is compared pairwise.
    """
    along = Window.partitionBy("backend", "campaign", "space", "path").orderBy("idx")
    rows = (
        _placed(footers, files)
        .withColumn("_before", F.lag(F.struct("idx", "json_type")).over(along))
        .withColumn("_next", F.lead("idx").over(along))
        .withColumn("_adjacent", F.coalesce(F.col("_before.idx") == F.col("idx") - 1, F.lit(False)))
    )
    event = lambda at, what, old, new: F.struct(at.alias("idx"), F.lit(what).alias("event"), old.alias("old_type"), new.alias("new_type"))
    none = F.lit(None).cast("string")
    starts = F.when((F.col("idx") > 0) & ~F.col("_adjacent"), event(F.col("idx"), "start", none, F.col("json_type")))
    ends = F.when((F.col("idx") < F.col("last_idx")) & (F.coalesce(F.col("_next"), F.col("last_idx") + 1) > F.col("idx") + 1), event(F.col("idx") + 1, "end", F.col("json_type"), none))
    retyped = F.when(F.col("_adjacent") & (F.col("space") != "name") & (F.col("_before.json_type") != F.col("json_type")), event(F.col("idx"), "retype", F.col("_before.json_type"), F.col("json_type")))
    held = ["backend", "campaign", "archive_id", "space", "path", "common", "known"]
    return rows.select(*held, F.explode(F.array_compact(F.array(starts, ends, retyped))).alias("_e")).select(*held, "_e.*")


CONTENT_DDL = "archive_id bigint, path string, size double, shape string"
CONTENT = pa.schema([("archive_id", pa.int64()), ("path", pa.string()), ("size", pa.float64()), ("shape", pa.string())])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "properties", "paths"))):
            wanted = set(wanted)
            rows.extend((key, path, *content(values)) for _, path, _, _, values in paths_of(read_json(text)) if path in wanted)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CONTENT)], schema=CONTENT)


def _open_pairs(events: DataFrame) -> DataFrame:
    """Endings and starts of one file and space that the common names leave unpaired, where a path they don't have is among them."""
    at = ["backend", "campaign", "idx", "space"]
    moved = events.where("event <> 'retype'")
    sides = moved.groupBy(*at, "common").agg(F.count_if(F.col("event") == "end").alias("e"), F.count_if(F.col("event") == "start").alias("s"))
    of_file = sides.groupBy(*at).agg(F.collect_set(F.when(F.least("e", "s") == 0, F.col("common"))).alias("_alone"))
    rest = moved.join(of_file, [moved[c].eqNullSafe(of_file[c]) for c in at]).drop(*[of_file[c] for c in at]).where(F.array_contains("_alone", F.col("common"))).drop("_alone")
    both = rest.groupBy(*at).agg(F.min("event").alias("_low"), F.max("event").alias("_high"), F.bool_or(~F.col("known")).alias("_new")).where("_low <> _high and _new")
    return rest.join(both.drop("_low", "_high", "_new"), [rest[c].eqNullSafe(both[c]) for c in at], "left_semi")


def content_renames(archive: DataFrame, events: DataFrame) -> DataFrame:
    """Renames by equal content: (backend, campaign, idx, space, old_path, new_path, old_common, new_common, old_known, new_known).

    Only what the common names leave open is looked at, and only the files of these events are read again, whole. An ending and
    a start pair if each is the other's nearest: equal shapes, or magnitudes within ``SAME_SIZE``; equally near ones pair in
    the order of their paths. Two paths that the common names both have are never a rename of this kind.
    """
    at = ["backend", "campaign", "idx", "space"]
    todo = stage(_open_pairs(events).select(*at, "archive_id", "path", "common", "known", "event"))  # few rows
    if todo.isEmpty():
        return todo.select(*at, *[F.lit(None).cast(kind).alias(f"{side}_{c}") for c, kind in (("path", "string"), ("common", "string"), ("known", "boolean")) for side in ("old", "new")])
    wanted = todo.groupBy("archive_id").agg(F.collect_set("path").alias("paths"))
    looks = archive.select("archive_id", "properties").join(wanted, "archive_id").mapInArrow(_contents, CONTENT_DDL).dropDuplicates(["archive_id", "path"])
    seen = stage(todo.join(looks, ["archive_id", "path"]))
    side = lambda event, name: seen.where(F.col("event") == event).select(*[F.col(c).alias(f"_{name}_{c}") for c in at], *[F.col(c).alias(f"{name}_{c}") for c in ("path", "common", "known", "size", "shape")])
    old, new = side("end", "old"), side("start", "new")
    pairs = old.join(new, [F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")) for c in at]).where("not (old_known and new_known)")
    gap = F.when(F.col("old_shape") == F.col("new_shape"), 0.0).when(F.abs(F.col("old_size") - F.col("new_size")) <= SAME_SIZE, F.abs(F.col("old_size") - F.col("new_size")))
    close = pairs.select(*[F.col(f"_old_{c}").alias(c) for c in at], gap.alias("_gap"), *[f"{s}_{c}" for c in ("path", "common", "known") for s in ("old", "new")]).where("_gap is not null")
    rank = lambda mine, other: F.row_number().over(Window.partitionBy(*at, mine).orderBy("_gap", other))
    ranked = close.withColumns({"_o": rank("old_path", "new_path"), "_n": rank("new_path", "old_path")})
    return ranked.where("_o = 1 and _n = 1").drop("_gap", "_o", "_n")


def aliases(renames: DataFrame) -> DataFrame:
    """The alias table: (space, path, common, support, learnt), from the common names and from renames by content (``renames``).

    A learnt path stands for the common key it was renamed to or from most often, over all producers; between two paths that no
    common name has, for the older one. ``support`` counts its renames.
    """
    spark = renames.sparkSession
    fixed = [("properties", TOP_KEYS), ("entry", ENTRY_ROLES), ("name", NAMES | {n: n for n in OTHER_NAMES}), ("properties", {k: k for k in OTHER_TOP_KEYS})]
    rows = [(space, f"{space}.{key}", common, 0, False) for space, table in fixed for key, common in table.items()]
    known = spark.createDataFrame(rows, "space string, path string, common string, support bigint, learnt boolean")
    learnt = renames.select("space", F.when(F.col("old_known"), F.col("new_path")).when(F.col("new_known"), F.col("old_path")).otherwise(F.col("new_path")).alias("path"), F.when(F.col("new_known"), F.col("new_common")).otherwise(F.col("old_common")).alias("common"))
    votes = learnt.groupBy("space", "path", "common").agg(F.count("*").alias("n"))
    return known.unionByName(votes.groupBy("space", "path").agg(F.max_by("common", F.struct("n", "common")).alias("common"), F.max("n").alias("support"), F.lit(True).alias("learnt")))


def _pair_up(events: DataFrame, renames: DataFrame) -> DataFrame:
    """Starts and endings of one file, paired to renames: (backend, campaign, idx, space, renamed, removed, added).

    First under one common key of the alias table (``common`` of the events), in the order of their paths; then by ``renames``, those found
    by content. A file's paths are few (its keys), so the arrays per file and space are bounded by its layout, not by its rows.
    """
    item = F.struct("path", "common", F.coalesce("old_type", "new_type").alias("type"))
    at = ["backend", "campaign", "idx", "space"]
    sides = events.where("event <> 'retype'").groupBy(*at).agg(F.sort_array(F.collect_list(F.when(F.col("event") == "end", item))).alias("olds"), F.sort_array(F.collect_list(F.when(F.col("event") == "start", item))).alias("news"))
    by_content = renames.groupBy(*at).agg(F.collect_list(F.struct("old_path", "new_path")).alias("_like"))
    keys = [F.col(c).alias(f"_k_{c}") for c in at]
    by_content = by_content.select(*keys, "_like")
    sides = sides.join(by_content, [sides[c].eqNullSafe(by_content[f"_k_{c}"]) for c in at], "left").drop(*[f"_k_{c}" for c in at])
    place = lambda items, x: F.size(F.filter(items, lambda y: (y["common"] == x["common"]) & (y["path"] < x["path"])))
    partner = lambda o: F.try_element_at(F.filter("news", lambda n: (n["common"] == o["common"]) & (place("news", n) == place("olds", o))), F.lit(1))
    first = sides.withColumn("_same", F.filter(F.transform("olds", lambda o: F.struct(o.alias("o"), partner(o).alias("n"))), lambda p: p["n"].isNotNull()))
    taken = lambda pairs, side, x: F.exists(pairs, lambda p: p[side]["path"] == x["path"])
    like = F.flatten(F.transform(F.coalesce("_like", F.array().cast("array<struct<old_path:string,new_path:string>>")), lambda r: F.transform(F.filter("olds", lambda o: (o["path"] == r["old_path"]) & ~taken("_same", "o", o)), lambda o: F.struct(o.alias("o"), F.try_element_at(F.filter("news", lambda n: (n["path"] == r["new_path"]) & ~taken("_same", "n", n)), F.lit(1)).alias("n")))))
    second = first.withColumn("renamed", F.concat("_same", F.filter(like, lambda p: p["n"].isNotNull())))
    return second.select(*at, "renamed", F.filter("olds", lambda o: ~taken("renamed", "o", o)).alias("removed"), F.filter("news", lambda n: ~taken("renamed", "n", n)).alias("added"))


def _named(events: DataFrame, table: DataFrame) -> DataFrame:
    """Events with the common key that the alias table has for their path."""
    learnt = table.where("learnt").select(F.col("path").alias("_path"), F.col("common").alias("_common"))
    return events.join(learnt, events["path"] == learnt["_path"], "left").withColumn("common", F.coalesce("_common", "common")).drop("_path", "_common")


def found_drift(archive: DataFrame, footers: DataFrame) -> DataFrame:
    """(archive_id, old_path, new_path, change_kind) between each file and the one before it in its sequence.

    A path whose non-null values are missing in one of the two files has no type there and isn't retyped; of equally common types
    the first by name counts. Among several renames under one common key at one file, paths pair in their order.
    """
    placed = stage(E.sequences(footers.where("kind = 'file'")))
    events = stage(layout_events(footers, placed))  # few rows, read for renames and for retypings
    renames = stage(content_renames(archive, events))
    row = lambda old, new, kind: F.struct(old.alias("old_path"), new.alias("new_path"), F.lit(kind).alias("change_kind"))
    blank = F.lit("")
    rows = _pair_up(_named(events, aliases(renames)), renames).select(
        "backend", "campaign", "idx",
        F.explode(F.concat(
            F.transform("removed", lambda o: row(o["path"], blank, "removed")),
            F.transform("added", lambda n: row(blank, n["path"], "added")),
            F.transform("renamed", lambda p: row(p["o"]["path"], p["n"]["path"], "renamed")),
            F.transform(F.filter("renamed", lambda p: (F.col("space") != "name") & (p["o"]["type"] != p["n"]["type"])), lambda p: row(p["o"]["path"], p["n"]["path"], "retyped")),
        )).alias("_r"),
    ).select("backend", "campaign", "idx", "_r.*")
    retyped = events.where("event = 'retype'").select("backend", "campaign", "idx", F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit("retyped").alias("change_kind"))
    found = rows.unionByName(retyped)
    files = placed.select("archive_id", F.col("backend").alias("_b"), F.col("campaign").alias("_c"), F.col("idx").alias("_i"))
    return found.join(files, (found["backend"] == files["_b"]) & found["campaign"].eqNullSafe(files["_c"]) & (found["idx"] == files["_i"])).select("archive_id", "old_path", "new_path", "change_kind")


def alias_table(archive: DataFrame, footers: DataFrame) -> DataFrame:
    """``aliases`` of an archive: the common names and what its renames teach."""
    if footers.where("kind = 'path' and not known").isEmpty():  # nothing to learn
        return aliases(archive.sparkSession.createDataFrame([], "space string, old_path string, new_path string, old_common string, new_common string, old_known boolean, new_known boolean"))
    return aliases(stage(content_renames(archive, stage(layout_events(footers)))))


def casts(footers: DataFrame, table: DataFrame) -> DataFrame:
    """For every path and type met the column that holds it in one table over all layouts and the cast that brings it there.

    (space, path, json_type, files, common, column, cast); ``table``: the alias table. Casts are those of ``CASTS``. Entry keys without a
    column of their own, top-level keys and measured names keep their JSON.
    """
    met = footers.where("kind = 'path'").select("space", "path", "common", "archive_id", F.explode("types").alias("json_type")).groupBy("space", "path", "common", "json_type").agg(F.countDistinct("archive_id").alias("files"))
    named = _named(met, table)
    column = F.when((F.col("space") == "entry") & F.col("common").isin(*set(ENTRY_ROLES.values())), F.col("common")).otherwise("more")
    kind = F.col("json_type")
    cast = (
        F.when(column.isin("value", "stderr"), F.when(kind == "string", "quantity of text").when(kind == "number", "number").otherwise("null"))
        .when(column == "date", F.when(kind == "string", "time of text").when(kind == "number", "time of milliseconds").otherwise("null"))
        .when(column == "unit", F.when(kind == "string", "unit").otherwise("null"))
        .when(column.isin("name", "method"), F.when(kind == "string", "text").when(column == "name", "null").otherwise("json"))
        .otherwise("json")
    )
    return named.withColumns({"column": column, "cast": cast}).select("space", "path", "json_type", "files", "common", "column", "cast")


CONSISTENT_DDL = "archive_id bigint, qubit int, pos int, name string, common_name string, value double, value_text string, unit string, measured_at timestamp, flags string, method string, stderr double, more map<string,string>"
CONSISTENT = pa.schema([("archive_id", pa.int64()), ("qubit", pa.int32()), ("pos", pa.int32()), ("name", pa.string()), ("common_name", pa.string()), ("value", pa.float64()), ("value_text", pa.string()), ("unit", pa.string()), ("measured_at", pa.timestamp("us", "UTC")), ("flags", pa.string()), ("method", pa.string()), ("stderr", pa.float64()), ("more", pa.map_(pa.string(), pa.string()))])


def _when(value: object) -> datetime | None:
    try:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return EPOCH + timedelta(milliseconds=value)
        if isinstance(value, str):
            at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
            return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    except (ValueError, OverflowError):
        pass
    return None


#: The casts by name: value -> (what the column gets, whether it holds all of the value).
CASTS: dict[str, Callable[[object], tuple[object, bool]]] = {
    "null": lambda v: (None, v is None),
    "text": lambda v: (v, True),
    "json": lambda v: (None if v is None else json.dumps(v), True),
    "unit": lambda v: (v, True),
    "number": lambda v: (E.quantity(v, None), True),
    "quantity of text": lambda v: ((q := E.quantity(v, None)), q[0] not in (E.IS_OTHER, E.IS_NULL) and not q[2]),
    "time of text": lambda v: ((at := _when(v)), at is not None),
    "time of milliseconds": lambda v: ((at := _when(v)), at is not None),
}
#: By key: the column, whether the key was learnt, and the cast by JSON type.
Plan = dict[str, tuple[str, bool, dict[str, str]]]


def consistent(entry: dict, name_key: str | None, plan: Plan) -> tuple:
    """An entry's row from its name on, by the casts of ``plan``. ``more`` holds as JSON every key whose content no column holds."""
    at: dict[str, str] = {}
    for learnt in (False, True):
        for key in entry:
            column, of, _ = plan.get(key, ("more", False, {}))
            if column != "more" and of == learnt:
                at.setdefault(column, key)
    if name_key is not None and isinstance(entry.get(name_key), str) and not isinstance(entry.get(at.get("name", "")), str):
        at["name"] = name_key
    cell: dict[str, object] = {}
    held: dict[str, bool] = {}
    for column, key in at.items():
        value = entry[key]
        cast = "null" if value is None else "text" if key == name_key and isinstance(value, str) else plan.get(key, ("more", False, {}))[2].get(json_type(value), "null")
        cell[column], held[column] = CASTS[cast](value)
    value, spelled = entry.get(at.get("value", "")), entry.get(at.get("unit", "")) if "unit" in at else None
    state, number, unit = E.quantity(value, spelled)
    error = cell.get("stderr") or (E.IS_NULL, None, "")
    held |= {"value": True, "unit": unit_of(spelled) in ("", unit)}  # value_text has the value; the unit is unknown, or the value's text names another
    columns = {key for column, key in at.items() if held[column]}
    name = cell.get("name")
    more = [(key, json.dumps(item)) for key, item in entry.items() if key not in columns]
    nan = float("nan")
    return (
        name, common_name(name) or name, nan if state == E.IS_NAN else number, value if value is None or isinstance(value, str) else json.dumps(value), unit or None, cell.get("date"),
        cell.get("flags"), cell.get("method"), nan if error[0] == E.IS_NAN else error[1], more,
    )


def _consistent(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "properties"))):
            entries = qubit_entries(read_json(text))
            name_key = entry_keys([e for _, _, e in entries]).get("name") if entries else None
            rows.extend((key, qubit, pos, *consistent(entry, name_key, plan)) for qubit, pos, entry in entries)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CONSISTENT)], schema=CONSISTENT)


def consistent_entries(archive: DataFrame, footers: DataFrame) -> DataFrame:
    """Every entry of every layout in one table, by the casts made of the alias table. Unreadable files give no rows.

    ``flags`` is JSON; ``more`` has the JSON of every key whose content no other column holds. The casts, a row per key and type met
    (the size of the layouts, not of the data), become a parameter of the reader.
    """
    found = casts(footers, alias_table(archive, footers)).where("space = 'entry' and column <> 'more'").collect()
    plan: Plan = {}
    for r in found:
        key = r["path"].removeprefix("entry.")
        plan.setdefault(key, (r["column"], key not in ENTRY_ROLES, {}))[2][r["json_type"]] = r["cast"]
    return archive.select("archive_id", "properties").mapInArrow(partial(_consistent, plan=plan), CONSISTENT_DDL)
