"""Deeply nested records to flat tables, by columnar shredding.

Each JSON document is shredded into one column per path. A column is the sequence of its
repetition levels, definition levels, JSON types and (for leaves) values, as in columnar nested
storage: the repetition level says which list a value continues, the definition level how much
of its path is there. The tables of each repeated ancestor are then rebuilt from the level
sequences alone, for whole batches of documents at once.

Levels of a path: every list on the way adds one repetition level. A definition level is added by a
value that isn't null, and by a list for a slot that exists (whether the slot holds null or not).

In a path a key's own backslashes, dots and brackets have a backslash before them, and an empty key is ``\\0``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibmill.functions.jsontext import UNREADABLE, is_gate_list, json_type, read_json

#: Paths whose lone object counts as a list of one.
LISTS = {
    "properties": {"qubits", "qubits[]", "gates", "gates[].parameters", "general"},
    "target": {"operations", "operations[].instances"},
}
#: child -> (part, path of the repeated ancestor); two lists on the path: the child has a parent position.
CHILDREN = {
    "entry": ("properties", "qubits[][]"),
    "gate": ("properties", "gates[]"),
    "gate_parameter": ("properties", "gates[].parameters[]"),
    "general": ("properties", "general[]"),
    "operation": ("target", "operations[]"),
    "instance": ("target", "operations[].instances[]"),
}
ABSENT, NULL, STRING, NUMBER, BOOLEAN, OBJECT, ARRAY = range(7)
TYPE_NAMES = ("absent", "null", "string", "number", "boolean", "object", "array")
_CODE = {"null": NULL, "string": STRING, "number": NUMBER, "boolean": BOOLEAN, "object": OBJECT, "array": ARRAY}


class Column:
    """The levels of one path of one document, and the columns below it."""

    __slots__ = ("path", "rep", "kids", "elem", "reps", "defs", "types", "values", "full")

    def __init__(self, path: str, rep: int, full: int) -> None:
        self.path, self.rep, self.full = path, rep, full  # rep: lists on the path; full: definition level of a value
        self.kids: dict[str, Column] = {}
        self.elem: Column | None = None
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.types: list[int] = []
        self.values: list[str | None] = []

    def null(self, rep: int, level: int, kind: int = ABSENT) -> None:
        self.reps.append(rep)
        self.defs.append(level)
        self.types.append(kind)
        self.values.append(None)
        for kid in self.kids.values():
            kid.null(rep, level)
        if self.elem is not None:
            self.elem.null(rep, level)

    def behind(self, parent: Column) -> Column:
        """This new column caught up with its parent's past records, where it was absent."""
        past = len(parent.reps) - 1
        self.reps, self.defs = parent.reps[:past], [min(d, parent.full) for d in parent.defs[:past]]
        self.types, self.values = [ABSENT] * past, [None] * past
        return self

    def columns(self) -> Iterator[Column]:
        yield self
        for kid in self.kids.values():
            yield from kid.columns()
        if self.elem is not None:
            yield from self.elem.columns()


def step_of(key: str) -> str:
    """A key as a step of a path."""
    return re.sub(r"([\\.\[\]])", r"\\\1", key) or "\\0"


def key_of(step: str) -> str:
    return "" if step == "\\0" else re.sub(r"\\(.)", r"\1", step, flags=re.S)


def _wanted(path: str, keep: frozenset[str] | None) -> bool:
    return keep is None or any(k == path or k.startswith((path + ".", path + "[")) for k in keep)


class Shredder:
    """Shreds documents; ``keep`` prunes to these paths and the way to them (None: every path)."""

    def __init__(self, lists: set[str], keep: frozenset[str] | None = None) -> None:
        self.lists, self.keep = lists, keep
        self._way: dict[str, bool] = {}
        self._steps: dict[str, str] = {}

    def wanted(self, path: str) -> bool:
        found = self._way.get(path)
        if found is None:
            found = self._way[path] = _wanted(path, self.keep)
        return found

    def shred(self, doc: dict) -> Column:
        root = Column("", 0, 0)
        self._emit(root, doc, 0, -1)
        return root

    def _emit(self, col: Column, value: Any, rep: int, level: int) -> None:
        """Record ``value`` in ``col``; ``level`` is the definition level if it were null."""
        kind = json_type(value)
        if kind == "null":
            col.null(rep, level, NULL)
            return
        if kind == "object" and col.path in self.lists:
            value, kind = [value], "array"
        col.reps.append(rep)
        col.defs.append(level + 1)
        col.types.append(_CODE[kind])
        col.values.append(None if kind in ("object", "array") else value if kind == "string" else json.dumps(value))
        level += 1
        if kind == "object":
            for key, item in value.items():
                kid = col.kids.get(key)
                if kid is None:
                    step = self._steps.get(key)
                    if step is None:
                        step = self._steps[key] = step_of(key)
                    path = f"{col.path}.{step}" if col.path else step
                    if not self.wanted(path):
                        continue
                    kid = col.kids[key] = Column(path, col.rep, col.full + 1).behind(col)
                self._emit(kid, item, rep, level)
            for kid in col.kids.values():
                if len(kid.reps) < len(col.reps):  # a key that this record lacks
                    kid.null(rep, level)
        else:
            for kid in col.kids.values():
                kid.null(rep, level)
        if kind == "array":
            if col.elem is None:
                if not self.wanted(col.path + "[]"):
                    return
                col.elem = Column(col.path + "[]", col.rep + 1, col.full + 2).behind(col)
            if not value:
                col.elem.null(rep, level)
            for item in value:
                self._emit(col.elem, item, rep, level + 1)
                rep = col.elem.rep
        elif col.elem is not None:
            col.elem.null(rep, level)


def _canonical(part: str, doc: Any) -> Any:
    """A document with its list of gates under ``gates``, whatever it is called; others gates-like lists follow."""
    if part != "properties":
        return doc
    out = {k: v for k, v in doc.items() if not is_gate_list(k, v)}
    gates = [v for k, v in doc.items() if is_gate_list(k, v)]
    if gates:
        out["gates"] = gates[0] if len(gates) == 1 else [x for g in gates for x in (g if isinstance(g, list) else [g])]
    return out


LEVELS = pa.schema([("archive_id", pa.int64()), ("part", pa.string()), ("path", pa.string()), ("rep_levels", pa.list_(pa.int8())), ("def_levels", pa.list_(pa.int8())), ("types", pa.list_(pa.int8())), ("values", pa.list_(pa.string()))])
LEVELS_DDL = "archive_id bigint, part string, path string, rep_levels array<tinyint>, def_levels array<tinyint>, types array<tinyint>, values array<string>"


def _shred_batches(batches: Iterator[pa.RecordBatch], paths: dict[str, frozenset[str] | None], values: bool) -> Iterator[pa.RecordBatch]:
    shredders = {part: Shredder(LISTS[part], keep) for part, keep in paths.items()}
    for batch in batches:
        rows: list[tuple] = []
        ids = batch.column("archive_id").to_pylist()
        for part, shredder in shredders.items():
            for key, text in zip(ids, batch.column(part).to_pylist()):
                doc = read_json(text)
                if doc is UNREADABLE or not isinstance(doc, dict):
                    continue
                keep = shredder.keep
                for col in shredder.shred(_canonical(part, doc)).columns():
                    if col.path and (keep is None or col.path in keep):
                        rows.append((key, part, col.path, col.reps, col.defs, col.types, col.values if values else None))
                if len(rows) >= 20_000:
                    yield _levels(rows)
                    rows = []
        if rows:
            yield _levels(rows)


def _levels(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LEVELS)], schema=LEVELS)


def shred_levels(archive: DataFrame, paths: dict[str, list[str] | None] | None = None, values: bool = True) -> DataFrame:
    """One row per readable text and path: its level sequences, JSON types and values.

    archive: ``archive_id`` and the texts ``properties`` and ``target``; further columns are ignored.
    paths: per part the paths to keep (None: all). Null, cut off or non-object texts give no rows.
    """
    paths = {"properties": None, "target": None} if paths is None else paths
    keep = {part: None if p is None else frozenset(p) for part, p in paths.items()}
    return archive.select("archive_id", *keep).mapInArrow(partial(_shred_batches, paths=keep, values=values), LEVELS_DDL)


def positions(reps: np.ndarray, level: int) -> np.ndarray:
    """The position within its list, at list ``level`` (from 1), of every record of concatenated repetition levels.

    A position rises with each repetition at its own level and starts anew with each lower one.
    """
    at = np.arange(len(reps))
    start = np.maximum.accumulate(np.where(reps < level, at, 0))
    rises = np.cumsum(reps == level)
    return rises - rises[start]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return column.flatten(), lengths


CHILD_DDL = "archive_id bigint, child string, parent_pos int, pos int"
CHILD = pa.schema([("archive_id", pa.int64()), ("child", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32())])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, paths, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("archive_id", "path", "part"))
        for child, (part, path) in CHILDREN.items():
            mine = np.flatnonzero((paths == path) & (parts == part))
            if not len(mine):
                continue
            rows = batch.take(pa.array(mine))
            reps, n = _lists(rows.column("rep_levels"))
            types, _ = _lists(rows.column("types"))
            reps, types = reps.to_numpy(zero_copy_only=False), types.to_numpy(zero_copy_only=False)
            key, depth = np.repeat(keys[mine], n), path.count("[]")
            pos = positions(reps, depth)
            parent = positions(reps, 1) if depth == 2 else np.full(len(pos), -1)
            there = types == OBJECT
            yield pa.RecordBatch.from_arrays([pa.array(key[there], pa.int64()), pa.array([child] * int(there.sum()), pa.string()), pa.array(parent[there].astype(np.int32)), pa.array(pos[there].astype(np.int32))], schema=CHILD)


def child_tables(levels: DataFrame) -> DataFrame:
    """(archive_id, child, parent_pos, pos) of every child object, rebuilt from the levels of each repeated ancestor."""
    return levels.mapInArrow(_children, CHILD_DDL)


LEAF_DDL = "archive_id bigint, child string, parent_pos int, pos int, key string, below string, item_pos array<int>, json_type string, value string"
LEAF = pa.schema([("archive_id", pa.int64()), ("child", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32()), ("key", pa.string()), ("below", pa.string()), ("item_pos", pa.list_(pa.int32())), ("json_type", pa.string()), ("value", pa.string())])
_STEP = re.compile(r"(?:[^\\.\[]|\\.)*", re.S)


def _leaf_place(path: str, part: str, nested: bool) -> tuple[str, str, str, bool] | None:
    """(child, its path, path below it, whether objects are left to a deeper child) of a path below a child.

    What lies below no child and isn't the way to one belongs to the text itself, a child of the part's name without a position.
    """
    place = None
    if path and not any(of == part and (path + "[").startswith(ancestor + "[") or of == part and ancestor.startswith((path + "[", path + ".")) for of, ancestor in CHILDREN.values()):
        place = part, "", path, False
    for child, (of, ancestor) in CHILDREN.items():
        if of == part and path.startswith(ancestor + ".") and (place is None or len(ancestor) > len(place[1])):
            place = child, ancestor, path[len(ancestor) + 1 :], (part, path) in CHILDREN.values()
    return place if place is None or nested or _STEP.fullmatch(place[2]) else None


def _leaves(batches: Iterator[pa.RecordBatch], nested: bool) -> Iterator[pa.RecordBatch]:
    names = pa.array(TYPE_NAMES)
    for batch in batches:
        keys, paths, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("archive_id", "path", "part"))
        for path, part in sorted(set(zip(paths, parts))):
            place = _leaf_place(path, part, nested)
            if place is None:
                continue
            child, ancestor, rest, deeper = place
            step = _STEP.match(rest)[0]
            mine = np.flatnonzero((paths == path) & (parts == part))
            rows = batch.take(pa.array(mine))
            reps, n = _lists(rows.column("rep_levels"))
            types, _ = _lists(rows.column("types"))
            values, _ = _lists(rows.column("values"))
            reps, types = reps.to_numpy(zero_copy_only=False), types.to_numpy(zero_copy_only=False)
            depth = ancestor.count("[]")
            owner, none = np.repeat(keys[mine], n), np.full(len(reps), -1)
            pos, parent = positions(reps, depth) if depth else none, positions(reps, 1) if depth == 2 else none
            there = np.flatnonzero((types != ABSENT) & (types != OBJECT) if deeper else types != ABSENT)
            lists = range(depth + 1, path.count("[]") + 1)
            items = np.stack([positions(reps, level)[there] for level in lists], 1).ravel() if lists else np.empty(0)
            item_pos = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * len(lists), pa.int32()), pa.array(items.astype(np.int32)))
            same = lambda text: pa.array([text] * len(there), pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(owner[there], pa.int64()), same(child), pa.array(parent[there].astype(np.int32)), pa.array(pos[there].astype(np.int32)), same(key_of(step)), same(rest[len(step) :]), item_pos, names.take(pa.array(types[there])), values.take(pa.array(there))], schema=LEAF)


def leaf_tables(levels: DataFrame, nested: bool = False) -> DataFrame:
    """The flat tables in long form: one row per child object and key that it has, explicit nulls included.

    ``value`` holds strings as they are, numbers and booleans as JSON, objects and lists as null. ``nested`` adds a row for
    each element of these lists and key of these objects, at any depth: ``below`` is its path below ``key`` and ``item_pos`` its
    position in each list on that path. Objects that are children themselves have their keys in their own table only. Keys of the
    text itself are those of a child ``properties`` or ``target`` at position -1.
    """
    return levels.mapInArrow(partial(_leaves, nested=nested), LEAF_DDL)


#: Columns of the flat tables: those of keys that hold one value, and those of keys that hold a list.
TABLES: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "entry": ({"name": "string", "value": "string", "unit": "string", "date": "string"}, {"flags": "string"}),
    "gate": ({"gate": "string", "name": "string"}, {"qubits": "int"}),
    "gate_parameter": ({"name": "string", "value": "double", "unit": "string", "date": "string"}, {}),
    "general": ({"name": "string", "value": "double", "unit": "string", "date": "string"}, {}),
    "operation": ({"name": "string"}, {"qargs": "int"}),
    "instance": ({"duration": "double", "error": "double"}, {"qargs": "int"}),
}


def flat_table(leaves: DataFrame, child: str) -> DataFrame:
    """The flat table of one child: archive_id, parent_pos, pos, a column per key of ``TABLES``, and ``more``, the JSON texts of its other keys.

    leaves: ``leaf_tables`` with ``nested``. Lists are arrays in the order of their elements, null elements included; a text in a number's
    column is NULL there and kept in ``more``. Rows that repeat an archive_id merge.
    """
    scalars, lists = TABLES[child]
    rows = leaves.where(F.col("child") == child)
    columns = []
    for key, kind in scalars.items():
        mine = (F.col("key") == key) & (F.col("below") == "")
        columns.append(F.max(F.when(mine, F.col("value").try_cast(kind))).alias(key))
    for key, kind in lists.items():
        item = (F.col("key") == key) & (F.col("below") == "[]")
        found = F.sort_array(F.collect_set(F.when(item, F.struct("item_pos", F.col("value").try_cast(kind).alias("v")))))  # one child's list
        held = F.bool_or((F.col("key") == key) & (F.col("below") == "") & (F.col("json_type") == "array"))
        columns.append(F.when(held, F.transform(found, lambda x: x["v"])).alias(key))
    lost = (F.col("below") == "") & F.col("value").isNotNull() & (~F.col("key").isin(*scalars) | F.coalesce(reduce(lambda a, b: a | b, [(F.col("key") == k) & F.col("value").try_cast(kind).isNull() for k, kind in scalars.items()]), F.lit(False)))
    more = F.map_from_entries(F.sort_array(F.collect_set(F.when(lost, F.struct("key", "value"))))).alias("more")
    return rows.groupBy("archive_id", "parent_pos", "pos").agg(*columns, more)


def found_children(archive: DataFrame) -> DataFrame:
    """Every child object of every readable text, with its file, parent and position.

    Only the levels of the repeated ancestors are made (no values). Empty, null and unreadable texts give no
    rows; repeated deliveries give a row each.
    """
    paths: dict[str, list[str] | None] = {part: [path for p, path in CHILDREN.values() if p == part] for part in LISTS}
    return child_tables(shred_levels(archive, paths, values=False))


def child_counts(children: DataFrame) -> DataFrame:
    """Children of each kind per file."""
    return children.groupBy("archive_id", "child").agg(F.count("*").alias("n"))
