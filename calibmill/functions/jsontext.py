"""Reading JSON texts of calibration files, tolerant of bare NaN and texts wrapped as JSON strings."""

from __future__ import annotations

import json
import re
from typing import Any

from calibmill.functions.lexicon import ENTRY_KEYS, NAMES, TOP_KEYS, common_name

UNREADABLE = object()


def read_json(text: str | None) -> Any:
    """The value of a complete JSON text, unwrapped from JSON strings; UNREADABLE otherwise.

    Bare NaN and Infinity are numbers. Nesting too deep for the parser counts as unreadable.
    """
    if text is None:
        return UNREADABLE
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return UNREADABLE
    return value


_BACKEND = re.compile(r'\\*"backend_name\\*":\s*\\*"([^"\\]+)')


def named_backend(text: str | None, doc: Any) -> str | None:
    """The backend that a text names, also a cut off one; ``doc`` is what ``read_json`` made of it."""
    if doc is UNREADABLE:
        found = _BACKEND.search(text or "")
        return found[1] if found else None
    body = doc.get("backend_name") if isinstance(doc, dict) else None
    return body if isinstance(body, str) else None


def as_list(value: Any) -> list:
    """A lone object counts as a list of one; anything but a list or an object as an empty one."""
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def is_gate_list(key: str, value: Any) -> bool:
    """Whether a top-level value is the list of gates: by content, whatever its key is called."""
    if key == "qubits":
        return False
    objects = [x for x in as_list(value) if isinstance(x, dict)]
    if isinstance(value, dict) and "gate" not in value and TOP_KEYS.get(key) != "gates":
        return False
    if any("gate" in x or ("parameters" in x and "qubits" in x) for x in objects):
        return True
    return TOP_KEYS.get(key) == "gates" and isinstance(value, (list, dict))


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(value)]


def qubit_entries(doc: Any) -> list[tuple[int, int, dict]]:
    """(qubit, pos, entry) of every entry object; nulls keep their place."""
    if not isinstance(doc, dict):
        return []
    return [(q, p, e) for q, lists in enumerate(as_list(doc.get("qubits"))) for p, e in enumerate(as_list(lists)) if isinstance(e, dict)]


def entry_keys(entries: list[dict]) -> dict[str, str]:
    """{'name': key, 'value': key, 'unit': key} as one file calls them.

    Known aliases first; an unknown name key is the string key that holds known measured names most often.
    """
    keys = {k for e in entries for k in e}
    found = {}
    for key in sorted(keys):
        if ENTRY_KEYS.get(key) in ("name", "value", "unit"):
            found.setdefault(ENTRY_KEYS[key], key)
    if "name" not in found:
        hits = {k: sum(isinstance(e.get(k), str) and common_name(e[k]) is not None for e in entries) for k in keys}
        best = max(sorted(hits), key=hits.get, default=None)
        if best is not None and hits[best]:
            found["name"] = best
    return found


def entry_part(entry: dict, part: str) -> Any:
    """An entry's name, value or unit under whichever known key it has; None where it has none."""
    for key, value in entry.items():
        if ENTRY_KEYS.get(key) == part:
            return value
    return None


__all__ = ["NAMES", "UNREADABLE", "as_list", "entry_keys", "entry_part", "is_gate_list", "json_type", "named_backend", "qubit_entries", "read_json"]
