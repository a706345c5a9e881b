"""Names, keys, units and layouts met in calibration files."""

from __future__ import annotations

import re
import unicodedata

# Measured names by common name.
NAME_ALIASES = {
    "T1": ("T1", "t1", "T1_time"),
    "T2": ("T2", "t2", "T2_echo_time"),
    "readout_length": ("readout_length", "readout_duration", "measure_length"),
    "frequency": ("frequency", "freq", "f01"),
    "readout_error": ("readout_error", "ro_error", "measure_error"),
    "prob_meas0_prep1": ("prob_meas0_prep1", "prob_meas0prep1", "p_0_given_1"),
    "prob_meas1_prep0": ("prob_meas1_prep0", "prob_meas1prep0", "p_1_given_0"),
}

# Keys of an entry by common key.
ENTRY_KEY_ALIASES = {
    "name": ("name", "parameter", "key"),
    "value": ("value", "val", "reading"),
    "unit": ("unit", "uom", "units"),
    "date": ("date", "measured", "cal_date"),
}

# Top-level keys by common key.
TOP_KEY_ALIASES = {
    "gates": ("gates", "gate_list", "gate_props"),
    "last_update_date": ("last_update_date", "updated_at", "lastUpdate"),
}

# Further paths that have one name only.
OTHER_NAMES = ("leakage", "anharm")
OTHER_ENTRY_KEYS = ("flags", "method", "stderr")
OTHER_TOP_KEYS = ("backend_name", "backend_version", "qubits", "general", "chip", "n_qubits", "remarks")

# Unit spellings (after NFKC and lower case) by common unit.
UNIT_SPELLINGS = {
    "s": ("s", "sec", "secs", "second", "seconds"),
    "ms": ("ms", "msec", "millisec", "millisecs", "millisecond", "milliseconds", "milli-s"),
    "us": ("us", "usec", "usecs", "μs", "microsec", "microsecond", "microseconds", "micro-s"),
    "ns": ("ns", "nsec", "nsecs", "nanosec", "nanosecond", "nanoseconds", "nano-s"),
    "dt": ("dt", "dt cycles", "dt cycle", "samples", "sample", "cycles"),
    "Hz": ("hz", "hertz"),
    "kHz": ("khz", "kilohertz"),
    "MHz": ("mhz", "megahertz"),
    "GHz": ("ghz", "gigahertz"),
    "1": ("1", "fraction", "ratio"),
    "%": ("%", "pct", "percent", "per cent"),
    "‰": ("‰", "per mille", "permille", "promille"),
}

# For each field the units it occurs in, as multiples of its common unit (None: by device clock).
FIELD_UNITS: dict[str, dict[str, float | None]] = {
    "T1": {"us": 1.0, "s": 1e6, "ms": 1e3, "ns": 1e-3},
    "T2": {"us": 1.0, "s": 1e6, "ms": 1e3, "ns": 1e-3},
    "readout_length": {"ns": 1.0, "s": 1e9, "ms": 1e6, "us": 1e3, "dt": None},
    "frequency": {"GHz": 1.0, "MHz": 1e-3, "kHz": 1e-6, "Hz": 1e-9},
    "readout_error": {"1": 1.0, "%": 1e-2, "‰": 1e-3},
    "prob_meas0_prep1": {"1": 1.0, "%": 1e-2, "‰": 1e-3},
    "prob_meas1_prep0": {"1": 1.0, "%": 1e-2, "‰": 1e-3},
    "t1_seconds": {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9},
}

# Weak prior of log10 of each field in its common unit (mean, spread in decades).
FIELD_PRIOR = {
    "T1": (2.0, 0.7),
    "T2": (2.0, 0.7),
    "readout_length": (2.9, 0.5),
    "frequency": (0.7, 0.2),
    "readout_error": (-2.0, 0.6),
    "prob_meas0_prep1": (-2.0, 0.6),
    "prob_meas1_prep0": (-2.0, 0.6),
    "t1_seconds": (-4.0, 0.7),
}

FIELDS = tuple(NAME_ALIASES)
NAMES = {alias: common for common, aliases in NAME_ALIASES.items() for alias in aliases}
ENTRY_KEYS = {alias: common for common, aliases in ENTRY_KEY_ALIASES.items() for alias in aliases}
TOP_KEYS = {alias: common for common, aliases in TOP_KEY_ALIASES.items() for alias in aliases}
_UNITS = {spelling: unit for unit, spellings in UNIT_SPELLINGS.items() for spelling in spellings}


def _squeeze(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


_LOOSE_NAMES = {_squeeze(alias): common for alias, common in NAMES.items()}


def common_name(name: object) -> str | None:
    """The common name of a measured name, or None; case and separators don't count."""
    if not isinstance(name, str):
        return None
    return NAMES.get(name) or _LOOSE_NAMES.get(_squeeze(name))


def unit_of(text: object) -> str | None:
    """The common spelling of a unit, '' where none is written, None for an unknown one."""
    if text is None:
        return ""
    if not isinstance(text, str):
        return None
    key = unicodedata.normalize("NFKC", text).strip().lower().rstrip(".")
    return _UNITS.get(key) if key else ""


_NUMBER = re.compile(r"\s*([+-]?(?:\d[\d_]*(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?|[+-]?(?:nan|inf(?:inity)?))\s*(.*?)\s*$", re.I | re.S)


def split_quantity(text: str) -> tuple[float, str] | None:
    """('66,7 us') -> (66.7, 'us'); None where no number leads the text. A comma is a decimal comma."""
    found = _NUMBER.match(text)
    if not found:
        return None
    try:
        return float(found[1].replace(",", ".").replace("_", "")), found[2]
    except ValueError:
        return None


_TIME_WORDS = [
    ("ns", re.compile(r"(?<![a-z])(?:ns|nsec|nano-?s(?:ec(?:ond)?s?)?)(?![a-z])")),
    ("us", re.compile(r"(?<![a-zμ])(?:us|usec|μs|micro-?s(?:ec(?:ond)?s?)?)(?![a-z])")),
    ("ms", re.compile(r"(?<![a-zμ])(?:ms|msec|milli-?s(?:ec(?:ond)?s?)?)(?![a-z])")),
    ("s", re.compile(r"(?<![a-zμ-])(?:s|secs?|seconds?)(?![a-z])")),
]


def stated_time_unit(text: object) -> str | None:
    """The one time unit that a free remark names, or None if it names none or several."""
    if not isinstance(text, str):
        return None
    low = unicodedata.normalize("NFKC", text).lower()
    hits = [unit for unit, pattern in _TIME_WORDS if pattern.search(low)]
    return hits[0] if len(hits) == 1 else None
