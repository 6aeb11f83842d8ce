"""Conversion of values to a field's type before they are written.

Numbers that come as text are read by their leading part; what has none becomes NaN and no error is raised here. Whole numbers come from numbers by
rounding down, and from text by cutting off the fraction. Text of a date becomes a date.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping

from ferrule.model import UNSET, Field, FieldSchema

_INT = re.compile(r"\s*([+-]?\d+)")
_FLOAT = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")

#: Kinds of known fields as types; others are strings.
KIND_TYPES = {"integer": "integer", "float": "float", "currency": "currency", "boolean": "boolean", "date": "date", "datetime": "datetime", "multiselect": "multiselect", "reference": "key"}


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def as_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def whole_number(value):
    if is_number(value):
        return value if isinstance(value, float) and not math.isfinite(value) else math.floor(value)
    m = _INT.match(as_text(value))
    return int(m[1]) if m else math.nan


def real_number(value):
    if is_number(value):
        return value
    m = _FLOAT.match(as_text(value))
    return float(m[1]) if m else math.nan


def truth(value) -> bool:
    return value if isinstance(value, bool) else as_text(value).upper() in ("T", "TRUE")


DATE_FORMS = ("%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%Y-%m", "%Y", "%d %b %Y", "%b %d, %Y")


def as_date(text: str) -> dt.datetime | None:
    """Text of one of DATE_FORMS or of ISO 8601 as a date and time; None for any other."""
    for form in DATE_FORMS:
        try:
            return dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
    try:
        return dt.datetime.fromisoformat(text.strip()) if text.strip() else None
    except ValueError:
        return None


def convert(value, field: Field, schema: FieldSchema | None = None):
    """None for null and UNSET. Reference objects give their id, externalId or refName as it is, but only where the schema says reference."""
    if value is None or value is UNSET:
        return None
    if schema is not None and schema.kind == "reference" and isinstance(value, Mapping):
        for key in ("id", "externalId", "refName"):
            if key in value:
                return value[key]
    if field.type in ("integer", "key"):
        return whole_number(value)
    if field.type in ("float", "currency"):
        return real_number(value)
    if field.type in ("boolean", "checkbox"):
        return truth(value)
    if field.type == "multiselect":
        return [as_text(v) for v in value] if isinstance(value, (list, tuple)) else [as_text(value)]
    kind = schema.kind if field.type is None and schema is not None else field.type
    if kind in ("date", "datetime") and isinstance(value, str) and (when := as_date(value)):
        return when.date() if kind == "date" else when
    return value
