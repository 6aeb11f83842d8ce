"""Checks of values against what is known of their fields."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from ferrule.functions.convert import as_date, as_text, is_number
from ferrule.model import UNSET, FieldSchema


class ValidationError(ValueError):
    """A value or a field isn't allowed."""


_NUMBER = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+")


def numeric(value) -> float | None:
    """A number, or numeric text as a number; else None."""
    if is_number(value):
        return float(value)
    if isinstance(value, str) and _NUMBER.fullmatch(value.strip()):
        text = value.strip().lower()
        return float(int(text, 0)) if text[:2] in ("0x", "0b", "0o") else float(text)
    return None


def is_date(value) -> bool:
    return isinstance(value, dt.date) or isinstance(value, str) and as_date(value) is not None


def _check_number(value, s: FieldSchema) -> str | None:
    n = numeric(value)
    if n is None:
        return "expects a numeric value"
    if s.minimum is not None and n < s.minimum:
        return f"expects a value greater than or equal to {s.minimum}"
    if s.maximum is not None and n > s.maximum:
        return f"expects a value less than or equal to {s.maximum}"
    return None


def _check_text(value: str, s: FieldSchema) -> str | None:
    if s.min_length is not None and len(value) < s.min_length:
        return f"expects at least {s.min_length} characters"
    if s.max_length is not None and len(value) > s.max_length:
        return f"expects no more than {s.max_length} characters"
    if s.pattern and not re.search(s.pattern, value):
        return "does not match the pattern"
    return None


def _is_reference(value) -> bool:
    return isinstance(value, str) or is_number(value) or isinstance(value, Mapping) and any(k in value for k in ("id", "refName", "externalId"))


_KINDS = {
    "integer": _check_number,
    "float": _check_number,
    "currency": _check_number,
    "boolean": lambda v, s: None if isinstance(v, bool) or as_text(v).lower() in ("t", "f", "true", "false") else "expects a boolean value",
    "date": lambda v, s: None if is_date(v) else "expects a date value",
    "datetime": lambda v, s: None if is_date(v) else "expects a date value",
    "multiselect": lambda v, s: None if isinstance(v, (list, tuple)) else "expects an array value",
    "reference": lambda v, s: None if _is_reference(v) else "expects a record reference value",
} | dict.fromkeys(("object", "subrecord", "sublist"), lambda v, s: None if isinstance(v, (Mapping, list, tuple)) else "expects an object value")


def check(key: str, value, schema: FieldSchema | None) -> None:
    """Raises ValidationError. UNSET is never checked; null only against fields that are required and not nullable."""
    if schema is None or value is UNSET:
        return
    if value is None:
        if schema.required and schema.nullable is False:
            raise ValidationError(f"Field '{key}' is required and not nullable according to record metadata.")
        return
    if not schema.kind or schema.kind == "unknown":
        return
    problem = None
    if schema.enum and not any(e is value or as_text(e) == as_text(value) for e in schema.enum):
        problem = f"expects one of {', '.join(map(as_text, schema.enum))}"
    problem = problem or (_check_text(value, schema) if isinstance(value, str) else None)
    problem = problem or (_KINDS[schema.kind](value, schema) if schema.kind in _KINDS else None)
    if problem:
        raise ValidationError(f"Field '{key}' {problem} according to record metadata.")
