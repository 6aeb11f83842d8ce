"""WHERE conditions as SQL text and positional parameters.

Conditions are joined as text and without brackets, so SQL's own precedence holds: a OR b AND c is a OR (b AND c). Only groups have brackets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ferrule.model import UNSET

#: Operators by what they take.
NO_VALUE, TWO_VALUES, VALUES, ONE_VALUE = ("IS NULL", "IS NOT NULL"), ("BETWEEN",), ("IN", "NOT IN"), ("=", "!=", "<>", ">", ">=", "<", "<=", "LIKE", "NOT LIKE")


@dataclass(frozen=True)
class Condition:
    link: str
    text: str
    args: tuple = ()


def is_list(value) -> bool:
    return isinstance(value, (list, tuple, set, frozenset, range))


def _none(op: str, value) -> tuple[str, tuple]:
    return "", ()


def _two(op: str, value) -> tuple[str, tuple]:
    if not is_list(value) or len(value) != 2:
        raise ValueError("BETWEEN requires exactly two values.")
    return " ? AND ?", tuple(value)


def _several(op: str, value) -> tuple[str, tuple]:
    if not is_list(value) or not len(value):
        raise ValueError(f"{op} requires at least one value.")
    return f" ({', '.join('?' * len(value))})", tuple(value)


def _one(op: str, value) -> tuple[str, tuple]:
    if is_list(value):
        raise ValueError(f"{op} does not accept an array value.")
    return " ?", (value,)


#: What follows each operator, and its parameters.
SHAPES = dict.fromkeys(NO_VALUE, _none) | dict.fromkeys(TWO_VALUES, _two) | dict.fromkeys(VALUES, _several) | dict.fromkeys(ONE_VALUE, _one)


def comparison(expr: str, op: str, value) -> tuple[str, tuple]:
    op = op.upper()
    if op not in SHAPES:
        raise ValueError(f"Unknown operator '{op}'.")
    rest, args = SHAPES[op](op, value)
    return f"{expr} {op}{rest}", args


def joined(conditions: list[Condition]) -> tuple[str, list]:
    """The text, whose first link is left out, and all parameters in order."""
    parts = [c.text if not k else f"{c.link} {c.text}" for k, c in enumerate(conditions)]
    return " ".join(parts), [a for c in conditions for a in c.args]


class Where:
    """Collects conditions. resolve(field, use_text) gives a field's SQL expression and raises for unknown fields.

    A condition whose value is UNSET is left out, before its field is looked up; None is a null."""

    def __init__(self, resolve: Callable[[str, bool], str]):
        self.resolve = resolve
        self.conditions: list[Condition] = []

    def _add(self, link: str, name: str, op: str, value, use_text: bool):
        if value is UNSET and op.upper() not in NO_VALUE:
            return self
        text, args = comparison(self.resolve(name, use_text), op, value)
        self.conditions.append(Condition(link, text, args))
        return self

    def where(self, name: str, op: str, value=UNSET, use_text: bool = False):
        return self._add("AND", name, op, value, use_text)

    def or_where(self, name: str, op: str, value=UNSET, use_text: bool = False):
        return self._add("OR", name, op, value, use_text)

    def where_raw(self, sql: str, *args):
        if "BUILTIN.DF(" in sql.upper():
            raise ValueError("Raw SQL cannot call BUILTIN.DF; use use_text=True.")
        self.conditions.append(Condition("AND", sql, args))
        return self

    def or_where_raw(self, sql: str, *args):
        self.where_raw(sql, *args)
        self.conditions[-1] = Condition("OR", sql, args)
        return self

    def where_in(self, name: str, values=UNSET):
        return self if values is UNSET or values is None or not len(values) else self.where(name, "IN", values)

    def where_not_in(self, name: str, values=UNSET):
        return self if values is UNSET or values is None or not len(values) else self.where(name, "NOT IN", values)

    def where_null(self, name: str):
        return self.where(name, "IS NULL")

    def where_not_null(self, name: str):
        return self.where(name, "IS NOT NULL")

    def where_between(self, name: str, low=UNSET, high=UNSET):
        return self if low is UNSET or high is UNSET else self.where(name, "BETWEEN", [low, high])

    def where_group(self, build: Callable[[Where], object]):
        return self._group("AND", build)

    def or_where_group(self, build: Callable[[Where], object]):
        return self._group("OR", build)

    def _group(self, link: str, build):
        inner = Where(self.resolve)
        build(inner)
        if inner.conditions:
            text, args = joined(inner.conditions)
            self.conditions.append(Condition(link, f"({text})", tuple(args)))
        return self
