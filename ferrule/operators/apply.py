"""Applying a record's changes as expressions over its nested row: one projection, no Python on the way."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.convert import as_date, is_number
from ferrule.functions.validate import numeric
from ferrule.operators.changes import Changes, LineChange, ordered


class ApplyError(ValueError):
    """Changes don't fit the stored record."""


#: Least and greatest value of whole-number columns.
RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _number(value, kind: T.DataType):
    """value as a number that the column can hold."""
    n = numeric(value)
    bits = RANGES.get(type(kind))
    if n is None or bits and not (math.isfinite(n) and -(2**bits) <= n < 2**bits):
        raise ApplyError(f"Value '{value}' can't be stored in a column of type {kind.simpleString()}.")
    return value if is_number(value) else int(n) if bits else n


def _date(value, kind: T.DataType):
    when = as_date(value) if isinstance(value, str) else value
    if not isinstance(when, dt.date):
        raise ApplyError(f"Value '{value}' can't be stored in a column of type {kind.simpleString()}.")
    return when


def storable(value, kind: T.DataType):
    """value as the column can hold it; ApplyError if it can't, so that nothing is written that couldn't be read."""
    if value is None or isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.NumericType):
        return _number(value, kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _date(value, kind)
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        raise ApplyError(f"Value '{value}' can't be stored in a column of type boolean.")
    return value


def _value(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        if value is not None and not isinstance(value, (list, tuple)):
            raise ApplyError(f"Value '{value}' can't be stored in a column of type {kind.simpleString()}.")
        return F.lit(None).cast(kind) if value is None else F.array(*[F.lit(storable(v, kind.elementType)) for v in value]).cast(kind)
    return F.lit(storable(value, kind)).cast(kind)


def _same_type(value, kind: T.DataType) -> bool:
    """Matches are strict: text is never a number, a number never a truth value."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, T.StringType) if isinstance(value, str) else not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType))


def _item_type(df: DataFrame, lines: str) -> T.StructType:
    kind = _column_type(df, lines)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise ApplyError(f"Column '{lines}' does not hold lines.")
    return kind.elementType


def _column_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ApplyError(f"Column '{name}' is not in the stored record.")
    return df.schema[name].dataType


def _field_type(of: T.StructType, name: str) -> T.DataType:
    if name not in of.names:
        raise ApplyError(f"Field '{name}' is not in the stored record.")
    return of[name].dataType


def _with(item: Column, kind: T.StructType, edits) -> Column:
    for e in ordered(edits):
        item = item.withField(f"`{e.field_id}`", _value(e.value, _field_type(kind, e.field_id)))
    return item


def _place(lines: Column, kind: T.StructType, change: LineChange) -> Column:
    """The number of the line to change, or -1."""
    if change.match is None:
        return F.lit(change.line)
    name, value = change.match
    if value is None:
        return F.array_position(F.transform(lines, lambda x: x[name].isNull()), F.lit(True)) - 1
    if not _same_type(value, _field_type(kind, name)):
        return F.lit(-1)
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x[name].eqNullSafe(F.lit(value))), F.lit(True)), F.lit(0)) - 1


def _without(lines: Column, place: int) -> Column:
    return F.filter(lines, lambda x, i: i != place)


def _changed(lines: Column, place: Column, kind: T.StructType, change: LineChange) -> Column:
    return F.transform(lines, lambda x, i: F.when(i == place, _with(x, kind, change.edits)).otherwise(x))


def changed_columns(df: DataFrame, changes: Changes) -> tuple[dict[str, Column], dict[str, Column]]:
    """New values of the columns that change, and checks, both of the record's row: for each removal and change of a line whether there is such a line.

    The order is: body, removals (highest line first), line updates on what is left, additions, sub-objects. A line change sees those before it."""
    now: dict[str, Column] = {}
    found: dict[str, Column] = {}
    col = lambda name: now.get(name, F.col(f"`{name}`"))
    for e in ordered(changes.body.values()):
        now[e.field_id] = _value(e.value, _column_type(df, e.field_id))
    there = lambda place, lines: F.coalesce((place >= 0) & (place < F.size(lines)), F.lit(False))
    for n, r in enumerate(changes.removes()):
        _item_type(df, r.lines)
        found[f"_remove{n}"] = there(F.lit(r.line), col(r.lines))
        now[r.lines] = _without(col(r.lines), r.line)
    for n, c in enumerate(changes.line_changes):
        kind = _item_type(df, c.lines)
        place = _place(col(c.lines), kind, c)
        found[f"_line{n}"] = there(place, col(c.lines))
        now[c.lines] = _changed(col(c.lines), place, kind, c)
    for a in changes.line_adds:
        kind = _item_type(df, a.lines)
        given = {e.field_id: e.value for e in ordered(a.edits)}
        for name in given:
            _field_type(kind, name)
        new = F.struct(*[_value(given.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
        now[a.lines] = F.concat(F.coalesce(col(a.lines), F.array().cast(T.ArrayType(kind))), F.array(new))
    for access, edits in changes.owned_edits.items():
        kind = _column_type(df, access)
        if not isinstance(kind, T.StructType):
            raise ApplyError(f"Column '{access}' does not hold a sub-object.")
        clear = changes.reloads.get(access)
        if clear:
            own = _column_type(df, clear)
            filled = col(clear).isNotNull() & ~F.coalesce(col(clear).cast("string"), F.lit("")).isin("", "0", "false", "0.0")
            now[clear] = F.when(filled, F.lit("" if isinstance(own, T.StringType) else None).cast(own)).otherwise(col(clear))
        empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
        now[access] = _with(F.coalesce(col(access), empty), kind, edits.values())
    return now, found


def apply_changes(df: DataFrame, key: str, changes: Changes) -> DataFrame:
    """The snapshot with the record's changes; all other rows as they are. One projection over the scan, without a shuffle."""
    now, _ = changed_columns(df, changes)
    hit = F.col(f"`{key}`") == F.lit(changes.record_id)
    return df.select(*[F.when(hit, now[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in now else F.col(f"`{c}`") for c in df.columns])


def check_record(df: DataFrame, key: str, changes: Changes) -> None:
    """Raises ApplyError if the record isn't there, or a line that is to be removed or changed. Reads one row by its key."""
    _, found = changed_columns(df, changes)
    row = df.filter(F.col(f"`{key}`") == F.lit(changes.record_id)).select(F.lit(1).alias("_there"), *[c.alias(k) for k, c in found.items()]).first()
    if row is None:
        raise ApplyError(f"Record '{changes.record_id}' does not exist.")
    for n, r in enumerate(changes.removes()):
        if not row[f"_remove{n}"]:
            raise ApplyError(f"Sublist '{r.lines}' has no line {r.line} to remove.")
    for n, c in enumerate(changes.line_changes):
        if not row[f"_line{n}"]:
            raise ApplyError(f"No matching line found for sublist '{c.lines}'." if c.match is not None else f"Sublist '{c.lines}' has no line {c.line}.")
