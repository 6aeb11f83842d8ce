"""What an entity is: its tables, joins, fields, relationships and write rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any


class _Unset:
    """No value at all, as against None, which is a null."""

    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


UNSET = _Unset()

FIELD_TYPES = ("string", "integer", "key", "float", "currency", "boolean", "checkbox", "date", "datetime", "select", "multiselect")
JOIN_TYPES = {"inner": "INNER JOIN", "left_outer": "LEFT OUTER JOIN", "right_outer": "RIGHT OUTER JOIN"}


class ConfigError(ValueError):
    """An entity's configuration can't be used."""


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class On:
    """source.foreign_key = target.primary_key; link says how it joins the conditions before it."""

    foreign_key: str
    primary_key: str
    source: str | None = None
    target: str | None = None
    link: str = "AND"


@dataclass(frozen=True)
class Join:
    to: Table
    source: str
    on: tuple[On, ...]
    kind: str = "inner"

    def __post_init__(self):
        object.__setattr__(self, "on", tuple(self.on))
        if not self.on:
            raise ConfigError(f"Join to '{self.to.name}' has no constraints.")


@dataclass(frozen=True)
class Source:
    """Where a field's values come from. Patches find the field by the path too; the rest is kept for those who read the configuration."""

    kind: str | None = None
    path: str | None = None
    record_type: str | None = None
    table: str | None = None
    field_id: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class UpdateRule:
    """Where a field is written: body, owned (a sub-object), lines, related, or nowhere (readonly, derived, external)."""

    kind: str
    access_id: str | None = None
    field_id: str | None = None
    clear_first: str | None = None
    match_by: str | None = None
    set_first: bool | None = None
    record_type: str | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Field:
    column: str
    table: str
    type: str | None = None
    alias: str | None = None
    nest_path: str | None = None
    many: bool = False
    primary: bool = False
    select: bool = True
    use_text: bool = False
    transform: Callable | None = None
    record_field: str | None = None
    readonly: bool = False
    access: str | None = None  # body, owned or lines
    access_id: str | None = None
    set_first: bool = False
    needs_reload: bool = False
    clear_field: str | None = None
    source: Source | None = None
    update: UpdateRule | None = None
    meta: Any = None

    @property
    def paths(self) -> list[str]:
        """Where the field lies in nested objects."""
        return [p for p in (self.nest_path, self.source and self.source.path) if p]

    @property
    def record_column(self) -> str:
        return self.record_field if self.record_field is not None else self.column


@dataclass(frozen=True)
class Owned:
    """A one-to-one sub-object, a struct column of the record."""

    access_id: str
    fields: Mapping[str, str] = field(default_factory=dict)
    clear_field: str | None = None


@dataclass(frozen=True)
class Lines:
    """A one-to-many list of lines, an array-of-struct column of the record."""

    access_id: str
    fields: Mapping[str, str] = field(default_factory=dict)
    match_field: str | None = None


@dataclass(frozen=True)
class FieldSchema:
    """What is known of a physical field. Properties that nothing interprets are kept in extra."""

    id: str
    kind: str | None = None
    writable: bool | None = None
    required: bool = False
    nullable: bool | None = None
    enum: tuple = ()
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    extra: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class GroupSchema:
    """Of a sub-object or a list of lines."""

    id: str
    writable: bool | None = None
    clear_first: str | None = None
    fields: Mapping[str, FieldSchema] = field(default_factory=dict)


@dataclass(frozen=True)
class RecordSchema:
    record_type: str
    fields: Mapping[str, FieldSchema] = field(default_factory=dict)
    owned: Mapping[str, GroupSchema] = field(default_factory=dict)
    lines: Mapping[str, GroupSchema] = field(default_factory=dict)
    operations: Mapping[str, bool] = field(default_factory=dict)


@dataclass(frozen=True)
class Entity:
    record_type: str
    table: Table
    fields: Mapping[str, Field]
    joins: tuple[Join, ...] = ()
    relationships: Mapping[str, Owned | Lines] = field(default_factory=dict)
    schema: RecordSchema | None = None
    explicit: bool = False
    description: str | None = None
    post_process: Callable[[dict], dict | None] | None = None

    def primary(self) -> tuple[str, Field] | None:
        return next(((k, f) for k, f in self.fields.items() if f.primary), None)

    def field(self, key: str) -> Field:
        got = self.fields.get(key)
        if got is None:
            raise KeyError(f"Field '{key}' is not defined in query config for '{self.record_type}'.")
        return got


_NAMES = {f.name for f in fields(Field)}


def make_field(config: Field | Mapping[str, Any]) -> Field:
    """A Field as it is; a mapping of its properties; or sections {query, common, record}, of which later ones win."""
    if isinstance(config, Field):
        return config
    if isinstance(config.get("query"), Mapping):
        merged: dict[str, Any] = {}
        for part in ("query", "common", "record"):
            merged.update(config.get(part) or {})
    else:
        merged = dict(config)
    unknown = set(merged) - _NAMES
    if unknown:
        raise ConfigError(f"Unknown field properties: {', '.join(sorted(unknown))}.")
    for name, kind in (("update", UpdateRule), ("source", Source)):
        if isinstance(merged.get(name), Mapping):
            merged[name] = kind(**merged[name])
    return Field(**merged)


def define_entity(record_type: str, table: Table | tuple[str, str], fields: Mapping[str, Field | Mapping[str, Any]], joins: Sequence[Join] = (), **rest: Any) -> Entity:
    """An Entity with its fields made, and checked: output names must differ in more than case, types must be known, aliases
    must be those of its tables."""
    made = {k: make_field(v) for k, v in fields.items()}
    table = table if isinstance(table, Table) else Table(*table)
    seen: dict[str, str] = {}
    for key, f in made.items():
        name = (f.alias or key).lower()
        if name in seen:
            raise ConfigError(f"Fields '{seen[name]}' and '{key}' of '{record_type}' have the same output name.")
        seen[name] = key
        if f.type is not None and f.type not in FIELD_TYPES:
            raise ConfigError(f"Field '{key}' has the unknown type '{f.type}'.")
    return Entity(record_type=record_type, table=table, fields=made, joins=tuple(joins), **rest)
