"""Where an update's keys lead: to a body field, a field of a sub-object, or a field of lines; and which may be written."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ferrule.functions.convert import KIND_TYPES, convert
from ferrule.functions.validate import ValidationError, check
from ferrule.model import Entity, Field, FieldSchema, Lines, Owned


@dataclass(frozen=True)
class Edit:
    """A converted value for a physical field."""

    key: str
    field_id: str
    value: object
    set_first: bool = False


_BECAUSE = lambda rule: f"is {rule.kind}" + (f": {rule.reason}" if rule.reason else ".")
#: Why rules of these kinds write nothing.
NOT_WRITTEN = dict.fromkeys(("readonly", "derived", "external"), _BECAUSE) | {"related": lambda rule: f"maps to related record '{rule.record_type}'; update that record itself."}
#: Kinds that write, and whether they need an access id.
WRITES = {"body": False, "owned": True, "lines": True}


class Targets:
    """Resolves keys of one entity. reloads gathers sub-objects whose list field must be cleared first (access id to list field);
    the first that registers one wins."""

    def __init__(self, entity: Entity, reloads: dict[str, str]):
        self.entity, self.reloads = entity, reloads

    def register_reload(self, access_id: str, clear_field: str | None) -> None:
        if clear_field:
            self.reloads.setdefault(access_id, clear_field)

    def target(self, key: str) -> Field:
        """The configured field as its update rule makes it."""
        f = self.entity.fields[key]
        rule = f.update
        if rule is None:
            return f
        if rule.kind not in WRITES:
            raise ValidationError(f"Field '{key}' {NOT_WRITTEN[rule.kind](rule)}")
        moved = {"record_field": rule.field_id or f.record_column, "access": rule.kind, "access_id": rule.access_id if WRITES[rule.kind] else None}
        if rule.set_first is not None:
            moved["set_first"] = rule.set_first
        if rule.kind == "owned" and rule.clear_first:
            self.register_reload(rule.access_id, rule.clear_first)
            moved |= {"needs_reload": True, "clear_field": rule.clear_first}
        return replace(f, **moved)

    def _from_schema(self, key: str, lines: str | None, physical: str | None) -> Field | None:
        """A field that only the record's schema has."""
        s = self.entity.schema
        if s is None:
            return None
        group = s.lines.get(lines) if lines else None
        known = (group.fields if group else {}) if lines else s.fields
        found = known.get(physical or key) or known.get(key)
        if found is None:
            return None
        access = "lines" if lines or found.kind == "sublist" else "owned" if found.kind == "subrecord" else "body"
        return Field(found.id, self.entity.table.alias, type=KIND_TYPES.get(found.kind, "string"), record_field=found.id, readonly=found.writable is False, access=access, access_id=lines or (None if access == "body" else found.id))

    def writable(self, key: str, lines: str | None = None, physical: str | None = None) -> Field:
        """The field to write, or ValidationError. `lines` says in which lines a key that only the schema has is to be looked for."""
        own = self.entity.fields.get(key)
        f = self.target(key) if own else self._from_schema(key, lines, physical)
        if f is None:
            raise ValidationError(f"Field '{key}' is not defined in query config or record metadata for '{self.entity.record_type}'.")
        if self.entity.explicit and own and own.update is None:
            raise ValidationError(f"Field '{key}' belongs to an explicit composite config and does not declare an update rule.")
        if f.readonly:
            raise ValidationError(f"Field '{key}' is readonly.")
        self._check_schema(key, f)
        return f

    def schema_of(self, key: str, f: Field) -> FieldSchema | None:
        """Nested by physical id, nested by key, then body by id and by key."""
        s = self.entity.schema
        if s is None:
            return None
        groups = {"owned": s.owned, "lines": s.lines}.get(f.access or "body", {})
        nested = groups[f.access_id].fields if f.access_id in groups else {}
        return next((d[n] for d in (nested, s.fields) for n in (f.record_column, key) if n in d), None)

    def _check_schema(self, key: str, f: Field) -> None:
        schema = self.schema_of(key, f)
        if schema is None:
            return
        if schema.writable is False:
            raise ValidationError(f"Field '{key}' is not writable according to record metadata.")
        if f.access not in ("owned", "lines"):
            return
        group = (self.entity.schema.owned if f.access == "owned" else self.entity.schema.lines).get(self.access_id(key, f))
        if group is None:
            return
        if group.writable is False:
            raise ValidationError(f"{'Subrecord' if f.access == 'owned' else 'Sublist'} '{f.access_id}' is not writable according to record metadata.")
        if f.access == "owned":
            self.register_reload(f.access_id, group.clear_first)

    def access_id(self, key: str, f: Field) -> str:
        if not f.access_id:
            raise ValidationError(f"Field '{key}' has access '{f.access}' but no access id.")
        return f.access_id

    def line_field(self, lines: str, key: str) -> Field:
        f = self.writable(key, lines)
        if f.access != "lines" or f.access_id != lines:
            raise ValidationError(f"Field '{key}' is not configured for sublist '{lines}'.")
        return f

    def edit(self, key: str, f: Field, value) -> Edit:
        schema = self.schema_of(key, f)
        check(key, value, schema)
        return Edit(key, f.record_column, convert(value, f, schema), f.set_first)

    def relationship_key(self, name: str, rel: Owned | Lines, key: str) -> str:
        if rel.fields.get(key):
            return rel.fields[key]
        if f"{name}_{key}" in self.entity.fields:
            return f"{name}_{key}"
        for own, f in self.entity.fields.items():
            if f.access_id == rel.access_id and f.nest_path and (f.nest_path == f"{name}.{key}" or f.nest_path.endswith(f".{key}")):
                return own
        raise ValidationError(f"Field '{key}' is not mapped on relationship '{name}' for '{self.entity.record_type}'.")
