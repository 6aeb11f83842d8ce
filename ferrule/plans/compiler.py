"""From a query's state to Spark SQL text with positional parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from ferrule.functions.display import DisplayJoins
from ferrule.model import JOIN_TYPES, Entity, Field
from ferrule.plans.predicates import Condition, joined
from ferrule.sources.catalog import Catalog


@dataclass(frozen=True)
class Output:
    """A column of the flat result: the field's key, its output path and the field."""

    key: str
    path: str
    field: Field


@dataclass(frozen=True)
class Compiled:
    sql: str
    args: list
    outputs: dict[str, Output]  # by lower-cased alias, in projection order


@dataclass
class State:
    """What a builder has gathered."""

    selected: set[str] | None = None
    distinct: bool = False
    conditions: list[Condition] = field(default_factory=list)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def name_of(key: str, f: Field) -> str:
    return f.alias or key


class Compiler:
    def __init__(self, entity: Entity, catalog: Catalog, displays: DisplayJoins):
        self.entity, self.catalog, self.displays = entity, catalog, displays

    def expression(self, f: Field, as_text: bool) -> str:
        plain = f"{f.table}.{f.column}"
        return self.displays.label(f.table, f.column) if as_text else plain

    def projected(self, state: State) -> list[tuple[str, Field]]:
        """In the order of the configuration; primary fields always."""
        out = []
        for key, f in self.entity.fields.items():
            chosen = f.select if state.selected is None else key in state.selected
            if f.primary or chosen:
                out.append((key, f))
        if not out:
            raise ValueError("At least one selectable field is required.")
        return out

    def _from(self) -> str:
        e = self.entity
        text = f"FROM {e.table.name} {e.table.alias}"
        for j in e.joins:
            on = ""
            for k, c in enumerate(j.on):
                on += f" {c.link} " if k else ""
                on += f"{c.source or j.source}.{c.foreign_key} = {c.target or j.to.alias}.{c.primary_key}"
            text += f" {JOIN_TYPES.get(j.kind, 'INNER JOIN')} {j.to.name} {j.to.alias} ON {on}"
        return text + self.displays.joins()

    def _order(self, state: State, outputs: list[tuple[str, Field]]) -> str:
        parts = []
        for key, way in state.sorts:
            f = self.entity.field(key)
            expr = self.expression(f, False)
            if state.distinct:  # only what is projected can order distinct rows
                if key not in dict(outputs) or f.use_text:
                    raise ValueError(f"Distinct rows cannot be ordered by '{key}', which is not projected as it is.")
                expr = quote(name_of(key, f))
            parts.append(f"{expr} {way} NULLS LAST")
        return f"ORDER BY {', '.join(parts)}" if parts else ""

    def compile(self, state: State, hidden_sorts: bool = False) -> Compiled:
        """SELECT, FROM, WHERE, ORDER BY and LIMIT on lines of their own. With hidden_sorts, sort keys are columns _sort0, _sort1, ... too."""
        outputs = self.projected(state)
        columns = [f"{self.expression(f, f.use_text)} AS {quote(name_of(k, f))}" for k, f in outputs]
        if hidden_sorts and not state.distinct:
            columns += [f"{self.expression(self.entity.field(k), False)} AS _sort{i}" for i, (k, _) in enumerate(state.sorts)]
        where, args = joined(state.conditions)
        lines = [f"SELECT {'DISTINCT ' if state.distinct else ''}{', '.join(columns)}", "", f"WHERE {where}" if where else "", self._order(state, outputs)]
        lines[1] = self._from()  # after all expressions, which may add display joins
        if state.limit is not None:
            lines.append(f"LIMIT {state.limit}")
        if state.offset:
            lines.append(f"OFFSET {state.offset}")
        named = {name_of(k, f).lower(): Output(k, f.nest_path or k, f) for k, f in outputs}
        return Compiled("\n".join(x for x in lines if x), args, named)

    def scalar(self, state: State, select: str) -> tuple[str, list]:
        where, args = joined(state.conditions)
        return " ".join(x for x in (f"SELECT {select}", self._from(), f"WHERE {where}" if where else "") if x), args


def inlined(sql: str, args: list) -> str:
    """For display only: every question mark becomes its parameter."""
    parts = sql.split("?")
    if len(parts) - 1 > len(args):
        raise ValueError("A parameter is missing.")
    out = parts[0]
    for value, rest in zip(args, parts[1:]):
        if value is None:
            shown = "NULL"
        elif isinstance(value, bool):
            shown = str(value).lower()
        elif isinstance(value, (int, float)):
            shown = str(value)
        else:
            shown = "'" + str(value).replace("'", "''") + "'"
        out += shown + rest
    return out
