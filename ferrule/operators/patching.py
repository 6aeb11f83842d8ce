"""Nested patches: where their values belong.

An entity's field paths are compiled once into a trie whose edges are property names; places in lists (numbers and *) aren't edges, so a path of the
patch and one of the configuration meet if they name the same properties. A patch is walked along it and comes out as assignments to field keys
and as changes of lines. What it means to write them isn't decided here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ferrule.functions.validate import ValidationError
from ferrule.model import UNSET, Entity, Field

#: Properties of an item that may tell its line, in the order in which they count.
LINE_KEYS = ("line", "_line", "lineNumber", "lineIndex")
_WHOLE = re.compile(r"\s*\+?(\d+)(?:\.0*)?\s*")


@dataclass(frozen=True)
class Assignment:
    key: str
    value: Any


@dataclass(frozen=True)
class LinePatch:
    """Values for a line that is told by its number, or by what its match field holds."""

    lines: str
    values: tuple[Assignment, ...]
    line: int | None = None
    match: Assignment | None = None


@dataclass
class Node:
    """What lies at a place of the nested object: a field, and below it fields of these lists, matched by these names."""

    key: str | None = None
    below: dict[str, Node] = field(default_factory=dict)
    lists: dict[str, list[str]] = field(default_factory=dict)

    def at(self, names: Sequence[str]) -> Node | None:
        node: Node | None = self
        for name in names:
            node = node and node.below.get(name)
        return node


def names_in(path: str) -> list[str]:
    """The properties that a dotted path names, without places in lists."""
    return [p for p in path.split(".") if p and p != "*" and not p.isdigit()]


def lines_of(f: Field) -> str | None:
    """The list whose lines a field belongs to: its update rule's, else its own."""
    if f.update is not None and f.update.kind == "lines":
        return f.update.access_id
    return f.access_id if f.access == "lines" else None


def line_number(item: Mapping[str, Any]) -> int | None:
    """The first of LINE_KEYS that holds a whole number from 0 on, or text of one."""
    for value in (item.get(k) for k in LINE_KEYS):
        if isinstance(value, str):
            value = int(m[1]) if (m := _WHOLE.fullmatch(value)) else None
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0 and value == value // 1:
            return int(value)
    return None


class Patcher:
    """Reads patches of one entity."""

    def __init__(self, entity: Entity):
        self.entity, self.root = entity, Node()
        self.names: dict[str, dict[str, str]] = {}  # of each list: what its fields are called, to their keys
        for key, f in entity.fields.items():
            lines = lines_of(f)
            for path in f.paths:
                self._add(names_in(path), key, f, lines)
            if lines:
                own = self.names.setdefault(lines, {})
                paths = [names_in(p) for p in f.paths]
                called = [key, f.record_column, f.column, *[".".join(p[k:]) for p in paths for k in range(len(p))]]
                if f.update is not None and f.update.kind == "lines" and f.update.field_id:
                    called.append(f.update.field_id)
                for name in called:
                    own.setdefault(name, key)

    def _add(self, path: list[str], key: str, f: Field, lines: str | None) -> None:
        node = self.root
        for name in path:
            if lines:  # all but the last node have the field below them
                by = node.lists.setdefault(lines, [])
                if f.update is not None and f.update.match_by and f.update.match_by not in by:
                    by.append(f.update.match_by)
            node = node.below.setdefault(name, Node())
        if path and node.key is None:
            node.key = key

    def read(self, values: Mapping[str, Any]) -> Iterator[Assignment | LinePatch]:
        """In the patch's order. Names at the top that lead nowhere are kept as keys, for the record's schema may know them; deeper ones are left
        out, or refused where every field must be declared."""
        return self._object(values, self.root, ())

    def _object(self, values: Mapping[str, Any], node: Node | None, above: tuple[str, ...] | None) -> Iterator[Assignment | LinePatch]:
        """above: the names on the way, of which keys may be made; None within lines, whose keys are found by their paths alone."""
        for name, value in values.items():
            here = None if above is None else (*above, name)
            there = node and node.at(names_in(name))
            key = self._key(here, there)
            if key is not None:
                yield Assignment(key, value)
            elif isinstance(value, Mapping):
                yield from self._object(value, there, here)
            elif isinstance(value, (list, tuple)):
                yield from self._list(name, value, there, here)
            elif above == ():
                yield Assignment(name, value)
            else:
                self._nowhere(".".join(here or (name,)))

    def _key(self, here: tuple[str, ...] | None, there: Node | None) -> str | None:
        made = [] if here is None else ["_".join(here), ".".join(here)]
        return next((k for k in made if k in self.entity.fields), there.key if there else None)

    def _nowhere(self, path: str) -> None:
        if self.entity.explicit:
            raise ValidationError(f"Patch path '{path}' is not mapped in explicit composite config for '{self.entity.record_type}'.")

    def _list(self, name: str, items: Sequence[Any], node: Node | None, here: tuple[str, ...] | None) -> Iterator[Assignment | LinePatch]:
        path = ".".join(here or (name,))
        lists = list(node.lists) if node else []
        if len(lists) > 1:
            raise ValidationError(f"Patch array '{path}' maps to multiple sublists ({', '.join(lists)}). Use an explicit collection patch.")
        for k, item in enumerate(items):
            if lists:
                yield from self._line(lists[0], path, k, item, node)
            elif isinstance(item, Mapping):
                yield from self._object(item, node, None if here is None else (*here, str(k)))
            else:
                self._nowhere(f"{path}.{k}")

    def _line(self, lines: str, path: str, k: int, item: Any, node: Node) -> Iterator[Assignment | LinePatch]:
        if not isinstance(item, Mapping):
            raise ValidationError(f"Patch path '{path}.{k}' must be an object to update sublist '{lines}'.")
        number = line_number(item)
        match = self._match(lines, path, k, item, node) if number is None else None
        rest = {name: v for name, v in item.items() if name not in LINE_KEYS}
        own = []
        for got in self._object(rest, node, None):
            if isinstance(got, LinePatch):
                yield got
            elif lines_of(self.entity.fields[got.key]) != lines:
                if self.entity.explicit:
                    raise ValidationError(f"Patch field '{got.key}' does not map to sublist '{lines}'.")
            elif match is None or got.key != match.key:  # what tells the line isn't written
                own.append(got)
        if own:
            yield LinePatch(lines, tuple(own), number, match)

    def _match(self, lines: str, path: str, k: int, item: Mapping[str, Any], node: Node) -> Assignment:
        by = node.lists[lines]
        if len(by) > 1:
            raise ValidationError(f"Patch array '{path}' has multiple matchBy fields ({', '.join(by)}). Use an explicit collection patch.")
        if not by:
            raise ValidationError(f"Sublist patch '{path}.{k}' needs a line number or a configured matchBy value for sublist '{lines}'.")
        names, array = names_in(by[0]), names_in(path)
        inner = names[len(array) :] if names[: len(array)] == array else names
        value = next((v for v in (_inside(item, n) for n in (names, inner)) if v is not UNSET), UNSET)
        if value is UNSET:
            raise ValidationError(f"Sublist patch '{path}' is missing matchBy value '{by[0]}' for sublist '{lines}'.")
        key = self.names[lines].get(by[0]) or self.names[lines].get(".".join(names))
        if key is None:
            raise ValidationError(f"Sublist '{lines}' matchBy field '{by[0]}' is not mapped in query config.")
        return Assignment(key, value)


def _inside(value: Any, names: Sequence[str]) -> Any:
    for name in names:
        value = value.get(name, UNSET) if isinstance(value, Mapping) else UNSET
    return value
