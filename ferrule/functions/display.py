"""Display texts of coded columns: left joins to lookup tables.

An id that the lookup lacks has a null text; a column without a registered lookup has its own value as text.
"""

from __future__ import annotations

from ferrule.model import Entity
from ferrule.sources.catalog import Catalog


class DisplayJoins:
    """The lookups that one query needs, each joined once. A key that a lookup repeats has its least label, so no row is repeated."""

    def __init__(self, entity: Entity, catalog: Catalog):
        self.tables = {entity.table.alias: entity.table.name} | {j.to.alias: j.to.name for j in entity.joins}
        self.catalog = catalog
        self.used: dict[tuple[str, str], str] = {}

    def label(self, alias: str, column: str) -> str:
        if (self.tables.get(alias), column) not in self.catalog.displays:
            return f"CAST({alias}.{column} AS STRING)"
        name = self.used.setdefault((alias, column), f"_display{len(self.used)}")
        return f"{name}.label"

    def joins(self) -> str:
        out = ""
        for (alias, column), name in self.used.items():
            d = self.catalog.displays[self.tables[alias], column]
            if self.catalog.has_unique_keys(d):  # then no row can be repeated, and Spark sees the lookup's size
                out += f" LEFT OUTER JOIN (SELECT {d.key} AS code, {d.label} AS label FROM {d.lookup}) {name} ON {alias}.{column} = {name}.code"
                continue
            out += f" LEFT OUTER JOIN (SELECT {d.key} AS code, MIN({d.label}) AS label FROM {d.lookup} GROUP BY {d.key}) {name} ON {alias}.{column} = {name}.code"
        return out
