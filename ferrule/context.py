"""Entity sets over a catalog: the entry points of an application."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from ferrule.model import Entity
from ferrule.operators.builder import Query
from ferrule.operators.changes import Changes
from ferrule.sources.catalog import Catalog


class EntitySet:
    """One registered entity: queries that start from it, and changes to its records."""

    def __init__(self, name: str, entity: Entity, catalog: Catalog, store=None):
        self.name, self.entity, self.catalog, self.store = name, entity, catalog, store

    @property
    def record_type(self) -> str:
        return self.entity.record_type

    @property
    def metadata(self):
        return self.entity.schema

    def query(self) -> Query:
        return Query(self.entity, self.catalog)

    def all(self) -> list[dict]:
        return self.query().objects()

    def first(self) -> dict | None:
        return self.query().first()

    def where(self, name: str, op: str, value) -> Query:
        return self.query().where(name, op, value)

    def by_key(self, key) -> Query:
        primary = self.entity.primary()
        if primary is None:
            raise ValueError(f"No primary field is configured for '{self.entity.record_type}'.")
        return self.query().where(primary[0], "=", key)

    def find(self, key) -> dict | None:
        return self.by_key(key).first()

    def update(self, key):
        return Changes(self.entity, self.store).id(key)

    def submit_patch(self, key, patch: Mapping[str, Any]):
        """Errors in the patch itself are raised; those of planning and applying come back as a failed result."""
        return self.update(key).patch(patch).submit()

    submit = submit_patch


class Repository:
    """One entity, without a context."""

    def __init__(self, entity: Entity, catalog: Catalog, store=None):
        self.entity, self.catalog, self.store = entity, catalog, store

    def query(self) -> Query:
        return Query(self.entity, self.catalog)

    def update(self, key, patch: Mapping[str, Any] | None = None, **options):
        """Without a patch, the pending changes; with one, they are submitted."""
        changes = EntitySet("", self.entity, self.catalog, self.store).update(key)
        if options:
            changes.with_options(**options)
        return changes if patch is None else changes.patch(patch).submit()


class Context:
    """Entity sets as read-only properties."""

    def __init__(self, catalog: Catalog, schema: Mapping[str, Entity], stores: Mapping[str, Any] | None = None):
        sets = {n: EntitySet(n, e, catalog, (stores or {}).get(n)) for n, e in schema.items()}
        object.__setattr__(self, "_sets", sets)

    def __getattr__(self, name: str) -> EntitySet:
        try:
            return object.__getattribute__(self, "_sets")[name]
        except KeyError:
            raise AttributeError(f"Entity '{name}' is not registered in this context.") from None

    def __setattr__(self, name: str, value) -> None:
        raise AttributeError(f"'{name}' is read-only.")

    def __dir__(self):
        return [*super().__dir__(), *self._sets]

    @property
    def entities(self) -> list[str]:
        return list(self._sets)

    def has(self, name: str) -> bool:
        return name in self._sets

    def set(self, name: str) -> EntitySet:
        if name not in self._sets:
            raise KeyError(f"Entity '{name}' is not registered in this context.")
        return self._sets[name]

    def get_config(self, name: str) -> Entity:
        return self.set(name).entity


def create_context(catalog: Catalog, schema: Mapping[str, Entity], stores: Mapping[str, Any] | None = None) -> Context:
    return Context(catalog, schema, stores)


def repository(entity: Entity, catalog: Catalog, store=None) -> Repository:
    return Repository(entity, catalog, store)
