"""Registered queries of what has no rows of its own: resolution, checks, patches, plans and entry points, as tables of cases with what each gives.

A case's outcome is text, 'ok' or what it gives, or the error's message. The SQL lists what is expected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import examples as ex
from ferrule.context import create_context, repository
from ferrule.model import UNSET, ConfigError, FieldSchema, GroupSchema, Join, Lines, On, Owned, RecordSchema, Table, define_entity, make_field
from ferrule.operators.builder import Query, query, run_query
from ferrule.operators.changes import Changes, update_record
from ferrule.sources.scratch import shared_folder
from ferrule.sources.store import SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def outcome(make: Callable[[], Any]) -> str:
    try:
        got = make()
    except Exception as e:
        return str(e.args[0]) if e.args else type(e).__name__
    return "ok" if got is None else str(got)


def _cases(name: str, cases: Callable[[SparkSession, str], Mapping[str, Callable[[], Any]]], expected: Mapping[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, outcome(v)) for k, v in cases(spark, sf_dir).items()], "case_name string, outcome string")

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in expected.items()) + ") t(case_name, outcome)"


def _query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


f = ex.f

# values against what is known of their fields

SCHEMA = RecordSchema(
    "thing",
    {
        "word": FieldSchema("word", "string", min_length=2, max_length=4, pattern="b"),
        "state": FieldSchema("state", "string", enum=("new", "old", 7)),
        "score": FieldSchema("score", "float", minimum=0, maximum=100),
        "size": FieldSchema("size", "integer"),
        "price": FieldSchema("price", "currency"),
        "flag": FieldSchema("flag", "boolean"),
        "day": FieldSchema("day", "date"),
        "at": FieldSchema("at", "datetime"),
        "tags": FieldSchema("tags", "multiselect"),
        "who": FieldSchema("who", "reference"),
        "box": FieldSchema("box", "object"),
        "must": FieldSchema("must", "string", required=True, nullable=False),
        "may": FieldSchema("may", "string", required=True),
        "odd": FieldSchema("odd", "unknown", enum=("x",)),
        "shut": FieldSchema("shut", "string", writable=False),
        "part": FieldSchema("part", "subrecord"),
        "rows": FieldSchema("rows", "sublist"),
    },
    {"addr": GroupSchema("addr", clear_first="list_id", fields={"zip": FieldSchema("zip", "string", max_length=3), "city": FieldSchema("city", "string", max_length=5), "closed": FieldSchema("closed", writable=False)}), "sealed": GroupSchema("sealed", writable=False, fields={"x": FieldSchema("x", "string")})},
    {"items": GroupSchema("items", fields={"qty": FieldSchema("qty", "float", maximum=9)}), "locked": GroupSchema("locked", writable=False, fields={"qty": FieldSchema("qty", "float")})},
)
T0 = ("thing", "t")
#: Fields that the schema alone has, and configured ones of its groups.
thing = define_entity(
    "thing",
    T0,
    {
        "id": f("t", "id", primary=True, readonly=True),
        "zip": f("t", "zip", access="owned", access_id="addr"),
        "town": f("t", "town", record_field="city", access="owned", access_id="addr"),
        "closed": f("t", "closed", access="owned", access_id="addr"),
        "sealed_x": f("t", "x", access="owned", access_id="sealed"),
        "item_qty": f("t", "qty", type="float", access="lines", access_id="items"),
        "locked_qty": f("t", "qty", type="float", access="lines", access_id="locked"),
        "bare": f("t", "zip", access="owned"),
        "plain": f("t", "word"),
    },
    schema=SCHEMA,
)


def _values(kind: str, given: Mapping[str, tuple[str, Any]], expected: Mapping[str, str]) -> None:
    def cases(spark: SparkSession, sf_dir: str):
        # what comes out is the converted value that would be written
        return {n: lambda key=key, value=value: repr(Changes(thing).set(key, value).body[key].value) for n, (key, value) in given.items()}

    _cases(f"validate_{kind}", cases, expected)


META = "according to record metadata."
_values(
    "null",
    {"needed": ("must", None), "may be null": ("may", None), "nothing is set": ("must", UNSET), "given": ("must", "x"), "unknown kind": ("odd", "anything")},
    {"needed": f"Field 'must' is required and not nullable {META}", "may be null": "None", "nothing is set": "None", "given": "'x'", "unknown kind": "'anything'"},
)
_values("enum", {"same": ("state", "new"), "as text": ("state", "7"), "number": ("state", 7), "other": ("state", "x")}, {"same": "'new'", "as text": "'7'", "number": "7", "other": f"Field 'state' expects one of new, old, 7 {META}"})
_values(
    "text",
    {"fits": ("word", "abc"), "short": ("word", "b"), "long": ("word", "abcde"), "pattern": ("word", "aac")},
    {"fits": "'abc'", "short": f"Field 'word' expects at least 2 characters {META}", "long": f"Field 'word' expects no more than 4 characters {META}", "pattern": f"Field 'word' does not match the pattern {META}"},
)
_values(
    "number",
    {"number": ("score", 5), "text": ("score", " 7.5 "), "least": ("score", 0), "greatest": ("score", 100), "below": ("score", -1), "above": ("score", "100.1"), "blank": ("score", " "), "letters": ("score", "5x"), "truth": ("score", True), "integer text": ("size", "12"), "integer down": ("size", -1.5), "integer cut": ("size", "-1.5"), "currency": ("price", "9.99"), "underscore": ("size", "1_0"), "hex": ("size", "0x10")},
    {"number": "5", "text": "7.5", "least": "0", "greatest": "100", "below": f"Field 'score' expects a value greater than or equal to 0 {META}", "above": f"Field 'score' expects a value less than or equal to 100 {META}", "blank": f"Field 'score' expects a numeric value {META}", "letters": f"Field 'score' expects a numeric value {META}", "truth": f"Field 'score' expects a numeric value {META}", "integer text": "12", "integer down": "-2", "integer cut": "-1", "currency": "9.99", "underscore": f"Field 'size' expects a numeric value {META}", "hex": "0"},
)
_values("boolean", {"true": ("flag", True), "T": ("flag", "T"), "False": ("flag", "False"), "f": ("flag", "f"), "1": ("flag", 1), "yes": ("flag", "yes")}, {"true": "True", "T": "True", "False": "False", "f": "False", "1": f"Field 'flag' expects a boolean value {META}", "yes": f"Field 'flag' expects a boolean value {META}"})
_values(
    "date",
    {"date": ("day", dt.date(2024, 1, 2)), "iso": ("day", "2024-01-31"), "american": ("day", "1/2/2024"), "month name": ("day", "5 Jan 2024"), "words": ("day", "soon"), "blank": ("day", ""), "number": ("day", 5), "time": ("at", "2024-01-31T10:30:00")},
    {"date": "datetime.date(2024, 1, 2)", "iso": "datetime.date(2024, 1, 31)", "american": "datetime.date(2024, 1, 2)", "month name": "datetime.date(2024, 1, 5)", "words": f"Field 'day' expects a date value {META}", "blank": f"Field 'day' expects a date value {META}", "number": f"Field 'day' expects a date value {META}", "time": "datetime.datetime(2024, 1, 31, 10, 30)"},
)
_values("multiselect", {"list": ("tags", [1, "a"]), "text": ("tags", "a")}, {"list": "['1', 'a']", "text": f"Field 'tags' expects an array value {META}"})
_values(
    "reference",
    {"id": ("who", {"id": 5}), "external before name": ("who", {"refName": "n", "externalId": "e"}), "text": ("who", "12"), "number": ("who", 12), "other object": ("who", {"x": 1}), "list": ("who", [1])},
    {"id": "5", "external before name": "'e'", "text": "12", "number": "12", "other object": f"Field 'who' expects a record reference value {META}", "list": f"Field 'who' expects a record reference value {META}"},
)
_values("object", {"object": ("box", {"a": 1}), "list": ("box", [1]), "text": ("box", "a")}, {"object": "{'a': 1}", "list": "[1]", "text": f"Field 'box' expects an object value {META}"})

# where keys lead


def _target(c: Changes) -> str:
    """The pending edits as text: place.field=value, and what is cleared first."""
    parts = [f"{e.field_id}={e.value}" for e in c.body.values()]
    parts += [f"{i}.{e.field_id}={e.value}" for i, own in c.owned_edits.items() for e in own.values()]
    parts += [f"{x.lines}[{x.line if x.match is None else f'{x.match[0]}={x.match[1]}'}]:" + ",".join(f"{e.field_id}={e.value}" for e in x.edits) for x in c.line_changes]
    parts += [f"{x.lines}[+]:" + ",".join(f"{e.field_id}={e.value}" for e in x.edits) for x in c.line_adds]
    parts += [f"{x.lines}[-{x.line}]" for x in c.line_removes]
    return " ".join(parts + [f"clear {i}:{v}" for i, v in c.reloads.items()]) or "nothing"


def _targets(name: str, entity, cases: Mapping[str, Callable[[Changes], Any]], expected: Mapping[str, str]) -> None:
    _cases(name, lambda spark, sf_dir: {n: lambda act=act: _target(act(Changes(entity))) for n, act in cases.items()}, expected)


_targets(
    "resolve_fields",
    thing,
    {"configured": lambda c: c.set("plain", "ab"), "of the schema alone": lambda c: c.set("size", "5"), "nowhere": lambda c: c.set("nope", 1), "readonly": lambda c: c.set("id", 1), "subrecord kind": lambda c: c.set("part", {}), "sublist kind": lambda c: c.set("rows", []), "in lines": lambda c: c.add_line("items", {"qty": 1}), "not in these lines": lambda c: c.add_line("items", {"size": 1}), "no access id": lambda c: c.set("bare", "1")},
    {"configured": "word=ab", "of the schema alone": "size=5", "nowhere": "Field 'nope' is not defined in query config or record metadata for 'thing'.", "readonly": "Field 'id' is readonly.", "subrecord kind": "part.part={}", "sublist kind": "Field 'rows' belongs to a sublist. Use update_line() or add_line().", "in lines": "items[+]:qty=1", "not in these lines": "Field 'size' is not defined in query config or record metadata for 'thing'.", "no access id": "Field 'bare' has access 'owned' but no access id."},
)
_targets(
    "resolve_writable",
    thing,
    {"field shut": lambda c: c.set("shut", "x"), "field in sub-object": lambda c: c.set("closed", "x"), "sub-object": lambda c: c.set("sealed_x", "x"), "lines": lambda c: c.add_line("locked", {"locked_qty": 1}), "clears a list": lambda c: c.set("zip", "123")},
    {"field shut": "Field 'shut' is readonly.", "field in sub-object": f"Field 'closed' is not writable {META}", "sub-object": f"Subrecord 'sealed' is not writable {META}", "lines": f"Sublist 'locked' is not writable {META}", "clears a list": "addr.zip=123 clear addr:list_id"},
)
_targets(
    "resolve_schema_order",
    thing,
    {"nested by physical name": lambda c: c.set("town", "abcdef"), "nested by key": lambda c: c.set("zip", "1234"), "line by physical name": lambda c: c.add_line("items", {"item_qty": 10}), "body": lambda c: c.set("plain", "abcde")},
    {"nested by physical name": f"Field 'town' expects no more than 5 characters {META}", "nested by key": f"Field 'zip' expects no more than 3 characters {META}", "line by physical name": f"Field 'item_qty' expects a value less than or equal to 9 {META}", "body": f"Field 'plain' expects no more than 4 characters {META}"},
)
ruled = define_entity(
    "thing",
    T0,
    {
        "a": f("t", "a", update={"kind": "body", "field_id": "aa", "set_first": True}, access="owned", access_id="z"),
        "b": f("t", "b", update={"kind": "owned", "access_id": "sub", "clear_first": "list_id"}),
        "c": f("t", "c", update={"kind": "lines", "access_id": "rows", "field_id": "cc"}),
        "r": f("t", "r", update={"kind": "readonly"}),
        "d": f("t", "d", update={"kind": "derived", "reason": "summed"}),
        "e": f("t", "e", update={"kind": "external", "reason": "elsewhere"}),
        "o": f("t", "o", update={"kind": "related", "record_type": "person"}),
        "u": f("t", "u"),
    },
)
strict = define_entity("thing", T0, ruled.fields, explicit=True)
_targets(
    "update_rules",
    ruled,
    {"body": lambda c: c.set("a", 1), "owned": lambda c: c.set("b", 1), "lines": lambda c: c.update_line("rows", 0, {"c": 1}), "readonly": lambda c: c.set("r", 1), "derived": lambda c: c.set("d", 1), "external": lambda c: c.set("e", 1), "related": lambda c: c.set("o", 1), "none": lambda c: c.set("u", 1), "first reload wins": lambda c: c.with_reload("sub", "mine").set("b", 1)},
    {"body": "aa=1", "owned": "sub.b=1 clear sub:list_id", "lines": "rows[0]:cc=1", "readonly": "Field 'r' is readonly.", "derived": "Field 'd' is derived: summed", "external": "Field 'e' is external: elsewhere", "related": "Field 'o' maps to related record 'person'; update that record itself.", "none": "u=1", "first reload wins": "sub.b=1 clear sub:mine"},
)
EXPLICIT = "is not mapped in explicit composite config for 'thing'."
_targets(
    "explicit_composite",
    strict,
    {"has a rule": lambda c: c.set("a", 1), "has none": lambda c: c.set("u", 1), "unknown path": lambda c: c.patch({"x": {"y": 1}}), "unknown item": lambda c: c.patch({"x": [1]})},
    {"has a rule": "aa=1", "has none": "Field 'u' belongs to an explicit composite config and does not declare an update rule.", "unknown path": f"Patch path 'x.y' {EXPLICIT}", "unknown item": f"Patch path 'x.0' {EXPLICIT}"},
)

# patches

sale = define_entity(
    "sale",
    ("sale", "s"),
    {
        "id": f("s", "id", primary=True),
        "memo": f("s", "memo", type="string"),
        "ship_city": f("s", "city"),
        "deep": f("s", "deep", nest_path="x.y.z"),
        "sourced": f("s", "src", source={"kind": "recordField", "path": "m.*.k"}),
        "zip": f("s", "zip", nest_path="address.zip", access="owned", access_id="addr"),
        "city": f("s", "town", nest_path="address.city", access="owned", access_id="addr", set_first=True),
        "item": f("s", "item", type="key", nest_path="lines.item", update={"kind": "lines", "access_id": "rows", "match_by": "lines.item"}),
        "qty": f("s", "qty", type="float", nest_path="lines.qty", access="lines", access_id="rows"),
        "note": f("s", "note", nest_path="lines.note"),
        "one": f("s", "one", nest_path="both.one", access="lines", access_id="first"),
        "two": f("s", "two", nest_path="both.two", access="lines", access_id="second"),
        "free": f("s", "free", nest_path="loose.free", access="lines", access_id="loose"),
    },
    relationships={"address": Owned("addr", {"postal": "zip"}, clear_field="book"), "rows": Lines("rows", {"sku": "item", "n": "qty"}, match_field="sku")},
)
_targets(
    "patch_paths",
    sale,
    {"key": lambda c: c.patch({"memo": "a"}), "joined key": lambda c: c.patch({"ship": {"city": "b"}}), "path": lambda c: c.patch({"x": {"y": {"z": 1}}}), "dotted": lambda c: c.patch({"x.y.z": 1}), "through a list": lambda c: c.patch({"x": [{"y": {"z": 2}}]}), "star": lambda c: c.patch({"m": [{"k": 3}]}), "unknown below": lambda c: c.patch({"x": {"q": 1}, "memo": "a"}), "unknown at the top": lambda c: c.patch({"q": 1}), "nothing": lambda c: c.patch({"memo": UNSET}), "plain list": lambda c: c.patch({"tags": [1, 2]}), "set_many": lambda c: c.set_many({"memo": "a", "x": {"y": {"z": UNSET}}})},
    {"key": "memo=a", "joined key": "city=b", "path": "deep=1", "dotted": "deep=1", "through a list": "deep=2", "star": "src=3", "unknown below": "memo=a", "unknown at the top": "Field 'q' is not defined in query config or record metadata for 'sale'.", "nothing": "nothing", "plain list": "nothing", "set_many": "memo=a"},
)
NEEDS = "Sublist patch 'loose.0' needs a line number or a configured matchBy value for sublist 'loose'."
_targets(
    "patch_lists",
    sale,
    {"by match": lambda c: c.patch({"lines": [{"item": "5", "qty": 2}]}), "by number": lambda c: c.patch({"lines": [{"line": 1, "item": 5, "qty": 2}]}), "order of identities": lambda c: c.patch({"lines": [{"lineIndex": 3, "_line": "2", "qty": 1}]}), "not a number": lambda c: c.patch({"lines": [{"line": "x", "lineNumber": 4, "qty": 1}]}), "negative": lambda c: c.patch({"loose": [{"line": -1, "free": 1}]}), "nothing left": lambda c: c.patch({"lines": [{"item": 5}]}), "foreign field": lambda c: c.patch({"lines": [{"item": 5, "note": "x", "qty": 1}]}), "two lists": lambda c: c.patch({"both": [{"one": 1}]}), "no object": lambda c: c.patch({"lines": [5]}), "no identity": lambda c: c.patch({"loose": [{"free": 1}]}), "no match value": lambda c: c.patch({"lines": [{"qty": 1}]})},
    {"by match": "rows[item=5]:qty=2", "by number": "rows[1]:item=5,qty=2", "order of identities": "rows[2]:qty=1", "not a number": "rows[4]:qty=1", "negative": NEEDS, "nothing left": "nothing", "foreign field": "rows[item=5]:qty=1", "two lists": "Patch array 'both' maps to multiple sublists (first, second). Use an explicit collection patch.", "no object": "Patch path 'lines.0' must be an object to update sublist 'rows'.", "no identity": NEEDS, "no match value": "Sublist patch 'lines' is missing matchBy value 'lines.item' for sublist 'rows'."},
)
_targets(
    "patch_relationships",
    sale,
    {"owned": lambda c: c.patch({"address": {"postal": "1", "city": "a"}}), "owned needs an object": lambda c: c.patch({"address": 5}), "unknown owned field": lambda c: c.patch({"address": {"planet": 1}}), "rows after relationships": lambda c: c.patch({"memo": "m", "address": {"zip": "2"}}), "collection": lambda c: c.patch({"rows": {"remove": [3], "add": [{"n": 1}], "update": [{"line": 0, "values": {"n": 2}}, {"updates": {"sku": 7, "n": 3}}, {"match": {"field": "n", "value": 4}, "values": {"sku": 8}}]}}), "collection needs an object": lambda c: c.patch({"rows": []}), "no values": lambda c: c.patch({"rows": {"update": [{"line": 0}]}}), "no line": lambda c: c.patch({"rows": {"update": [{"values": {"n": 1}}]}})},
    {"owned": "addr.zip=1 addr.town=a clear addr:book", "owned needs an object": "Owned relationship 'address' expects an object patch.", "unknown owned field": "Field 'planet' is not mapped on relationship 'address' for 'sale'.", "rows after relationships": "memo=m addr.zip=2 clear addr:book", "collection": "rows[0]:qty=2 rows[item=7]:item=7,qty=3 rows[qty=4]:item=8 rows[+]:qty=1 rows[-3]", "collection needs an object": "Collection relationship 'rows' expects a collection patch object.", "no values": "Collection relationship 'rows' update requires values or updates.", "no line": "Collection relationship 'rows' update requires line or match."},
)
_targets(
    "relationship_flattening",
    sale,
    {"many": lambda c: c.owned("address").set_many({"postal": "1", "city": UNSET}).end(), "line": lambda c: c.collection("rows").add_line({"sku": "5"}).update_lines([(0, {"n": 1}), (2, {"n": 2})]).remove_line(1).end(), "by field": lambda c: c.collection("rows").update_line_by("sku", "9", {"n": 1}).end(), "nested": lambda c: c.collection("rows").add_line({"n": {"x": 1}}).end(), "not owned": lambda c: c.owned("rows"), "not a collection": lambda c: c.collection("address"), "unknown": lambda c: c.owned("nope")},
    {"many": "addr.zip=1 clear addr:book", "line": "rows[0]:qty=1 rows[2]:qty=2 rows[+]:item=5 rows[-1]", "by field": "rows[item=9]:qty=1", "nested": "Field 'n_x' is not mapped on relationship 'rows' for 'sale'.", "not owned": "Relationship 'rows' is not an owned subrecord relationship.", "not a collection": "Relationship 'address' is not a collection relationship.", "unknown": "Relationship 'nope' is not defined in query config for 'sale'."},
)

# plans


def _steps(c: Changes) -> str:
    def step(o: dict) -> str:
        fields = ",".join(x["field"] for x in o.get("fields", ()))
        at = o.get("lines") or o.get("access_id") or ""
        place = o["line"] if o.get("line") is not None else o.get("match") or ""
        return " ".join(str(x) for x in (o["kind"], at, place, fields) if x != "")

    return "; ".join(step(o) for o in c.plan().operations) or "nothing"


def _plan_cases(spark: SparkSession, sf_dir: str):
    full = lambda: Changes(sale).id(1).patch({"memo": "m", "address": {"zip": "1", "city": "a"}, "rows": {"remove": [1, 4, 2], "add": [{"n": 1}], "update": [{"line": 0, "values": {"n": 2}}, {"values": {"sku": 7, "n": 3}}]}})
    return {
        "nothing": lambda: _steps(Changes(sale).id(1)),
        "body": lambda: _steps(Changes(sale).id(1).set("memo", "a").set("deep", 1).set("memo", "b")),
        "all, set_first first": lambda: _steps(full()),
        "pending": lambda: full().pending(),
        "cleared": lambda: (full().clear().pending(), full().clear().reloads),
        "details": lambda: full().plan().details,
        "notes": lambda: len(full().plan().notes),
        "calls of each kind": lambda: [(p.calls, p.submits, p.loads, p.saves) for p in (c.plan() for c in (Changes(sale), Changes(sale).set("memo", "a"), full()))],
        "options": lambda: Changes(sale).id(1).dynamic().with_options(enable_sourcing=True).add_line("rows", {"qty": 1}).plan().operations[0]["dynamic"],
        "first set loses to a later one": lambda: [e.value for e in Changes(define_entity("p", T0, {"a": f("t", "x"), "b": f("t", "x", set_first=True)})).set("a", 1).set("b", 2).body.values()],
    }


_cases(
    "plan_steps",
    _plan_cases,
    {
        "nothing": "nothing",
        "body": "submit_fields memo,deep",
        "all, set_first first": "load; body memo; remove_line rows 4; remove_line rows 2; remove_line rows 1; update_line rows 0 qty; update_line rows ('item', 7) item,qty; add_line rows qty; owned addr town,zip; save",
        "pending": "9",
        "cleared": "(0, {})",
        "details": "Details(body_fields=1, owned_objects=1, lines_updated=2, lines_added=1, lines_removed=3)",
        "notes": "3",
        "calls of each kind": "[(0, 0, 0, 0), (1, 1, 0, 0), (4, 0, 2, 2)]",
        "options": "True",
        "first set loses to a later one": "[1, 2]",
    },
)

# submitting through a store of files


def customer_store(spark: SparkSession, folder: str) -> SnapshotStore:
    return SnapshotStore(spark, shared_folder(spark, "customers"), "c_custkey", buckets=4).create(ex.customer_rows(spark, folder))


def _submits(spark: SparkSession, sf_dir: str):
    store = customer_store(spark, sf_dir)
    db = create_context(ex.catalog(spark, sf_dir), {"customers": ex.customer_record}, {"customers": store})
    repo = repository(ex.customer_record, ex.catalog(spark, sf_dir), store)
    told = lambda r: (r.success, r.id, r.details.body_fields, r.error)
    return {
        "by the context": lambda: told(db.customers.submit_patch(7, {"name": "A"})),
        "submit is the same": lambda: told(db.customers.submit(8, {"balance": "2.5"})),
        "by the repository": lambda: told(repo.update(9, {"name": "C"}, require_fast_path=True)),
        "pending only": lambda: repo.update(9).set("name", "D").pending(),
        "options first": lambda: told(repo.update(9, {"nation": {"name": "x"}}, require_fast_path=True)),
        "errors of the patch are raised": lambda: db.customers.submit_patch(7, {"id": 1}),
        "text ids": lambda: told(update_record(ex.customer_record, store).id("10").submit()),
        "no id": lambda: told(update_record(ex.customer_record, store).set("name", "x").submit()),
        "no record": lambda: told(db.customers.submit_patch(-5, {"name": "x"})),
        "snapshots": lambda: store.version(),
        "read back": lambda: [store.load(k)["c_name"] for k in (7, 9)] + [store.load(8)["c_acctbal"]],
    }


_cases(
    "submit_results",
    _submits,
    {
        "by the context": "(True, 7, 1, None)",
        "submit is the same": "(True, 8, 1, None)",
        "by the repository": "(True, 9, 1, None)",
        "pending only": "1",
        "options first": "(False, None, 0, \"Update guardrail rejected customer update: requires fast path but planned execution is 'load_save'.\")",
        "errors of the patch are raised": "Field 'id' is readonly.",
        "text ids": "(True, 10, 0, None)",
        "no id": "(False, None, 0, 'Record ID is not set. Call id() before submit().')",
        "no record": "(False, None, 0, \"Record '-5' does not exist.\")",
        "snapshots": "3",
        "read back": "['A', 'C', 2.5]",
    },
)


@_query("store_point_read", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7)")
def _point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = customer_store(spark, sf_dir)
    return spark.createDataFrame([(r["c_custkey"], r["c_name"]) for r in (store.load(k) for k in (1, 7))], "c_custkey long, c_name string")


# entry points

CUSTOMER = 'c_custkey AS "id", c_name AS "name", c_mktsegment AS "segment", c_acctbal AS "balance"'


def _context(spark: SparkSession, sf_dir: str):
    return create_context(ex.catalog(spark, sf_dir), {"customers": ex.customer, "flags": _keyless})


_keyless = define_entity("segment", ex.CUSTOMERS, {"segment": f("c", "c_mktsegment")})
_OBJECTS = "id long, name string, segment string, balance double"
_query("context_where", f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 5000")(lambda spark, d: _context(spark, d).customers.where("balance", ">", 5000.0).to_df())
_query("context_query", f"SELECT {CUSTOMER} FROM customer ORDER BY c_custkey LIMIT 5")(lambda spark, d: _context(spark, d).set("customers").query().order_by("id").limit(5).to_df())
_query("context_find", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey IN (3, 4)")(lambda spark, d: spark.createDataFrame([_context(spark, d).customers.find(k) for k in (3, 4)], _OBJECTS))
_query("context_all", f"SELECT {CUSTOMER} FROM customer")(lambda spark, d: spark.createDataFrame(_context(spark, d).customers.all(), _OBJECTS))
_query("repository_query", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey < 9")(lambda spark, d: repository(ex.customer, ex.catalog(spark, d)).query().where("id", "<", 9).to_df())
_query("run_query", 'SELECT n_nationkey AS "id", lower(n_name) AS "name", n_name || \'#\' || n_nationkey AS "label" FROM nation')(lambda spark, d: spark.createDataFrame(run_query(ex.upper, ex.catalog(spark, d)), "id int, name string, label string"))


def _context_cases(spark: SparkSession, sf_dir: str):
    db = _context(spark, sf_dir)
    return {
        "entities": lambda: db.entities,
        "has": lambda: (db.has("customers"), db.has("x")),
        "config is the same object": lambda: db.get_config("customers") is ex.customer,
        "set of unknown": lambda: db.set("x"),
        "property of unknown": lambda: db.x,
        "read-only": lambda: setattr(db, "customers", 1),
        "listed": lambda: "customers" in dir(db),
        "record type": lambda: (db.customers.record_type, db.customers.metadata),
        "first": lambda: sorted(db.customers.first()),
        "find without a primary field": lambda: db.flags.find(1),
        "find of nothing": lambda: db.customers.find(-1) is None,
    }


_cases(
    "context_registry",
    _context_cases,
    {"entities": "['customers', 'flags']", "has": "(True, False)", "config is the same object": "True", "set of unknown": "Entity 'x' is not registered in this context.", "property of unknown": "Entity 'x' is not registered in this context.", "read-only": "'customers' is read-only.", "listed": "True", "record type": "('customer', None)", "first": "['balance', 'id', 'name', 'segment']", "find without a primary field": "No primary field is configured for 'segment'.", "find of nothing": "True"},
)


def _config_cases(spark: SparkSession, sf_dir: str):
    sections = {"query": {"table": "t", "column": "a", "alias": "x"}, "common": {"alias": "y", "type": "string"}, "record": {"type": "integer"}}
    return {
        "later sections win": lambda: [getattr(make_field(sections), k) for k in ("column", "alias", "type")],
        "plain": lambda: make_field({"table": "t", "column": "a"}).record_column,
        "source": lambda: [getattr(make_field({"table": "t", "column": "a", "source": {"kind": "joinedRecordField", "path": "x.y", "record_type": "r", "table": "j", "field_id": "f", "description": "d"}}).source, k) for k in ("kind", "path", "record_type", "table", "field_id", "description")],
        "unknown property": lambda: make_field({"table": "t", "column": "a", "colour": 1}),
        "same output names": lambda: define_entity("e", T0, {"a": f("t", "a"), "A": f("t", "b")}),
        "unknown type": lambda: define_entity("e", T0, {"a": f("t", "a", type="colour")}),
        "join without constraints": lambda: Join(Table("x", "x"), "t", []),
        "kept as given": lambda: define_entity("e", T0, {"a": make_field(f("t", "a"))}).fields["a"].column,
        "config error": lambda: issubclass(ConfigError, ValueError),
    }


_cases(
    "config_sections",
    _config_cases,
    {"later sections win": "['a', 'y', 'integer']", "plain": "a", "source": "['joinedRecordField', 'x.y', 'r', 'j', 'f', 'd']", "unknown property": "Unknown field properties: colour.", "same output names": "Fields 'a' and 'A' of 'e' have the same output name.", "unknown type": "Field 'a' has the unknown type 'colour'.", "join without constraints": "Join to 'x' has no constraints.", "kept as given": "a", "config error": "True"},
)


def _text_cases(spark: SparkSession, sf_dir: str):
    q = lambda entity=ex.customer: query(entity, ex.catalog(spark, sf_dir))
    hidden = define_entity("e", ex.CUSTOMERS, {"a": f("c", "c_name", select=False)})
    return {
        "to_sql": lambda: q().select("name").where("id", "IN", [1, 2]).or_where("name", "=", "o'x").order_by_desc("id").limit(2.9).offset(-1).to_sql().replace("\n", " | "),
        "null and truth": lambda: q().select().where("id", "=", None).where("name", "!=", True).to_sql().replace("\n", " | "),
        "build": lambda: (list(q().select("name").compile().outputs), q().where("id", ">", 3).compile().args),
        "unknown field": lambda: q().where("nope", "=", 1),
        "unknown sort": lambda: q().order_by("nope"),
        "unknown but unset": lambda: q().where("nope", "=", UNSET).compile().args,
        "list to =": lambda: q().where("id", "=", [1]),
        "IN of nothing": lambda: q().where("id", "IN", []),
        "BETWEEN of one": lambda: q().where("id", "BETWEEN", [1]),
        "empty projection": lambda: q(hidden).to_sql(),
        "display text in raw": lambda: q().where_raw("BUILTIN.DF(c.c_name) = 'x'"),
    }


_FROM = "FROM customer c"
_cases(
    "sql_text",
    _text_cases,
    {
        "to_sql": f"SELECT c.c_custkey AS `id`, c.c_name AS `name` | {_FROM} | WHERE c.c_custkey IN (1, 2) OR c.c_name = 'o''x' | ORDER BY c.c_custkey DESC NULLS LAST | LIMIT 2",
        "null and truth": f"SELECT c.c_custkey AS `id` | {_FROM} | WHERE c.c_custkey = NULL AND c.c_name != true",
        "build": "(['id', 'name'], [3])",
        "unknown field": "Field 'nope' is not defined in query config for 'customer'.",
        "unknown sort": "Field 'nope' is not defined in query config for 'customer'.",
        "unknown but unset": "[]",
        "list to =": "= does not accept an array value.",
        "IN of nothing": "IN requires at least one value.",
        "BETWEEN of one": "BETWEEN requires exactly two values.",
        "empty projection": "At least one selectable field is required.",
        "display text in raw": "Raw SQL cannot call BUILTIN.DF; use use_text=True.",
    },
)

# pages, hooks, rows of the caller's own

ORDER = 'o_orderkey AS "id", o_totalprice AS "total"'


@_query("paged_rows", f"SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 400 AS page, {ORDER} FROM orders")
def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Query(ex.order, ex.catalog(spark, sf_dir)).select("total").order_by_desc("total").order_by("id").pages(400)
    return pages.to_df().drop("row")


@_query("paged_keeps_offset_rows", f"SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 4 AS page, {ORDER} FROM orders ORDER BY o_orderkey LIMIT 6")
def _paged_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Query(ex.order, ex.catalog(spark, sf_dir)).select("total").order_by("id").limit(4).offset(2).pages(4)
    rows = [(k, r["id"], r["total"]) for k, page in enumerate(pages) for r in page]
    pages.close()
    return spark.createDataFrame(rows, "page long, id long, total double")


def _shout(obj: dict) -> dict | None:
    return None if obj["id"] % 2 else obj | {"name": obj["name"].upper() + "!"}


@_query("post_process", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation")
def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = define_entity("nation", Table("nation", "n"), {"id": f("n", "n_nationkey", primary=True), "name": f("n", "n_name")}, post_process=_shout)
    return spark.createDataFrame(Query(e, ex.catalog(spark, sf_dir)).objects(), "id int, name string")


@_query("map_own_rows", "SELECT l_orderkey AS id, count(DISTINCT (l_linenumber, l_partkey)) AS n FROM lineitem GROUP BY 1")
def _own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ex.catalog(spark, sf_dir)
    flat = c.table("lineitem").select(F.col("l_orderkey").alias("ID"), F.col("l_linenumber").alias("lineNo"), F.col("l_partkey").alias("part"))
    return Query(ex.order_lines(), c).map_rows(flat).select("id", F.size("lines").cast("long").alias("n"))


_many = define_entity("order", ex.ORDERS, {"id": f("o", "o_orderkey", primary=True), "x": f("o", "o_orderstatus", nest_path="a"), "y": f("o", "o_orderpriority", nest_path="a.b")})
_query("nest_path_overwritten", "SELECT o_orderkey AS id, o_orderpriority AS b FROM orders")(lambda spark, d: Query(_many, ex.catalog(spark, d)).nested().select("id", F.col("a.b").alias("b")))


@_query("join_multi_as_given", 'SELECT l.l_orderkey AS "id", count(*) AS n FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber GROUP BY 1')
def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = define_entity("line", ex.LINES, {"id": f("l", "l_orderkey", primary=True), "part": f("m", "l_partkey")}, [Join(Table("lineitem", "m"), "l", [On("l_orderkey", "l_orderkey"), On("l_linenumber", "l_linenumber")])])
    return Query(e, ex.catalog(spark, sf_dir)).to_df().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
