"""Entities over the test tables, shared by the registered queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ferrule.model import Entity, Join, Lines, On, Owned, Table, define_entity
from ferrule.sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "conversations")


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """One for each session and folder, so files are looked at once."""
    at = spark.sparkContext.applicationId, folder
    if at not in _CATALOGS:
        c = Catalog(spark).add_parquet(folder, *TABLES)
        _CATALOGS[at] = c.add_display("customer", "c_nationkey", "nation", "n_nationkey", "n_name").add_display("nation", "n_regionkey", "region", "r_regionkey", "r_name")
    return _CATALOGS[at]


def f(table: str, column: str, **rest) -> dict:
    return {"table": table, "column": column} | rest


ORDERS, LINES, CUSTOMERS = Table("orders", "o"), Table("lineitem", "l"), Table("customer", "c")
TO_LINES = Join(LINES, "o", [On("o_orderkey", "l_orderkey")], "left_outer")
TO_CUSTOMER = Join(CUSTOMERS, "o", [On("o_custkey", "c_custkey")])

customer = define_entity(
    "customer",
    CUSTOMERS,
    {"id": f("c", "c_custkey", type="integer", primary=True), "name": f("c", "c_name"), "segment": f("c", "c_mktsegment"), "balance": f("c", "c_acctbal", type="float"), "nationKey": f("c", "c_nationkey", type="key", select=False)},
)
customer_shown = define_entity(
    "customer", CUSTOMERS, {"id": f("c", "c_custkey", primary=True), "name": f("c", "c_name", alias="customerName"), "nation": f("c", "c_nationkey", use_text=True), "segment": f("c", "c_mktsegment"), "code": f("c", "c_nationkey")}
)
order = define_entity(
    "order", ORDERS, {"id": f("o", "o_orderkey", primary=True), "customer": f("o", "o_custkey"), "status": f("o", "o_orderstatus"), "total": f("o", "o_totalprice"), "priority": f("o", "o_orderpriority"), "placed": f("o", "o_orderdate")}
)


def order_lines(kind: str = "left_outer", **extra: dict) -> Entity:
    join = Join(LINES, "o", [On("o_orderkey", "l_orderkey")], kind)
    fields = {"id": f("o", "o_orderkey", primary=True), "status": f("o", "o_orderstatus"), "total": f("o", "o_totalprice")}
    lines = {"lineNo": f("l", "l_linenumber", nest_path="lines.number", many=True), "part": f("l", "l_partkey", nest_path="lines.part", many=True), "qty": f("l", "l_quantity", nest_path="lines.qty", many=True)}
    return define_entity("order", ORDERS, fields | lines | extra, [join])


order_flags = define_entity("order", ORDERS, {"id": f("o", "o_orderkey", primary=True), "status": f("o", "o_orderstatus"), "flag": f("l", "l_returnflag", nest_path="flags.flag", many=True)}, [TO_LINES])
order_two = define_entity(
    "order", ORDERS, {"id": f("o", "o_orderkey", primary=True), "flag": f("l", "l_returnflag", nest_path="flags.flag", many=True), "mode": f("l", "l_linestatus", nest_path="modes.mode", many=True)}, [TO_LINES]
)
#: Lines are the driving side; orders without lines have a null line key.
line_orders = define_entity("line", LINES, {"id": f("l", "l_orderkey", primary=True), "status": f("o", "o_orderstatus"), "part": f("l", "l_partkey", nest_path="parts.key", many=True)}, [Join(ORDERS, "l", [On("l_orderkey", "o_orderkey")], "right_outer")])
customer_orders = define_entity(
    "customer", CUSTOMERS, {"id": f("c", "c_custkey", primary=True), "name": f("c", "c_name"), "order": f("o", "o_orderkey"), "total": f("o", "o_totalprice")}, [Join(ORDERS, "c", [On("c_custkey", "o_custkey")])]
)
chain = define_entity(
    "order",
    ORDERS,
    {"id": f("o", "o_orderkey", primary=True), "customer": f("c", "c_name"), "nation": f("n", "n_name"), "region": f("r", "r_name")},
    [TO_CUSTOMER, Join(Table("nation", "n"), "c", [On("c_nationkey", "n_nationkey")]), Join(Table("region", "r"), "n", [On("n_regionkey", "r_regionkey")])],
)
customer_owned = define_entity(
    "customer",
    CUSTOMERS,
    {"id": f("c", "c_custkey", primary=True), "name": f("c", "c_name"), "nationName": f("n", "n_name", nest_path="nation.name"), "regionKey": f("n", "n_regionkey", nest_path="nation.region.key")},
    [Join(Table("nation", "n"), "c", [On("c_nationkey", "n_nationkey")], "left_outer")],
)
upper = define_entity(
    "nation",
    Table("nation", "n"),
    {
        "id": f("n", "n_nationkey", primary=True),
        "name": f("n", "n_name", transform=lambda v, row: F.lower(v)),
        "label": f("n", "n_name", alias="tagged", transform=lambda v, row: F.concat(v, F.lit("#"), row("id").cast("string"))),
    },
)


# records for the write side: customers with their nation as a sub-object, orders with their lines

customer_record = define_entity(
    "customer",
    CUSTOMERS,
    {"id": f("c", "c_custkey", primary=True, readonly=True), "name": f("c", "c_name", type="string"), "balance": f("c", "c_acctbal", type="float"), "nation_name": f("c", "name", nest_path="nation.name", access="owned", access_id="nation"), "nation_region": f("c", "region", type="integer", nest_path="nation.region", access="owned", access_id="nation")},
    relationships={"nation": Owned("nation", clear_field="c_mktsegment")},
)
order_record = define_entity(
    "order",
    ORDERS,
    {
        "id": f("o", "o_orderkey", primary=True),
        "status": f("o", "o_orderstatus", type="string"),
        "lines_part": f("l", "part", type="key", nest_path="lines.part", many=True, access="lines", access_id="item", update={"kind": "lines", "access_id": "item", "match_by": "lines.part"}),
        "lines_qty": f("l", "qty", type="float", nest_path="lines.qty", many=True, access="lines", access_id="item"),
    },
    relationships={"lines": Lines("item", match_field="part")},
)


def customer_rows(spark: SparkSession, folder: str):
    c = catalog(spark, folder)
    return c.table("customer").join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))


def order_rows(spark: SparkSession, folder: str):
    """Orders that have lines, with these in the order of part, quantity and line number."""
    c = catalog(spark, folder)
    lines = c.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_linenumber").alias("number")))).alias("item"))
    return c.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "item")
