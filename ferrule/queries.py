"""The registered queries of the entity engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import examples as ex
from ferrule.model import UNSET, Join, On, Table, define_entity
from ferrule.operators.builder import Query
from ferrule.operators.changes import Changes
from ferrule.sources.scratch import shared_folder
from ferrule.sources.store import FrameStore, SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, entity, build: Callable[[Query], Query | DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = build(Query(entity, ex.catalog(spark, sf_dir)))
        return got.to_df() if isinstance(got, Query) else got

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _lines(df: DataFrame, array: str, *keep: str, **item: str) -> DataFrame:
    """An array's items as rows with their places; entities without items have one row of nulls."""
    return df.select(*keep, F.posexplode_outer(array).alias("pos", "item")).select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col(f"item.{v}").alias(k) for k, v in item.items()])


CUSTOMER = 'c_custkey AS "id", c_name AS "name", c_mktsegment AS "segment", c_acctbal AS "balance"'
ORDER = 'o_orderkey AS "id", o_custkey AS "customer", o_orderstatus AS "status", o_totalprice AS "total", o_orderpriority AS "priority", o_orderdate AS "placed"'

# projection

_add("scan_project", f"SELECT {CUSTOMER} FROM customer", ex.customer, lambda q: q)
_add("select_subset", 'SELECT c_custkey AS "id", c_acctbal AS "balance" FROM customer', ex.customer, lambda q: q.select("balance", "unknown"))
_add("select_nothing", 'SELECT c_custkey AS "id" FROM customer', ex.customer, lambda q: q.select())
_add("select_all_again", f"SELECT {CUSTOMER} FROM customer", ex.customer, lambda q: q.select("name").select_all())
_add("hidden_field", 'SELECT c_custkey AS "id", c_nationkey AS "nationKey" FROM customer', ex.customer, lambda q: q.select("nationKey"))
_add("alias_output", 'SELECT c_custkey AS "id", c_name AS "customerName" FROM customer', ex.customer_shown, lambda q: q.select("name"))

segments = define_entity("segment", ex.CUSTOMERS, {"segment": ex.f("c", "c_mktsegment"), "nation": ex.f("c", "c_nationkey")})
_add("select_distinct", 'SELECT DISTINCT c_mktsegment AS "segment", c_nationkey AS "nation" FROM customer', segments, lambda q: q.distinct())
_add("distinct_ordered", 'SELECT DISTINCT c_mktsegment AS "segment" FROM customer ORDER BY 1 DESC LIMIT 3', segments, lambda q: q.select("segment").distinct().order_by_desc("segment").limit(3))

# predicates

for name, op, sign, value in (("eq", "=", "=", 35), ("ne", "!=", "<>", 35), ("ne_angle", "<>", "<>", 35), ("gt", ">", ">", 1000), ("ge", ">=", ">=", 1000), ("lt", "<", "<", 40), ("le", "<=", "<=", 40)):
    _add(f"cmp_{name}", f"SELECT {ORDER} FROM orders WHERE o_orderkey {sign} {value}", ex.order, lambda q, op=op, value=value: q.where("id", op, value))
_add("like", f"SELECT {ORDER} FROM orders WHERE o_orderpriority LIKE '%U%'", ex.order, lambda q: q.where("priority", "LIKE", "%U%"))
_add("not_like", f"SELECT {ORDER} FROM orders WHERE o_orderpriority NOT LIKE '1%'", ex.order, lambda q: q.where("priority", "NOT LIKE", "1%"))
_add("in_list", f"SELECT {ORDER} FROM orders WHERE o_orderstatus IN ('F', 'P')", ex.order, lambda q: q.where_in("status", ["F", "P"]))
_add("not_in_list", f"SELECT {ORDER} FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", ex.order, lambda q: q.where_not_in("status", ["F", "P"]))
_add("between", f"SELECT {ORDER} FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000", ex.order, lambda q: q.where_between("total", 1000.0, 90000.0))
LEFT = 'SELECT o_orderkey AS "id", o_orderstatus AS "status", o_totalprice AS "total", l_linenumber AS "lineNo", l_partkey AS "part", l_quantity AS "qty" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey'
_add("is_null", f"{LEFT} WHERE l_partkey IS NULL", ex.order_lines(), lambda q: q.where_null("part"))
_add("is_not_null", f"{LEFT} WHERE l_partkey IS NOT NULL", ex.order_lines(), lambda q: q.where_not_null("part"))
_add("skip_undefined", f"SELECT {ORDER} FROM orders", ex.order, lambda q: q.where("status", "=", UNSET).where("nowhere", "=", UNSET).where_between("total", 1, UNSET))
_add("empty_in_skipped", f"SELECT {ORDER} FROM orders", ex.order, lambda q: q.where_in("status", []).where_not_in("status", UNSET).where_group(lambda g: None))
_add("null_param", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = NULL", ex.order, lambda q: q.where("status", "=", None))
_add("or_precedence", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW' AND o_totalprice > 50000", ex.order, lambda q: q.where("status", "=", "F").or_where("priority", "=", "5-LOW").where("total", ">", 50000.0))
_add("leading_or", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000", ex.order, lambda q: q.or_where("status", "=", "F").where("total", ">", 50000.0))
_add("where_group", f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 50000", ex.order, lambda q: q.where_group(lambda g: g.where("status", "=", "F").or_where("status", "=", "P")).where("total", ">", 50000.0))
_add("or_where_group", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 9 OR (o_orderstatus = 'P' AND o_totalprice > 50000)", ex.order, lambda q: q.where("id", "<", 9).or_where_group(lambda g: g.where("status", "=", "P").where("total", ">", 50000.0)))
_add("nested_group", f"SELECT {ORDER} FROM orders WHERE (o_orderkey < 99 AND (o_orderstatus = 'P' OR o_totalprice > 50000))", ex.order, lambda q: q.where_group(lambda g: g.where("id", "<", 99).where_group(lambda h: h.where("status", "=", "P").or_where("total", ">", 50000.0))))
RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"
_add("where_raw_subquery", f"SELECT {ORDER} FROM orders WHERE o_custkey IN ({RICH})", ex.order, lambda q: q.where_raw("o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > ?)", 5000))
_add("where_raw_not_in", f"SELECT {ORDER} FROM orders WHERE o_custkey NOT IN ({RICH})", ex.order, lambda q: q.where_raw("o.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > ?)", 5000))
_add("where_raw_exists", f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", ex.order, lambda q: q.where_raw("EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey AND x.l_quantity > ?)", 45))
_add("or_where_raw", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 9 OR length(o_orderpriority) = 5", ex.order, lambda q: q.where("id", "<", 9).or_where_raw("length(o.o_orderpriority) = ?", 5))

# joins

_add("join_left", LEFT, ex.order_lines(), lambda q: q)
_add("join_inner", LEFT.replace("LEFT JOIN", "JOIN"), ex.order_lines("inner"), lambda q: q)
_add("join_unknown_kind_is_inner", LEFT.replace("LEFT JOIN", "JOIN"), ex.order_lines("something"), lambda q: q)
_add("join_right", 'SELECT l_orderkey AS "id", o_orderstatus AS "status", l_partkey AS "part" FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey', ex.line_orders, lambda q: q)
multi = define_entity("line", ex.LINES, {"id": ex.f("l", "l_orderkey", primary=True), "part": ex.f("m", "l_partkey")}, [Join(Table("lineitem", "m"), "l", [On("l_orderkey", "l_orderkey"), On("l_linenumber", "l_linenumber")])])
_add("join_multi_key", 'SELECT l.l_orderkey AS "id", m.l_partkey AS "part" FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber', multi, lambda q: q)
either = define_entity("nation", Table("nation", "n"), {"id": ex.f("n", "n_nationkey", primary=True), "other": ex.f("m", "n_name")}, [Join(Table("nation", "m"), "n", [On("n_nationkey", "n_nationkey"), On("n_regionkey", "n_regionkey", link="OR")])])
_add("join_or_key", 'SELECT n.n_nationkey AS "id", m.n_name AS "other" FROM nation n JOIN nation m ON n.n_nationkey = m.n_nationkey OR n.n_regionkey = m.n_regionkey', either, lambda q: q)
_add("join_chain3", 'SELECT o_orderkey AS "id", c_name AS "customer", n_name AS "nation", r_name AS "region" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey', ex.chain, lambda q: q)
peers = define_entity("nation", Table("nation", "n"), {"id": ex.f("n", "n_nationkey", primary=True), "peer": ex.f("p", "n_name")}, [Join(Table("nation", "p"), "n", [On("n_regionkey", "n_regionkey")])])
_add("self_join", 'SELECT n.n_nationkey AS "id", p.n_name AS "peer" FROM nation n JOIN nation p ON n.n_regionkey = p.n_regionkey', peers, lambda q: q)
_add("unselected_join_kept", 'SELECT o_orderkey AS "id" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey', ex.order_lines(), lambda q: q.select())

# display texts

_add("display_text_select", 'SELECT c_custkey AS "id", n_name AS "nation" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey', ex.customer_shown, lambda q: q.select("nation"))
_add("display_text_where", "SELECT c_custkey AS \"id\", c_nationkey AS \"code\" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%A%'", ex.customer_shown, lambda q: q.select("code").where("code", "LIKE", "%A%", use_text=True))
_add("display_sorts_by_code", 'SELECT c_custkey AS "id", n_name AS "nation" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY c_nationkey, c_custkey LIMIT 20', ex.customer_shown, lambda q: q.select("nation").order_by("nation").order_by("id").limit(20))
_add("display_unregistered", 'SELECT o_orderkey AS "id", CAST(o_custkey AS VARCHAR) AS "who" FROM orders', define_entity("order", ex.ORDERS, {"id": ex.f("o", "o_orderkey", primary=True), "who": ex.f("o", "o_custkey", use_text=True)}), lambda q: q)

# order and extent

TOP = f"SELECT {ORDER} FROM orders ORDER BY o_totalprice DESC, o_orderkey"
_add("order_multi", f"{TOP} LIMIT 100", ex.order, lambda q: q.order_by_desc("total").order_by_asc("id").limit(100.7))
_add("top_n", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ex.order, lambda q: q.where("status", "=", "F").order_by_desc("total").order_by("id").limit(25))
_add("offset_only", f"{TOP} OFFSET 100", ex.order, lambda q: q.order_by_desc("total").order_by("id").offset(100))
_add("limit_offset", f"{TOP} LIMIT 10 OFFSET 5", ex.order, lambda q: q.order_by_desc("total").order_by("id").limit(10).offset(5))
_add("page_3", f"{TOP} LIMIT 20 OFFSET 40", ex.order, lambda q: q.order_by_desc("total").order_by("id").page(3, 20))
_add("page_clamped", f"{TOP} LIMIT 1", ex.order, lambda q: q.order_by_desc("total").order_by("id").page(-2, 0))
_add("order_by_unselected", 'SELECT o_orderkey AS "id" FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7', ex.order, lambda q: q.select().order_by("total").order_by("id").limit(7))
_add("order_nulls_last", f"{LEFT} ORDER BY l_partkey DESC NULLS LAST, o_orderkey, l_linenumber, l_quantity LIMIT 50", ex.order_lines(), lambda q: q.order_by_desc("part").order_by("id").order_by("lineNo").order_by("qty").limit(50))
_add("count_joined", 'SELECT count(*) AS "count" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = \'F\'', ex.order_lines(), lambda q: q.where("status", "=", "F").limit(3).distinct().count_df())
_add("exists_true", 'SELECT true AS "exists"', ex.order, lambda q: q.where("id", ">", 5).exists_df())
_add("exists_false", 'SELECT false AS "exists"', ex.order, lambda q: q.where("id", "<", -5).exists_df())

# nesting

ITEMS = """WITH flat AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total, l_linenumber AS number, l_partkey AS part, l_quantity AS qty FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
items AS (SELECT DISTINCT id, number, part, qty FROM flat WHERE number IS NOT NULL OR part IS NOT NULL OR qty IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY number, part, qty) - 1 AS pos FROM items),
docs AS (SELECT DISTINCT id, status, total FROM flat)"""
_add("nest_lines", f"{ITEMS} SELECT docs.id, status, pos, number, part, qty FROM docs LEFT JOIN placed ON docs.id = placed.id", ex.order_lines(), lambda q: _lines(q.nested(), "lines", "id", "status", number="number", part="part", qty="qty"))
_add("nest_sizes", f"{ITEMS} SELECT docs.id, total, count(pos) AS n FROM docs LEFT JOIN placed ON docs.id = placed.id GROUP BY ALL", ex.order_lines(), lambda q: q.nested().select("id", "total", F.size("lines").cast("long").alias("n")))
FLAGS = "WITH flat AS (SELECT o_orderkey AS id, l_returnflag AS flag, l_linestatus AS mode FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"
_add("nest_dedupe", f"{FLAGS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY flag) - 1 AS pos, flag FROM (SELECT DISTINCT id, flag FROM flat WHERE flag IS NOT NULL)", ex.order_flags, lambda q: _lines(q.nested(), "flags", "id", flag="flag").filter("pos IS NOT NULL"))
_add("nest_empty_items", "SELECT o_orderkey AS id, 0 AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", ex.order_flags, lambda q: q.nested().filter("size(flags) = 0").select("id", F.size("flags").cast("int").alias("n")))
_add("nest_null_key_dropped", "SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", ex.line_orders, lambda q: q.nested().select("id", F.size("parts").cast("long").alias("n")))
_add("nest_two_arrays", f"{FLAGS} SELECT id, count(DISTINCT flag) AS flags, count(DISTINCT mode) AS modes FROM flat GROUP BY id", ex.order_two, lambda q: q.nested().select("id", F.size("flags").cast("long").alias("flags"), F.size("modes").cast("long").alias("modes")))
_add("nest_unselected_many", "SELECT o_orderkey AS id, o_orderstatus AS status, 0 AS n FROM orders", ex.order_flags, lambda q: q.select("status").nested().select("id", "status", F.size("flags").cast("int").alias("n")))
keyless = define_entity("order", ex.ORDERS, {"status": ex.f("o", "o_orderstatus"), "flag": ex.f("l", "l_returnflag", nest_path="flags.flag", many=True)}, [ex.TO_LINES])
_add("nest_without_primary", "SELECT o_orderstatus AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", keyless, lambda q: q.nested())
_add("nest_owned_struct", "SELECT c_custkey AS id, c_name AS name, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", ex.customer_owned, lambda q: q.nested().select("id", "name", F.col("nation.name").alias("nation"), F.col("nation.region.key").alias("region")))
own = define_entity("order", ex.ORDERS, {"id": ex.f("o", "o_orderkey", primary=True), "items": ex.f("l", "l_partkey", many=True)}, [ex.TO_LINES])
_add("nest_own_key", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) - 1 AS pos, l_partkey AS part FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)", own, lambda q: _lines(q.nested(), "items", "id", part="items").filter("pos IS NOT NULL"))
talks = define_entity("conversation", Table("conversations", "t"), {"id": ex.f("t", "conv_id", primary=True), "turn": ex.f("t", "turn", nest_path="turns.n", many=True), "role": ex.f("t", "role", nest_path="turns.role", many=True), "text": ex.f("t", "text", nest_path="turns.text", many=True)})
_add("nest_turns", "SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM conversations", talks, lambda q: _lines(q.order_by("turn").nested(), "turns", "id", role="role", text="text"))
_add("find_by_key", f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7", ex.order, lambda q: q.where("id", "=", 7)._one().to_df())
_add("first_truncates_children", f"{ITEMS} SELECT id, 1 AS n FROM placed WHERE pos = 0 AND id = (SELECT min(id) FROM placed)", ex.order_lines(), lambda q: q.where_not_null("part").order_by("id")._one().nested().select("id", F.size("lines").cast("int").alias("n")))
_add("limit_counts_rows", f"{LEFT} ORDER BY o_orderkey, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_quantity NULLS LAST LIMIT 5", ex.order_lines(), lambda q: q.order_by("id").order_by("lineNo").order_by("part").order_by("qty").limit(5))
_add("transform_values", "SELECT n_nationkey AS id, lower(n_name) AS name, n_name || '#' || n_nationkey AS label FROM nation", ex.upper, lambda q: q.nested())

# changes: the snapshot after them


def _change(name: str, sql: str, entity, rows, key: str, flat, *patches: Callable[[Changes], Changes]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = SnapshotStore(spark, shared_folder(spark, name), key, buckets=8).create(rows(spark, sf_dir))
        for patch in patches:
            result = patch(Changes(entity, store)).submit()
            if not result.success:
                raise RuntimeError(result.error)
        return flat(store.current())

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


_customers = lambda df: df.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.col("nation.name").alias("nation"), F.col("nation.region").alias("region"))
_items = lambda df: df.select("o_orderkey", "o_orderstatus", F.posexplode("item").alias("pos", "x")).select("o_orderkey", "o_orderstatus", F.col("pos").cast("long").alias("pos"), "x.part", "x.qty", "x.number")
C = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
_change("update_body", f"SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'Renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN 12.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment, n_name AS nation, n_regionkey AS region {C}", ex.customer_record, ex.customer_rows, "c_custkey", _customers, lambda c: c.id(7).patch({"name": "Renamed", "balance": "12.5kg"}))
_change("update_owned", f"SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey = 7 THEN '' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 7 THEN 'Nowhere' ELSE n_name END AS nation, CASE WHEN c_custkey = 7 THEN 3 ELSE n_regionkey END AS region {C}", ex.customer_record, ex.customer_rows, "c_custkey", _customers, lambda c: c.id(7).owned("nation").set("name", "Nowhere").set("region", 3.9).end())
_change("update_twice", f"SELECT c_custkey, CASE c_custkey WHEN 7 THEN 'A' WHEN 8 THEN 'B' ELSE c_name END AS c_name, c_acctbal, c_mktsegment, n_name AS nation, n_regionkey AS region {C}", ex.customer_record, ex.customer_rows, "c_custkey", _customers, lambda c: c.id(7).set("name", "A"), lambda c: c.id(8).set("name", "B"))
L = "WITH l AS (SELECT o_orderkey, o_orderstatus, l_partkey AS part, l_quantity AS qty, l_linenumber AS number, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_quantity, l_linenumber) - 1 AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey), one AS (SELECT min(o_orderkey) AS k FROM (SELECT o_orderkey FROM l GROUP BY 1 HAVING count(*) >= 4))"


def _line_change(name: str, sql: str, patch: Callable[[Changes], Changes]) -> None:
    """Changes of the first order with four lines or more."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ex.order_rows(spark, sf_dir)
        key = df.filter(F.size("item") >= 4).agg(F.min("o_orderkey")).first()[0]
        store = SnapshotStore(spark, shared_folder(spark, name), "o_orderkey", buckets=8).create(df)
        result = patch(Changes(ex.order_record, store).id(key), df.filter(F.col("o_orderkey") == key).first()["item"]).submit()
        if not result.success:
            raise RuntimeError(result.error)
        return _items(store.current())

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{L} {sql}"


_line_change("line_remove", "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS pos, part, qty, number FROM l WHERE NOT (o_orderkey = (SELECT k FROM one) AND pos IN (0, 2))", lambda c, item: c.remove_line("item", 0).remove_line("item", 2))
_line_change("line_update_index", "SELECT o_orderkey, o_orderstatus, pos, part, CASE WHEN o_orderkey = (SELECT k FROM one) AND pos = 1 THEN 99.0 ELSE qty END AS qty, number FROM l", lambda c, item: c.update_line("item", 1, {"lines": {"qty": 99}}))
_line_change("line_update_match", "SELECT o_orderkey, o_orderstatus, pos, part, CASE WHEN o_orderkey = (SELECT k FROM one) AND pos = (SELECT min(pos) FROM l x WHERE x.o_orderkey = (SELECT k FROM one) AND x.part = (SELECT part FROM l y WHERE y.o_orderkey = (SELECT k FROM one) AND y.pos = 2)) THEN 98.0 ELSE qty END AS qty, number FROM l", lambda c, item: c.patch({"lines": {"update": [{"match": {"field": "part", "value": item[2]["part"]}, "values": {"qty": 98}}]}}))
_line_change("line_add", "SELECT * FROM (SELECT o_orderkey, o_orderstatus, pos, part, qty, number FROM l UNION ALL SELECT o_orderkey, any_value(o_orderstatus), count(*), 5, 1.5, NULL FROM l WHERE o_orderkey = (SELECT k FROM one) GROUP BY 1)", lambda c, item: c.collection("lines").add_line({"part": "5", "qty": 1.5}).end())
_line_change("line_mixed", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT k FROM one) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, pos, part, qty, number FROM (SELECT o_orderkey, o_orderstatus, pos - (o_orderkey = (SELECT k FROM one) AND pos > 1)::INT AS pos, part, CASE WHEN o_orderkey = (SELECT k FROM one) AND pos = 2 THEN 97.0 ELSE qty END AS qty, number FROM l WHERE NOT (o_orderkey = (SELECT k FROM one) AND pos = 1) UNION ALL SELECT o_orderkey, any_value(o_orderstatus), count(*) - 1, 6, NULL, NULL FROM l WHERE o_orderkey = (SELECT k FROM one) GROUP BY 1)", lambda c, item: c.patch({"status": "X", "lines": {"remove": [1], "update": [{"line": 1, "values": {"qty": 97}}], "add": [{"part": 6}]}}))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {
        "empty": Changes(ex.customer_record).id(1),
        "body": Changes(ex.customer_record).id(1).set("name", "x").set("balance", 2),
        "owned": Changes(ex.customer_record).id(1).set("name", "x").owned("nation").set("name", "y").end(),
        "lines": Changes(ex.order_record).id(1).remove_line("item", 3).collection("lines").add_line({"part": 1}).update_line_by("part", 5, {"qty": 1}).end(),
    }
    rows = [(n, p.mode, p.pending, p.calls, p.loads, p.saves, p.line_scans, p.reloads, len(p.operations)) for n, p in ((n, c.plan()) for n, c in cases.items())]
    return spark.createDataFrame(rows, "name string, mode string, pending long, calls long, loads long, saves long, scans long, reloads long, operations long")


QUERIES["plan_modes"] = _plans
ORACLE_SQL["plan_modes"] = "SELECT * FROM (VALUES ('empty', 'none', 0, 0, 0, 0, 0, 0, 0), ('body', 'submit_fields', 2, 1, 0, 0, 0, 0, 1), ('owned', 'load_save', 2, 4, 2, 2, 0, 1, 4), ('lines', 'load_save', 3, 2, 1, 1, 1, 0, 5)) t(name, mode, pending, calls, loads, saves, scans, reloads, operations)"


def _guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda **o: Changes(ex.order_record, FrameStore(ex.order_rows(spark, sf_dir), "o_orderkey")).id(1).with_options(**o).collection("lines").update_line_by("part", 5, {"qty": 1}).end()
    owned = lambda **o: Changes(ex.customer_record).id(1).with_options(**o).owned("nation").set("name", "y").end()
    cases = {"fast": lines(require_fast_path=True), "scan": lines(allow_line_scans=False), "calls": owned(max_record_calls=3), "reload": owned(allow_reloads=False, require_fast_path=True), "no id": Changes(ex.customer_record).set("name", "x")}
    return spark.createDataFrame([(n, r.success, r.error.count(";") + 1) for n, r in ((n, c.submit()) for n, c in cases.items())], "name string, success boolean, problems long")


QUERIES["guardrails"] = _guardrails
ORACLE_SQL["guardrails"] = "SELECT * FROM (VALUES ('fast', false, 1), ('scan', false, 1), ('calls', false, 1), ('reload', false, 2), ('no id', false, 1)) t(name, success, problems)"

# what has no rows of its own

from ferrule import case_queries  # noqa: E402

QUERIES |= case_queries.QUERIES
ORACLE_SQL |= case_queries.ORACLE_SQL
