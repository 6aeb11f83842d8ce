import os
import uuid

import pytest
from pyspark.sql import functions as F

from ferrule.context import create_context, repository
from ferrule.model import UNSET, ConfigError, Field, Join, On, Table, define_entity, make_field
from ferrule.operators.builder import Query, run_query
from ferrule.plans.compiler import inlined
from ferrule.sources.catalog import Catalog

ORDER_ROWS = [(10, 100, 1, 2.0, 50.0), (10, 100, 1, 2.0, 50.0), (10, 100, 2, 3.0, 75.0), (11, 101, None, None, None), (None, 9, 4, 1.0, 1.0)]


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    c.add("txn", spark.createDataFrame(ORDER_ROWS, "id long, entity long, item long, qty double, amount double"))
    c.add("empty_text", spark.createDataFrame([(1, "", None), (1, "a", "x"), (2, None, "")], "id long, a string, b string"))
    return c


def f(column, **rest):
    return {"table": "t", "column": column} | rest


def entity(fields, table="txn", **rest):
    return define_entity("order", (table, "t"), fields, **rest)


ORDER = {"id": f("id", primary=True), "entityId": f("entity"), "itemId": f("item", nest_path="lines.itemId", many=True), "qty": f("qty", nest_path="lines.qty", many=True)}


def test_nesting_groups_dedupes_and_drops(catalog):
    got = {o["id"]: o for o in run_query(entity(ORDER), catalog)}
    assert set(got) == {10, 11}  # the null key is dropped
    assert got[10] == {"id": 10, "entityId": 100, "lines": [{"itemId": 1, "qty": 2.0}, {"itemId": 2, "qty": 3.0}]}
    assert got[11]["lines"] == []


def test_nesting_of_much_has_more_tasks_than_run_at_once(spark, tmp_path, monkeypatch):
    spark.range(3000).select((F.col("id") % 700).alias("id"), (F.col("id") % 13).alias("v")).unionByName(spark.sql("SELECT null AS id, 1L AS v")).write.parquet(str(tmp_path / "big.parquet"))
    c = Catalog(spark).add_parquet(str(tmp_path), "big")
    e = define_entity("big", ("big", "t"), {"id": f("id", primary=True), "v": f("v", nest_path="vs.v", many=True)})
    shuffled = lambda df: "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    small = Query(e, c).order_by_desc("id").nested()
    assert not shuffled(small)
    size = sum(x.stat().st_size for x in (tmp_path / "big.parquet").glob("*.parquet"))
    monkeypatch.setattr("ferrule.operators.nesting.TASK_BYTES", size // 20)
    big = Query(e, c).order_by_desc("id").nested()
    assert shuffled(big) and len(big.collect()) == 700 and big.collect() == small.collect()
    n = Query(e, c).nested().select("id", F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    assert n >= 20
    monkeypatch.setattr("ferrule.operators.nesting.TASKS", 6)
    assert Query(e, c).nested().select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0] == 6


def test_empty_text_is_an_empty_value(catalog):
    e = entity({"id": f("id", primary=True), "a": f("a", nest_path="x.a", many=True), "b": f("b", nest_path="x.b", many=True)}, "empty_text")
    assert {o["id"]: o["x"] for o in run_query(e, catalog)} == {1: [{"a": "a", "b": "x"}], 2: []}


def test_many_without_primary_has_no_array(catalog):
    e = entity({"entityId": f("entity"), "itemId": f("item", many=True)})
    got = run_query(e, catalog)
    assert len(got) == 5 and all(set(o) == {"entityId"} for o in got)


def test_paths(catalog):
    e = entity({"id": f("id", primary=True), "deep": f("entity", nest_path="a.b.c"), "x": f("entity"), "xy": f("id", nest_path="x.y")})
    one = Query(e, catalog).where("id", "=", 11).objects()
    assert one == [{"id": 11, "a": {"b": {"c": 101}}, "x": {"y": 11}}]


def test_post_process_and_transform(catalog):
    e = entity({"id": f("id", primary=True), "double": f("entity", transform=lambda v, row: v * 2 + row("id"))}, post_process=lambda o: None if o["id"] == 11 else {"gone": o["id"]})
    assert sorted(map(str, Query(e, catalog).where_not_null("id").where("id", ">", 9).distinct().objects())) == sorted(["{'gone': 10}", "{'id': 11, 'double': 213}"])


def test_first_truncates_and_does_not_leak(catalog):
    q = Query(entity(ORDER), catalog).where("id", "=", 10).order_by("itemId")
    assert q.first()["lines"] == [{"itemId": 1, "qty": 2.0}]
    assert q.state.limit is None and len(q.objects()[0]["lines"]) == 2
    assert Query(entity(ORDER), catalog).where("id", "=", -1).first() is None


def test_errors(catalog):
    q = Query(entity(ORDER), catalog)
    for bad in (lambda: q.where("nope", "=", 1), lambda: q.order_by("nope")):
        with pytest.raises(KeyError, match="not defined in query config for 'order'"):
            bad()
    with pytest.raises(ValueError, match="exactly two"):
        q.where("id", "BETWEEN", [1])
    with pytest.raises(ValueError, match="at least one"):
        q.where("id", "IN", [])
    with pytest.raises(ValueError, match="does not accept an array"):
        q.where("id", "=", [1])
    with pytest.raises(ValueError, match="At least one selectable field"):
        Query(entity({"a": f("id", select=False)}), catalog).compile()
    with pytest.raises(ValueError, match="Distinct"):
        Query(entity(ORDER), catalog).select("qty").distinct().order_by("entityId").compile()
    with pytest.raises(ConfigError):
        entity({"a": f("id"), "A": f("entity")})
    with pytest.raises(ConfigError):
        Join(Table("x", "x"), "t", [])
    with pytest.raises(ValueError, match="parameter"):
        inlined("? ?", [1])


def test_sql_text(catalog):
    q = Query(entity(ORDER), catalog).select("entityId").where("id", "=", 1).or_where("entityId", "IN", [2, "o'x"]).where("id", "=", None).order_by_desc("id").limit(-3.5).offset(2.9)
    assert q.to_sql() == "SELECT t.id AS `id`, t.entity AS `entityId`\nFROM txn t\nWHERE t.id = 1 OR t.entity IN (2, 'o''x') AND t.id = NULL\nORDER BY t.id DESC NULLS LAST\nLIMIT 0\nOFFSET 2"
    assert list(q.compile().outputs) == ["id", "entityid"]
    assert Query(entity(ORDER), catalog).where("nope", "=", UNSET).compile().args == []


def test_pages_count_exists(catalog):
    q = Query(entity(ORDER), catalog)
    pages = q.pages(2)
    assert pages.page_count == 3 and [len(p) for p in pages] == [2, 2, 1]
    assert q.count() == 5 and q.exists() and not Query(entity(ORDER), catalog).where("id", "=", -1).exists()


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        got = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_walk_over_all_pages_fetches_many_at_once(spark, monkeypatch):
    c = Catalog(spark).add("many", spark.range(1000, numPartitions=7).select("id", (F.col("id") % 10).alias("v")))
    e = define_entity("many", ("many", "t"), {"id": f("id", primary=True), "v": f("v")})
    pages = Query(e, c).order_by_desc("v").order_by("id").pages(3)
    rows = [tuple(r) for r in sorted(((i, i % 10) for i in range(1000)), key=lambda r: (-r[1], r[0]))]
    expected = [rows[i : i + 3] for i in range(0, 1000, 3)]
    got, jobs = jobs_of(spark, lambda: [[tuple(r) for r in p] for p in pages])
    assert got == expected and jobs < 10
    monkeypatch.setattr("ferrule.operators.builder.WALK_ROWS", 100)
    assert [[tuple(r) for r in p] for p in pages] == expected
    assert [tuple(r) for r in pages.page(333)] == expected[333] and pages.page(334) == pages.page(-1) == []
    numbered, jobs = jobs_of(spark, lambda: [tuple(r) for r in pages.to_df().orderBy("row").collect()])
    assert numbered == [(k // 3, k, *r) for k, r in enumerate(rows)] and jobs < 10
    pages.close()


def test_pages_of_nothing(catalog):
    pages = Query(entity(ORDER), catalog).where("id", "=", -1).pages(2)
    assert list(pages) == [] and pages.page(0) == [] and pages.page_count == 0 and pages.to_df().collect() == []


def test_paged_rows_needs_few_jobs(spark):
    from ferrule.queries import QUERIES

    if os.path.isdir("/root/testdata/sf0.001"):
        got, jobs = jobs_of(spark, lambda: QUERIES["paged_rows"](spark, "/root/testdata/sf0.001"))
        plan = got._jdf.queryExecution().analyzed().toString()
        assert jobs < 10 and "LogicalRDD" not in plan and "LocalRelation" not in plan  # its rows don't pass the driver


def test_an_offset_is_not_one_tasks(spark, monkeypatch):
    rows = [(i, i % 3) for i in range(500)]
    c = Catalog(spark).add("off", spark.range(500, numPartitions=7).select("id", (F.col("id") % 3).cast("int").alias("v")))
    e = define_entity("off", ("off", "t"), {"id": f("id", primary=True), "v": f("v"), "w": f("v", nest_path="ws.w", many=True)})
    q = lambda *keys: Query(e, c).select("v", *keys)
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))

    def whole_in_one_task(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return "SinglePartition" in plan or "CollectLimit" in plan or "TakeOrdered" in plan

    df = q().order_by_desc("v").order_by("id").offset(100).to_df()
    assert [tuple(r) for r in df.collect()] == expected[100:] and not whole_in_one_task(df) and df.columns == ["id", "v"]
    df = q().order_by_desc("v").offset(100).to_df()  # ties are broken by all columns, so that they have several tasks
    assert [tuple(r) for r in df.collect()] == expected[100:]
    df = q().offset(100).to_df()
    got = [tuple(r) for r in df.collect()]
    assert len(set(got)) == len(got) == 400 and set(got) <= set(rows) and not whole_in_one_task(df)
    assert q().order_by("id").offset(500).rows() == q().offset(10**12).rows() == []
    assert [o["id"] for o in q("w").order_by_desc("id").offset(490).objects()] == list(range(9, -1, -1))
    assert [tuple(r) for r in q().select().distinct().order_by_desc("id").offset(497).rows()] == [(2, 2), (1, 1), (0, 0)]

    monkeypatch.setattr("ferrule.operators.builder.ONE_TASK_ROWS", 50)
    df = q().order_by_desc("v").order_by("id").limit(20).offset(100).to_df()
    assert [tuple(r) for r in df.collect()] == expected[100:120] and not whole_in_one_task(df)
    assert [tuple(r) for r in q().order_by_desc("v").order_by("id").limit(60).rows()] == expected[:60]
    pages = q().order_by_desc("v").order_by("id").limit(60).offset(1).pages(25)
    assert [len(p) for p in pages] == [25, 25, 11] and [tuple(r) for r in pages.page(2)] == expected[50:61] and pages.to_df().count() == 61
    pages.close()


def test_rows_of_an_offset_leave_no_files(spark, catalog, tmp_path, monkeypatch):
    monkeypatch.setattr("ferrule.operators.builder.shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert len(Query(entity(ORDER), catalog).order_by("id").offset(1).rows()) == 4
    assert len(Query(entity(ORDER), catalog).order_by("id").offset(1).objects()) == 2
    assert os.listdir(tmp_path) == []


def test_context(catalog):
    e = entity(ORDER)
    db = create_context(catalog, {"orders": e})
    assert db.entities == ["orders"] and db.has("orders") and not db.has("x") and db.get_config("orders") is e
    assert db.orders.find(11)["entityId"] == 101 and db.orders.record_type == "order" and db.orders.where("id", "=", 10).count() == 3
    with pytest.raises(KeyError, match="is not registered"):
        db.set("x")
    with pytest.raises(AttributeError):
        db.orders = 1
    with pytest.raises(ValueError, match="No primary field"):
        create_context(catalog, {"o": entity({"a": f("id")})}).o.find(1)
    assert repository(e, catalog).query().count() == 5


def test_field_sections():
    plain = Field("a", "t")
    assert make_field(plain) is plain
    made = make_field({"query": {"column": "a", "table": "t", "type": "string"}, "common": {"type": "integer"}, "record": {"type": "float", "record_field": "b"}})
    assert (made.type, made.record_column) == ("float", "b")
    with pytest.raises(ConfigError):
        make_field({"column": "a", "table": "t", "colour": 1})


def test_display_lookup_never_repeats_rows(spark):
    c = Catalog(spark).add("t1", spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, code int")).add("codes", spark.createDataFrame([(5, "b"), (5, "a")], "k int, label string"))
    c.add_display("t1", "code", "codes", "k", "label")
    e = define_entity("t", ("t1", "t"), {"id": f("id", primary=True), "code": f("code", use_text=True)})
    assert sorted(map(tuple, Query(e, c).rows())) == [(1, "a"), (2, None), (3, None)]
    assert Query(e, c).where("code", "=", "a", use_text=True).count() == 1
    assert Query(e, c).where("code", "=", 6).count() == 1
    with pytest.raises(ValueError):
        Query(e, c).where_raw("BUILTIN.DF(t.code) = ?", "a")


def test_scan_is_pruned_and_filter_pushed(spark, tmp_path):
    spark.range(100).withColumns({"a": F.col("id") * 2, "b": F.lit("x")}).write.parquet(str(tmp_path / "w.parquet"))
    c = Catalog(spark).add_parquet(str(tmp_path), "w")
    e = define_entity("w", ("w", "t"), {"id": f("id", primary=True), "a": f("a"), "b": f("b")})
    plan = Query(e, c).select("a").where("a", ">", 10).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,10)]" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan
