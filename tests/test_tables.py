from datetime import UTC, datetime

from pyspark.sql import functions as F

from weftline.sources.tables import iso_micros, named_id, newest, scan_order


def test_newest_takes_latest_once(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), ("b", 1, "y"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "id string, t int, v string")
    got = sorted((r.id or "", r.v) for r in newest(df, ["id"], "t").collect())
    assert got == [("", "n"), ("a", "new"), ("b", "y")]


def test_newest_ties_resolve_alike_and_maps_do_not_break_it(spark):
    rows = [("a", 1, "x", {"k": 1}), ("a", 1, "y", {"k": 2})]
    df = spark.createDataFrame(rows, "id string, t int, v string, m map<string,int>")
    first = newest(df, ["id"], "t").collect()
    assert len(first) == 1 and first[0].v == newest(df.orderBy(F.desc("v")), ["id"], "t").collect()[0].v


def test_named_id(spark):
    cases = {" `p-x.ds.t` ": "ds.t", "`ds`.`t`": "ds.t", "ds.t": "ds.t", "t": "t", "": "", "p.ds.T ": "ds.T", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert all(r.x == r.b for r in df.select(named_id(F.col("a")).alias("x"), "b").collect())


def test_iso_micros_spellings(spark):
    base = int(datetime(2025, 2, 4, 7, 58, 14, 64736, tzinfo=UTC).timestamp()) * 1_000_000 + 64736
    texts = [
        "2025-02-04T16:58:14.064736+09:00", "2025-02-04T07:58:14.064736", "2025-02-04T07:58:14.064736Z", "2025-02-04 07:58:14.064736z",
        "2025-02-04T16:58:14.064736+0900", "2025-02-04T16:58:14.064736+09", "2025-02-04T02:58:14.064736-05:00", " 2025-02-04t07:58:14.064736Z ",
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(iso_micros(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [base] * len(texts)
    bad = spark.createDataFrame([("x",), (None,), ("",)], "t string").select(iso_micros(F.col("t")).alias("m")).collect()
    assert [r.m for r in bad] == [None] * 3


def test_scan_order_by_time_not_by_id(spark):
    rows = [
        (7, "p", "2025-01-01T00:00:00Z", 1), (3, "p", "2025-01-01T02:00:00+01:00", 1), (5, "p", "2024-12-31T23:00:00-02:00", 1),
        (7, "p", "2025-01-01T00:00:00Z", 1), (9, "q", None, 1),
    ]
    df = spark.createDataFrame(rows, "snapshot_id bigint, project_id string, generated_at string, received_at int")
    got = {r.snapshot_id: (r.ord, r.prev_id) for r in scan_order(df).collect()}
    assert got == {7: (1, None), 3: (2, 7), 5: (3, 3), 9: (1, None)}


def test_scratch_is_freed(spark, tmp_path):
    import os

    from weftline.session import Scratch, scratch_scope

    outer = Scratch(spark, "outer")
    kept = outer.cut(spark.range(3))
    with scratch_scope():
        inner = Scratch(spark, "inner")
        assert inner.cut(spark.range(2)).count() == 2 and os.path.exists(inner.root)
    assert not os.path.exists(inner.root) and kept.count() == 3
    outer.drop()
    assert not os.path.exists(outer.root)


def test_sparks_own_catalogue(spark):
    from weftline.sources.catalog import SparkCatalog, assemble_nodes, from_spark_catalog, list_datasets

    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    try:
        spark.sql("CREATE TABLE shop.things (Id INT, name STRING) USING parquet")
        spark.sql("CREATE VIEW shop.named AS SELECT name FROM shop.things")
        read = SparkCatalog(spark)
        assert (read.table_type("shop", "named"), read.table_type("shop", "things"), read.table_type("shop", "none")) == ("view", "table", None)
        assert read.view_sql("shop", "named") == "SELECT name FROM shop.things" and read.view_sql("shop", "things") is None
        spark.sql("DROP VIEW shop.named")
        assert read.table_type("shop", "named") == "view"  # read once
        nodes, columns, errors = from_spark_catalog(spark, ["shop", "nowhere"])
        assert [(r.node_id, r.source) for r in nodes.collect()] == [("shop.things", "ingestion")] and len(errors) == 1 and "nowhere" in errors[0]
        assert [(r.ordinal, r.name, r.name_lc, r.data_type) for r in columns.orderBy("ordinal").collect()] == [(0, "Id", "id", "int"), (1, "name", "name", "string")]
        assert [tuple(r) for r in list_datasets(nodes).collect()] == [("shop", 1, 0)]
    finally:
        spark.sql("DROP DATABASE shop CASCADE")
    tables = spark.createDataFrame([("d", "t", "BASE TABLE"), ("d", "v", "VIEW"), ("d", "m", "MATERIALIZED VIEW"), ("d", "x", "EXTERNAL")], "dataset string, name string, table_type string")
    views = spark.createDataFrame([("d", "v", "SELECT 1"), ("d", "gone", "SELECT 2")], "dataset string, name string, sql string")
    cols = spark.createDataFrame([("d", "t", 1, "A", "INT64"), ("d", "gone", 1, "b", "INT64")], "dataset string, name string, ordinal int, column string, data_type string")
    nodes, columns = assemble_nodes(tables, views, cols)
    assert {(r.node_id, r.type, r.source, r.sql) for r in nodes.collect()} == {
        ("d.t", "table", "ingestion", None), ("d.v", "view", "bigquery_view", "SELECT 1"), ("d.m", "materialized", "ingestion", None), ("d.x", "table", "ingestion", None),
    }
    assert [r.node_id for r in columns.collect()] == ["d.t"]
