import pytest

from weftline.plans.lineage import parse_views, view_mappings
from weftline.plans.sqltext import Unreadable, is_dynamic, read, table_references
from weftline.queries.views import expected_mappings
from weftline.plans.views import RAW, VIEW_COLUMNS, VIEWS

SCHEMAS = {
    "d.t": ["a", "b", "c", "tags", "addr", "ts"], "d.u": ["a", "x", "y"], "d.ev": ["id", "props"], "D.Up": ["ID", "Name"],
}


def trace(sql, *columns, **more):
    schemas = {k: dict.fromkeys(v, "STRING") for k, v in {**SCHEMAS, **more}.items()}
    schemas["v.x"] = dict.fromkeys(columns, "STRING")
    return {(m.source_node, m.target_column): (",".join(m.source_columns), m.transformation) for m in view_mappings("v.x", sql, schemas)}


CASES = [
    ("SELECT a, b AS bb FROM d.t", {("d.t", "a"): ("a", "direct"), ("d.t", "bb"): ("b", "rename")}),
    ("SELECT a FROM `proj.d.t` WHERE b IN (SELECT x FROM d.u)", {("d.t", "a"): ("a", "direct")}),
    ("SELECT `proj-1`.d.t.a, d.t.b FROM `proj-1`.d.t", {("d.t", "a"): ("a", "direct"), ("d.t", "b"): ("b", "direct")}),
    ("WITH RECURSIVE r(n) AS (SELECT a FROM d.t UNION ALL SELECT u.y FROM r JOIN d.u u ON u.x = r.n) SELECT n, n AS m FROM r",
     {("d.t", "n"): ("a", "rename"), ("d.u", "n"): ("y", "rename"), ("d.t", "m"): ("a", "rename"), ("d.u", "m"): ("y", "rename")}),
    ("WITH RECURSIVE r AS (SELECT a FROM d.t UNION ALL SELECT a FROM r) SELECT a FROM r", {("d.t", "a"): ("a", "direct")}),
    ("SELECT tag, o FROM d.t, UNNEST(tags) AS tag WITH OFFSET AS o", {("d.t", "tag"): ("tags", "expression"), ("d.t", "o"): ("tags", "expression")}),
    ("SELECT v FROM d.t, UNNEST(ARRAY(SELECT x FROM d.u)) AS v", {("d.u", "v"): ("x", "expression")}),
    ("SELECT t.a, q.n FROM d.t t JOIN (SELECT a, COUNT(*) AS n FROM d.u GROUP BY a) q ON q.a = t.a", {("d.t", "a"): ("a", "direct"), ("d.t", "n"): ("*", "aggregation")}),
    ("SELECT UPPER(a) AS s, 5 AS five, CURRENT_TIMESTAMP() AS now FROM d.t", {("d.t", "s"): ("a", "expression"), ("d.t", "five"): ("", "literal"), ("d.t", "now"): ("", "literal")}),
    ("SELECT COUNT(*) AS n, SUM(b) AS s, SUM(b) OVER (PARTITION BY a) AS w, ROW_NUMBER() OVER () AS rn FROM d.t",
     {("d.t", "n"): ("*", "aggregation"), ("d.t", "s"): ("b", "aggregation"), ("d.t", "w"): ("a,b", "expression"), ("d.t", "rn"): ("*", "expression")}),
    ("SELECT * FROM d.t", {("d.t", c): (c, "direct") for c in ("a", "b")}),
    ("SELECT t.* EXCEPT (b), u.x FROM d.t t JOIN d.u u USING (a)", {("d.t", "a"): ("a", "direct"), ("d.u", "x"): ("x", "direct")}),
    ("WITH q AS (SELECT a, MAX(b) AS m FROM d.t GROUP BY 1) SELECT a, m, m + 1 AS p FROM q",
     {("d.t", "a"): ("a", "direct"), ("d.t", "m"): ("b", "aggregation"), ("d.t", "p"): ("b", "expression")}),
    ("SELECT z FROM (SELECT y AS z FROM (SELECT x AS y FROM d.u))", {("d.u", "z"): ("x", "rename")}),
    ("SELECT a AS k FROM d.t UNION ALL SELECT x FROM d.u", {("d.t", "k"): ("a", "rename"), ("d.u", "k"): ("x", "rename")}),
    ("SELECT a AS k FROM d.t UNION DISTINCT SELECT b FROM d.t", {("d.t", "k"): ("b", "rename")}),
    ("SELECT t.a, tag FROM d.t AS t, UNNEST(t.tags) AS tag WITH OFFSET AS o", {("d.t", "a"): ("a", "direct"), ("d.t", "tag"): ("tags", "expression")}),
    ("SELECT t.a, tag FROM d.t t LEFT JOIN UNNEST(tags) tag", {("d.t", "a"): ("a", "direct"), ("d.t", "tag"): ("tags", "expression")}),
    ("SELECT e.id, p.name AS n FROM d.ev e, e.props p", {("d.ev", "id"): ("id", "direct"), ("d.ev", "n"): ("props", "expression")}),
    ("SELECT addr.city AS city, t.addr.zip.code AS code FROM d.t t", {("d.t", "city"): ("addr", "expression"), ("d.t", "code"): ("addr", "expression")}),
    ("SELECT a, (SELECT MAX(u.x) FROM d.u u WHERE u.a = t.a) AS m FROM d.t t", {("d.t", "a"): ("a", "direct"), ("d.u", "m"): ("x", "aggregation")}),
    ("SELECT CASE WHEN a > 1 THEN b ELSE c END AS k, IF(a = 1, b, NULL) AS i, CAST(c AS INT64) AS n FROM d.t",
     {("d.t", "k"): ("a,b,c", "expression"), ("d.t", "i"): ("a,b", "expression"), ("d.t", "n"): ("c", "expression")}),
    ("SELECT a, ARRAY_AGG(STRUCT(b, c AS cc) ORDER BY ts DESC LIMIT 1)[OFFSET(0)].* FROM d.t GROUP BY a",
     {("d.t", "a"): ("a", "direct"), ("d.t", "b"): ("b,ts", "aggregation"), ("d.t", "cc"): ("c,ts", "aggregation")}),
    ("CREATE OR REPLACE TABLE v.x AS SELECT a FROM d.t QUALIFY ROW_NUMBER() OVER (PARTITION BY b ORDER BY ts DESC) = 1", {("d.t", "a"): ("a", "direct")}),
    ("-- head\nSELECT t.ghost AS g, TIMESTAMP_DIFF(ts, ts, SECOND) AS d FROM d.t t", {("d.t", "g"): ("ghost", "rename"), ("d.t", "d"): ("ts", "expression")}),
    ("SELECT whatever FROM d.unlisted", {("d.unlisted", "whatever"): ("whatever", "direct")}),
    ("SELECT nowhere FROM d.t JOIN d.u USING (a)", {("d.t", "nowhere"): ("", "unknown")}),
    ("SELECT concat(t.b, u.x) AS j FROM d.t t CROSS JOIN d.u u", {("d.t", "j"): ("b", "expression"), ("d.u", "j"): ("x", "expression")}),
    ("SELECT id AS i, name FROM D.Up", {("D.Up", "i"): ("id", "rename"), ("D.Up", "name"): ("name", "direct")}),
]


@pytest.mark.parametrize("sql,want", CASES, ids=range(len(CASES)))
def test_constructs(sql, want):
    assert trace(sql, *(c for _, c in want)) == want


def test_expression_text_is_the_authors():
    schemas = {"d.t": {"a": ""}, "v.x": {"k": ""}}
    assert view_mappings("v.x", "SELECT  UPPER( a )\n AS k FROM d.t", schemas)[0].expression == "UPPER( a )"


def test_no_schema_no_lineage():
    assert view_mappings("v.x", "SELECT a FROM d.t", {"d.t": {"a": ""}}) == []


def test_table_references():
    sql = "CREATE TABLE o.x AS WITH c AS (SELECT 1 FROM in1.t) SELECT * FROM c JOIN `p.d.t` ON EXISTS (SELECT 1 FROM z.z); SELECT * FROM c, loose"
    assert set(table_references(sql)) == {("o", "x"), ("in1", "t"), ("d", "t"), ("z", "z"), (None, "c"), (None, "loose")}
    assert table_references("SELECT a FROM d.t UNION ALL SELECT a FROM d.t") == [("d", "t"), ("d", "t")]
    assert table_references("this is not sql (") == [] and table_references(None) == [] and table_references("") == []


def test_dynamic_and_unreadable():
    assert is_dynamic("begin execute\n immediate 'x'; end") and is_dynamic("-- EXECUTE IMMEDIATE") and not is_dynamic("select 1") and not is_dynamic(None)
    with pytest.raises(Unreadable):
        read("SELECT (a FROM d.t")


def test_catalogue_golden_rows():
    schemas = {v: dict.fromkeys(c, "") for v, c in VIEW_COLUMNS.items()}
    raw = {f"tpc.{t}": {} for t in RAW} | {"tpc.orders": dict.fromkeys(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "")}
    raw |= {"tpc.nation": {"n_name": ""}, "tpc.region": {"r_name": ""}, "tpc.lineitem": {"l_orderkey": ""}, "tpc.supplier": {"s_nationkey": ""}}
    found = set()
    for view, sql in VIEWS.items():
        found |= {(view, m.source_node, m.target_column, ",".join(m.source_columns), m.transformation) for m in view_mappings(view, sql, {**schemas, **raw})}
    assert found == set(expected_mappings())


def test_parse_views_outcomes(spark):
    rows = [
        ("v.ok", "SELECT a FROM d.t"), ("v.dyn", "EXECUTE IMMEDIATE 'x'"), ("v.bad", "SELECT ((("), ("v.none", "SELECT a FROM d.t"),
        ("v.empty", "SELECT 1 AS k"), ("d.t", None), ("v.blank", "  "),
    ]
    nodes = spark.createDataFrame(rows, "node_id string, sql string")
    columns = spark.createDataFrame([("d.t", 0, "a"), ("v.ok", 0, "a"), ("v.bad", 0, "a"), ("v.empty", 0, "k")], "node_id string, ordinal int, name string")
    got = {r.target_node: (r.outcome, r.source_node, r.transformation) for r in parse_views(nodes, columns).collect()}
    assert got == {
        "v.ok": ("ok", "d.t", "direct"), "v.dyn": ("dynamic", None, None), "v.bad": ("failed", None, None),
        "v.none": ("no_schema", None, None), "v.empty": ("empty", None, None),
    }
