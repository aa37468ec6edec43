"""Queries that run the view catalogue, and read its lineage; with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import build_graph
from weftline.plans.lineage import parse_views
from weftline.plans.views import VIEWS, catalogue_rows, run_view


def _view(view: str, spark: SparkSession, directory: str) -> DataFrame:
    return run_view(spark, directory, view)


def lineage_catalogue(spark: SparkSession, directory: str) -> DataFrame:
    """Column mappings of the view catalogue."""
    nodes, columns = catalogue_rows(spark, directory)
    found = parse_views(nodes, columns).where("outcome = 'ok'")
    return found.select("target_node", "source_node", "target_column", F.array_join("source_columns", ",").alias("source_columns"), "transformation")


def lineage_column_status(spark: SparkSession, directory: str) -> DataFrame:
    """Views with the number of their columns that are resolved, and their status after building."""
    graph = build_graph(*catalogue_rows(spark, directory))
    per = graph.columns.groupBy("node_id").agg(F.count_if(F.col("lineage_status") == "resolved").alias("resolved"), F.count("*").alias("columns"))
    return graph.nodes.where("type = 'view'").join(per, "node_id").select("node_id", "status", "resolved", "columns")


QUERIES = {f"view_{v.split('.')[1]}": partial(_view, v) for v in VIEWS} | {f.__name__: f for f in (lineage_catalogue, lineage_column_status)}

# What the rules of column lineage give for the catalogue: target < source | target column:sources:transformation.
# d direct, r rename, e expression, a aggregation, l literal, u unknown.
EXPECTED = """
freight.consignments < tpc.lineitem | order_ref:l_orderkey:r part_ref:l_partkey:r shipper:l_suppkey:r pieces:l_quantity:e cents:l_extendedprice:e state:l_linestatus,l_returnflag:e left_at:l_shipdate:r
freight.consignments < tpc.supplier | from_nation:s_nationkey:r
freight.load_calendar < freight.consignments | period:left_at:e state:state:d pieces:pieces:a n_lines:*:a bulky:pieces:a returned_cents:cents,state:a
freight.lead_times < freight.consignments | order_ref:order_ref:d part_ref:part_ref:d shipper:shipper:d from_nation:from_nation:d pieces:pieces:d cents:cents:d state:state:d left_at:left_at:d lead_days:left_at:e
freight.lead_times < tpc.orders | lead_days:o_orderdate:e
freight.lead_times < tpc.nation | origin:n_name:r
freight.lead_times < tpc.region | zone:r_name:r
freight.zone_marks < freight.lead_times | zone:zone:d origin:origin:d pieces:pieces:a last_out:left_at:a place:origin,pieces,zone:e wide_rank:shipper:e thin_rank:shipper:e
freight.zone_marks < freight.lead_times | ahead:origin,pieces,zone:e behind:origin,pieces,zone:e zone_pieces:pieces,zone:e mean_shippers:shipper,zone:e origins:*:e running:origin,pieces,zone:e
freight.state_shares < freight.consignments | state:state:d n_lines:*:a all_lines:*:e place:state:e
freight.newest_line < freight.consignments | shipper:shipper:d order_ref:order_ref:d part_ref:part_ref:d left_at:left_at:d
buyers.last_order < tpc.orders | buyer:o_custkey:r order_ref:o_orderdate,o_orderkey:a o_orderstatus:o_orderdate,o_orderkey,o_orderstatus:a
buyers.next_order < tpc.orders | buyer:o_custkey:r order_ref:o_orderdate,o_orderkey:a
buyers.watch < tpc.customer | buyer:c_custkey:r label:c_name:e
buyers.watch < tpc.orders | dearest:o_totalprice:a
buyers.parties < tpc.customer | party:c_name:r role::l home:c_nationkey:r
buyers.parties < tpc.supplier | party:s_name:r role::l home:s_nationkey:r
buyers.parties < tpc.nation | party:n_name:r role::l home:n_nationkey:r
buyers.initials < buyers.parties | initial:party:e n:*:a
buyers.initials < tpc.region | initial:r_name:e
goods.bands < tpc.part | band:p_retailprice:e parts:*:a low:p_retailprice:a high:p_retailprice:a per_big:p_retailprice,p_size:a
goods.kinds < tpc.part | kind:p_type:r mean_size:p_size:a spread:p_size:a variance:p_size:a tie:p_retailprice,p_size:a branded:p_brand:a again:p_type:a rows_held:p_brand:a
goods.brand_lists < tpc.part | kind:p_type:r brands:p_brand:a
goods.by_zone < tpc.region | zone:r_name:r
goods.by_zone < tpc.part | kinds:p_type:a
goods.words < tpc.part | part_ref:p_partkey:r word:p_name:e at:p_name:e
signals.cells < tpc.embeddings | vec_id:vec_id:d value:embedding:e at:embedding:e half::u
signals.boxes < tpc.embeddings | vec_id:vec_id:d kind:embedding,label:e n:embedding,label:e head:embedding,label:e
signals.visits < tpc.events | user_id:user_id:d visits:event_id,ts,user_id:a since:ts:a hours:ts:a
signals.loudest < tpc.events | user_id:user_id:d n:*:a unit::l after_start::l
desk.open_book < tpc.orders | o_orderkey:o_orderkey:d o_custkey:o_custkey:d o_orderstatus:o_orderstatus:d o_orderdate:o_orderdate:d o_orderpriority:o_orderpriority:e
desk.overview < freight.zone_marks | zone:zone:d origin:origin:d pieces:pieces:d per_part:pieces:e
desk.overview < goods.bands | parts:parts:a per_part:parts:e
"""
KINDS = {"d": "direct", "r": "rename", "e": "expression", "a": "aggregation", "l": "literal", "u": "unknown"}


def expected_mappings() -> list[tuple[str, str, str, str, str]]:
    out = []
    for line in EXPECTED.strip().splitlines():
        ends, maps = line.split(" | ")
        target, source = ends.split(" < ")
        for m in maps.split():
            column, sources, kind = m.split(":")
            out.append((target, source, column, sources, KINDS[kind]))
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def _status_rows() -> list[tuple[str, str, int]]:
    """(view, column, whether it is known) of the catalogue."""
    known: dict[tuple[str, str], int] = {}
    for target, _, column, _, kind in expected_mappings():
        known[target, column] = max(known.get((target, column), 0), int(kind != "unknown"))
    return [(t, c, k) for (t, c), k in known.items()]


# The views' results, said once more in the SQL of the engine they are held against.
_LINES = """
c AS (SELECT l_orderkey AS order_ref, l_partkey AS part_ref, l_suppkey AS shipper, s_nationkey::BIGINT AS from_nation, l_quantity::BIGINT AS pieces,
  round(l_extendedprice * 100)::BIGINT AS cents, l_returnflag || '/' || l_linestatus AS state, l_shipdate AS left_at
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
_LEADS = f"""{_LINES},
t AS (SELECT c.*, date_sub('day', o_orderdate, left_at) AS lead_days, n_name AS origin, r_name AS zone FROM c LEFT JOIN orders ON o_orderkey = order_ref
  LEFT JOIN nation ON n_nationkey = from_nation LEFT JOIN region ON r_regionkey = n_regionkey)"""
_MARKS = f"""{_LEADS},
b AS (SELECT zone, origin, sum(pieces)::BIGINT AS pieces, count(DISTINCT shipper) AS shippers, max(left_at) AS last_out FROM t GROUP BY zone, origin)"""
_PARTIES = """p AS (SELECT c_name AS party, 'buyer' AS role, c_nationkey::BIGINT AS home FROM customer
  UNION ALL SELECT s_name, 'seller', s_nationkey FROM supplier UNION ALL SELECT n_name, 'land', n_nationkey FROM nation)"""
_LATEST = "FROM orders GROUP BY o_custkey"

SQL: dict[str, str] = {
    "view_consignments": f"WITH {_LINES} SELECT * FROM c",
    "view_load_calendar": f"""WITH {_LINES} SELECT strftime(left_at, '%Y-%m') AS period, state, sum(pieces)::BIGINT AS pieces, count(*) AS n_lines,
count(*) FILTER (pieces >= 40) AS bulky, coalesce(sum(cents) FILTER (state = 'R/F'), 0)::BIGINT AS returned_cents FROM c GROUP BY ALL""",
    "view_lead_times": f"WITH {_LEADS} SELECT * FROM t",
    "view_zone_marks": f"""WITH {_MARKS} SELECT zone, origin, pieces, last_out, row_number() OVER z AS place, rank() OVER (ORDER BY shippers DESC) AS wide_rank,
dense_rank() OVER (ORDER BY shippers) AS thin_rank, lag(pieces) OVER z AS ahead, lead(origin) OVER z AS behind, sum(pieces) OVER (PARTITION BY zone)::BIGINT AS zone_pieces,
avg(shippers) OVER (PARTITION BY zone) AS mean_shippers, (SELECT count(*) FROM b) AS origins,
(SELECT sum(2 * x.pieces) FROM b x WHERE x.zone = b.zone AND x.origin <= b.origin)::BIGINT AS running
FROM b WINDOW z AS (PARTITION BY zone ORDER BY pieces DESC, origin)""",
    "view_state_shares": f"""WITH {_LINES}, n AS (SELECT state, count(*) AS n_lines FROM c GROUP BY state)
SELECT state, n_lines, (SELECT count(*) FROM c) AS all_lines, rank() OVER (ORDER BY n_lines DESC, state) AS place FROM n""",
    "view_newest_line": f"""WITH {_LINES}, m AS (SELECT shipper, max((left_at, order_ref, part_ref)) AS x FROM c WHERE pieces > 10 GROUP BY shipper)
SELECT shipper, x[2] AS order_ref, x[3] AS part_ref, x[1] AS left_at FROM m""",
    "view_last_order": f"SELECT o_custkey AS buyer, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_ref, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus {_LATEST}",
    "view_next_order": f"SELECT o_custkey AS buyer, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[2] AS order_ref {_LATEST}",
    "view_watch": """SELECT c_custkey AS buyer, upper(c_name) AS label, max(o_totalprice) AS dearest FROM customer JOIN orders ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0 GROUP BY ALL HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND max(o_totalprice) > 300000""",
    "view_parties": f"WITH {_PARTIES} SELECT * FROM p",
    "view_initials": f"""WITH {_PARTIES}, u AS (SELECT lower(party[1]) AS initial, home FROM p UNION SELECT r_name, r_regionkey FROM region)
SELECT initial, count(*) AS n FROM u GROUP BY initial""",
    "view_bands": """SELECT CASE WHEN p_retailprice < 930 THEN 'low' WHEN p_retailprice < 960 THEN 'mid' ELSE 'high' END AS band, count(*) AS parts,
min(p_retailprice) AS low, max(p_retailprice) AS high, round(sum(p_retailprice) / nullif(count(*) FILTER (p_size > 25), 0), 2) AS per_big
FROM part WHERE p_size >= 1 GROUP BY band""",
    "view_kinds": """SELECT p_type AS kind, round(avg(p_size), 6) AS mean_size, round(stddev_samp(p_size), 6) AS spread, round(var_samp(p_size), 6) AS variance,
round(corr(p_size, p_retailprice), 6) AS tie, count(p_brand) > 0 AS branded, p_type AS again, count(p_brand) AS rows_held FROM part GROUP BY p_type""",
    "view_brand_lists": "SELECT p_type AS kind, array_to_string(list_reverse_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY p_type",
    "view_by_zone": "SELECT r_name AS zone, (SELECT count(DISTINCT p_type) FROM part) AS kinds FROM region",
    "view_words": """SELECT p_partkey AS part_ref, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS "at" FROM part""",
    "view_cells": """SELECT vec_id, value, "at", half FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS "at" FROM embeddings),
(VALUES (1::BIGINT), (2)) AS h(half)""",
    "view_boxes": "SELECT vec_id, label::BIGINT AS kind, len(embedding) AS n, embedding[1]::DOUBLE AS head FROM embeddings",
    "view_visits": """WITH g AS (SELECT user_id, ts, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS pause FROM events)
SELECT user_id, count(*) FILTER (pause IS NULL OR pause > 86400) AS visits, min(ts) AS since, date_sub('hour', min(ts), max(ts)) AS hours FROM g GROUP BY user_id""",
    "view_loudest": "SELECT user_id, count(*) AS n, 'events' AS unit, true AS after_start FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "view_open_book": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, upper(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus = 'O'",
    "view_overview": f"""WITH {_MARKS}, n AS (SELECT count(*) AS parts FROM part WHERE p_size >= 1)
SELECT zone, origin, pieces, parts, round(pieces / nullif(parts, 0), 4) AS per_part FROM b, n""",
    "lineage_catalogue": f"""SELECT * FROM (VALUES {_values(expected_mappings())})
AS t(target_node, source_node, target_column, source_columns, transformation)""",
    "lineage_column_status": f"""SELECT target AS node_id, 'ok' AS status, sum(k::INT)::BIGINT AS resolved, count(*) AS columns
FROM (VALUES {_values(_status_rows())}) AS t(target, c, k) GROUP BY target""",
}
