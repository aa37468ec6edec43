"""A catalogue of views over the driver's tables: executable, and read for their lineage.

``tpc.x`` is the table x.  The texts are warehouse SQL; each shows some constructs that lineage must
understand, and runs on Spark through :mod:`weftline.plans.dialect`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.model import COLUMNS, NODES
from weftline.plans.dialect import run_sql
from weftline.sources.tables import read_table

VIEWS: dict[str, str] = {
    "freight.consignments": """
SELECT l.l_orderkey AS order_ref, l.l_partkey AS part_ref, l.l_suppkey AS shipper, s.s_nationkey AS from_nation,
  SAFE_CAST(l.l_quantity AS INT64) AS pieces, CAST(ROUND(l.l_extendedprice * 100) AS INT64) AS cents,
  CONCAT(l.l_returnflag, '/', l.l_linestatus) AS state, l.l_shipdate AS left_at
FROM `acme-dw.tpc.lineitem` AS l INNER JOIN `acme-dw`.tpc.supplier AS s ON s.s_suppkey = l.l_suppkey""",
    "freight.load_calendar": """
SELECT FORMAT_TIMESTAMP("%Y-%m", left_at) AS period, state, SUM(pieces) AS pieces, COUNT(*) AS n_lines, COUNTIF(pieces >= 40) AS bulky,
  SUM(CASE WHEN state = 'R/F' THEN cents ELSE 0 END) AS returned_cents
FROM freight.consignments GROUP BY period, 2""",
    "freight.lead_times": """
SELECT c.*, TIMESTAMP_DIFF(c.left_at, o.o_orderdate, DAY) AS lead_days, n.n_name AS origin, r.r_name AS zone
FROM freight.consignments c
LEFT JOIN tpc.orders o ON o.o_orderkey = c.order_ref
LEFT JOIN tpc.nation n ON n.n_nationkey = c.from_nation
LEFT OUTER JOIN tpc.region r ON r.r_regionkey = n.n_regionkey""",
    "freight.zone_marks": """
WITH by_origin AS (
  SELECT zone, origin, SUM(pieces) AS pieces, COUNT(DISTINCT shipper) AS shippers, MAX(left_at) AS last_out
  FROM freight.lead_times GROUP BY zone, origin)
SELECT zone, origin, pieces, last_out,
  ROW_NUMBER() OVER (PARTITION BY zone ORDER BY pieces DESC, origin) AS place,
  RANK() OVER (ORDER BY shippers DESC) AS wide_rank, DENSE_RANK() OVER (ORDER BY shippers) AS thin_rank,
  LAG(pieces) OVER (PARTITION BY zone ORDER BY pieces DESC, origin) AS ahead,
  LEAD(origin) OVER (PARTITION BY zone ORDER BY pieces DESC, origin) AS behind,
  SUM(pieces) OVER (PARTITION BY zone) AS zone_pieces, AVG(shippers) OVER (PARTITION BY zone) AS mean_shippers,
  COUNT(*) OVER () AS origins, SUM(pieces * 2) OVER (PARTITION BY zone ORDER BY origin) AS running
FROM by_origin""",
    "freight.state_shares": """
SELECT state, COUNT(*) AS n_lines, SUM(COUNT(*)) OVER () AS all_lines, RANK() OVER (ORDER BY COUNT(*) DESC, state) AS place
FROM freight.consignments GROUP BY state""",
    "freight.newest_line": """
SELECT shipper, order_ref, part_ref, left_at FROM freight.consignments WHERE pieces > 10
QUALIFY ROW_NUMBER() OVER (PARTITION BY shipper ORDER BY left_at DESC, order_ref DESC, part_ref DESC) = 1""",
    "buyers.last_order": """
SELECT o_custkey AS buyer, ARRAY_AGG(STRUCT(o_orderkey AS order_ref, o_orderstatus) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)[OFFSET(0)].*
FROM tpc.orders GROUP BY o_custkey""",
    "buyers.next_order": """
SELECT o_custkey AS buyer, ARRAY_AGG(STRUCT(o_orderkey AS order_ref) ORDER BY o_orderdate DESC, o_orderkey LIMIT 2)[OFFSET(1)].*
FROM tpc.orders GROUP BY buyer""",
    "buyers.watch": """
SELECT c.c_custkey AS buyer, UPPER(c.c_name) AS label, (SELECT MAX(o.o_totalprice) FROM tpc.orders o WHERE o.o_custkey = c.c_custkey) AS dearest
FROM tpc.customer c
WHERE c.c_nationkey NOT IN (SELECT n_nationkey FROM tpc.nation WHERE n_regionkey = 0)
  AND EXISTS (SELECT 1 FROM tpc.orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderstatus = 'O')
  AND c.c_custkey IN (SELECT o_custkey FROM tpc.orders WHERE o_totalprice > 300000)""",
    "buyers.parties": """
SELECT c_name AS party, 'buyer' AS role, c_nationkey AS home FROM tpc.customer
UNION ALL SELECT s_name, 'seller', s_nationkey FROM tpc.supplier
UNION ALL SELECT n_name, 'land', n_nationkey FROM tpc.nation""",
    "buyers.initials": """
SELECT initial, COUNT(*) AS n FROM (
  SELECT LOWER(SUBSTR(party, 1, 1)) AS initial, home FROM buyers.parties UNION DISTINCT SELECT r_name, r_regionkey FROM tpc.region)
GROUP BY initial""",
    "goods.bands": """
SELECT band, COUNT(*) AS parts, MIN(price) AS low, MAX(price) AS high, ROUND(SUM(price) / NULLIF(COUNTIF(big), 0), 2) AS per_big
FROM (SELECT band, price, big FROM (
  SELECT CASE WHEN p_retailprice < 930 THEN 'low' WHEN p_retailprice < 960 THEN 'mid' ELSE 'high' END AS band,
    COALESCE(p_retailprice, 0) AS price, IF(p_size > 25, TRUE, FALSE) AS big
  FROM tpc.part WHERE p_size >= 1))
GROUP BY band""",
    "goods.kinds": """
SELECT p_type AS kind, ROUND(AVG(p_size), 6) AS mean_size, ROUND(STDDEV(p_size), 6) AS spread, ROUND(VARIANCE(p_size), 6) AS variance,
  ROUND(CORR(p_size, p_retailprice), 6) AS tie, APPROX_COUNT_DISTINCT(p_brand) > 0 AS branded, ANY_VALUE(p_type) AS again,
  ARRAY_LENGTH(ARRAY_AGG(p_brand)) AS rows_held
FROM tpc.part GROUP BY 1""",
    "goods.brand_lists": """
SELECT kind, STRING_AGG(brand, ',' ORDER BY brand DESC) AS brands
FROM (SELECT DISTINCT p_type AS kind, p_brand AS brand FROM tpc.part) GROUP BY kind""",
    "goods.by_zone": """
SELECT r.r_name AS zone, t.kinds FROM tpc.region r JOIN (SELECT COUNT(DISTINCT p_type) AS kinds FROM tpc.part) t ON TRUE""",
    "goods.words": """
SELECT p.p_partkey AS part_ref, word, at FROM tpc.part p LEFT JOIN UNNEST(SPLIT(p.p_name, ' ')) AS word WITH OFFSET AS at""",
    "signals.cells": """
SELECT e.vec_id, v AS value, at, half FROM tpc.embeddings AS e, UNNEST(e.embedding) AS v WITH OFFSET AS at CROSS JOIN UNNEST([1, 2]) AS half""",
    "signals.boxes": """
SELECT vec_id, box.kind AS kind, box.dims.n AS n, box.dims.head AS head
FROM (SELECT vec_id, STRUCT(label AS kind, STRUCT(ARRAY_LENGTH(embedding) AS n, embedding[OFFSET(0)] AS head) AS dims) AS box FROM tpc.embeddings)""",
    "signals.visits": """
WITH gaps AS (
  SELECT user_id, ts, TIMESTAMP_DIFF(ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), SECOND) AS pause FROM tpc.events),
marked AS (SELECT user_id, ts, IF(pause IS NULL OR pause > 86400, 1, 0) AS begins FROM gaps)
SELECT user_id, SUM(begins) AS visits, MIN(ts) AS since, TIMESTAMP_DIFF(MAX(ts), MIN(ts), HOUR) AS hours FROM marked GROUP BY user_id""",
    "signals.loudest": """
SELECT user_id, COUNT(*) AS n, 'events' AS unit, CURRENT_TIMESTAMP() > TIMESTAMP '2020-01-01 00:00:00' AS after_start
FROM tpc.events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""",
    "desk.open_book": """
-- written anew every night
CREATE OR REPLACE TABLE desk.open_book AS
SELECT * EXCEPT (o_totalprice) REPLACE (UPPER(o_orderpriority) AS o_orderpriority) FROM tpc.orders WHERE o_orderstatus = 'O'""",
    "desk.overview": """
SELECT z.zone, z.origin, z.pieces, p.parts, ROUND(z.pieces / NULLIF(p.parts, 0), 4) AS per_part
FROM freight.zone_marks z LEFT JOIN (SELECT SUM(parts) AS parts FROM goods.bands) p ON TRUE""",
}

# Columns of each view, in order, as a catalogue would list them.
VIEW_COLUMNS: dict[str, tuple[str, ...]] = {
    view: tuple(names.split())
    for view, names in {
        "freight.consignments": "order_ref part_ref shipper from_nation pieces cents state left_at",
        "freight.load_calendar": "period state pieces n_lines bulky returned_cents",
        "freight.lead_times": "order_ref part_ref shipper from_nation pieces cents state left_at lead_days origin zone",
        "freight.zone_marks": "zone origin pieces last_out place wide_rank thin_rank ahead behind zone_pieces mean_shippers origins running",
        "freight.state_shares": "state n_lines all_lines place",
        "freight.newest_line": "shipper order_ref part_ref left_at",
        "buyers.last_order": "buyer order_ref o_orderstatus",
        "buyers.next_order": "buyer order_ref",
        "buyers.watch": "buyer label dearest",
        "buyers.parties": "party role home",
        "buyers.initials": "initial n",
        "goods.bands": "band parts low high per_big",
        "goods.kinds": "kind mean_size spread variance tie branded again rows_held",
        "goods.brand_lists": "kind brands",
        "goods.by_zone": "zone kinds",
        "goods.words": "part_ref word at",
        "signals.cells": "vec_id value at half",
        "signals.boxes": "vec_id kind n head",
        "signals.visits": "user_id visits since hours",
        "signals.loudest": "user_id n unit after_start",
        "desk.open_book": "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority",
        "desk.overview": "zone origin pieces parts per_part",
    }.items()
}
RAW = ("customer", "embeddings", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def run_view(spark: SparkSession, directory: str, view: str) -> DataFrame:
    return run_sql(spark, VIEWS[view], {f"tpc.{t}": read_table(spark, directory, t) for t in RAW}, VIEWS)


def catalogue_rows(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and columns of the views and the raw tables they rest on."""
    nodes, cols = [], []
    for t in RAW:
        nodes.append((f"tpc.{t}", "table", "tpc", t, "ingestion", None, None, "ok", None))
        for i, f in enumerate(read_table(spark, directory, t).schema.fields):
            cols.append((f"tpc.{t}", i, f.name, f.name.lower(), f.dataType.simpleString(), "resolved"))
    for view, sql in VIEWS.items():
        dataset, name = view.split(".")
        nodes.append((view, "view", dataset, name, "bigquery_view", sql, None, "ok", None))
        cols += [(view, i, c, c.lower(), "STRING", "resolved") for i, c in enumerate(VIEW_COLUMNS[view])]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(cols, COLUMNS)
