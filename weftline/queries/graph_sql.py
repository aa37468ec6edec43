"""The graph queries in SQL, over the same parquet tables."""

from __future__ import annotations

from weftline.queries.problem_sql import _named

_GRAPH = f"""
g_raw AS (
  SELECT id AS node_id, type, dataset, name, status, status_message, columns
  FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)
  UNION ALL
  SELECT id, type, dataset, name, status, status_message, columns FROM shared_nodes WHERE id NOT IN (SELECT id FROM nodes)),
g_whole AS (
  SELECT id AS node_id, type, dataset, name, source, sql, description, status, status_message
  FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)
  UNION ALL SELECT id, type, dataset, name, source, NULL, description, status, status_message FROM shared_nodes WHERE id NOT IN (SELECT id FROM nodes)),
g_nodes AS (SELECT node_id, type, dataset, name, status, status_message FROM g_raw),
g_cols AS (
  SELECT node_id, ordinal::BIGINT AS ordinal, c.name AS name, c.data_type AS data_type, coalesce(c.lineage_status, 'resolved') AS lineage_status
  FROM (SELECT node_id, unnest(range(len(columns))) AS ordinal, unnest(columns) AS c FROM g_raw)),
g_full AS (
  SELECT id AS edge_id, {_named("source_node")} AS source_node, {_named("target_node")} AS target_node,
         coalesce(edge_type, 'automatic') AS edge_type, description, column_mappings
  FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)),
g_edges AS (SELECT edge_id, source_node, target_node, edge_type FROM g_full),
g_maps AS (
  SELECT edge_id, source_node, target_node, m.target_column AS target_column, coalesce(m.source_columns, []) AS source_columns,
         coalesce(m.transformation, 'unknown') AS transformation, m.expression AS expression, m.description AS description
  FROM (SELECT edge_id, source_node, target_node, unnest(column_mappings) AS m FROM g_full)),
ce AS (
  SELECT edge_id, source_node AS sn, lower(sc) AS sc, target_node AS tn, lower(target_column) AS tc
  FROM (SELECT *, unnest(source_columns) AS sc FROM g_maps))"""

_LEVELS = """
deps AS (SELECT DISTINCT target_node AS n, source_node AS d FROM g_edges
         WHERE target_node <> source_node AND target_node IN (SELECT node_id FROM g_nodes) AND source_node IN (SELECT node_id FROM g_nodes)),
reach(a, b) AS (SELECT d, n FROM deps UNION SELECT r.a, x.n FROM reach r JOIN deps x ON x.d = r.b),
bad AS (SELECT DISTINCT b AS n FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b)),
walk(n, l) AS (
  SELECT node_id, 0 FROM g_nodes WHERE node_id NOT IN (SELECT n FROM deps)
  UNION SELECT x.n, w.l + 1 FROM walk w JOIN deps x ON x.d = w.n WHERE x.n NOT IN (SELECT n FROM bad)),
levels AS (SELECT node_id, CASE WHEN node_id IN (SELECT n FROM bad) THEN -1 ELSE (SELECT max(l) FROM walk WHERE n = node_id) END::BIGINT AS level FROM g_nodes)"""

_DEPTHS = """
mutual AS (SELECT x.a AS n, min(x.b) AS s FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
sets AS (SELECT node_id AS n, coalesce(s, node_id) AS s, s IS NOT NULL AS looped FROM g_nodes LEFT JOIN mutual ON n = node_id),
tops AS (SELECT node_id AS n FROM g_nodes WHERE node_id NOT IN (SELECT n FROM deps)),
led AS (SELECT n FROM tops UNION SELECT b FROM reach WHERE a IN (SELECT n FROM tops)),
set_deps AS (SELECT DISTINCT p.s AS d, c.s AS n FROM deps x JOIN sets p ON p.n = x.d JOIN sets c ON c.n = x.n WHERE p.s <> c.s AND x.d IN (SELECT n FROM led)),
fall(n, l) AS (SELECT s, 0 FROM sets UNION SELECT x.n, f.l + 1 FROM fall f JOIN set_deps x ON x.d = f.n),
falls AS (SELECT n, max(l)::BIGINT AS l FROM fall GROUP BY n)"""

_BUSY = """
busy AS (SELECT sn AS node, sc AS col FROM ce WHERE sn IS NOT NULL AND sc IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, sn, sc LIMIT 1),
hops AS (SELECT DISTINCT sn, sc, tn, tc FROM ce),
down(node, col, depth) AS (
  SELECT node, col, 0 FROM busy UNION SELECT h.tn, h.tc, d.depth + 1 FROM down d JOIN hops h ON h.sn = d.node AND h.sc = d.col WHERE d.depth < 40),
downs AS (SELECT node, col, min(depth)::BIGINT AS depth FROM down GROUP BY ALL),
up(node, col, depth) AS (
  SELECT node, col, 0 FROM busy UNION
  SELECT h.sn, h.sc, u.depth + 1 FROM up u JOIN hops h ON h.tn = u.node AND h.tc = u.col
  WHERE u.depth < 40 AND (h.sn, h.sc) NOT IN (SELECT (node, col) FROM downs WHERE depth > 0)),
ups AS (SELECT node, col, min(depth)::BIGINT AS depth FROM up GROUP BY ALL),
traced AS (
  SELECT CASE WHEN depth = 0 THEN 'start' ELSE 'down' END AS direction, node, col, depth FROM downs
  UNION ALL SELECT 'up', node, col, depth FROM ups WHERE depth > 0)"""

_ORIGINS = """
oh AS (SELECT DISTINCT tn, tc, sn, sc FROM ce WHERE sc <> '*' AND sn IS NOT NULL AND tn IS NOT NULL),
starts AS (SELECT DISTINCT node_id AS node, lower(name) AS col FROM g_cols),
back(node, target_column, an, ac, depth) AS (
  SELECT node, col, node, col, 0 FROM starts
  UNION SELECT b.node, b.target_column, h.sn, h.sc, b.depth + 1 FROM back b JOIN oh h ON h.tn = b.an AND h.tc = b.ac WHERE b.depth < 40),
found AS (
  SELECT node, target_column, an AS origin_node, ac AS origin_column, min(depth)::BIGINT AS depth FROM back
  WHERE depth > 0 AND (an, ac) NOT IN (SELECT (tn, tc) FROM oh) AND (an, ac) <> (node, target_column) GROUP BY ALL),
origins AS (
  SELECT *, depth AS steps FROM found
  UNION ALL
  SELECT DISTINCT target_node, lower(target_column), target_node, lower(target_column), 0, 1 FROM g_maps
  WHERE transformation = 'literal' AND source_node IS NOT NULL AND target_node IN (SELECT node_id FROM g_nodes))"""


def _boundary(at: str, name: str = "name") -> str:
    return (
        f"({at} = 1 OR substr({name}, {at} - 1, 1) IN ('_', '.', ' ', '-') OR"
        f" (regexp_matches(substr({name}, {at} - 1, 1), '^[a-z]$') AND regexp_matches(substr({name}, {at}, 1), '^[A-Z]$')))"
    )


def _hit(at: str, before: str) -> str:
    gap = "0" if before == "0" else f"-0.5 * ({at} - {before} - 1)"
    first = f"CASE WHEN {at} = 1 THEN 25 ELSE 0 END" if before == "0" else "0"
    return f"5 + CASE WHEN {at} = {before} + 1 THEN 15 ELSE {gap} END + CASE WHEN {_boundary(at)} THEN 20 ELSE 0 END + {first}"


def _fuzzy(pattern: str, rows: str, out: str) -> str:
    """CTEs that add score and places (a text of numbers from 0) to ``rows`` with a column name; ``out`` is the last one's name."""
    n, steps, before = len(pattern), [f"{out}_0 AS (SELECT *, strpos(lower(name), '{pattern}') AS whole FROM {rows})"], "0"
    for k, char in enumerate(pattern, 1):
        found = f"strpos(substr(lower(name), {before} + 1), '{char}')"
        steps.append(f"{out}_{k} AS (SELECT *, CASE WHEN {before} IS NOT NULL AND {found} > 0 THEN {found} + {before} END AS h{k} FROM {out}_{k - 1})")
        before = f"h{k}"
    hits = " + ".join(_hit(f"h{k}", "0" if k == 1 else f"h{k - 1}") for k in range(1, n + 1))
    places = " || ',' || ".join(f"(h{k} - 1)" for k in range(1, n + 1))
    block = " || ',' || ".join(f"(whole + {k - 1})" for k in range(n))
    steps.append(f"""{out} AS (SELECT *, CASE WHEN whole > 0
  THEN 100 + 10 * {n} + CASE WHEN whole = 1 THEN 50 ELSE 0 END + CASE WHEN {_boundary("whole")} THEN 30 ELSE 0 END - 0.5 * (length(name) - {n})
  WHEN {before} IS NOT NULL THEN {hits} - 0.3 * (length(name) - {n}) END::DOUBLE AS score,
  CASE WHEN whole > 0 THEN {block} ELSE {places} END AS places FROM {out}_{n})""")
    return ",\n".join(steps)


_FUZZY = _fuzzy("fct", "g_nodes", "scored")
_SEARCH = f"""
by_name AS (SELECT node_id, type, name FROM g_nodes), by_id AS (SELECT node_id, node_id AS name FROM g_nodes),
by_col AS (SELECT node_id, name, data_type FROM g_cols),
{_fuzzy("audit", "by_name", "names")}, {_fuzzy("audit", "by_id", "ids")}, {_fuzzy("audit", "by_col", "cols")},
best AS (SELECT 0 AS k, 'table' AS kind, n.node_id, '' AS col, n.type AS data_type,
  CASE WHEN n.score IS NULL OR i.score > n.score THEN i.score ELSE n.score END AS score,
  CASE WHEN n.score IS NULL OR i.score > n.score THEN i.places
    ELSE array_to_string(list_transform(string_split(n.places, ','), lambda p: p::INT + length(n.node_id) - length(n.name)), ',') END AS places
  FROM names n JOIN ids i USING (node_id)
  UNION ALL SELECT 1, 'column', node_id, name, data_type, score, places FROM cols)"""
_SOURCES = """
spring AS (SELECT tn AS node, tc AS col FROM ce WHERE tn IS NOT NULL AND tc IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, tn, tc LIMIT 1),
hops AS (SELECT DISTINCT sn, sc, tn, tc FROM ce WHERE sn IS NOT NULL AND tn IS NOT NULL),
above(node, col) AS (SELECT node, col FROM spring UNION SELECT h.sn, h.sc FROM above a JOIN hops h ON h.tn = a.node AND h.tc = a.col)"""
_PATHS = """
busy AS (SELECT sn AS node, sc AS col FROM ce WHERE sn IS NOT NULL AND sc IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, sn, sc LIMIT 1),
lh AS (SELECT DISTINCT sn || '.' || sc AS s, tn || '.' || tc AS t FROM ce WHERE sn IS NOT NULL AND tn IS NOT NULL),
ups(pt, path) AS (SELECT node || '.' || col, [node || '.' || col] FROM busy
  UNION ALL SELECT h.s, list_append(u.path, h.s) FROM ups u JOIN lh h ON h.t = u.pt WHERE NOT list_contains(u.path, h.s)),
downs(pt, path) AS (SELECT node || '.' || col, [node || '.' || col] FROM busy
  UNION ALL SELECT h.t, list_append(d.path, h.t) FROM downs d JOIN lh h ON h.s = d.pt WHERE NOT list_contains(d.path, h.t)),
top AS (SELECT path FROM ups u WHERE NOT EXISTS (SELECT 1 FROM lh h WHERE h.t = u.pt AND NOT list_contains(u.path, h.s))),
low AS (SELECT path FROM downs d WHERE NOT EXISTS (SELECT 1 FROM lh h WHERE h.s = d.pt AND NOT list_contains(d.path, h.t))),
whole AS (SELECT list_reverse(t.path) || l.path[2:] AS path FROM top t, low l),
kept AS (SELECT path FROM whole WHERE len(path) > 1 OR (SELECT count(*) FROM whole) = 1)"""
_TARGET = """
t AS (SELECT target_node AS n FROM g_edges WHERE target_node IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT source_node) DESC, 1 LIMIT 1)"""

_W = f"WITH RECURSIVE {_GRAPH}"

SQL: dict[str, str] = {
    "catalog_datasets": f"""{_W} SELECT dataset, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'view') AS views
FROM g_nodes WHERE dataset IS NOT NULL GROUP BY dataset""",
    "catalog_columns": f"{_W} SELECT node_id, ordinal, name, data_type, lineage_status FROM g_cols",
    "stats_totals": f"""{_W} SELECT (SELECT count(*) FROM g_nodes) AS total_nodes, (SELECT count(*) FROM g_edges) AS total_edges,
count(*) FILTER (NOT i AND NOT o) AS orphan_nodes, count(*) FILTER (i AND NOT o) AS terminal_nodes, count(*) FILTER (status = 'truncated') AS truncated_nodes
FROM (SELECT status, node_id IN (SELECT target_node FROM g_edges) AS i, node_id IN (SELECT source_node FROM g_edges) AS o FROM g_nodes)""",
    "stats_by_type": f"{_W} SELECT coalesce(type, 'table') AS type, count(*) AS n FROM g_nodes GROUP BY ALL",
    "status_of_columns": f"""{_W} SELECT node_id, name, CASE WHEN (node_id, lower(name)) IN
(SELECT (target_node, lower(target_column)) FROM g_maps WHERE transformation <> 'unknown' AND target_node IS NOT NULL AND target_column IS NOT NULL)
THEN 'resolved' ELSE 'unknown' END AS lineage_status FROM g_cols""",
    "topo_order": f"{_W}, {_LEVELS} SELECT node_id, level FROM levels",
    "node_depths": f"""{_W}, {_LEVELS}, {_DEPTHS} SELECT s.n AS node_id, (SELECT max(l) FROM falls) - l AS depth, looped AS on_cycle FROM sets s JOIN falls f ON f.n = s.s""",
    "trace_column": f'{_W}, {_BUSY} SELECT direction, node, col AS "column", depth FROM traced',
    "trace_column_edges": f"""{_W}, {_BUSY} SELECT DISTINCT edge_id FROM ce
WHERE (sn, sc) IN (SELECT (node, col) FROM traced) AND (tn, tc) IN (SELECT (node, col) FROM traced)""",
    "trace_chain": f"""{_W}, {_BUSY} SELECT (CASE direction WHEN 'up' THEN 0 WHEN 'start' THEN 1 ELSE 2 END)::INTEGER AS section,
CASE WHEN direction = 'up' THEN -depth ELSE depth END AS place, t.node, coalesce(n.type, '?') AS type,
CASE WHEN t.col = '*' THEN '(all rows)' ELSE coalesce(c.name, t.col) END AS "column", coalesce(c.data_type, '') AS data_type
FROM traced t LEFT JOIN g_nodes n ON n.node_id = t.node LEFT JOIN g_cols c ON c.node_id = t.node AND lower(c.name) = t.col""",
    "trace_table": f"""{_W}, {_BUSY}, both_ways AS (SELECT source_node AS a, target_node AS b FROM g_edges UNION SELECT target_node, source_node FROM g_edges),
near(n) AS (SELECT node FROM busy UNION SELECT b FROM near JOIN both_ways ON a = n)
SELECT g.node_id AS node, coalesce(c.name, '') AS "column" FROM g_nodes g LEFT JOIN g_cols c USING (node_id) WHERE g.node_id IN (SELECT n FROM near)""",
    "trace_origins": f"{_W}, {_ORIGINS} SELECT node, target_column, origin_node, origin_column, depth, steps FROM origins",
    "trace_origin_tables": f"""{_W}, {_ORIGINS} SELECT node, origin_node, count(DISTINCT origin_column) AS n_columns,
array_to_string(list_sort(list(DISTINCT target_column)), ',') AS target_columns FROM origins GROUP BY node, origin_node""",
    "prune_upstream": f"""{_W}, ends AS (SELECT DISTINCT target_node AS t, source_node AS s FROM g_edges),
above(n) AS (SELECT s FROM ends WHERE t IN (SELECT node_id FROM g_nodes WHERE status = 'warning') UNION SELECT s FROM above JOIN ends ON t = n)
SELECT n AS node FROM above""",
    "filter_views": f"""{_W}, kept AS (SELECT node_id FROM g_nodes WHERE type = 'view' AND contains(lower(name), 'daily'))
SELECT 'node' AS kind, node_id AS id FROM kept UNION ALL
SELECT 'edge', edge_id FROM g_edges WHERE source_node IN (SELECT node_id FROM kept) AND target_node IN (SELECT node_id FROM kept)""",
    "fuzzy_names": f"{_W}, {_FUZZY} SELECT node_id, score FROM scored WHERE score IS NOT NULL",
    "fuzzy_search": f"""{_W}, {_SEARCH} SELECT kind, node_id, col AS "column", data_type, score, places FROM best
WHERE score IS NOT NULL ORDER BY k, score DESC, node_id, col LIMIT 50""",
    "trace_tree": f"""{_W}, {_SOURCES} SELECT node, col AS "column" FROM above""",
    "trace_paths": f"""{_W}, {_PATHS} SELECT node, col AS "column", array_to_string(path, ' > ') AS path FROM kept, busy""",
    "trace_branches": f"""{_W}, {_PATHS}, n AS (SELECT max(k) AS k FROM (SELECT unnest(range(0, (SELECT min(len(path)) FROM kept) + 1)) AS k)
  WHERE k = 0 OR (SELECT count(DISTINCT path[-k:]) FROM kept) = 1)
SELECT array_to_string(path[:len(path) - k], ' > ') AS branch, CASE WHEN k = 0 THEN '' ELSE array_to_string(path[-k:], ' > ') END AS suffix FROM kept, n""",
    "node_links": f"""{_W}, b AS (SELECT source_node AS n FROM g_edges WHERE source_node IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT 'upstream' AS direction, edge_id, source_node AS other, edge_type FROM g_edges WHERE target_node = (SELECT n FROM b)
UNION ALL SELECT 'downstream', edge_id, target_node, edge_type FROM g_edges WHERE source_node = (SELECT n FROM b)""",
    "facet_values": f"""{_W} SELECT DISTINCT kind, value FROM (UNPIVOT (SELECT dataset, type, status FROM g_nodes) ON dataset, type, status INTO NAME kind VALUE value)""",
    "scan_within_hops": f"""{_W}, {_TARGET},
reach(n, h) AS (SELECT n, 0 FROM t UNION SELECT source_node, h + (split_part(source_node, '.', 1) <> split_part(n, '.', 1))::INT
  FROM reach JOIN g_edges ON target_node = n WHERE h <= 1 AND source_node IS NOT NULL AND (n IN (SELECT n FROM t) OR n IN (SELECT node_id FROM g_nodes))),
near AS (SELECT n, min(h) AS h FROM reach GROUP BY n)
SELECT n AS node_id, CASE WHEN h > 1 THEN 'truncated' ELSE coalesce(status, 'error') END AS status,
CASE WHEN h > 1 THEN 'Depth limit reached (2 dataset hops > 1)' WHEN status = 'truncated' THEN status_message END AS message FROM near LEFT JOIN g_nodes ON node_id = n""",
    "scan_in_scope": f"""{_W}, {_TARGET},
reach(n) AS (SELECT n FROM t UNION SELECT source_node FROM reach JOIN g_edges ON target_node = n
  WHERE source_node IS NOT NULL AND split_part(n, '.', 1) = (SELECT split_part(n, '.', 1) FROM t))
SELECT n AS node_id, CASE WHEN split_part(n, '.', 1) <> (SELECT split_part(n, '.', 1) FROM t) THEN 'truncated' ELSE coalesce(status, 'error') END AS status,
CASE WHEN split_part(n, '.', 1) <> (SELECT split_part(n, '.', 1) FROM t) THEN 'Dataset not in scan scope' WHEN status = 'truncated' THEN status_message END AS message
FROM reach LEFT JOIN g_nodes ON node_id = n""",
    "export_sizes": f"""{_W}, cs AS (SELECT node_id, list({{'name': name, 'data_type': data_type, 'lineage_status': lineage_status}} ORDER BY ordinal) AS c FROM g_cols GROUP BY node_id),
ms AS (SELECT edge_id, list(m ORDER BY m) AS m FROM (SELECT edge_id, {{'target_column': target_column, 'source_columns': source_columns,
  'transformation': transformation, 'expression': expression, 'description': description}} AS m FROM g_maps) GROUP BY edge_id)
SELECT 'node' AS kind, node_id AS id, to_json({{'type': type, 'dataset': dataset, 'name': name, 'columns': coalesce(c, []), 'source': source, 'sql': sql,
  'description': description, 'status': status, 'status_message': status_message}})::VARCHAR AS json FROM g_whole LEFT JOIN cs USING (node_id)
UNION ALL SELECT 'edge', edge_id, to_json({{'id': edge_id, 'source_node': source_node, 'target_node': target_node, 'edge_type': edge_type,
  'description': description, 'column_mappings': coalesce(m, [])}})::VARCHAR FROM g_full LEFT JOIN ms USING (edge_id)""",
    "mapping_merge": f"""{_W} SELECT target_node, lower(target_column) AS target_column, transformation, coalesce(expression, '') AS expression,
array_to_string(list_sort(list_distinct(flatten(list(source_columns)))), ',') AS source_columns, min(source_node) AS source_node FROM g_maps GROUP BY ALL""",
    "mapping_same": f"""{_W} SELECT target_node, lower(target_column) AS target_column, count(DISTINCT (transformation, coalesce(expression, ''))) = 1 AS shared
FROM g_maps GROUP BY ALL""",
    "graph_warnings": f"""{_W}, n AS (SELECT target_node, count(DISTINCT lower(target_column)) AS k FROM g_maps WHERE transformation = 'unknown' GROUP BY ALL)
SELECT 'scope' AS kind, node_id, coalesce(status_message, 'Outside the scan') AS message FROM g_nodes WHERE status = 'truncated' UNION ALL
SELECT 'parse', target_node, k || CASE WHEN k = 1 THEN ' column' ELSE ' columns' END || ' with unknown lineage' FROM n WHERE target_node IN (SELECT node_id FROM g_nodes)""",
    "graph_gaps": f"""{_W} SELECT node_id, node_id NOT IN (SELECT target_node FROM g_edges) AND type <> 'table' AS no_upstream,
node_id NOT IN (SELECT source_node FROM g_edges) AS no_downstream FROM g_nodes""",
    "manual_retention": f"""{_W} SELECT edge_id, CASE WHEN source_node IN (SELECT node_id FROM g_nodes) AND target_node IN (SELECT node_id FROM g_nodes)
THEN 'kept' ELSE 'dropped' END AS fate FROM g_edges WHERE edge_type = 'manual'""",
    "default_mappings": f"""{_W}, p AS (SELECT DISTINCT source_node, target_node FROM g_edges)
SELECT DISTINCT p.source_node, p.target_node, t.name AS target_column, s.name AS source_column,
CASE WHEN s.name IS NULL THEN 'unknown' ELSE 'direct' END AS transformation
FROM p JOIN g_cols t ON t.node_id = p.target_node LEFT JOIN g_cols s ON s.node_id = p.source_node AND s.name = t.name""",
    "export_mermaid": f"""{_W}, names AS (SELECT node_id, array_to_string(list(replace(name, '"', '&quot;') ORDER BY ordinal), '<br/>') AS t FROM g_cols GROUP BY node_id)
SELECT 0 AS part, node_id AS id, '  ' || regexp_replace(node_id, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(node_id, '"', '&quot;') || coalesce('<br/>' || t, '') || '"]' AS line
FROM g_nodes LEFT JOIN names USING (node_id) UNION ALL
SELECT 1, edge_id, '  ' || regexp_replace(source_node, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN edge_type = 'manual' THEN ' -.-> ' ELSE ' --> ' END
|| regexp_replace(target_node, '[^A-Za-z0-9_]', '_', 'g') FROM g_edges""",
    "scan_upstream": f"""{_W}, t AS (SELECT target_node AS n FROM g_edges WHERE target_node IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT source_node) DESC, 1 LIMIT 1),
above(n) AS (SELECT n FROM t UNION SELECT source_node FROM above JOIN g_edges ON target_node = n)
SELECT n AS node_id, coalesce(status, 'error') AS status FROM above LEFT JOIN g_nodes ON node_id = n""",
    "events_fold": """SELECT user_id, coalesce(min_by(event_type, event_id) FILTER (event_type IN ('complete', 'error')), 'running') AS status,
max_by(event_type, event_id) AS last_type, count(*) AS n_events FROM events GROUP BY user_id""",
    "scan_dataset": f"""{_W}, listed AS (SELECT node_id AS n FROM g_nodes WHERE dataset = (SELECT min(dataset) FROM g_nodes WHERE type = 'view')),
reach(n, h) AS (
  SELECT DISTINCT source_node, (split_part(source_node, '.', 1) <> (SELECT min(dataset) FROM g_nodes WHERE type = 'view'))::INT
  FROM g_edges WHERE target_node IN (SELECT n FROM listed) AND source_node NOT IN (SELECT n FROM listed)
  UNION SELECT source_node, h + (split_part(source_node, '.', 1) <> split_part(n, '.', 1))::INT FROM reach JOIN g_edges ON target_node = n
  WHERE h <= 1 AND source_node NOT IN (SELECT n FROM listed)),
near AS (SELECT n, min(h) AS h FROM reach GROUP BY n UNION ALL SELECT n, 0 FROM listed)
SELECT n AS node_id, CASE WHEN h > 1 THEN 'truncated' ELSE coalesce(status, 'error') END AS status,
CASE WHEN h > 1 THEN 'Depth limit reached (2 dataset hops > 1)' WHEN status = 'truncated' THEN status_message END AS message FROM near LEFT JOIN g_nodes ON node_id = n""",
    "entity_reach": """WITH RECURSIVE links(src, dst) AS (
SELECT 'region.' || n_regionkey, 'nation.' || n_nationkey FROM nation UNION SELECT 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer
UNION SELECT 'nation.' || s_nationkey, 'supplier.' || s_suppkey FROM supplier UNION SELECT 'customer.' || o_custkey, 'orders.' || o_orderkey FROM orders
UNION SELECT 'orders.' || l_orderkey, 'lineitem.' || l_orderkey || '.' || l_linenumber FROM lineitem
UNION SELECT 'supplier.' || l_suppkey, 'lineitem.' || l_orderkey || '.' || l_linenumber FROM lineitem
UNION SELECT 'part.' || l_partkey, 'lineitem.' || l_orderkey || '.' || l_linenumber FROM lineitem),
roots(r) AS (SELECT 'region.' || r_regionkey FROM region UNION SELECT 'region.' || n_regionkey FROM nation UNION SELECT 'part.' || p_partkey FROM part),
reached(root, node, depth) AS (SELECT r, r, 0::BIGINT FROM roots WHERE r IS NOT NULL
UNION SELECT root, dst, depth + 1 FROM reached JOIN links ON src = node WHERE dst IS NOT NULL)
SELECT root, node, min(depth) AS depth FROM reached GROUP BY ALL""",
}
