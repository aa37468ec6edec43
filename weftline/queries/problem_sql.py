"""The general problems in SQL, over the same parquet tables."""

from __future__ import annotations


def _named(end: str) -> str:
    bare = f"trim(replace({end}, '`', ''))"
    parts = f"string_split({bare}, '.')"
    return f"CASE WHEN len({parts}) > 2 THEN {parts}[-2] || '.' || {parts}[-1] ELSE {bare} END"


_HEADS = """
heads AS (
  SELECT snapshot_id, any_value(project_id) AS project_id,
         any_value(CASE WHEN regexp_matches(generated_at, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN generated_at
                        ELSE generated_at || 'Z' END)::TIMESTAMPTZ AS made
  FROM (SELECT * FROM graph_metadata QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY received_at DESC) = 1)
  GROUP BY snapshot_id),
ordered AS (
  SELECT snapshot_id, project_id, row_number() OVER w AS ord, lag(snapshot_id) OVER w AS prev_id
  FROM heads WINDOW w AS (PARTITION BY project_id ORDER BY made, snapshot_id))"""

_NEW_NODES = """
n AS (SELECT snapshot_id, id, coalesce(columns, []) AS columns FROM node_snapshots
      QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY received_at DESC) = 1)"""

_NEW_EDGES = """
e AS (SELECT snapshot_id, id, source_node, target_node, coalesce(column_mappings, []) AS column_mappings
      FROM edge_snapshots QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY received_at DESC) = 1)"""

_ORPHANS = f"""
WITH {_HEADS}, {_NEW_NODES}, {_NEW_EDGES},
named AS (SELECT snapshot_id, id, {_named("source_node")} AS src, {_named("target_node")} AS tgt, column_mappings FROM e),
held AS (SELECT snapshot_id, project_id, ord, n.id, list_transform(columns, lambda c: lower(c.name)) AS cols
         FROM n LEFT JOIN ordered USING (snapshot_id)),
shared AS (SELECT id, list_transform(columns, lambda c: lower(c.name)) AS cols FROM shared_nodes),
ends AS (
  SELECT snapshot_id, id AS edge_id, 'source_node' AS field, src AS node, NULL AS col FROM named
  UNION ALL SELECT snapshot_id, id, 'target_node', tgt, NULL FROM named),
cols AS (
  SELECT DISTINCT snapshot_id, id AS edge_id, 'source_columns' AS field, src AS node, lower(c) AS col
  FROM (SELECT snapshot_id, id, src, unnest(m.source_columns) AS c
        FROM (SELECT snapshot_id, id, src, unnest(column_mappings) AS m FROM named))
  WHERE c <> '*'),
lacking AS (
  SELECT r.* FROM ends r LEFT JOIN held h ON r.snapshot_id = h.snapshot_id AND r.node = h.id
    LEFT JOIN shared s ON r.node = s.id WHERE h.id IS NULL AND s.id IS NULL
  UNION ALL
  SELECT r.* FROM cols r LEFT JOIN held h ON r.snapshot_id = h.snapshot_id AND r.node = h.id
    LEFT JOIN shared s ON r.node = s.id
  WHERE len(coalesce(h.cols, s.cols)) > 0 AND NOT list_contains(coalesce(h.cols, s.cols), r.col)),
seen AS (
  SELECT project_id, id AS node, col, min(ord) AS first, max(ord) AS last
  FROM (SELECT project_id, ord, id, NULL AS col FROM held UNION ALL SELECT project_id, ord, id, unnest(cols) FROM held)
  GROUP BY ALL),
found AS (
  SELECT DISTINCT l.snapshot_id, l.edge_id, l.field, coalesce(l.col, l.node) AS ref,
    CASE WHEN s.first < o.ord THEN 'deleted' WHEN s.last > o.ord THEN 'late' ELSE 'missing' END AS kind
  FROM lacking l LEFT JOIN ordered o USING (snapshot_id)
  LEFT JOIN seen s ON s.project_id = o.project_id AND s.node = l.node AND s.col IS NOT DISTINCT FROM l.col)"""

_CHANGES = f"""
WITH {_HEADS}, {_NEW_NODES}, {_NEW_EDGES},
recs AS (
  SELECT snapshot_id, 'node' AS entity, id, list_transform(columns, lambda c: {{'n': lower(c.name), 't': c.data_type, 's': c.lineage_status}})::VARCHAR AS content FROM n
  UNION ALL
  SELECT snapshot_id, 'edge', id, list_sort(list_distinct(list_transform(column_mappings, lambda m: {{
     's': list_sort(list_distinct(list_transform(coalesce(m.source_columns, []), lambda c: lower(c)))), 't': lower(m.target_column),
     'k': m.transformation, 'e': coalesce(m.expression, '')}})))::VARCHAR FROM e),
pairs AS (SELECT snapshot_id, prev_id FROM ordered WHERE prev_id IS NOT NULL),
cur AS (SELECT p.snapshot_id, r.entity, r.id, r.content FROM pairs p JOIN recs r ON r.snapshot_id = p.snapshot_id),
old AS (SELECT p.snapshot_id, r.entity, r.id, r.content FROM pairs p JOIN recs r ON r.snapshot_id = p.prev_id),
found AS (
  SELECT coalesce(c.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(c.entity, o.entity) AS entity,
         coalesce(c.id, o.id) AS record_id,
         CASE WHEN o.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM cur c FULL JOIN old o ON c.snapshot_id = o.snapshot_id AND c.entity = o.entity AND c.id = o.id
  WHERE o.id IS NULL OR c.id IS NULL OR c.content <> o.content)"""

_LINKS = f"""
WITH RECURSIVE ids AS (SELECT id FROM nodes UNION SELECT id FROM shared_nodes),
links AS (
  SELECT DISTINCT p, c FROM (
    SELECT {_named("source_node")} AS p, {_named("target_node")} AS c
    FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1))
  WHERE p IN (SELECT id FROM ids) AND c IN (SELECT id FROM ids)),
roots AS (SELECT DISTINCT p AS r FROM links WHERE p NOT IN (SELECT c FROM links)),
walk(r, n, d) AS (
  SELECT r, r, 0 FROM roots
  UNION
  SELECT w.r, l.c, w.d + 1 FROM walk w JOIN links l ON l.p = w.n WHERE w.d < 40),
near AS (SELECT r AS root_id, n AS node_id, min(d)::BIGINT AS depth FROM walk GROUP BY r, n)"""

_CLOSURE = f"""{_LINKS},
pairs(a, b) AS (SELECT p, c FROM links UNION SELECT x.a, l.c FROM pairs x JOIN links l ON l.p = x.b),
both_ways AS (SELECT x.a, x.b FROM pairs x JOIN pairs y ON x.a = y.b AND x.b = y.a),
cycles AS (SELECT a AS node_id, min(b) AS root_id, count(*)::BIGINT AS depth FROM both_ways GROUP BY a)"""

_JSON = """
WITH good AS (SELECT DISTINCT export_id, payload::JSON AS j FROM graph_exports WHERE json_valid(payload)),
owners AS (
  SELECT export_id, 'node' AS kind, opos, x.key AS owner_id, x.value AS o
  FROM (SELECT export_id, unnest(range(len(m))) AS opos, unnest(m) AS x
        FROM (SELECT export_id, map_entries(CAST(j->'nodes' AS MAP(VARCHAR, JSON))) AS m FROM good WHERE json_type(j, '$.nodes') = 'OBJECT'))
  UNION ALL
  SELECT export_id, kind, opos, o->>'id', o FROM (
    SELECT export_id, kind, unnest(range(len(a))) AS opos, unnest(a) AS o FROM (
      SELECT export_id, 'node' AS kind, CAST(j->'nodes' AS JSON[]) AS a FROM good WHERE json_type(j, '$.nodes') = 'ARRAY'
      UNION ALL SELECT export_id, 'edge', CAST(j->'edges' AS JSON[]) FROM good WHERE json_type(j, '$.edges') = 'ARRAY'))),
columns AS (
  SELECT export_id, owner_id, opos, unnest(range(len(a))) AS pos, unnest(a) AS v
  FROM (SELECT export_id, owner_id, opos, CAST(o->'columns' AS JSON[]) AS a FROM owners WHERE kind = 'node' AND json_type(o, '$.columns') = 'ARRAY')),
mappings AS (
  SELECT export_id, owner_id, opos, unnest(range(len(a))) AS pos, unnest(a) AS v
  FROM (SELECT export_id, owner_id, opos, CAST(o->'column_mappings' AS JSON[]) AS a FROM owners WHERE kind = 'edge' AND json_type(o, '$.column_mappings') = 'ARRAY')),
sources AS (
  SELECT export_id, owner_id, opos, pos, unnest(range(len(a))) AS src_pos, unnest(a) AS item
  FROM (SELECT export_id, owner_id, opos, pos, CASE json_type(v, '$.source_columns') WHEN 'ARRAY' THEN CAST(v->'source_columns' AS VARCHAR[])
          WHEN 'VARCHAR' THEN [v->>'source_columns'] ELSE [] END AS a FROM mappings)),
found AS (
  SELECT export_id, owner_id, pos::BIGINT AS pos, (-1)::BIGINT AS src_pos, v->>'name' AS item, 'columns' AS entry FROM columns
  UNION ALL SELECT export_id, owner_id, pos::BIGINT, (-1)::BIGINT, v->>'target_column', 'mappings' FROM mappings
  UNION ALL SELECT export_id, owner_id, pos::BIGINT, src_pos::BIGINT, item, 'source_columns' FROM sources)"""



def _fields(of: str, *names: str) -> str:
    return ", ".join(f"{of}->>'{n}' AS {n}" for n in names)


def _listed(path: str) -> str:
    """The items of a plain list of the payload; a bare value is a list of one."""
    return f"""SELECT export_id, unnest(range(len(a))) AS pos, unnest(a) AS item FROM (SELECT export_id, CASE json_type(j, '{path}')
WHEN 'ARRAY' THEN CAST(json_extract(j, '{path}') AS VARCHAR[]) WHEN 'VARCHAR' THEN [json_extract_string(j, '{path}')] ELSE [] END AS a FROM good)"""


_STATS = ("total_nodes", "total_edges", "nodes_by_type", "orphan_nodes", "terminal_nodes", "truncated_nodes", "parse_errors")
_NODE = ("type", "dataset", "name", "source", "sql", "description", "status", "status_message")
_META = ", ".join(
    [f"json_extract_string(j, '$.metadata.{n}') AS {n}" for n in ("project_id", "generated_at", "description")]
    + [f"json_extract_string(j, '$.metadata.scan_config.{n}') AS scan_config_{n}" for n in ("target", "depth")]
    + [f"json_extract_string(j, '$.metadata.scan_stats.{n}') AS scan_stats_{n}" for n in _STATS]
)

SQL: dict[str, str] = {
    "p1_found": f"{_ORPHANS} SELECT snapshot_id, edge_id, field, ref, kind FROM found",
    "p1_report": f"{_ORPHANS} SELECT snapshot_id, field, kind, count(*) AS n_refs, count(DISTINCT ref) AS n_keys FROM found GROUP BY ALL",
    "p2_found": f"{_CHANGES} SELECT snapshot_id, entity, record_id, change FROM found",
    "p2_counts": f"{_CHANGES} SELECT snapshot_id, entity, change, count(*) AS n FROM found GROUP BY ALL",
    "p5_found": f"""{_CLOSURE} SELECT 'root' AS kind, root_id, node_id, depth FROM near WHERE depth > 0
UNION ALL SELECT 'cycle', root_id, node_id, depth FROM cycles""",
    "p5_descendants": f"""{_LINKS} SELECT root_id, count(*) AS n_descendants, max(depth) AS max_depth
FROM near WHERE depth > 0 GROUP BY root_id""",
    "p5_pairs": f"""{_LINKS},
far(a, n, d) AS (SELECT DISTINCT p, p, 0 FROM links UNION SELECT f.a, l.c, f.d + 1 FROM far f JOIN links l ON l.p = f.n WHERE f.d < 40)
SELECT a AS node_id, n AS descendant_id, min(d)::BIGINT AS depth FROM far WHERE a <> n GROUP BY a, n""",
    "p5_paths": f"""{_LINKS},
ways(r, n, d, path) AS (
  SELECT r, r, 0, [r] FROM roots
  UNION SELECT w.r, l.c, w.d + 1, list_append(w.path, l.c) FROM ways w JOIN links l ON l.p = w.n
  JOIN near k ON k.root_id = w.r AND k.node_id = l.c AND k.depth = w.d + 1)
SELECT r AS root_id, n AS node_id, d::BIGINT AS depth, array_to_string(min(path), ' > ') AS path FROM ways GROUP BY r, n, d""",
    "p6_found": f"{_JSON} SELECT export_id, owner_id, pos, src_pos, item FROM found",
    "p6_metadata": f"{_JSON} SELECT export_id, {_META} FROM good",
    "p6_datasets": f"{_JSON} {_listed('$.metadata.scan_config.datasets')}",
    "p6_prune_points": f"{_JSON} {_listed('$.prune_points')}",
    "p6_nodes": f"{_JSON} SELECT export_id, opos AS pos, owner_id AS id, {_fields('o', *_NODE)} FROM owners WHERE kind = 'node'",
    "p6_edges": f"{_JSON} SELECT export_id, opos AS pos, owner_id AS id, {_fields('o', 'source_node', 'target_node', 'edge_type', 'description')} FROM owners WHERE kind = 'edge'",
    "p6_columns": f"{_JSON} SELECT export_id, owner_id AS node_id, opos AS node_pos, pos, {_fields('v', 'name', 'data_type', 'lineage_status')} FROM columns",
    "p6_mappings": f"""{_JSON} SELECT export_id, owner_id AS edge_id, opos AS edge_pos, pos,
{_fields('v', 'target_column', 'transformation', 'expression', 'description')} FROM mappings""",
    "p6_source_columns": f"{_JSON} SELECT export_id, owner_id AS edge_id, opos AS edge_pos, pos AS mapping_pos, src_pos AS pos, item FROM sources",
    "p6_tables": f"""{_JSON} SELECT export_id, entry, count(*) AS n FROM
(SELECT export_id, entry FROM found UNION ALL SELECT export_id, kind || 's' FROM owners) GROUP BY ALL""",
}
