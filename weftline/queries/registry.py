"""All queries of the core and the SQL to hold them against."""

from __future__ import annotations

from weftline.queries import graph, graph_sql, problem_sql, problems, views


def queries() -> dict:
    return {**problems.QUERIES, **graph.QUERIES, **views.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**problem_sql.SQL, **graph_sql.SQL, **views.SQL}
