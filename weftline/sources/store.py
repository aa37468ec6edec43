"""Saving and loading graphs, named scans, and exports."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import COLUMNS, EDGES, MAPPINGS, NODES, LineageGraph
from weftline.operators.edit import EditError
from weftline.operators.graph import graph_stats

TABLES = {"nodes": NODES, "columns": COLUMNS, "edges": EDGES, "mappings": MAPPINGS}
#: Fixed value: what a scan may be called.
SCAN_NAME = re.compile(r"^[\w\-]+$")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete saves of a graph, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(p)]
    numbers = sorted(int(n.removeprefix("v")) for n in names if re.fullmatch(r"v\d+", n))
    return [n for n in numbers if fs.exists(_fs(spark, f"{_version(path, n)}/graph.json")[1])]


def _version(path: str, number: int) -> str:
    return f"{path}/v{number:010}"


def save_graph(graph: LineageGraph, path: str) -> LineageGraph:
    """Save as a new version and return the graph as saved.

    A version holds one Parquet table for each part and a metadata file, which appears last and whole
    and makes the version valid: a save that breaks off leaves the one before.  The version before is
    kept, since the saved graph may still be read from it; older ones are deleted.
    """
    spark = graph.spark
    before = _versions(spark, path)
    target = _version(path, before[-1] + 1 if before else 1)
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{target}/{name}")
    meta = {"metadata": graph.metadata, "prune_points": graph.prune_points, "parse_errors": graph.parse_errors}
    _write_text(spark, f"{target}/.graph.json.tmp", json.dumps(meta))
    fs, part = _fs(spark, f"{target}/.graph.json.tmp")
    fs.rename(part, _fs(spark, f"{target}/graph.json")[1])
    for number in before[:-1]:
        fs.delete(_fs(spark, _version(path, number))[1], True)
    return load_graph(spark, path) or graph


def _metadata(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """Folder and metadata of the newest version; None if there is none."""
    found = _versions(spark, path)
    if not found:
        return None
    folder = _version(path, found[-1])
    return folder, json.loads(_read_text(spark, f"{folder}/graph.json") or "")


def load_graph(spark: SparkSession, path: str) -> LineageGraph | None:
    """A saved graph; None if there is none or it cannot be read."""
    try:
        if (found := _metadata(spark, path)) is None:
            return None
        folder, meta = found
        parts = [spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()]
        return LineageGraph(*parts, meta.get("prune_points") or [], meta.get("metadata") or {}, meta.get("parse_errors") or 0)
    except Exception:
        return None


def _scan_path(root: str, name: str) -> str:
    if not SCAN_NAME.match(name or ""):
        raise EditError(422, "Scan names hold letters, digits, _ and - only")
    return f"{root}/scans/name={name}"


def list_scans(spark: SparkSession, root: str) -> list[dict]:
    """Saved scans by name, with what their metadata tells; only the name of one that cannot be read."""
    fs, p = _fs(spark, f"{root}/scans")
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName().removeprefix("name=")
        entry = {"name": name}
        try:
            entry |= _metadata(spark, f"{root}/scans/name={name}")[1]["metadata"]
        except (ValueError, KeyError, TypeError):
            pass
        out.append(entry)
    return sorted(out, key=lambda e: e["name"])


def scan_exists(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _fs(spark, _scan_path(root, name))
    return fs.exists(p)


def save_scan(graph: LineageGraph, root: str, name: str, overwrite: bool = False) -> int:
    """Save under a name; 201 if new, 200 if replaced, refused with 409 if it exists and may not be."""
    there = scan_exists(graph.spark, root, name)
    if there and not overwrite:
        raise EditError(409, f"Scan {name} exists")
    save_graph(graph, _scan_path(root, name))
    return 200 if there else 201


def load_scan(spark: SparkSession, root: str, name: str) -> LineageGraph:
    """A named scan, which also becomes the current graph of ``root``."""
    graph = load_graph(spark, _scan_path(root, name))
    if graph is None:
        raise EditError(404, f"Scan {name} not found")
    return save_graph(graph, f"{root}/current")


def delete_scan(spark: SparkSession, root: str, name: str) -> None:
    if not scan_exists(spark, root, name):
        raise EditError(404, f"Scan {name} not found")
    fs, p = _fs(spark, _scan_path(root, name))
    fs.delete(p, True)


# -- JSON


def node_json(graph: LineageGraph) -> DataFrame:
    """(node_id, json): each node with its ordered columns, as saved graph files hold it under its id."""
    cols = graph.columns.groupBy("node_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "name", "data_type", "lineage_status"))).alias("cs")
    )
    plain = F.transform(F.coalesce("cs", F.array().cast("array<struct<ordinal:int,name:string,data_type:string,lineage_status:string>>")),
                        lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"), c["lineage_status"].alias("lineage_status")))
    full = graph.nodes.join(cols, "node_id", "left")
    body = F.struct("type", "dataset", "name", plain.alias("columns"), "source", "sql", "description", "status", "status_message")
    return full.select("node_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def edge_json(graph: LineageGraph) -> DataFrame:
    """(edge_id, json): each edge with its mappings by target column."""
    one = F.struct("target_column", "source_columns", "transformation", "expression", "description")
    maps = graph.mappings.groupBy("edge_id").agg(F.sort_array(F.collect_list(one)).alias("ms"))
    full = graph.edges.join(maps, "edge_id", "left")
    none = F.array().cast("array<struct<target_column:string,source_columns:array<string>,transformation:string,expression:string,description:string>>")
    body = F.struct(F.col("edge_id").alias("id"), "source_node", "target_node", "edge_type", "description", F.coalesce("ms", none).alias("column_mappings"))
    return full.select("edge_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def export_json(graph: LineageGraph) -> str:
    """The whole graph as one JSON text; meant for graphs that a file viewer can open."""
    nodes = {r.node_id: json.loads(r.json) for r in node_json(graph).orderBy("node_id").toLocalIterator()}
    edges = [json.loads(r.json) for r in edge_json(graph).orderBy("edge_id").toLocalIterator()]
    stats = graph_stats(graph).collect()[0].asDict(recursive=True)
    out = {"metadata": {**graph.metadata, "scan_stats": stats}, "nodes": nodes, "edges": edges}
    if graph.prune_points:
        out["prune_points"] = graph.prune_points
    return json.dumps(out, ensure_ascii=False)


def import_json(spark: SparkSession, text: str) -> LineageGraph | None:
    """A graph from its JSON text; absent keys take their defaults, text that is not such a graph gives None."""
    try:
        raw = json.loads(text)
        nodes, cols, edges, maps = [], [], [], []
        for node_id, n in (raw.get("nodes") or {}).items():
            dataset, _, name = node_id.partition(".")
            nodes.append((node_id, n.get("type", "table"), n.get("dataset", dataset), n.get("name", name), n.get("source", "unknown"),
                          n.get("sql"), n.get("description"), n.get("status", "ok"), n.get("status_message")))
            for i, c in enumerate(n.get("columns") or []):
                cols.append((node_id, i, c["name"], c["name"].lower(), c.get("data_type", "STRING"), c.get("lineage_status", "resolved")))
        for e in raw.get("edges") or []:
            ends = e["id"], e["source_node"], e["target_node"]
            edges.append((*ends, e.get("edge_type", "automatic"), e.get("description")))
            for m in e.get("column_mappings") or []:
                maps.append((*ends, m["target_column"], list(m.get("source_columns") or []), m.get("transformation", "unknown"), m.get("expression"), m.get("description")))
        parts = [spark.createDataFrame(rows, schema) for rows, schema in zip((nodes, cols, edges, maps), TABLES.values(), strict=True)]
        stats = (raw.get("metadata") or {}).get("scan_stats") or {}
        return LineageGraph(*parts, raw.get("prune_points") or [], raw.get("metadata") or {}, stats.get("parse_errors") or 0)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


# -- diagrams and reports


def _safe(column):
    return F.regexp_replace(column, "[^A-Za-z0-9_]", "_")


def mermaid_lines(graph: LineageGraph, detailed: bool = False) -> DataFrame:
    """(part, id, line): the lines of a flowchart, nodes before edges, in order of (part, id)."""
    quote = F.lit('"')
    escaped = F.replace(F.col("node_id"), quote, F.lit("&quot;"))
    nodes = graph.nodes.select("node_id", escaped.alias("label"))
    if detailed:
        names = graph.columns.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("cs"))
        list_text = F.array_join(F.transform("cs", lambda c: F.replace(c["name"], quote, F.lit("&quot;"))), "<br/>")
        nodes = nodes.join(names, "node_id", "left").select("node_id", F.concat_ws("<br/>", "label", list_text).alias("label"))
    lines = nodes.select(
        F.lit(0).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit("  "), _safe(F.col("node_id")), F.lit('["'), "label", F.lit('"]')).alias("line")
    )
    arrow = F.when(F.col("edge_type") == "manual", " -.-> ").otherwise(" --> ")
    links = graph.edges.select(
        F.lit(1).alias("part"), F.col("edge_id").alias("id"), F.concat(F.lit("  "), _safe(F.col("source_node")), arrow, _safe(F.col("target_node"))).alias("line")
    )
    return lines.unionByName(links)


def export_mermaid(graph: LineageGraph, detailed: bool = False) -> str:
    """A flowchart text of a graph small enough to draw."""
    rows = mermaid_lines(graph, detailed).orderBy("part", "id").collect()
    return "\n".join(["flowchart LR", *(r.line for r in rows)])


def scan_report(graph: LineageGraph, errors: list[str] | None = None) -> str:
    """A console report of a scan: totals, kinds, what is missing, and errors."""
    s = graph_stats(graph).collect()[0]
    kinds = ", ".join(f"{k}: {v}" for k, v in sorted((s.nodes_by_type or {}).items()))
    lines = [
        f"Project: {graph.metadata.get('project_id', '')}",
        f"Nodes: {s.total_nodes} ({kinds})",
        f"Edges: {s.total_edges}",
        f"Orphans: {s.orphan_nodes}, terminal: {s.terminal_nodes}, truncated: {s.truncated_nodes}, parse errors: {s.parse_errors}",
    ]
    config = graph.metadata.get("scan_config") or {}
    told = [f"{k}={v}" for k, v in config.items() if v]
    lines[1:1] = [f"Scan of: {', '.join(told)}"] if told else []
    for r in graph.nodes.where("status <> 'ok'").groupBy("status").count().orderBy("status").collect():
        lines.append(f"Nodes with status {r.status}: {r['count']}")
    weak = graph.nodes.where("status <> 'ok'").select("node_id", "status", "status_message").orderBy("node_id")
    lines += [f"  {r.status}: {r.node_id} {r.status_message or ''}".rstrip() for r in weak.toLocalIterator()]
    lines += [f"  error: {e}" for e in errors or []]
    return "\n".join(lines)


def log_report(graph: LineageGraph, errors: list[str] | None = None, log: logging.Logger | None = None) -> None:
    """The totals of a scan in the log: what needs looking at as warnings, the rest as information."""
    log = log or logging.getLogger("weftline")
    s = graph_stats(graph).collect()[0]
    log.info("graph of %d nodes and %d edges; by type: %s", s.total_nodes, s.total_edges, dict(s.nodes_by_type or {}))
    for level, text, n in (
        (logging.WARNING, "without any edge", s.orphan_nodes),
        (logging.INFO, "that feed nothing", s.terminal_nodes),
        (logging.INFO, "cut off by the scan's limits", s.truncated_nodes),
        (logging.WARNING, "whose SQL gave no lineage", s.parse_errors),
    ):
        if n:
            log.log(level, "nodes %s: %d", text, n)
    for error in errors or []:
        log.warning("scan error: %s", error)


def with_prune_points(graph: LineageGraph, points: list[str]) -> LineageGraph:
    return replace(graph, prune_points=points)
