"""Manual edges, prune points, and growing a graph by merging or expanding scans."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import EDGES, MAPPINGS, LineageGraph, ScanConfig
from weftline.operators.graph import build_graph
from weftline.operators.scan import ScanResult, resolve_references, run_scan
from weftline.plans.lineage import view_references


#: An argument that was not given, where None is a value.
UNSET = object()
Progress = Callable[[str, str], None]


def silent(kind: str, message: str = "") -> None:
    """Progress that nobody follows."""


class EditError(Exception):
    """A refused edit; ``status`` is the matching HTTP status."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _mapping_rows(edge_id: str, source: str, target: str, mappings: list[dict]) -> list[tuple]:
    """Rows of a mapping payload; a mapping must name its target column, the rest has defaults."""
    out = []
    for m in mappings:
        if not m.get("target_column"):
            raise EditError(422, "target_column is required")
        kind = m.get("transformation") or "unknown"
        out.append((edge_id, source, target, m["target_column"], list(m.get("source_columns") or []), kind, m.get("expression"), m.get("description")))
    return out


def create_manual_edge(
    graph: LineageGraph | None, source: str, target: str, mappings: list[dict] | None = None, description: str | None = None
) -> tuple[LineageGraph, str]:
    """The graph with one more manual edge, and the edge's id (``manual_a__b``, with _2, _3 ... if taken)."""
    if graph is None:
        raise EditError(400, "No graph loaded")
    if not source or not target:
        raise EditError(422, "source_node and target_node are required")
    have = {r.node_id for r in graph.nodes.where(F.col("node_id").isin(source, target)).select("node_id").distinct().collect()}
    if gone := [end for end in (source, target) if end not in have]:
        raise EditError(404, f"Nodes not found: {', '.join(gone)}")
    base = f"manual_{source}__{target}"
    near = F.col("edge_id") == base
    numbered = F.col("edge_id").startswith(f"{base}_") & F.col("edge_id").substr(F.lit(len(base) + 2), F.length("edge_id")).rlike(r"^\d+$")
    taken = {r.edge_id for r in graph.edges.where(near | numbered).select("edge_id").collect()}
    edge_id, n = base, 2
    while edge_id in taken:
        edge_id, n = f"{base}_{n}", n + 1
    edges = graph.spark.createDataFrame([(edge_id, source, target, "manual", description)], EDGES)
    maps = graph.spark.createDataFrame(_mapping_rows(edge_id, source, target, mappings or []), MAPPINGS)
    return replace(graph, edges=graph.edges.unionByName(edges), mappings=graph.mappings.unionByName(maps)), edge_id


def _manual(graph: LineageGraph, edge_id: str):
    rows = graph.edges.where((F.col("edge_id") == edge_id) & (F.col("edge_type") == "manual")).limit(1).collect()
    if not rows:
        raise EditError(404, f"Manual edge {edge_id} not found")
    return rows[0]


def update_manual_edge(graph: LineageGraph, edge_id: str, description: object = UNSET, mappings: list[dict] | None = None) -> LineageGraph:
    """Change a manual edge's description, mappings or both; automatic edges cannot be addressed.

    A description of None removes the one there is.
    """
    row = _manual(graph, edge_id)
    edges, maps = graph.edges, graph.mappings
    if description is not UNSET:
        text = F.when(F.col("edge_id") == edge_id, F.lit(description).cast("string")).otherwise(F.col("description"))
        edges = edges.withColumn("description", text)
    if mappings is not None:
        new = graph.spark.createDataFrame(_mapping_rows(edge_id, row.source_node, row.target_node, mappings), MAPPINGS)
        maps = maps.where(F.col("edge_id") != edge_id).unionByName(new)
    return replace(graph, edges=edges, mappings=maps)


def delete_manual_edge(graph: LineageGraph, edge_id: str) -> LineageGraph:
    _manual(graph, edge_id)
    other = F.col("edge_id") != edge_id
    return replace(graph, edges=graph.edges.where(other), mappings=graph.mappings.where(other))


def default_mappings(columns: DataFrame, source: str, target: str) -> list[dict]:
    """Mappings offered for a new manual edge: columns of equal name are direct, others unknown; one blank row if the target has none."""
    names = columns.where(F.col("node_id").isin(source, target)).select("node_id", "ordinal", "name").orderBy("ordinal").collect()
    have = {r.name for r in names if r.node_id == source}
    wanted = [r.name for r in names if r.node_id == target]
    if not wanted:
        return [{"target_column": "", "source_columns": [], "transformation": "unknown"}]
    return [
        {"target_column": c, "source_columns": [c] if c in have else [], "transformation": "direct" if c in have else "unknown"}
        for c in wanted
    ]


def matched_columns(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_node, target_node, target_column, source_column, transformation) of :func:`default_mappings` for many pairs at once."""
    wanted = pairs.join(columns.select(F.col("node_id").alias("target_node"), F.col("name").alias("target_column")), "target_node")
    have = columns.select(F.col("node_id").alias("source_node"), F.col("name").alias("source_column")).distinct()
    hit = (wanted.source_node == have.source_node) & (wanted.target_column == have.source_column)
    out = wanted.join(have, hit, "left")
    return out.select(
        wanted.source_node, "target_node", "target_column", "source_column",
        F.when(F.col("source_column").isNotNull(), "direct").otherwise("unknown").alias("transformation"),
    )


def clean_mappings(source: str, target: str, mappings: list[dict]) -> list[dict]:
    """Rows fit to be saved: blanks trimmed and dropped, ends distinct, at least one target column."""
    if not source or not target or source == target:
        raise EditError(422, "Choose two different nodes")
    out = []
    for m in mappings:
        name = (m.get("target_column") or "").strip()
        if name:
            out.append({**m, "target_column": name, "source_columns": [c.strip() for c in m.get("source_columns") or [] if c and c.strip()]})
    if not out:
        raise EditError(422, "Name at least one target column")
    return out


def set_prune_points(graph: LineageGraph | None, points: object) -> LineageGraph:
    """Replace the prune points; they need not be nodes of the graph."""
    if graph is None:
        raise EditError(400, "No graph loaded")
    if not isinstance(points, list):
        raise EditError(422, "prune_points must be a list")
    return replace(graph, prune_points=[str(p) for p in points])


def _scanned(catalogue: tuple[DataFrame, DataFrame], config: ScanConfig, progress: Progress) -> ScanResult:
    nodes, _ = catalogue
    return run_scan(nodes, resolve_references(view_references(nodes), nodes), config, progress)


def full_scan(
    catalogue: tuple[DataFrame, DataFrame],
    config: ScanConfig,
    project: str = "",
    before: LineageGraph | None = None,
    progress: Progress = silent,
) -> LineageGraph:
    """Scan and build anew; manual edges of the graph before are kept where their nodes still exist, prune points are not."""
    found = _scanned(catalogue, config, progress).nodes
    manual = _only(before, "manual") if before is not None else None
    columns = catalogue[1].join(found.select("node_id"), "node_id", "left_semi")
    return build_graph(found, columns, config, project, manual, progress=progress)


def _only(graph: LineageGraph, kind: str) -> LineageGraph:
    edges = graph.edges.where(F.col("edge_type") == kind)
    return replace(graph, edges=edges, mappings=graph.mappings.join(edges.select("edge_id"), "edge_id", "left_semi"))


def overlay(
    graph: LineageGraph, nodes: DataFrame, columns: DataFrame, config: ScanConfig | None = None, progress: Progress = silent
) -> LineageGraph:
    """Newly scanned nodes laid over a graph: they replace nodes of their id, and what they touch is parsed again.

    Parsed are the new nodes and the targets of automatic edges out of them; other automatic edges
    are carried over, manual edges and prune points kept.
    """
    fresh = nodes.select("node_id")
    rest = graph.nodes.join(fresh, "node_id", "left_anti").select(*graph.nodes.columns)
    all_nodes = nodes.select(*graph.nodes.columns).unionByName(rest)
    old_cols = graph.columns.join(fresh, "node_id", "left_anti").select(*graph.columns.columns)
    all_cols = columns.join(fresh, "node_id", "left_semi").select(*graph.columns.columns).unionByName(old_cols)
    auto = _only(graph, "automatic")
    touched = auto.edges.join(fresh.withColumnRenamed("node_id", "source_node"), "source_node", "left_semi")
    again = fresh.unionByName(touched.select(F.col("target_node").alias("node_id"))).distinct()
    stay = auto.edges.join(again.withColumnRenamed("node_id", "target_node"), "target_node", "left_anti").select(*graph.edges.columns)
    carried = replace(auto, edges=stay, mappings=auto.mappings.join(stay.select("edge_id"), "edge_id", "left_semi").select(*graph.mappings.columns))
    built = build_graph(all_nodes, all_cols, config, graph.metadata.get("project_id", ""), _only(graph, "manual"), again, carried, progress=progress)
    return replace(built, prune_points=graph.prune_points)


def merge_scan(
    graph: LineageGraph | None, catalogue: tuple[DataFrame, DataFrame], config: ScanConfig, progress: Progress = silent
) -> LineageGraph:
    """Scan more and merge: the configuration becomes the union of datasets without target or depth."""
    if graph is None:
        raise EditError(400, "No graph loaded")
    found = _scanned(catalogue, config, progress).nodes
    old = graph.metadata.get("scan_config") or {}
    both = tuple(sorted({*(old.get("datasets") or []), *config.datasets}))
    return overlay(graph, found, catalogue[1], ScanConfig(datasets=both), progress)


def expand_node(
    graph: LineageGraph | None, catalogue: tuple[DataFrame, DataFrame], node_id: str, depth: int = 1, progress: Progress = silent
) -> LineageGraph:
    """Scan on from a truncated node, within the datasets of the graph's own scan and the node's."""
    if graph is None:
        raise EditError(400, "No graph loaded")
    if not node_id:
        raise EditError(422, "node_id is required")
    rows = graph.nodes.where(F.col("node_id") == node_id).select("status", "dataset").limit(1).collect()
    if not rows:
        raise EditError(404, f"Node {node_id} not found")
    if rows[0].status != "truncated":
        raise EditError(400, f"Node {node_id} is not truncated")
    old = graph.metadata.get("scan_config") or {}
    datasets = tuple(sorted({*(old.get("datasets") or []), rows[0].dataset})) if old.get("datasets") else ()
    found = _scanned(catalogue, ScanConfig(node_id, datasets, depth), progress).nodes
    real = found.where("status <> 'truncated'").unionByName(
        found.where("status = 'truncated'").join(graph.nodes.select("node_id"), "node_id", "left_anti")
    )
    built = overlay(graph, real, catalogue[1], progress=progress)
    return replace(built, metadata={**built.metadata, "scan_config": old})


class ScanLock:
    """One scan at a time: claimed when it is accepted, so that two requests cannot both begin."""

    def __init__(self) -> None:
        self._lock = threading.Lock()

    @property
    def held(self) -> bool:
        return self._lock.locked()

    def __enter__(self) -> ScanLock:
        if not self._lock.acquire(blocking=False):
            raise EditError(409, "A scan is already in progress")
        return self

    def __exit__(self, *_: object) -> None:
        self._lock.release()
