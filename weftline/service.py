"""What a lineage server's routes do, without a web server: one project's graph, its scans and edits.

Every change is saved before the call returns, so a new service over the same folder goes on from it.
Refusals are :class:`EditError` with the matching HTTP status.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import LineageGraph, ScanConfig
from weftline.operators import edit
from weftline.operators.edit import EditError, ScanLock
from weftline.sources import catalog, store
from weftline.streaming.events import EventLog, reset

Catalogue = tuple[DataFrame, DataFrame]


class LineageService:
    """``catalogue`` gives (nodes, columns) of the warehouse; without one nothing can be scanned."""

    def __init__(self, spark: SparkSession, root: str, project: str, catalogue: Callable[[], Catalogue] | None = None, no_scan: bool = False):
        self.spark, self.project, self.catalogue, self.no_scan = spark, project, catalogue, no_scan
        self.root = f"{root.rstrip('/')}/{project}"
        self.lock = ScanLock()
        self.current = store.load_graph(spark, f"{self.root}/current")

    # -- reading

    def health(self) -> dict:
        return {
            "status": "ok", "project_id": self.project, "no_scan": self.no_scan, "catalogue_connected": self.catalogue is not None,
            "has_graph": self.current is not None, "scan_in_progress": self.lock.held,
        }

    def graph_json(self) -> str:
        """The graph as JSON; an empty shape if there is none."""
        return store.export_json(self.current) if self.current is not None else '{"metadata": null, "nodes": {}, "edges": []}'

    def _connected(self) -> Catalogue:
        if self.catalogue is None:
            raise EditError(503, "No catalogue is connected")
        return self.catalogue()

    def datasets(self) -> DataFrame:
        return catalog.list_datasets(self._connected()[0])

    def tables(self, dataset: str) -> DataFrame:
        return catalog.list_tables(self._connected()[0], dataset)

    def columns(self, dataset: str, table: str) -> DataFrame:
        return catalog.columns_of(self._connected()[1], f"{dataset}.{table}").orderBy("ordinal")

    # -- scans

    def events(self) -> str:
        return f"{self.root}/events"

    def _run(self, what: str, work: Callable[[Callable[[str, str], None]], LineageGraph]) -> LineageGraph:
        """One scan at a time; its events end with ``complete`` or ``error``."""
        if self.no_scan:
            raise EditError(400, "Scans are switched off")
        self._connected()
        with self.lock:
            reset(self.spark, self.events())
            log, began = EventLog(self.spark, self.events()), time.monotonic()
            try:
                self._keep(work(log.publish))
            except Exception as e:
                log.publish("error", f"{what} failed: {type(e).__name__}: {e}"[:1000])
                raise
            log.publish("complete", f"{what} complete in {time.monotonic() - began:.1f} s: {self.current.nodes.count()} nodes, {self.current.edges.count()} edges")
            return self.current

    def _keep(self, graph: LineageGraph) -> LineageGraph:
        self.current = store.save_graph(graph, f"{self.root}/current")
        return self.current

    def scan(self, config: ScanConfig | None = None, merge: bool = False) -> LineageGraph:
        """Scan a target, datasets or, without either, the whole project; ``merge`` adds to the graph there is."""
        config = config or ScanConfig()
        if merge and self.current is not None:
            return self._run("Merge", lambda p: edit.merge_scan(self.current, self._connected(), config, p))
        return self._run("Scan", lambda p: edit.full_scan(self._connected(), config, self.project, self.current, p))

    def expand(self, node_id: str, depth: int = 1) -> LineageGraph:
        self._graph()
        return self._run("Expansion", lambda p: edit.expand_node(self.current, self._connected(), node_id, depth, p))

    # -- edits

    def _graph(self) -> LineageGraph:
        if self.current is None:
            raise EditError(400, "No graph loaded")
        return self.current

    def create_edge(self, source: str, target: str, mappings: list[dict] | None = None, description: str | None = None) -> str:
        graph, edge_id = edit.create_manual_edge(self._graph(), source, target, mappings, description)
        self._keep(graph)
        return edge_id

    def update_edge(self, edge_id: str, **changes: object) -> None:
        self._keep(edit.update_manual_edge(self._graph(), edge_id, **changes))

    def delete_edge(self, edge_id: str) -> None:
        self._keep(edit.delete_manual_edge(self._graph(), edge_id))

    def edge(self, edge_id: str) -> dict:
        """One edge with its mappings."""
        found = self._graph().edges.where(F.col("edge_id") == edge_id).limit(1).collect()
        if not found:
            raise EditError(404, f"Edge {edge_id} not found")
        maps = self.current.mappings.where(F.col("edge_id") == edge_id).drop("edge_id", "source_node", "target_node").orderBy("target_column")
        return {**found[0].asDict(), "column_mappings": [r.asDict() for r in maps.collect()]}

    def set_prune_points(self, points: object) -> None:
        self._keep(edit.set_prune_points(self._graph(), points))

    # -- named scans

    def scans(self) -> list[dict]:
        return store.list_scans(self.spark, self.root)

    def save_scan(self, name: str, overwrite: bool = False) -> int:
        return store.save_scan(self._graph(), self.root, name, overwrite)

    def load_scan(self, name: str) -> LineageGraph:
        self.current = store.load_scan(self.spark, self.root, name)
        return self.current

    def delete_scan(self, name: str) -> None:
        store.delete_scan(self.spark, self.root, name)
