import json
import logging

import pytest
from pyspark.sql import functions as F

from test_graph import make, node, rows
from weftline.model import ScanConfig
from weftline.operators import filters
from weftline.operators.edit import EditError
from weftline.operators.scan import resolve_references, run_scan
from weftline.service import LineageService
from weftline.sources import store
from weftline.streaming.events import EventLog, follow, read_events, reset


@pytest.fixture(scope="module")
def catalogue(spark):
    nodes = [node("a.v", "SELECT k FROM b.v"), node("b.v", "SELECT k FROM c.t"), node("c.t"), node("z.t")]
    g = make(spark, nodes, {n[0]: ["k"] for n in nodes})
    return lambda: (g.nodes, g.columns)


def refused(status, call):
    with pytest.raises(EditError) as e:
        call()
    assert e.value.status == status


def test_edits_last(spark, tmp_path, catalogue):
    service = LineageService(spark, str(tmp_path), "p", catalogue)
    assert service.health()["has_graph"] is False and json.loads(service.graph_json()) == {"metadata": None, "nodes": {}, "edges": []}
    service.scan()
    first = service.create_edge("c.t", "a.v", [{"target_column": "k"}], "by hand")
    second = service.create_edge("c.t", "a.v")
    assert second == f"{first}_2"
    service.set_prune_points(["a.v"])
    again = LineageService(spark, str(tmp_path), "p", catalogue)  # as after a restart
    assert again.current.nodes.count() == 4 and again.current.prune_points == ["a.v"]
    assert again.edge(first)["column_mappings"] == [
        {"target_column": "k", "source_columns": [], "transformation": "unknown", "expression": None, "description": None}
    ]
    again.update_edge(first, mappings=[{"target_column": "k", "source_columns": ["k"], "transformation": "direct"}])
    assert again.edge(first)["description"] == "by hand" and again.edge(first)["column_mappings"][0]["transformation"] == "direct"
    again.update_edge(first, description=None)
    again.delete_edge(second)
    third = LineageService(spark, str(tmp_path), "p")
    assert third.edge(first)["description"] is None and third.current.nodes.count() == 4 and third.current.edges.count() == 3
    refused(404, lambda: third.delete_edge(second))
    refused(404, lambda: third.delete_edge("edge_b.v__a.v"))
    refused(422, lambda: third.create_edge("c.t", "a.v", [{"source_columns": ["k"]}]))
    refused(404, lambda: third.create_edge("c.t", "no.no"))
    refused(503, third.datasets)
    refused(503, third.scan)
    assert {r.dataset for r in again.datasets().collect()} == {"a", "b", "c", "z"} and [r.name for r in again.columns("c", "t").collect()] == ["k"]


def test_a_broken_save_leaves_the_one_before(spark, tmp_path, catalogue):
    service = LineageService(spark, str(tmp_path), "p", catalogue)
    graph = service.scan(ScanConfig("a.v"))
    bad = store.replace(graph, edges=graph.edges.withColumn("edge_id", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        store.save_graph(bad, f"{service.root}/current")
    assert rows(store.load_graph(spark, f"{service.root}/current").nodes.select("node_id")) == [("a.v",), ("b.v",), ("c.t",)]


def test_events_of_scans_in_order(spark, tmp_path, catalogue):
    service = LineageService(spark, str(tmp_path), "p", catalogue)
    refused(400, lambda: service.expand("a.v"))
    service.scan(ScanConfig(datasets=("a",), depth=1))

    def kinds():
        return [r.type for r in read_events(spark, service.events()).orderBy("seq").collect()]

    assert list(dict.fromkeys(kinds())) == ["scan_start", "scan_dataset", "scan_node", "scan_complete", "build_sort", "build_parse", "build_complete", "complete"]
    service.expand("c.t")
    assert service.current.nodes.where("status = 'truncated'").count() == 0
    service.scan(ScanConfig(datasets=("z",)), merge=True)
    assert kinds()[-1] == "complete" and service.current.nodes.count() == 4
    refused(400, lambda: service.expand("a.v"))
    assert kinds()[-1] == "error"
    with service.lock:
        assert service.health()["scan_in_progress"]
        refused(409, service.scan)
    refused(400, LineageService(spark, str(tmp_path), "p", catalogue, no_scan=True).scan)
    assert service.save_scan("one") == 201 and [s["name"] for s in service.scans()] == ["one"]
    service.load_scan("one")
    service.delete_scan("one")
    refused(404, lambda: service.load_scan("one"))


def test_follow_in_small_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    EventLog(spark, path, "old").publish("complete")
    reset(spark, path)
    log = EventLog(spark, path, "s")
    for _ in range(9):
        log.publish("scan_node")
    seen, idle = [], []
    with pytest.raises(FileNotFoundError):
        open(f"{path}/old-000000.json")
    follow(spark, path, seen.extend, str(tmp_path / "cp"), 6, lambda: idle.append(1), 0.5, files=2)
    assert len(seen) == 9 and idle


def test_reports_are_whole(spark, catalogue, caplog):
    nodes = [node(f"d.n{i:03}", status="error") for i in range(130)]
    g = make(spark, nodes, {})
    assert store.scan_report(g).count("error: d.n") == 130
    with caplog.at_level(logging.INFO, "weftline"):
        store.log_report(g, ["gone"])
    assert "130 nodes" in caplog.text and "gone" in caplog.text


def test_shortest_hops_and_order_of_listing(spark):
    g = make(spark, [node(n) for n in ("a.v", "b.x", "a.y", "c.t", "b.w")], {})
    flat = [("a.v", 0, "b.x", "b"), ("a.v", 1, "a.y", "a"), ("b.x", 0, "c.t", "c"), ("a.y", 0, "c.t", "c"), ("c.t", 0, "d.u", "d")]
    refs = spark.createDataFrame(flat, "node_id string, ord int, ref_id string, ref_dataset string")
    first = {r.node_id: r.status_message for r in run_scan(g.nodes, refs, ScanConfig("a.v", depth=2)).nodes.collect()}
    least = {r.node_id: r.status_message for r in run_scan(g.nodes, refs, ScanConfig("a.v", depth=2), shortest=True).nodes.collect()}
    assert first["d.u"] == "Depth limit reached (3 dataset hops > 2)" and least["d.u"] == "Table d.u not found"
    # datasets in the order given: the reference out of b comes first
    refs = spark.createDataFrame([("a.v", 0, "e.t", "e"), ("b.x", 0, "b.gone", "b"), ("b.gone", 0, "e.t", "e")], "node_id string, ord int, ref_id string, ref_dataset string")
    got = run_scan(g.nodes, refs, ScanConfig(datasets=("b", "a"), depth=0))
    assert {r.node_id: r.status for r in got.nodes.collect()} == {"a.v": "ok", "a.y": "ok", "b.x": "ok", "b.w": "ok", "e.t": "truncated", "b.gone": "error"}


def test_project_before_a_dataset(spark):
    g = make(spark, [node("a.v", "x")], {})
    refs = spark.createDataFrame([("a.v", 0, "p.b", "t"), ("a.v", 1, "q.b", "t"), ("a.v", 2, None, "u")], "node_id string, ord int, ref_dataset string, ref_table string")
    assert {r.ref_id for r in resolve_references(refs, g.nodes, "p").collect()} == {"b.t", "q.b.t", "a.u"}
    assert {r.ref_id for r in resolve_references(refs, g.nodes).collect()} == {"b.t", "a.u"}


def test_nodes_behind_a_loop_keep_their_depth(spark):
    ends = [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    g = make(spark, [node(f"d.{n}") for n in "rabcdxyz"], {}, [(f"{a}{b}", f"d.{a}", f"d.{b}", "automatic", None) for a, b in ends])
    got = {r.node_id[2:]: (r.depth, r.on_cycle) for r in filters.node_depths(g).collect()}
    assert got == {"r": (3, False), "a": (2, True), "b": (2, True), "c": (1, False), "d": (0, False), "x": (3, True), "y": (3, True), "z": (3, False)}
