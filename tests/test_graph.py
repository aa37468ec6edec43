import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.functions.fuzzy import fuzzy_score, search
from weftline.model import COLUMNS, EDGES, MAPPINGS, NODES, LineageGraph, ScanConfig, empty_graph
from weftline.operators import edit, filters, trace
from weftline.operators.graph import build_graph, graph_stats, topological_order
from weftline.operators.scan import run_scan
from weftline.session import Scratch
from weftline.sources import store
from weftline.streaming.events import EventLog, fold_status, follow, read_events


def node(i, sql=None, status="ok", kind=None):
    dataset, name = i.split(".")
    return (i, kind or ("view" if sql else "table"), dataset, name, "ingestion", sql, None, status, None)


def make(spark, nodes, columns, edges=(), maps=()):
    cols = [(n, k, c, c.lower(), "STRING", "resolved") for n, names in columns.items() for k, c in enumerate(names)]
    frames = ((nodes, NODES), (cols, COLUMNS), (list(edges), EDGES), (list(maps), MAPPINGS))
    return LineageGraph(*(spark.createDataFrame(r, s) for r, s in frames))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    """raw.a -> mid.b -> out.c, with a literal, a star and an aggregate."""
    nodes = [
        node("raw.a"), node("mid.b", "SELECT x AS y, COUNT(*) AS n, 'k' AS lit FROM raw.a"),
        node("out.c", "SELECT y, n, UPPER(lit) AS l FROM mid.b"), node("dyn.d", "EXECUTE IMMEDIATE 'x'"), node("lone.e"),
    ]
    cols = {"raw.a": ["X"], "mid.b": ["y", "n", "lit"], "out.c": ["y", "n", "l"], "dyn.d": ["q"], "lone.e": []}
    g = make(spark, nodes, cols)
    return build_graph(g.nodes, g.columns, project="p")


def test_build(chain):
    got = {(r.target_node, r.target_column): (r.source_node, r.transformation) for r in chain.mappings.collect()}
    assert got == {
        ("mid.b", "y"): ("raw.a", "rename"), ("mid.b", "n"): ("raw.a", "aggregation"), ("mid.b", "lit"): ("raw.a", "literal"),
        ("out.c", "y"): ("mid.b", "direct"), ("out.c", "n"): ("mid.b", "direct"), ("out.c", "l"): ("mid.b", "expression"),
    }
    status = {r.node_id: r.status for r in chain.nodes.collect()}
    assert status["dyn.d"] == "warning" and status["mid.b"] == "ok" and chain.parse_errors == 1
    unknown = {(r.node_id, r.name) for r in chain.columns.where("lineage_status = 'unknown'").collect()}
    assert unknown == {("dyn.d", "q")}
    s = graph_stats(chain).collect()[0]
    assert (s.total_nodes, s.total_edges, s.orphan_nodes, s.terminal_nodes, s.parse_errors) == (5, 2, 2, 1, 1)
    assert s.nodes_by_type == {"table": 2, "view": 3}


def test_traces(chain):
    assert rows(trace.trace_column(chain, "mid.b", "Y")) == [("down", "out.c", "y", 1), ("start", "mid.b", "y", 0), ("up", "raw.a", "x", 1)]
    found = {(r.target_column, r.origin_node, r.origin_column, tuple(c.transformation for c in r.chain)) for r in trace.origins(chain, "out.c").collect()}
    assert found == {("y", "raw.a", "x", ("rename", "direct")), ("l", "mid.b", "lit", ("expression",)), ("n", "mid.b", "n", ("direct",))}
    assert {r.origin_column for r in trace.origins(chain, "mid.b").collect()} == {"x", "lit"}
    assert rows(trace.trace_table(chain, "raw.a"))[:1] == [("mid.b", "lit")] and rows(trace.trace_table(chain, "lone.e")) == [("lone.e", "")]
    tree = trace.upstream_tree(chain, "out.c", "Y")
    assert [(r.place, r.node, r.column, r.parent_node, r.depth) for r in tree.orderBy("place").collect()] == [
        (0, "out.c", "y", None, 0), (1, "mid.b", "y", "out.c", 1), (2, "raw.a", "x", "mid.b", 2),
    ]
    assert tuple(trace.tree_counts(tree).collect()[0]) == (3, 3, 1)
    paths = trace.trace_paths(chain, "mid.b", "y")
    assert [tuple(r.path) for r in paths.collect()] == [("raw.a.x", "mid.b.y", "out.c.y")]
    assert [tuple(r.path) for r in trace.trace_paths(chain, "lone.e", "z").collect()] == [("lone.e.z",)]


def test_deep_paths_are_whole(spark):
    ends = [(f"d.n{i:02}", f"d.n{i + 1:02}") for i in range(36)] + [("d.n05", "d.n03")]
    edges = [(f"e{i}", a, b, "automatic", None) for i, (a, b) in enumerate(ends)]
    maps = [(f"e{i}", a, b, "c", ["c"], "direct", None, None) for i, (a, b) in enumerate(ends)]
    g = make(spark, [], {}, edges, maps)
    whole = tuple(f"d.n{i:02}.c" for i in range(37))
    assert {tuple(r.path) for r in trace.trace_paths(g, "d.n36", "c").collect()} == {whole}


def test_split_paths(spark):
    df = spark.createDataFrame([("n", "c", list("abxy")), ("n", "c", list("qxy")), ("m", "c", ["z"])], "node string, column string, path array<string>")
    assert {(tuple(r.branch), tuple(r.suffix)) for r in trace.split_paths(df).collect()} == {(("a", "b"), ("x", "y")), (("q",), ("x", "y")), ((), ("z",))}


def test_topological_order(spark):
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(["z", "c", "b", "a", "l1", "l2", "after", "self"])], "node_id string, ord int")
    deps = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("a", "c"), ("l1", "l2"), ("l2", "l1"), ("after", "l1"), ("self", "self"), ("c", "missing")], "node_id string, dep string"
    )
    got = {r.node_id: r.level for r in topological_order(nodes, deps, Scratch(spark, "t")).collect()}
    assert got == {"z": 0, "c": 0, "self": 0, "b": 1, "a": 2, "l1": -1, "l2": -1, "after": -1}


def scan_brute(refs, nodes, target, datasets, depth):
    """The queue of the scan rules, one reference at a time."""
    found, stubs, visited, queue = {}, {}, set(), deque([(target, 0)])
    while queue:
        n, hops = queue.popleft()
        if n in visited:
            continue
        visited.add(n)
        if datasets and n.split(".")[0] not in datasets:
            if n not in found:
                stubs.setdefault(n, "Dataset not in scan scope")
            continue
        found[n] = "ok" if n in nodes else "error"
        stubs.pop(n, None)
        for dep in refs.get(n, ()) if n in nodes else ():
            if dep in visited:
                continue
            h = hops + (dep.split(".")[0] != n.split(".")[0])
            if depth is not None and h > depth:
                if dep not in found:
                    stubs.setdefault(dep, f"Depth limit reached ({h} dataset hops > {depth})")
                continue
            queue.append((dep, h))
    return {**{n: (s, None) for n, s in found.items()}, **{n: ("truncated", m) for n, m in stubs.items()}}


@pytest.mark.parametrize("seed,datasets,depth", [(2, (), 1), (3, ("d0", "d1"), 2)])
def test_scan_follows_the_queue(spark, seed, datasets, depth):
    rng = random.Random(seed)
    names = [f"d{rng.randrange(3)}.n{i}" for i in range(25)]
    names[0] = "d0.n0"
    refs = {n: [rng.choice(names) for _ in range(rng.randrange(4))] for n in names}
    refs["d0.n0"] = names[1:4] + ["d1.gone"]
    g = make(spark, [node(n, "x") for n in names], {})
    flat = [(n, i, d, d.split(".")[0]) for n, ds in refs.items() for i, d in enumerate(ds)]
    r = spark.createDataFrame(flat, "node_id string, ord int, ref_id string, ref_dataset string")
    got = run_scan(g.nodes, r, ScanConfig("d0.n0", datasets, depth))
    want = scan_brute(refs, set(names), "d0.n0", datasets, depth)
    seen = {x.node_id: (x.status, x.status_message if x.status == "truncated" else None) for x in got.nodes.collect()}
    assert seen == want
    assert got.errors.count() == sum(s == "error" for s, _ in want.values())


def test_scan_of_datasets_and_bad_target(spark):
    g = make(spark, [node("d.v", "x"), node("e.t", "x"), node("f.u")], {})
    r = spark.createDataFrame([("d.v", 0, "e.t", "e"), ("e.t", 0, "f.u", "f"), ("d.v", 1, "d.gone", "d")], "node_id string, ord int, ref_id string, ref_dataset string")
    got = {x.node_id: x.status for x in run_scan(g.nodes, r, ScanConfig(datasets=("d",), depth=1)).nodes.collect()}
    assert got == {"d.v": "ok", "e.t": "ok", "f.u": "truncated", "d.gone": "error"}
    bad = run_scan(g.nodes, r, ScanConfig(target="nodot"))
    assert bad.nodes.count() == 0 and "expected 'dataset.table'" in bad.errors.collect()[0].message


def test_filters(chain):
    shown = filters.filter_graph(chain, filters.GraphFilter(types=("view",), text="B"))
    assert [r.node_id for r in shown.nodes.collect()] == ["mid.b"] and shown.edges.count() == 0
    depths = {r.node_id: r.depth for r in filters.node_depths(chain).collect()}
    assert depths["out.c"] == 0 and depths["mid.b"] == 1 and depths["raw.a"] == 2
    pruned = filters.filter_graph(edit.set_prune_points(chain, ["out.c", "not.there"]), filters.GraphFilter())
    assert {r.node_id for r in pruned.nodes.collect()} == {"out.c", "dyn.d", "lone.e"}
    gaps = {r.node_id: (r.no_upstream, r.no_downstream) for r in filters.gaps(chain).collect()}
    assert gaps["raw.a"] == (False, False) and gaps["dyn.d"] == (True, True)
    assert filters.filter_badge(5, 5, filters.GraphFilter()) == "5 nodes" and filters.target_outside("a.b", ("c",))


def score_brute(pattern, text):
    p, t = pattern.lower(), text.lower()

    def boundary(i):
        return i == 0 or text[i - 1] in "_. -" or (text[i - 1].isascii() and text[i - 1].islower() and text[i].isupper())

    if not p:
        return 0.0
    if len(p) > len(t):
        return None
    at = t.find(p)
    if at >= 0:
        return 100 + 10 * len(p) + 50 * (at == 0) + 30 * boundary(at) - 0.5 * (len(t) - len(p))
    score, last = 0.0, -1
    for k, ch in enumerate(p):
        i = t.find(ch, last + 1)
        if i < 0:
            return None
        score += 5 + (15 if i == last + 1 else 0 if last < 0 else -0.5 * (i - last - 1)) + 20 * boundary(i) + 25 * (k == 0 and i == 0)
        last = i
    return score - 0.3 * (len(t) - len(p))


@pytest.mark.parametrize("pattern", ["ord", "oc", "custSum", ""])
def test_fuzzy_scores(spark, pattern):
    names = ["orders_clean", "customerSummary", "order.clean", "my-order", "o_c", "XY", "x_y", "", "recordX Y", "cust_sum"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {r.name: r.s for r in df.select("name", fuzzy_score(pattern, F.col("name")).alias("s")).collect()}
    for n in names:
        want = score_brute(pattern, n)
        assert got[n] is None if want is None else got[n] == pytest.approx(want), n
    assert got[None] is None


def test_search(chain):
    found = search(chain.nodes, chain.columns, "li").collect()
    assert [(r.kind, r.node_id, r.column) for r in found][0][0] in ("table", "column") and any(r.column == "lit" for r in found)
    assert search(chain.nodes, chain.columns, "l").count() == 0
    best = search(chain.nodes, chain.columns, "mid").collect()[0]
    assert (best.node_id, best.data_type, best.places) == ("mid.b", "view", [0, 1, 2])
    assert [r.places for r in search(chain.nodes, chain.columns, "dn").collect() if r.node_id == "dyn.d"] == [[0, 2]]


def test_tree_is_depth_first(spark):
    """s is fed by a and b, a by b, b by s: b hangs under a, which the walk reaches first, and s is not met again."""
    ends = [("a", "s"), ("b", "s"), ("b", "a"), ("s", "b")]
    edges = [(f"e{i}", f"d.{x}", f"d.{y}", "automatic", None) for i, (x, y) in enumerate(ends)]
    maps = [(f"e{i}", f"d.{x}", f"d.{y}", "c", ["C", "c"], "direct", None, None) for i, (x, y) in enumerate(ends)]
    g = make(spark, [], {}, edges, maps)
    starts = spark.createDataFrame([("d.s", "c"), ("d.a", "c")], "node string, column string")
    got = {(r.start[9:12], r.place, r.node[2:], (r.parent_node or "d.")[2:], r.depth) for r in trace.upstream_tree(g, starts).collect()}
    assert got == {("d.s", 0, "s", "", 0), ("d.s", 1, "a", "s", 1), ("d.s", 2, "b", "a", 2), ("d.a", 0, "a", "", 0), ("d.a", 1, "b", "a", 1), ("d.a", 2, "s", "b", 2)}


def test_manual_edges(chain, spark):
    g, first = edit.create_manual_edge(chain, "raw.a", "lone.e", [{"target_column": "t", "source_columns": ["X"]}])
    g, second = edit.create_manual_edge(g, "raw.a", "lone.e")
    assert (first, second) == ("manual_raw.a__lone.e", "manual_raw.a__lone.e_2")
    g = edit.update_manual_edge(g, first, "text", [{"target_column": "u"}])
    assert g.edges.where(F.col("edge_id") == first).collect()[0].description == "text"
    assert [r.target_column for r in g.mappings.where(F.col("edge_id") == first).collect()] == ["u"]
    assert edit.delete_manual_edge(g, first).edges.where(F.col("edge_id") == first).count() == 0
    for bad, status in (
        (lambda: edit.create_manual_edge(None, "a", "b"), 400), (lambda: edit.create_manual_edge(chain, "", "b"), 422),
        (lambda: edit.create_manual_edge(chain, "raw.a", "no.no"), 404), (lambda: edit.delete_manual_edge(chain, "edge_raw.a__mid.b"), 404),
        (lambda: edit.set_prune_points(chain, "x"), 422), (lambda: edit.clean_mappings("a", "a", []), 422),
    ):
        with pytest.raises(edit.EditError) as e:
            bad()
        assert e.value.status == status
    assert edit.default_mappings(chain.columns, "mid.b", "out.c")[0] == {"target_column": "y", "source_columns": ["y"], "transformation": "direct"}
    assert edit.clean_mappings("a", "b", [{"target_column": " t ", "source_columns": [" x ", " "]}, {"target_column": " "}]) == [{"target_column": "t", "source_columns": ["x"]}]
    lock = edit.ScanLock()
    with lock, pytest.raises(edit.EditError), lock:
        pass


def test_scan_then_expand_and_merge(spark):
    all_nodes = [node("a.v", "SELECT k FROM b.v"), node("b.v", "SELECT k FROM c.t"), node("c.t"), node("z.t")]
    cat = make(spark, all_nodes, {n[0]: ["k"] for n in all_nodes})
    catalogue = (cat.nodes, cat.columns)
    g = edit.full_scan(catalogue, ScanConfig("a.v", depth=1), "p")
    status = {r.node_id: r.status for r in g.nodes.collect()}
    assert status == {"a.v": "ok", "b.v": "ok", "c.t": "truncated"}
    g, manual = edit.create_manual_edge(edit.set_prune_points(g, ["a.v"]), "c.t", "a.v")
    grown = edit.expand_node(g, catalogue, "c.t")
    assert {r.node_id: r.status for r in grown.nodes.collect()} == {"a.v": "ok", "b.v": "ok", "c.t": "ok"}
    assert {r.edge_id for r in grown.edges.collect()} == {"edge_b.v__a.v", "edge_c.t__b.v", manual}
    assert grown.prune_points == ["a.v"] and grown.metadata["scan_config"]["target"] == "a.v"
    merged = edit.merge_scan(grown, catalogue, ScanConfig(datasets=("z",)))
    assert {r.node_id for r in merged.nodes.collect()} == {"a.v", "b.v", "c.t", "z.t"} and merged.edges.count() == 3
    assert merged.metadata["scan_config"] == {"target": None, "datasets": ["z"], "depth": None}
    with pytest.raises(edit.EditError):
        edit.expand_node(grown, catalogue, "a.v")


def test_store(chain, spark, tmp_path):
    g = edit.set_prune_points(chain, ["raw.a"])
    root = str(tmp_path)
    assert store.load_graph(spark, f"{root}/none") is None
    assert store.save_scan(g, root, "one") == 201 and store.save_scan(g, root, "one", True) == 200
    with pytest.raises(edit.EditError):
        store.save_scan(g, root, "one")
    with pytest.raises(edit.EditError):
        store.save_scan(g, root, "no/slash")
    back = store.load_scan(spark, root, "one")
    for part in store.TABLES:
        assert rows(getattr(back, part).na.fill("")) == rows(getattr(g, part).na.fill(""))
    assert back.prune_points == ["raw.a"] and [s["name"] for s in store.list_scans(spark, root)] == ["one"]
    assert store.load_graph(spark, f"{root}/current") is not None
    store.delete_scan(spark, root, "one")
    assert store.list_scans(spark, root) == []
    again = store.import_json(spark, store.export_json(g))
    assert rows(again.mappings.na.fill("")) == rows(g.mappings.na.fill("")) and again.prune_points == ["raw.a"]
    assert store.import_json(spark, "{") is None
    text = store.export_mermaid(g, detailed=True)
    assert text.startswith("flowchart LR\n") and '  mid_b["mid.b<br/>y<br/>n<br/>lit"]' in text and "  raw_a --> mid_b" in text
    assert "Nodes: 5" in store.scan_report(g, ["bad"]) and "error: bad" in store.scan_report(g, ["bad"])


def test_empty_graph(spark):
    g = empty_graph(spark)
    assert graph_stats(g).collect()[0].total_nodes == 0
    assert filters.node_depths(g).count() == 0 and trace.origins(g, "a.b").count() == 0 and filters.warnings(g).count() == 0
    assert trace.trace_column(g, "a.b", "c").count() == 1


def test_events(spark, tmp_path):
    path = str(tmp_path / "events")
    log = EventLog(spark, path, "s1")
    for kind in ("scan_start", "scan_complete", "build_parse", "complete"):
        log.publish(kind, kind.upper())
    with pytest.raises(ValueError):
        log.publish("nonsense")
    seen = []
    follow(spark, path, lambda rs: seen.extend(r.type for r in rs), str(tmp_path / "cp"), timeout=60)
    assert seen == ["scan_start", "scan_complete", "build_parse", "complete"]
    assert rows(fold_status(read_events(spark, path))) == [("s1", "complete", "complete", 4)]
    open_scan = spark.createDataFrame([("a", 1, "scan_start"), ("b", 1, "error"), ("b", 2, "scan_node")], "scan_id string, seq int, type string")
    assert rows(fold_status(open_scan)) == [("a", "running", "scan_start", 1), ("b", "error", "scan_node", 2)]


def test_entity_reach(spark, tmp_path):
    from weftline.queries.graph import entity_reach

    tables = {
        "region": ("r_regionkey int", [(0,), (1,)]),
        "nation": ("n_nationkey int, n_regionkey int", [(10, 0), (11, 1)]),
        "customer": ("c_custkey int, c_nationkey int", [(20, 11), (21, None)]),
        "supplier": ("s_suppkey int, s_nationkey int", [(30, 0), (31, 10)]),
        "orders": ("o_orderkey int, o_custkey int", [(40, 20)]),
        "part": ("p_partkey int", [(50,), (51,)]),
        "lineitem": ("l_orderkey int, l_linenumber int, l_suppkey int, l_partkey int", [(40, 1, 31, 50), (40, 2, None, 50)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {tuple(r) for r in entity_reach(spark, str(tmp_path)).collect()} == {
        ("region.0", "region.0", 0), ("region.0", "nation.10", 1), ("region.0", "supplier.31", 2), ("region.0", "lineitem.40.1", 3),
        ("region.1", "region.1", 0), ("region.1", "nation.11", 1), ("region.1", "customer.20", 2), ("region.1", "orders.40", 3),
        ("region.1", "lineitem.40.1", 4), ("region.1", "lineitem.40.2", 4),
        ("part.50", "part.50", 0), ("part.50", "lineitem.40.1", 1), ("part.50", "lineitem.40.2", 1), ("part.51", "part.51", 0),
    }
