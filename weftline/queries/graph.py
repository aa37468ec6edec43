"""Queries over the current graph of the nodes, edges and shared_nodes tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.fuzzy import fuzzy_score, search
from weftline.operators import filters, trace
from weftline.operators.edit import matched_columns
from weftline.operators.graph import column_status, graph_stats, split_manual, topological_order
from weftline.operators.scan import resolve_references, run_scan
from weftline.operators.walk import Ways, walk
from weftline.model import LineageGraph, ScanConfig
from weftline.plans.lineage import parse_views, view_references
from weftline.session import Scratch
from weftline.sources.catalog import list_datasets, saved_graph
from weftline.sources.store import edge_json, mermaid_lines, node_json
from weftline.sources.tables import read_table
from weftline.streaming.events import fold_status


def _graph(spark: SparkSession, directory: str) -> LineageGraph:
    """The graph with its parts written once, for operators that read them again and again."""
    graph, scratch = saved_graph(spark, directory), Scratch(spark, "graph")
    return LineageGraph(*(scratch.cut(getattr(graph, p), p) for p in ("nodes", "columns", "edges", "mappings")))


def catalog_datasets(spark, directory) -> DataFrame:
    return list_datasets(saved_graph(spark, directory).nodes)


def catalog_columns(spark, directory) -> DataFrame:
    return saved_graph(spark, directory).columns.select("node_id", F.col("ordinal").cast("bigint").alias("ordinal"), "name", "data_type", "lineage_status")


def stats_totals(spark, directory) -> DataFrame:
    return graph_stats(_graph(spark, directory)).drop("nodes_by_type", "parse_errors")


def stats_by_type(spark, directory) -> DataFrame:
    return graph_stats(_graph(spark, directory)).select(F.explode("nodes_by_type").alias("type", "n"))


def status_of_columns(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return column_status(g.columns, g.mappings).select("node_id", "name", "lineage_status")


def topo_order(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    nodes = g.nodes.select("node_id", F.xxhash64("node_id").alias("ord"))
    deps = g.edges.select(F.col("target_node").alias("node_id"), F.col("source_node").alias("dep"))
    return topological_order(nodes, deps, Scratch(spark, "topo")).select("node_id", "level")


def node_depths(spark, directory) -> DataFrame:
    return filters.node_depths(_graph(spark, directory))


def _busiest(g: LineageGraph) -> DataFrame:
    """The column that feeds most others, the least of several."""
    counts = g.column_edges().groupBy("source_node", "source_column").agg(F.count("*").alias("n"))
    most = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "source_node", "source_column")).alias("s"))
    return most.select(F.col("s.source_node").alias("node"), F.col("s.source_column").alias("column"))


def trace_column(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return trace.trace_column(g, _busiest(g))


def trace_column_edges(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return trace.column_trace_edges(g, trace.trace_column(g, _busiest(g)))


def trace_table(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return trace.trace_table(g, _busiest(g).select("node"))


def trace_paths(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return trace.trace_paths(g, _busiest(g)).select("node", "column", F.array_join("path", " > ").alias("path"))


def trace_tree(spark, directory) -> DataFrame:
    """The depth-first upstream tree of the column with most upstream links of its own: each column once."""
    g = _graph(spark, directory)
    fed = g.column_edges().groupBy("target_node", "target_column").agg(F.count("*").alias("n"))
    least = fed.agg(F.min(F.struct((-F.col("n")).alias("n"), "target_node", "target_column")).alias("s"))
    tree = trace.upstream_tree(g, least.select(F.col("s.target_node").alias("node"), F.col("s.target_column").alias("column")))
    return tree.select("node", "column")


def trace_branches(spark, directory) -> DataFrame:
    """The paths through the busiest column as branches before their longest common ending."""
    g = _graph(spark, directory)
    parts = trace.split_paths(trace.trace_paths(g, _busiest(g)))
    return parts.select(F.array_join("branch", " > ").alias("branch"), F.array_join("suffix", " > ").alias("suffix"))


def node_links(spark, directory) -> DataFrame:
    """Edges into and out of the node that feeds most."""
    g = _graph(spark, directory)
    fan = g.edges.where("source_node is not null").groupBy("source_node").agg(F.count("*").alias("n"))
    busy = fan.agg(F.min(F.struct((-F.col("n")).alias("n"), "source_node")).alias("s")).collect()[0].s
    return filters.node_edges(g, busy.source_node if busy else "")


def facet_values(spark, directory) -> DataFrame:
    return filters.distinct_values(saved_graph(spark, directory))


def trace_chain(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return trace.ordered_chain(g, trace.trace_column(g, _busiest(g)))


def trace_origins(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    found = trace.origins(g, g.nodes.select(F.col("node_id").alias("node")))
    return found.select("node", "target_column", "origin_node", "origin_column", "depth", F.size("chain").cast("bigint").alias("steps"))


def trace_origin_tables(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    by = trace.origins_by_table(trace.origins(g, g.nodes.select(F.col("node_id").alias("node"))))
    return by.select("node", "origin_node", "n_columns", F.array_join("target_columns", ",").alias("target_columns"))


def prune_upstream(spark, directory) -> DataFrame:
    """What pruning at every node with a warning hides."""
    g = _graph(spark, directory)
    return filters.pruned_nodes(g, g.nodes.where("status = 'warning'").select(F.col("node_id").alias("node")))


def filter_views(spark, directory) -> DataFrame:
    g = filters.filter_graph(_graph(spark, directory), filters.GraphFilter(types=("view",), text="daily"))
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


def fuzzy_names(spark, directory) -> DataFrame:
    g = saved_graph(spark, directory)
    scored = g.nodes.select("node_id", fuzzy_score("fct", F.col("name")).alias("score"))
    return scored.where("score is not null")


def fuzzy_search(spark, directory) -> DataFrame:
    """The best 50 tables and columns for a query; a top-k report."""
    g = saved_graph(spark, directory)
    found = search(g.nodes, g.columns, "audit")
    return found.withColumn("places", F.concat_ws(",", F.col("places").cast("array<string>")))


def mapping_merge(spark, directory) -> DataFrame:
    merged = filters.merged_mappings(saved_graph(spark, directory).mappings)
    return merged.withColumn("source_columns", F.array_join("source_columns", ","))


def mapping_same(spark, directory) -> DataFrame:
    return filters.same_transformation(saved_graph(spark, directory).mappings)


def graph_warnings(spark, directory) -> DataFrame:
    return filters.warnings(saved_graph(spark, directory))


def graph_gaps(spark, directory) -> DataFrame:
    return filters.gaps(saved_graph(spark, directory))


def manual_retention(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    kept, dropped = split_manual(g.edges.where("edge_type = 'manual'"), g.nodes)
    parts = [d.select("edge_id", F.lit(name).alias("fate")) for d, name in ((kept, "kept"), (dropped, "dropped"))]
    return parts[0].unionByName(parts[1])


def default_mappings(spark, directory) -> DataFrame:
    g = _graph(spark, directory)
    return matched_columns(g.columns, g.edges.select("source_node", "target_node").distinct()).distinct()


def export_mermaid(spark, directory) -> DataFrame:
    return mermaid_lines(saved_graph(spark, directory), detailed=True)


def export_sizes(spark, directory) -> DataFrame:
    """Nodes and edges as JSON objects."""
    g = saved_graph(spark, directory)
    nodes = node_json(g).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "json")
    return nodes.unionByName(edge_json(g).select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "json"))


def table_refs(spark, directory) -> DataFrame:
    return view_references(saved_graph(spark, directory).nodes)


def lineage_parse(spark, directory) -> DataFrame:
    """Column mappings read from the SQL of all current views."""
    g = saved_graph(spark, directory)
    found = parse_views(g.nodes, g.columns)
    return found.select("target_node", "outcome", "source_node", "target_column", "source_columns", "transformation")


def scan_upstream(spark, directory) -> DataFrame:
    """A scan without limits from the node with most sources, along the edges."""
    g = _graph(spark, directory)
    fed = g.edges.groupBy("target_node").agg(F.countDistinct("source_node").alias("n"))
    target = fed.agg(F.min(F.struct((-F.col("n")).alias("n"), "target_node")).alias("t")).select("t.target_node").collect()[0].target_node
    if target is None:
        return g.nodes.select("node_id", "status")
    refs = g.edges.select(
        F.col("target_node").alias("node_id"), F.xxhash64("edge_id").alias("ord"), F.col("source_node").alias("ref_id"),
        F.element_at(F.split("source_node", r"\."), 1).alias("ref_dataset"),
    )
    return run_scan(g.nodes, refs, ScanConfig(target)).nodes.select("node_id", "status")


def _most_fed(g: LineageGraph) -> str:
    fed = g.edges.where("target_node is not null").groupBy("target_node").agg(F.countDistinct("source_node").alias("n"))
    best = fed.agg(F.min(F.struct((-F.col("n")).alias("n"), "target_node")).alias("t")).collect()[0].t
    return best.target_node if best else ""


def _edge_refs(g: LineageGraph) -> DataFrame:
    return g.edges.where("source_node is not null and target_node is not null").select(
        F.col("target_node").alias("node_id"), F.xxhash64("edge_id").alias("ord"), F.col("source_node").alias("ref_id"),
        F.element_at(F.split("source_node", r"\."), 1).alias("ref_dataset"),
    )


def scan_within_hops(spark, directory) -> DataFrame:
    """A scan from the node with most sources that may leave its dataset once, by the shortest ways."""
    g = _graph(spark, directory)
    found = run_scan(g.nodes, _edge_refs(g), ScanConfig(_most_fed(g), depth=1), shortest=True).nodes
    return found.select("node_id", "status", F.when(F.col("status") == "truncated", F.col("status_message")).alias("message"))


def scan_in_scope(spark, directory) -> DataFrame:
    """A scan from the node with most sources that stays in its own dataset."""
    g = _graph(spark, directory)
    target = _most_fed(g)
    found = run_scan(g.nodes, _edge_refs(g), ScanConfig(target, datasets=(target.split(".")[0],))).nodes
    return found.select("node_id", "status", F.when(F.col("status") == "truncated", F.col("status_message")).alias("message"))


def scan_dataset(spark, directory) -> DataFrame:
    """A scan of the first dataset with views and what it needs along the edges, one dataset hop out by the shortest ways."""
    g = _graph(spark, directory)
    least = g.nodes.where("type = 'view'").agg(F.min("dataset").alias("d")).collect()[0].d
    found = run_scan(g.nodes, _edge_refs(g), ScanConfig(datasets=(least or "",), depth=1), shortest=True).nodes
    return found.select("node_id", "status", F.when(F.col("status") == "truncated", F.col("status_message")).alias("message"))


def scan_views(spark, directory) -> DataFrame:
    """A scan of one dataset along the references in the views' SQL, one dataset hop out."""
    g = _graph(spark, directory)
    least = g.nodes.where("type = 'view'").agg(F.min("dataset").alias("d")).collect()[0].d
    refs = resolve_references(view_references(g.nodes), g.nodes)
    return run_scan(g.nodes, refs, ScanConfig(datasets=(least or "",), depth=1)).nodes.select("node_id", "dataset", "status", "status_message")


def events_fold(spark, directory) -> DataFrame:
    """Each user's last event, folded as a scan's status is."""
    events = read_table(spark, directory, "events")
    return fold_status(events, "user_id", "event_id", "event_type")


def entity_reach(spark, directory) -> DataFrame:
    """(root, node, depth): what hangs on every region and every part, line items included, by level under each root."""
    t = {n: read_table(spark, directory, n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")}

    def name(table, *keys):
        return F.concat(F.lit(table), *(F.concat(F.lit("."), F.col(k).cast("string")) for k in keys))  # null for a null key

    line = name("lineitem", "l_orderkey", "l_linenumber")
    ends = (
        (t["nation"], name("region", "n_regionkey"), name("nation", "n_nationkey")),
        (t["customer"], name("nation", "c_nationkey"), name("customer", "c_custkey")),
        (t["supplier"], name("nation", "s_nationkey"), name("supplier", "s_suppkey")),
        (t["orders"], name("customer", "o_custkey"), name("orders", "o_orderkey")),
        (t["lineitem"], name("orders", "l_orderkey"), line),
        (t["lineitem"], name("supplier", "l_suppkey"), line),
        (t["lineitem"], name("part", "l_partkey"), line),
    )
    links = reduce(DataFrame.unionByName, (df.select(a.alias("src"), b.alias("dst")) for df, a, b in ends)).where("src is not null and dst is not null")
    scratch = Scratch(spark, "entity")
    links = scratch.cut(links.distinct(), "links")
    roots = t["region"].select(name("region", "r_regionkey").alias("root")).union(t["nation"].select(name("region", "n_regionkey")))
    roots = roots.union(t["part"].select(name("part", "p_partkey"))).where("root is not null").distinct()
    start = roots.select("root", F.col("root").alias("node"))
    ways = Ways(links, "src", "dst", scratch)
    return walk(start, lambda f: ways.follow(f.withColumnRenamed("node", "src")).select("root", F.col("dst").alias("node")), ["root", "node"], scratch)


QUERIES = {
    f.__name__: f
    for f in (
        catalog_datasets, catalog_columns, stats_totals, stats_by_type, status_of_columns, topo_order, node_depths, trace_column,
        trace_column_edges, trace_table, trace_paths, trace_branches, trace_tree, trace_chain, node_links, facet_values, trace_origins, trace_origin_tables, prune_upstream, filter_views,
        fuzzy_names, fuzzy_search, mapping_merge, mapping_same, graph_warnings, graph_gaps, manual_retention, default_mappings,
        export_mermaid, export_sizes, table_refs, lineage_parse, scan_upstream, scan_within_hops, scan_in_scope, scan_dataset, scan_views, events_fold, entity_reach,
    )
}
