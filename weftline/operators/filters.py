"""Depths, filters, pruning, and the facts a graph view shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import LineageGraph
from weftline.operators.graph import topological_order
from weftline.operators.hierarchy import Hierarchy
from weftline.operators.walk import closure
from weftline.session import Scratch


def node_depths(graph: LineageGraph) -> DataFrame:
    """(node_id, depth, on_cycle): longest distance from a root, turned round so that the deepest are 0.

    A set of nodes that reach each other counts as one step, so what lies behind a loop keeps its
    distance; its nodes are marked.  Nodes that no root leads to count as distance 0.
    """
    scratch = Scratch(graph.spark, "depths")
    links = graph.edges.select(F.col("source_node").alias("parent"), F.col("target_node").alias("child"))
    ids = graph.nodes.select("node_id")
    links = links.join(ids.withColumnRenamed("node_id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("node_id", "child"), "child", "left_semi")
    links = scratch.cut(links.where("parent <> child").distinct(), "links")
    sets = scratch.cut(Hierarchy(links).named_cycles().where("root_id <> node_id or depth > 1"), "sets").select("node_id", F.col("root_id").alias("set"))
    whole = scratch.cut(ids.join(sets, "node_id", "left").select("node_id", F.coalesce("set", "node_id").alias("set"), F.col("set").isNotNull().alias("on_cycle")), "whole")
    roots = ids.join(links.select(F.col("child").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("node"))
    led = closure(links.select(F.col("parent").alias("src"), F.col("child").alias("dst")), roots, scratch)
    links = links.join(led.select(F.col("node").alias("parent")), "parent", "left_semi")
    above = whole.select(F.col("node_id").alias("parent"), F.col("set").alias("dep"))
    below = whole.select(F.col("node_id").alias("child"), F.col("set").alias("node_id"))
    deps = links.join(above, "parent").join(below, "child").where("dep <> node_id").select("node_id", "dep")
    groups = whole.select(F.col("set").alias("node_id")).distinct().withColumn("ord", F.xxhash64("node_id"))
    levels = scratch.cut(topological_order(groups, deps, scratch).select(F.col("node_id").alias("set"), "level"), "levels")
    most = levels.agg(F.max("level")).collect()[0][0] or 0
    return whole.join(levels, "set").select("node_id", (F.lit(most).cast("bigint") - F.col("level")).alias("depth"), "on_cycle")


def distinct_values(graph: LineageGraph) -> DataFrame:
    """(kind, value): datasets, types and statuses that occur."""
    parts = [graph.nodes.select(F.lit(c).alias("kind"), F.col(c).alias("value")).where("value is not null") for c in ("dataset", "type", "status")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def upstream(graph: LineageGraph, seeds: DataFrame) -> DataFrame:
    """(node): all nodes above any of the seeds (node); a seed itself only if another path or a loop leads to it."""
    scratch = Scratch(graph.spark, "upstream")
    links = scratch.cut(
        graph.edges.select(F.col("target_node").alias("src"), F.col("source_node").alias("dst")).where("src is not null and dst is not null").distinct(), "links"
    )
    first = links.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return closure(links, first, scratch).select("node")


def pruned_nodes(graph: LineageGraph, points: DataFrame | None = None) -> DataFrame:
    """(node): everything above the prune points; ids that are not in the graph prune nothing."""
    if points is None:
        points = graph.spark.createDataFrame([(p,) for p in graph.prune_points], "node string")
    known = points.join(graph.nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    return upstream(graph, known)


@dataclass(frozen=True)
class GraphFilter:
    """Predicates of a filtered view; an empty one lets everything through."""

    datasets: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    edge_types: tuple[str, ...] = ()
    text: str = ""
    max_depth: int | None = None

    def active(self) -> bool:
        return self != GraphFilter()


def filter_graph(graph: LineageGraph, by: GraphFilter, pruned: DataFrame | None = None) -> LineageGraph:
    """The part of the graph that passes: nodes by every predicate, edges by type and both ends."""
    keep = graph.nodes
    for column, allowed in (("dataset", by.datasets), ("type", by.types), ("status", by.statuses)):
        if allowed:
            keep = keep.where(F.col(column).isin(list(allowed)))
    if by.text:
        keep = keep.where(F.contains(F.lower("name"), F.lit(by.text.lower())))
    if by.max_depth is not None:
        depths = node_depths(graph).where(F.col("depth") <= by.max_depth)
        keep = keep.join(depths.select("node_id"), "node_id", "left_semi")
    if pruned is None and graph.prune_points:
        pruned = pruned_nodes(graph)
    if pruned is not None:
        keep = keep.join(pruned.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    ids = keep.select("node_id")
    edges = graph.edges.where(F.col("edge_type").isin(list(by.edge_types))) if by.edge_types else graph.edges
    edges = edges.join(ids.withColumnRenamed("node_id", "source_node"), "source_node", "left_semi")
    edges = edges.join(ids.withColumnRenamed("node_id", "target_node"), "target_node", "left_semi")
    maps = graph.mappings.join(edges.select("edge_id"), "edge_id", "left_semi")
    cols = graph.columns.join(ids, "node_id", "left_semi")
    return LineageGraph(keep.select(*graph.nodes.columns), cols, edges.select(*graph.edges.columns), maps, graph.prune_points, graph.metadata, graph.parse_errors)


def filter_badge(shown: int, total: int, by: GraphFilter, pruned: int = 0) -> str:
    """A line telling how much of the graph is shown."""
    if not by.active() and not pruned:
        return f"{total} nodes"
    return f"{shown} of {total} nodes" + (f", {pruned} pruned" if pruned else "")


def node_edges(graph: LineageGraph, node: str) -> DataFrame:
    """(direction, edge_id, other, edge_type): edges into and out of a node."""
    ins = graph.edges.where(F.col("target_node") == node).select(F.lit("upstream").alias("direction"), "edge_id", F.col("source_node").alias("other"), "edge_type")
    outs = graph.edges.where(F.col("source_node") == node).select(F.lit("downstream").alias("direction"), "edge_id", F.col("target_node").alias("other"), "edge_type")
    return ins.unionByName(outs)


def node_columns(graph: LineageGraph, node: str, text: str = "") -> DataFrame:
    """Columns of a node whose name or type holds ``text``."""
    found = graph.columns.where(F.col("node_id") == node)
    low = F.lit(text.lower())
    return found.where(F.contains("name_lc", low) | F.contains(F.lower("data_type"), low)) if text else found


def merged_mappings(mappings: DataFrame) -> DataFrame:
    """(target_node, target_column, transformation, expression, source_columns, source_node): mappings of a column
    with equal transformation and expression as one, with all their source columns and the least source node."""
    return mappings.groupBy(
        "target_node", F.lower("target_column").alias("target_column"), "transformation", F.coalesce("expression", F.lit("")).alias("expression")
    ).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_columns")))).alias("source_columns"),
        F.min("source_node").alias("source_node"),
    )


def same_transformation(mappings: DataFrame) -> DataFrame:
    """(target_node, target_column, shared): whether all sources of a column come by one transformation."""
    one = F.countDistinct(F.struct("transformation", F.coalesce("expression", F.lit("")).alias("expression"))) == 1
    return mappings.groupBy("target_node", F.lower("target_column").alias("target_column")).agg(one.alias("shared"))


def warnings(graph: LineageGraph) -> DataFrame:
    """(kind, node_id, message): truncated nodes (scope), and nodes with columns of unknown lineage (parse)."""
    scope = graph.nodes.where("status = 'truncated'").select(
        F.lit("scope").alias("kind"), "node_id", F.coalesce("status_message", F.lit("Outside the scan")).alias("message")
    )
    n = graph.mappings.where("transformation = 'unknown'").groupBy(F.col("target_node").alias("node_id")).agg(
        F.countDistinct(F.lower("target_column")).alias("n")
    )
    n = n.join(graph.nodes.select("node_id"), "node_id", "left_semi")
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " column").otherwise(" columns"), F.lit(" with unknown lineage"))
    return scope.unionByName(n.select(F.lit("parse").alias("kind"), "node_id", text.alias("message")))


def gaps(graph: LineageGraph) -> DataFrame:
    """(node_id, no_upstream, no_downstream): views nothing feeds, and nodes that feed nothing."""
    ins = graph.edges.select(F.col("target_node").alias("node_id")).distinct().withColumn("i", F.lit(True))
    outs = graph.edges.select(F.col("source_node").alias("node_id")).distinct().withColumn("o", F.lit(True))
    marked = graph.nodes.join(ins, "node_id", "left").join(outs, "node_id", "left")
    return marked.select(
        "node_id", (F.col("i").isNull() & (F.col("type") != "table")).alias("no_upstream"), F.col("o").isNull().alias("no_downstream")
    )


def target_outside(target: str | None, datasets: tuple[str, ...]) -> bool:
    """Whether a scan's target lies in none of the chosen datasets."""
    return bool(target and datasets and target.split(".")[0] not in datasets)
