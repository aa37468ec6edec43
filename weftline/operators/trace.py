"""Following columns and tables through the graph."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.model import LineageGraph
from weftline.operators.walk import Ways, closure, walk
from weftline.session import Scratch


def _starts(graph: LineageGraph, node: DataFrame | str, column: str | None = None) -> DataFrame:
    if isinstance(node, DataFrame):
        return node
    return graph.spark.createDataFrame([(node, (column or "").lower())], "node string, column string")


def _hops(graph: LineageGraph) -> DataFrame:
    return graph.column_edges().where("source_node is not null and target_node is not null").select(
        F.struct(F.col("source_node").alias("node"), F.col("source_column").alias("column")).alias("up"),
        F.struct(F.col("target_node").alias("node"), F.col("target_column").alias("column")).alias("down"),
    )


def trace_column(graph: LineageGraph, node: DataFrame | str, column: str | None = None) -> DataFrame:
    """(direction, node, column, depth): what a column feeds and what feeds it, case ignored.

    ``node`` may be a table (node, column) of several starts.  The start is at depth 0; on a loop a
    column met downstream is not met again upstream.  ``*`` is a column like any other.
    """
    scratch = Scratch(graph.spark, "trace")
    hops = scratch.cut(_hops(graph), "hops")
    keys = ["node", "column"]
    start = scratch.cut(_starts(graph, node, column).select("node", F.lower("column").alias("column")), "start")

    def along(come: str, go: str):
        ways = Ways(hops.select(F.col(come).alias("at"), F.col(go).alias("to")), "at", "to", scratch)
        return lambda f: ways.follow(f.select(F.struct(*keys).alias("at"))).select("to.node", "to.column")

    down = walk(start, along("up", "down"), keys, scratch).withColumn("direction", F.when(F.col("depth") == 0, "start").otherwise("down"))
    seen = scratch.cut(down, "down")
    blocked = seen.where("depth > 0").select(*keys)
    step = along("down", "up")
    up = walk(start, lambda f: step(f).join(blocked, keys, "left_anti"), keys, scratch)
    out = seen.select("direction", *keys, "depth").unionByName(up.where("depth > 0").select(F.lit("up").alias("direction"), *keys, "depth"))
    return out


def trace_nodes(trace: DataFrame) -> DataFrame:
    return trace.select("node").distinct()


def trace_table(graph: LineageGraph, node: DataFrame | str) -> DataFrame:
    """(node, column): all columns of every node connected with ``node`` in any direction; '' for a node without columns."""
    scratch = Scratch(graph.spark, "connected")
    both = graph.edges.select(F.explode(F.array(
        F.struct(F.col("source_node").alias("src"), F.col("target_node").alias("dst")),
        F.struct(F.col("target_node").alias("src"), F.col("source_node").alias("dst")),
    )).alias("l")).select("l.*").where("src is not null and dst is not null").distinct()
    seeds = node if isinstance(node, DataFrame) else graph.spark.createDataFrame([(node,)], "node string")
    found = closure(scratch.cut(both, "both"), seeds, scratch)
    inside = found.join(graph.nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    cols = graph.columns.select(F.col("node_id").alias("node"), F.col("name").alias("column"))
    return inside.join(cols, "node", "left").select("node", F.coalesce("column", F.lit("")).alias("column"))


def table_trace_edges(graph: LineageGraph, nodes: DataFrame) -> DataFrame:
    """(edge_id): edges with both ends among ``nodes`` (node)."""
    ids = nodes.select("node").distinct()
    kept = graph.edges.join(ids.withColumnRenamed("node", "source_node"), "source_node", "left_semi")
    return kept.join(ids.withColumnRenamed("node", "target_node"), "target_node", "left_semi").select("edge_id")


def column_trace_edges(graph: LineageGraph, trace: DataFrame) -> DataFrame:
    """(edge_id): edges with a mapping from a traced column to a traced column."""
    ids = trace.select("node", "column").distinct()
    up = ids.select(F.col("node").alias("source_node"), F.col("column").alias("source_column"))
    down = ids.select(F.col("node").alias("target_node"), F.col("column").alias("target_column"))
    kept = graph.column_edges().join(up, ["source_node", "source_column"], "left_semi")
    return kept.join(down, ["target_node", "target_column"], "left_semi").select("edge_id").distinct()


def origins(graph: LineageGraph, node: DataFrame | str) -> DataFrame:
    """(node, target_column, origin_node, origin_column, depth, chain): where each column of ``node`` comes from.

    An origin is a column reached upstream that nothing feeds (``*`` feeds nothing); a literal column
    is its own origin.  ``chain`` lists (transformation, expression) from origin to target along the
    first path found.  A column fed by nothing but ``*`` has no origin.  ``node`` may be a table
    (node) of several.
    """
    scratch = Scratch(graph.spark, "origins")
    seeds = node if isinstance(node, DataFrame) else graph.spark.createDataFrame([(node,)], "node string")
    maps = graph.mappings.where("source_node is not null and target_node is not null")
    hops = maps.select(
        F.col("target_node").alias("at_node"),
        F.lower("target_column").alias("at_column"),
        F.col("source_node").alias("to_node"),
        F.explode("source_columns").alias("to_column"),
        F.struct("transformation", F.coalesce("expression", F.lit("")).alias("expression")).alias("how"),
    ).withColumn("to_column", F.lower("to_column")).where("to_column <> '*'")
    # levels carry hashes of what was done; the texts are put in at the end
    hops = hops.select(F.struct("at_node", "at_column").alias("at"), F.struct("to_node", "to_column").alias("to"), "how", F.xxhash64("how").alias("h"))
    hops = scratch.cut(hops, "hops")
    told = scratch.cut(hops.groupBy("h").agg(F.min("how").alias("how")), "told")
    ways = Ways(hops.select("at", "to", "h"), "at", "to", scratch)
    cols = graph.columns.join(seeds.withColumnRenamed("node", "node_id"), "node_id", "left_semi")
    chain = F.array().cast("array<bigint>").alias("chain")
    first = cols.select(F.col("node_id").alias("node"), F.col("name_lc").alias("target_column"))
    keys = ["node", "target_column", "at_node", "at_column"]
    start = first.distinct().select("node", "target_column", F.col("node").alias("at_node"), F.col("target_column").alias("at_column"), chain)
    reached = walk(
        start,
        lambda f: ways.follow(f.withColumn("at", F.struct("at_node", "at_column"))).select(
            "node", "target_column", F.col("to.to_node").alias("at_node"), F.col("to.to_column").alias("at_column"),
            F.concat(F.array("h"), "chain").alias("chain"),
        ),
        keys,
        scratch,
    )
    fed = hops.select("at.at_node", "at.at_column").distinct()
    ends = reached.where("depth > 0").join(fed, ["at_node", "at_column"], "left_anti")
    out = ends.select(
        "node", "target_column", F.col("at_node").alias("origin_node"), F.col("at_column").alias("origin_column"), "depth", "chain"
    )
    keys = ["node", "target_column", "origin_node", "origin_column", "depth"]
    steps = out.select(*keys, F.posexplode("chain").alias("place", "h")).join(told, "h")
    steps = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "how"))).alias("steps"))  # one a level
    out = steps.select(*keys, F.transform("steps", lambda x: x["how"]).alias("chain"))
    literal = maps.join(seeds.withColumnRenamed("node", "target_node"), "target_node", "left_semi").where("transformation = 'literal'")
    own = literal.groupBy("target_node", F.lower("target_column").alias("column")).agg(F.min(F.coalesce("expression", F.lit(""))).alias("expression"))
    own = own.select(
        F.col("target_node").alias("node"), F.col("column").alias("target_column"), F.col("target_node").alias("origin_node"),
        F.col("column").alias("origin_column"), F.lit(0).cast("bigint").alias("depth"),
        F.array(F.struct(F.lit("literal").alias("transformation"), "expression")).alias("chain"),
    )
    return out.unionByName(own)


def origins_by_table(found: DataFrame) -> DataFrame:
    """(node, origin_node, origin_columns, n_columns, target_columns) of :func:`origins`."""
    return found.groupBy("node", "origin_node").agg(
        F.sort_array(F.collect_set("origin_column")).alias("origin_columns"),
        F.countDistinct("origin_column").alias("n_columns"),
        F.sort_array(F.collect_set("target_column")).alias("target_columns"),
    )


def origins_text(found: DataFrame) -> str:
    """Origins of one node as text, a table with its columns a line; for a node's worth of rows."""
    rows = origins_by_table(found).orderBy("origin_node").collect()
    return "\n".join(f"{r.origin_node}: {', '.join(r.origin_columns)}" for r in rows)


def ordered_chain(graph: LineageGraph, trace: DataFrame) -> DataFrame:
    """(section, place, node, type, column, data_type): upstream farthest first, the start, then downstream.

    Names and types as the nodes write them; ``*`` reads "(all rows)", an unknown node has type ``?``.
    """
    types = graph.nodes.select(F.col("node_id").alias("node"), "type")
    names = graph.columns.select(F.col("node_id").alias("node"), F.col("name_lc").alias("column"), "name", "data_type")
    section = F.when(F.col("direction") == "up", 0).when(F.col("direction") == "start", 1).otherwise(2)
    place = F.when(F.col("direction") == "up", -F.col("depth")).otherwise(F.col("depth"))
    full = trace.join(types, "node", "left").join(names, ["node", "column"], "left")
    return full.select(
        section.alias("section"),
        place.alias("place"),
        "node",
        F.coalesce("type", F.lit("?")).alias("type"),
        F.when(F.col("column") == "*", "(all rows)").otherwise(F.coalesce("name", "column")).alias("column"),
        F.coalesce("data_type", F.lit("")).alias("data_type"),
    )


TREE = "start string, place bigint, node string, column string, parent_node string, parent_column string, depth bigint"


def upstream_tree(graph: LineageGraph, node: DataFrame | str, column: str | None = None) -> DataFrame:
    """(start, place, node, column, parent_node, parent_column, depth): each upstream column once, depth first.

    ``place`` is the order of a depth-first walk that takes sources in order of their edges and never
    comes to a column again; a column stands under the one that led there first.  The columns are found
    level by level; the links among them, those of one start's upstream, are then walked in one task.
    """
    scratch = Scratch(graph.spark, "tree")
    key = F.struct("node", F.lower("column").alias("column"))
    starts = scratch.cut(_starts(graph, node, column).select(F.to_json(key).alias("start"), key.alias("at")), "starts")
    hops = graph.column_edges().where("source_node is not null and target_node is not null").groupBy(
        F.struct(F.col("target_node").alias("node"), F.col("target_column").alias("column")).alias("at"),
        F.struct(F.col("source_node").alias("node"), F.col("source_column").alias("column")).alias("to"),
    ).agg(F.min("edge_id").alias("edge"))
    hops = scratch.cut(hops, "hops")
    ways = Ways(hops, "at", "to", scratch)
    met = walk(starts, lambda f: ways.follow(f).select("start", F.col("to").alias("at")), ["start", "at"], scratch)
    links = met.select("start", "at").join(hops, "at", "left").select("start", F.to_json("at").alias("at"), F.to_json("to").alias("to"), "edge")

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        start = group.start.iloc[0]
        sources: dict[str, list[str]] = {}
        for at, to in group[group.to.notna()].sort_values(["at", "edge", "to"])[["at", "to"]].itertuples(index=False):
            sources.setdefault(at, []).append(to)
        rows, seen = [(start, None, 0)], {start}
        todo = [(start, 0, iter(sources.get(start, ())))]
        while todo:
            at, depth, ways = todo[-1]
            to = next(ways, None)
            if to is None:
                todo.pop()
            elif to not in seen:
                seen.add(to)
                rows.append((to, at, depth + 1))
                todo.append((to, depth + 1, iter(sources.get(to, ()))))
        out = []
        for place, (at, parent, depth) in enumerate(rows):
            own, above = json.loads(at), json.loads(parent) if parent else {}
            out.append((start, place, own.get("node"), own.get("column"), above.get("node"), above.get("column"), depth))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])

    return links.groupBy("start").applyInPandas(walked, TREE)


def tree_counts(tree: DataFrame) -> DataFrame:
    """One row: n_nodes, n_steps, n_leaves of an upstream tree."""
    parents = tree.select("start", F.col("parent_node").alias("node"), F.col("parent_column").alias("column")).distinct().withColumn("inner", F.lit(True))
    return tree.join(parents, ["start", "node", "column"], "left").agg(
        F.countDistinct("node").alias("n_nodes"), F.count("*").alias("n_steps"), F.count_if(F.col("inner").isNull()).alias("n_leaves")
    )


def trace_paths(graph: LineageGraph, node: DataFrame | str, column: str | None = None) -> DataFrame:
    """(node, column, path): all ways from a source through the column to a sink, as arrays of "node.column".

    Neither side of a path meets a column twice, which ends the search on loops.  A path of one step is given only
    if it is the only one.  The number of paths may grow exponentially with depth.
    """
    scratch = Scratch(graph.spark, "paths")
    label = F.concat_ws(".", "node", "column")
    hops = scratch.cut(_hops(graph).distinct(), "hops")
    start = _starts(graph, node, column).select("node", F.lower("column").alias("column"))

    def side(come: str, go: str, name: str) -> DataFrame:
        links = hops.select(
            F.concat_ws(".", f"{come}.node", f"{come}.column").alias("at"), F.concat_ws(".", f"{go}.node", f"{go}.column").alias("to")
        ).distinct()
        level = scratch.cut(start.select("node", "column", label.alias("at"), F.array(label).alias("path")), "paths")
        ended, schema = [], level.select("node", "column", "path").schema
        while True:
            grown = level.join(links, "at").where(~F.array_contains("path", F.col("to")))
            grown = scratch.cut(grown.select("node", "column", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path")), "paths")
            more = grown.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
            ended.append(scratch.write(level.join(more, "path", "left_anti").select("node", "column", "path"), "ended"))
            level = grown
            if level.isEmpty():
                break
        # read together by one scan, so the plan keeps its size however deep the paths are
        return scratch.read(ended, schema).withColumnRenamed("path", name)

    both = side("down", "up", "ups").join(side("up", "down", "downs"), ["node", "column"])
    whole = both.select(
        "node",
        "column",
        F.concat(F.reverse("ups"), F.slice("downs", F.lit(2), F.greatest(F.size("downs") - 1, F.lit(0)))).alias("path"),
    )
    count = F.count("*").over(Window.partitionBy("node", "column"))
    return whole.withColumn("__n", count).where((F.size("path") > 1) | (F.col("__n") == 1)).drop("__n")


def split_paths(paths: DataFrame) -> DataFrame:
    """(node, column, branch, suffix): the longest common ending of a column's paths, and what comes before it."""
    turned = paths.select("node", "column", "path", F.reverse("path").alias("back"))
    first = turned.groupBy("node", "column").agg(F.min("back").alias("low"), F.max("back").alias("high"))
    same = F.expr("aggregate(sequence(1, least(size(low), size(high))), 0, (n, i) -> if(n = i - 1 and low[i - 1] = high[i - 1], i, n))")
    shared = first.select("node", "column", same.alias("n"))  # what the least and the greatest share, all share
    joined = turned.join(shared, ["node", "column"])
    return joined.select(
        "node",
        "column",
        F.slice("path", F.lit(1), F.size("path") - F.col("n")).alias("branch"),
        F.reverse(F.slice("back", F.lit(1), F.col("n"))).alias("suffix"),
    )
