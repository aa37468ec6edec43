"""Building the graph from scanned nodes, its order and its statistics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import LineageGraph, ScanConfig
from weftline.plans.lineage import parse_views
from weftline.session import Scratch


def topological_order(nodes: DataFrame, deps: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, level, place): a node comes after all it depends on, first come first served.

    ``nodes`` is (node_id, ord), ``deps`` (node_id, dep).  Dependencies on itself or on unknown nodes
    do not count.  Nodes on or behind a cycle have level -1 and come last, in their own order.  The
    order is that of (level, place) with -1 last; ``place`` lists the ords along the last dependencies,
    so that no task sorts everything.  Each round handles the links out of the last level only.
    """
    own = deps.where("node_id <> dep").select("node_id", "dep").distinct()
    own = own.join(nodes.select("node_id"), "node_id", "left_semi")
    own = scratch.cut(own.join(nodes.select(F.col("node_id").alias("dep")), "dep", "left_semi").select("node_id", "dep"), "deps")
    need = own.groupBy("node_id").agg(F.count("*").alias("need"))
    todo = nodes.select("node_id", F.col("ord").cast("bigint").alias("ord")).join(need, "node_id", "left")
    todo = scratch.cut(todo.withColumn("need", F.coalesce("need", F.lit(0))), "todo")
    # of each node: how many of what it needs came up to a level, and the place that follows from the last
    state = todo.where("need = 0").select(
        "node_id", F.lit(0).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("got"), F.lit(True).alias("ready"), F.array("ord").alias("place")
    )
    schema, paths = state.schema, [scratch.write(state, "level")]
    while not (last := scratch.read(paths[-1:], schema).where("ready")).isEmpty():
        came = own.join(last.select(F.col("node_id").alias("dep"), "place"), "dep").groupBy("node_id").agg(
            F.count("*").alias("more"), F.max("place").alias("after")
        )
        before = scratch.read(paths, schema).groupBy("node_id").agg(F.max("got").alias("had"))
        now = came.join(before, "node_id", "left").join(todo, "node_id").select(
            "node_id", F.lit(len(paths)).cast("bigint").alias("level"), (F.coalesce("had", F.lit(0)) + F.col("more")).alias("got"), "need", F.concat("after", F.array("ord")).alias("place")
        )
        paths.append(scratch.write(now.select("node_id", "level", "got", (F.col("got") == F.col("need")).alias("ready"), "place"), "level"))
    done = scratch.read(paths, schema).where("ready").select("node_id", "level", "place")
    rest = todo.join(done.select("node_id"), "node_id", "left_anti")
    return done.unionByName(rest.select("node_id", F.lit(-1).cast("bigint").alias("level"), F.array("ord").alias("place")))


def graph_stats(graph: LineageGraph) -> DataFrame:
    """One row: total_nodes, total_edges, nodes_by_type, orphan_nodes, terminal_nodes, truncated_nodes, parse_errors."""
    ins = graph.edges.select(F.col("target_node").alias("node_id")).distinct().withColumn("has_in", F.lit(True))
    outs = graph.edges.select(F.col("source_node").alias("node_id")).distinct().withColumn("has_out", F.lit(True))
    marked = graph.nodes.select("node_id", "type", "status").join(ins, "node_id", "left").join(outs, "node_id", "left")
    by_type = marked.groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("has_in").isNull() & F.col("has_out").isNull()).alias("orphans"),
        F.count_if(F.col("has_in").isNotNull() & F.col("has_out").isNull()).alias("terminal"),
        F.count_if(F.col("status") == "truncated").alias("truncated"),
    )
    entry = F.struct(F.coalesce("type", F.lit("table")).alias("key"), F.col("n").alias("value"))
    totals = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_nodes"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("nodes_by_type"),
        F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphan_nodes"),
        F.coalesce(F.sum("terminal"), F.lit(0)).alias("terminal_nodes"),
        F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated_nodes"),
    )
    counts = {"total_edges": graph.edges.count(), "parse_errors": graph.parse_errors}
    return totals.withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


def column_status(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """``columns`` with lineage_status ``resolved`` where some mapping that is not unknown targets them, else ``unknown``."""
    known = mappings.where("transformation <> 'unknown'").select(
        F.col("target_node").alias("node_id"), F.lower("target_column").alias("name_lc"), F.lit(True).alias("hit")
    ).distinct()
    found = columns.drop("lineage_status").join(known, ["node_id", "name_lc"], "left")
    status = F.when(F.col("hit"), "resolved").otherwise("unknown").alias("lineage_status")
    return found.select(*[c for c in columns.columns if c != "lineage_status"], status).select(*columns.columns)


def split_manual(manual: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual edges whose ends both exist, and those dropped because one does not."""
    ids = nodes.select("node_id").distinct()
    kept = manual.join(ids.withColumnRenamed("node_id", "source_node"), "source_node", "left_semi")
    kept = kept.join(ids.withColumnRenamed("node_id", "target_node"), "target_node", "left_semi").select(*manual.columns)
    return kept, manual.join(kept.select("edge_id"), "edge_id", "left_anti")


def build_graph(
    nodes: DataFrame,
    columns: DataFrame,
    config: ScanConfig | None = None,
    project: str = "",
    manual: LineageGraph | None = None,
    only: DataFrame | None = None,
    carried: LineageGraph | None = None,
    generated_at: str | None = None,
    progress: Callable[[str, str], None] = lambda kind, message: None,
) -> LineageGraph:
    """The graph of scanned nodes: views parsed, statuses set, manual edges kept, parse errors counted.

    ``only`` (node_id) restricts parsing; ``carried`` are automatic edges kept from before, replaced
    for views that are parsed again.  Dynamic SQL makes a view a warning with unknown columns even if
    it had another status; other findings never override a status that is not ok.
    """
    scratch = Scratch(nodes.sparkSession, "build")
    progress("build_sort", "Reading the SQL of views")
    parsed = scratch.cut(parse_views(nodes, columns, only), "parsed")
    found = parsed.where("outcome = 'ok'")
    edge_id = F.concat(F.lit("edge_"), "source_node", F.lit("__"), "target_node").alias("edge_id")
    none = F.lit(None).cast("string")
    maps = found.select(
        edge_id, "source_node", "target_node", "target_column", "source_columns", "transformation", "expression", none.alias("description")
    )
    edges = maps.select("edge_id", "source_node", "target_node", F.lit("automatic").alias("edge_type"), none.alias("description")).distinct()
    if carried is not None:
        stay = carried.edges.join(parsed.select("target_node").distinct(), "target_node", "left_anti").select(*edges.columns)
        edges = edges.unionByName(stay)
        maps = maps.unionByName(carried.mappings.join(stay.select("edge_id"), "edge_id", "left_semi").select(*maps.columns))
    if manual is not None:
        kept, _ = split_manual(manual.edges, nodes)
        edges = edges.unionByName(kept.select(*edges.columns))
        maps = maps.unionByName(manual.mappings.join(kept.select("edge_id"), "edge_id", "left_semi").select(*maps.columns))
    outcome = parsed.groupBy("target_node").agg(F.max("outcome").alias("outcome")).withColumnRenamed("target_node", "node_id")
    seen = nodes.join(outcome, "node_id", "left")
    weak = F.col("outcome").isin("no_schema", "empty", "failed") & (F.col("status") == "ok")
    text = (
        F.when(F.col("outcome") == "dynamic", "Dynamic SQL (EXECUTE IMMEDIATE) cannot be traced")
        .when(F.col("outcome") == "failed", "Lineage parsing failed")
        .otherwise("Lineage could not be resolved")
    )
    changed = weak | (F.col("outcome") == "dynamic")
    statuses = seen.select(
        *[c for c in nodes.columns if c not in ("status", "status_message")],
        F.when(changed, "warning").otherwise(F.col("status")).alias("status"),
        F.when(changed, text).otherwise(F.col("status_message")).alias("status_message"),
    ).select(*nodes.columns)
    blind = outcome.where("outcome in ('dynamic', 'failed')").select("node_id")
    looked = outcome.where("outcome in ('ok', 'empty')").select("node_id")
    cols = column_status(columns.join(looked, "node_id", "left_semi"), maps)
    cols = cols.unionByName(columns.join(blind, "node_id", "left_semi").withColumn("lineage_status", F.lit("unknown")))
    cols = cols.unionByName(columns.join(looked.unionByName(blind), "node_id", "left_anti"))
    config = config or ScanConfig()
    meta = {
        "project_id": project,
        "generated_at": generated_at or datetime.now(UTC).isoformat(),
        "description": None,
        "scan_config": {"target": config.target, "datasets": list(config.datasets), "depth": config.depth},
    }
    by_outcome = {r.outcome: r["count"] for r in outcome.groupBy("outcome").count().collect()}
    errors = sum(n for kind, n in by_outcome.items() if kind != "ok")
    progress("build_parse", f"Read {sum(by_outcome.values())} views, {errors} without lineage")
    parts = {"nodes": statuses, "columns": cols, "edges": edges, "mappings": maps}
    # written once: graphs are built upon graphs, and plans must not grow with every step
    built = LineageGraph(*(scratch.cut(df, name) for name, df in parts.items()), metadata=meta, parse_errors=errors)
    progress("build_complete", f"Graph of {built.nodes.count()} nodes and {built.edges.count()} edges")
    return built
