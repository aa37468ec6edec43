"""References to records that do not exist, per field and period.

References are first counted per (period, node, column), so later joins see a key once however
often it is used.  Keys with a large share of all references (few by construction) are checked by
broadcast, the others by a shuffled anti-join; both orphan counts are united and, for a listing,
joined back to the referring rows with the same split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import MAX_HEAVY, heavy_keys
from weftline.session import Scratch
from weftline.sources.tables import named_id, newest, scan_order

KEY = ["snapshot_id", "node", "col"]


def _lower_names(array: str, name: str) -> str:
    return f"array_distinct(filter(transform(coalesce({array}, array()), x -> lower({name})), c -> c is not null))"


def edge_ends(edges: DataFrame) -> DataFrame:
    """(snapshot_id, id, received_at, src, tgt, cols): what edges refer to, without the text beside it.

    Null source columns refer to nothing, ``*`` to no single column.
    """
    named = "flatten(transform(coalesce(column_mappings, array()), m -> coalesce(m.source_columns, array())))"
    return edges.where("snapshot_id is not null and id is not null").select(
        "snapshot_id",
        "id",
        "received_at",
        named_id(F.col("source_node")).alias("src"),
        named_id(F.col("target_node")).alias("tgt"),
        F.expr(f"array_remove({_lower_names(named, 'x')}, '*')").alias("cols"),
    )


def edge_references(ends: DataFrame) -> DataFrame:
    """(snapshot_id, edge_id, field, node, col): col is '' for a reference to the node itself.

    ``ends`` has one row per (snapshot_id, id).  Null endpoints refer to nothing.
    """
    refs = F.expr(
        "concat(array(struct('source_node' as field, src as node, cast('' as string) as col),"
        " struct('target_node' as field, tgt as node, cast('' as string) as col)),"
        " transform(cols, c -> struct('source_columns' as field, src as node, c as col)))"
    )
    out = ends.select("snapshot_id", F.col("id").alias("edge_id"), F.explode(refs).alias("r")).select("snapshot_id", "edge_id", "r.*")
    return out.where("node is not null")


def held_nodes(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, id, received_at, cols): lower-case column names of each node, a null array as empty."""
    names = F.expr(_lower_names("columns", "x.name"))
    return nodes.where("id is not null").select("snapshot_id", "id", "received_at", names.alias("cols"))


#: Held rows of heavy keys, and column names in them, that are broadcast; more are joined by shuffle.
HOT_ROWS, HOT_NAMES = 100_000, 2_000_000
#: Orphan keys that are broadcast to the references; of more, only the heavy ones.
FEW_KEYS = 200_000


def _lacking(keys: DataFrame, held: DataFrame, common: DataFrame) -> DataFrame:
    """Keys whose node is neither held nor common, or has columns of which none is the one named."""
    found = keys.join(held, ["snapshot_id", "node"], "left").join(common, "node", "left")
    cols = F.coalesce("cols", "common_cols")
    lacks = F.when(F.col("col") == "", cols.isNull()).otherwise((F.size(cols) > 0) & ~F.array_contains(cols, F.col("col")))
    return found.where(lacks).select(*keys.columns)


def orphan_keys(refs: DataFrame, held: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(snapshot_id, node, col, n): keys of references that lack their record, n references each.

    ``held`` is (snapshot_id, node, cols); ``shared`` (node, cols) belongs to every period.  What is held
    of heavy keys is broadcast if it is measured to be small: then their references are checked where they lie.
    """
    counts = scratch.cut(refs.groupBy(*KEY).agg(F.count("*").alias("n")), "counts")
    heavy = F.broadcast(scratch.cut(heavy_keys(counts, ["node"]), "heavy"))  # under MAX_HEAVY rows
    common = shared.groupBy("node").agg(F.flatten(F.collect_list("cols")).alias("common_cols"))
    hot_held = scratch.cut(held.join(heavy, "node", "left_semi"), "hot_held")
    size = hot_held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("cols")), F.lit(0)).alias("names")).collect()[0]
    small = size.n <= HOT_ROWS and size.names <= HOT_NAMES
    hot = _lacking(counts.join(heavy, "node", "left_semi"), F.broadcast(hot_held) if small else hot_held, common)
    rest = _lacking(counts.join(heavy, "node", "left_anti"), held.join(heavy, "node", "left_anti"), common)
    return hot.unionByName(rest)


def orphan_kinds(orphans: DataFrame, held: DataFrame, order: DataFrame) -> DataFrame:
    """Adds kind: ``deleted`` if an earlier scan of the project holds it, else ``late`` if a later one does, else ``missing``."""
    placed = orphans.join(order.select("snapshot_id", "project_id", "ord"), "snapshot_id", "left")
    wanted = placed.select("project_id", "node").distinct()
    seen = held.join(order.select("snapshot_id", "project_id", "ord"), "snapshot_id").join(
        wanted, ["project_id", "node"], "left_semi"
    )
    seen = seen.select(
        "project_id", "node", "ord", F.explode(F.concat(F.array(F.lit("")), F.col("cols"))).alias("col")
    ).groupBy("project_id", "node", "col").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    kind = F.when(F.col("first") < F.col("ord"), "deleted").when(F.col("last") > F.col("ord"), "late").otherwise("missing")
    return placed.join(seen, ["project_id", "node", "col"], "left").select(*orphans.columns, kind.alias("kind"))


def find_orphans(
    edge_snapshots: DataFrame, node_snapshots: DataFrame, shared_nodes: DataFrame, graph_metadata: DataFrame
) -> DataFrame:
    """(snapshot_id, edge_id, field, ref, kind), distinct.

    Rows with a null snapshot_id or id are no record.  A scan without a header has no earlier or
    later scan.  Empty tables give no rows or all references; extra columns are not read.
    """
    scratch = Scratch(edge_snapshots.sparkSession, "orphans")
    # only what is compared is moved to find the newest rows
    edges = newest(edge_ends(edge_snapshots), ["snapshot_id", "id"], "received_at", ["src", "tgt", "cols"])
    nodes = newest(held_nodes(node_snapshots), ["snapshot_id", "id"], "received_at", ["cols"])
    refs = scratch.cut(edge_references(edges), "refs")
    held = scratch.cut(nodes.withColumnRenamed("id", "node"), "held")
    shared = shared_nodes.where("id is not null").select(F.col("id").alias("node"), F.expr(_lower_names("columns", "x.name")).alias("cols"))
    order = scratch.cut(scan_order(graph_metadata), "order")
    orphans = orphan_keys(refs, held, shared, scratch)
    kinds = scratch.cut(orphan_kinds(orphans, held, order), "kinds")
    # back to the referring rows: few keys go by broadcast, of many those used by more than 1/MAX_HEAVY of the rows
    size = kinds.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
    hot = F.lit(True) if size.keys <= FEW_KEYS else F.col("n") * MAX_HEAVY > F.lit(size.n)
    keys = kinds.select(*KEY, "kind", hot.alias("hot"))
    both = refs.join(F.broadcast(keys.where("hot").drop("hot")), KEY)
    if size.keys > FEW_KEYS:
        both = both.unionByName(refs.join(keys.where("not hot").drop("hot"), KEY))
    ref = F.when(F.col("field") == "source_columns", F.col("col")).otherwise(F.col("node"))
    # one row each: references are distinct within an edge, and keys have one kind
    return both.select("snapshot_id", "edge_id", "field", ref.alias("ref"), "kind")


def orphan_report(
    edge_snapshots: DataFrame, node_snapshots: DataFrame, shared_nodes: DataFrame, graph_metadata: DataFrame
) -> DataFrame:
    """Orphan references per snapshot, field and kind: (snapshot_id, field, kind, n_refs, n_keys)."""
    found = find_orphans(edge_snapshots, node_snapshots, shared_nodes, graph_metadata)
    return found.groupBy("snapshot_id", "field", "kind").agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref").alias("n_keys")
    )
