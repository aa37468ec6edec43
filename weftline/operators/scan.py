"""Scans over view references: backwards from a target, or over datasets and what they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import ScanConfig
from weftline.session import Scratch


@dataclass
class ScanResult:
    """Nodes found, with stubs for what was cut off, and (ord, message) errors."""

    nodes: DataFrame
    errors: DataFrame


def resolve_references(refs: DataFrame, nodes: DataFrame, project: str | None = None) -> DataFrame:
    """(node_id, ord, ref_id, ref_dataset): a name without dataset is one of the view's own dataset.

    A dataset written with the project before it loses that; with ``project`` None, whatever project it is.
    """
    own = nodes.select("node_id", F.col("dataset").alias("own_dataset"))
    parts = F.split("ref_dataset", r"\.")
    bare = F.element_at(parts, -1)
    if project is not None:
        bare = F.when((F.size(parts) > 1) & (parts[0] != project), F.col("ref_dataset")).otherwise(bare)
    dataset = F.coalesce(bare, "own_dataset")
    return refs.join(own, "node_id").select(
        "node_id", "ord", F.concat_ws(".", dataset, "ref_table").alias("ref_id"), dataset.alias("ref_dataset")
    )


ARRIVAL = "node_id string, ord array<string>, hops int, dataset string, message string"


def _first(df: DataFrame, shortest: bool = False) -> DataFrame:
    """The first arrival of each node, in queue order or, for ``shortest``, of the least hops."""
    rank = ("hops", "ord") if shortest else ("ord", "hops")
    best = df.groupBy("node_id").agg(F.min(F.struct(*rank, "dataset", "message")).alias("b"))
    return best.select("node_id", "b.ord", "b.hops", "b.dataset", "b.message")


def _place(number: str):
    """A number as text that sorts as the number does."""
    return F.lpad(F.col(number).cast("string"), 10, "0")


def run_scan(
    nodes: DataFrame, refs: DataFrame, config: ScanConfig, progress: Callable[[str, str], None] = lambda kind, message: None, shortest: bool = False
) -> ScanResult:
    """Scan the catalogue ``nodes`` along ``refs`` (of :func:`resolve_references`).

    A queue is followed level by level: within a level, parents in their order and then the place
    of the reference decide which arrival of a node counts, so hops are those of the first path
    found; with ``shortest`` they are the least ones over all paths.  Datasets are listed in the order
    given, their nodes by name.  Beyond ``depth`` dataset hops, and outside the datasets of a targeted
    scan, nodes become truncated stubs, unless another reference reaches them.  A node the catalogue
    lacks is an error, and so is one it could not read (status error).  Loops end by themselves.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "scan")
    progress("scan_start", f"Scan of {config.target or ', '.join(config.datasets) or 'the whole project'}, depth {config.depth}")
    nodes = scratch.cut(nodes, "nodes")
    refs = scratch.cut(refs, "refs")
    datasets = list(config.datasets)
    empty = spark.createDataFrame([], ARRIVAL)
    none = F.lit(None).cast("string")
    columns = empty.columns
    late: list[str] = []  # written tables: arrivals beyond the limits
    if config.target is not None:
        if len(config.target.split(".")) != 2:
            message = f"Invalid target format '{config.target}': expected 'dataset.table'"
            return ScanResult(nodes.where("false"), spark.createDataFrame([(0, message)], "ord int, message string"))
        queue = spark.createDataFrame([(config.target, ["0"], 0, config.target.split(".")[0], None)], ARRIVAL)
        stubs, listed = empty, nodes.where("false")
        allowed = F.col("dataset").isin(datasets) if datasets else F.lit(True)
    else:
        for d in datasets:
            progress("scan_dataset", f"Dataset {d}")
        listed = nodes.where(F.col("dataset").isin(datasets)) if datasets else nodes
        outside = refs.join(listed.select("node_id", "dataset", "name"), "node_id")
        outside = outside.join(listed.select(F.col("node_id").alias("ref_id")), "ref_id", "left_anti")
        hops = F.when(F.col("ref_dataset").isin(datasets), 0).otherwise(1) if datasets else F.lit(0)
        turn = F.coalesce(F.array_position(F.lit(datasets), F.col("dataset")), F.lit(0)) if datasets else F.lit(0)
        first = outside.withColumn("turn", turn).select(
            F.col("ref_id").alias("node_id"),
            F.array(_place("turn"), F.coalesce("dataset", F.lit("")), F.coalesce("name", F.lit("")), _place("ord")).alias("ord"),
            hops.alias("hops"), F.col("ref_dataset").alias("dataset"), none.alias("message"),
        )
        queue, stubs = _within(first, config.depth)
        # stubs made while the datasets are listed are final
        stubs = scratch.cut(_first(stubs, shortest), "stubs")
        queue = queue.join(stubs.select("node_id"), "node_id", "left_anti")
        allowed = F.lit(True)
    levels: list[str] = []
    while True:
        # a node counts at its first arrival; the shortest way may also lead through one that was met before
        seen = scratch.read(levels, empty.schema) if levels else empty
        known = seen.select("node_id", "hops").unionByName(stubs.select("node_id", F.lit(-1).alias("hops")) if config.target is None else empty.select("node_id", "hops"))
        known = known.groupBy("node_id").agg(F.min("hops").alias("known"))
        level = _first(queue, shortest).join(known, "node_id", "left").where(F.col("known").isNull() | (F.lit(shortest) & (F.col("hops") < F.col("known"))))
        levels.append(scratch.write(level.select(*columns), "level"))
        level = scratch.read(levels[-1:], empty.schema)
        if level.isEmpty():
            break
        progress("scan_node", f"Level {len(levels)}: {level.count()} nodes")
        steps = level.where(allowed).join(refs.withColumnRenamed("ord", "place"), "node_id").select(
            F.col("ref_id").alias("node_id"),
            F.concat("ord", F.array(_place("place"))).alias("ord"),
            (F.col("hops") + (F.col("ref_dataset") != F.col("dataset")).cast("int")).alias("hops"),
            F.col("ref_dataset").alias("dataset"),
            none.alias("message"),
        )
        if config.target is None:  # listed nodes are known already
            steps = steps.join(listed.select("node_id"), "node_id", "left_anti")
        queue, cut = _within(steps, config.depth)
        late.append(scratch.write(cut.select(*columns), "late"))
    reached = _first(scratch.read(levels, empty.schema), shortest) if shortest else scratch.read(levels, empty.schema)
    fetched = scratch.cut(reached.where(allowed), "fetched")
    refused = reached.where(~allowed).withColumn("message", F.lit("Dataset not in scan scope"))
    stubs = stubs.unionByName(refused.select(*columns))
    real = nodes.join(fetched.select("node_id"), "node_id", "left_semi")
    if "type" in nodes.columns and "source" in nodes.columns:  # a view fetched by itself without a text has no known source
        real = real.withColumn("source", F.when((F.col("type") == "view") & F.col("sql").isNull(), "unknown").otherwise(F.col("source"))).select(*nodes.columns)
    if config.target is None:
        real = real.join(listed.select("node_id"), "node_id", "left_anti").unionByName(listed)
    missing = fetched.join(nodes.select("node_id"), "node_id", "left_anti")
    cut_off = stubs.select(*columns)
    settled = cut_off.select("node_id").unionByName(fetched.select("node_id")).unionByName(real.select("node_id"))
    beyond = scratch.read(late, empty.schema) if late else empty
    cut_off = cut_off.unionByName(_first(beyond, shortest).join(settled, "node_id", "left_anti").select(*columns))
    cut_off = cut_off.join(real.select("node_id"), "node_id", "left_anti")

    def stub(df: DataFrame, status: str, source: str, message) -> DataFrame:
        made = {
            "node_id": F.col("node_id"), "type": F.lit("table"), "dataset": F.col("dataset"),
            "name": F.element_at(F.split("node_id", r"\."), -1), "source": F.lit(source), "sql": none,
            "description": none, "status": F.lit(status), "status_message": message,
        }
        return df.select(*(made.get(c, none).alias(c) for c in nodes.columns))

    lost = F.concat(F.lit("Table "), F.col("node_id"), F.lit(" not found"))
    missing = scratch.cut(missing, "missing")
    real = scratch.cut(real, "real")
    out = real.unionByName(stub(cut_off, "truncated", "unknown", F.col("message")))
    out = scratch.cut(out.unionByName(stub(missing, "error", "unknown", lost)), "scanned")
    said = missing.select(F.lit(0).alias("ord"), lost.alias("message"))
    if "status" in nodes.columns:
        failed = F.concat(F.lit("Failed to access "), F.col("node_id"))
        said = said.unionByName(real.where("status = 'error'").select(F.lit(0).alias("ord"), F.coalesce("status_message", failed).alias("message")))
    progress("scan_complete", f"{out.count()} nodes found")
    return ScanResult(out, said)


def _within(refs: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """References within the limit, and those beyond it with their message."""
    if depth is None:
        return refs, refs.where("false")
    text = F.format_string(f"Depth limit reached (%d dataset hops > {depth})", "hops")
    return refs.where(F.col("hops") <= depth), refs.where(F.col("hops") > depth).withColumn("message", text)
