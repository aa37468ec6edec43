"""Queries of the general problems over the graph tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.hierarchy import graph_hierarchy
from weftline.operators.orphans import find_orphans, orphan_report
from weftline.operators.shred import TABLES, export_items, flat_table, flatten_exports
from weftline.operators.snapshot_diff import snapshot_changes
from weftline.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, directory, n) for n in names]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_orphans(*_tables(spark, directory, "edge_snapshots", "node_snapshots", "shared_nodes", "graph_metadata"))


def p1_report(spark: SparkSession, directory: str) -> DataFrame:
    return orphan_report(*_tables(spark, directory, "edge_snapshots", "node_snapshots", "shared_nodes", "graph_metadata"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return snapshot_changes(*_tables(spark, directory, "node_snapshots", "edge_snapshots", "graph_metadata"))


def p2_counts(spark: SparkSession, directory: str) -> DataFrame:
    return p2_found(spark, directory).groupBy("snapshot_id", "entity", "change").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return graph_hierarchy(*_tables(spark, directory, "edges", "nodes", "shared_nodes")).table()


def p5_paths(spark: SparkSession, directory: str) -> DataFrame:
    paths = graph_hierarchy(*_tables(spark, directory, "edges", "nodes", "shared_nodes")).paths()
    return paths.select("root_id", "node_id", "depth", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, directory: str) -> DataFrame:
    return graph_hierarchy(*_tables(spark, directory, "edges", "nodes", "shared_nodes")).descendants()


def p5_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return graph_hierarchy(*_tables(spark, directory, "edges", "nodes", "shared_nodes")).pairs()


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return export_items(read_table(spark, directory, "graph_exports"))


def p6_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of each flat table, by export."""
    flat = flatten_exports(read_table(spark, directory, "graph_exports"))
    return flat.groupBy("export_id", "entry").agg(F.count("*").alias("n"))


def _flat_table(name: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return flat_table(read_table(spark, directory, "graph_exports"), name)

    query.__name__ = f"p6_{name}"
    return query


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_report, p2_found, p2_counts, p5_found, p5_paths, p5_descendants, p5_pairs, p6_found, p6_tables, *map(_flat_table, TABLES))
}
