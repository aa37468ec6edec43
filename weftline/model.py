"""Schemas and closed vocabularies of the lineage graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
NODE_TYPES = ("table", "view", "materialized", "routine")
NODE_SOURCES = ("bigquery_view", "scheduled_query", "routine", "ingestion", "external_process", "unknown")
NODE_STATUSES = ("ok", "warning", "error", "truncated")
LINEAGE_STATUSES = ("resolved", "unknown")
TRANSFORMATIONS = ("direct", "rename", "expression", "aggregation", "literal", "external", "new_field", "unknown")
EDGE_TYPES = ("automatic", "manual")
EVENT_TYPES = (
    "scan_start", "scan_dataset", "scan_node", "scan_complete", "build_sort", "build_parse", "build_complete", "complete", "error",
)

NODES = "node_id string, type string, dataset string, name string, source string, sql string, description string, status string, status_message string"
COLUMNS = "node_id string, ordinal int, name string, name_lc string, data_type string, lineage_status string"
EDGES = "edge_id string, source_node string, target_node string, edge_type string, description string"
MAPPINGS = (
    "edge_id string, source_node string, target_node string, target_column string, source_columns array<string>,"
    " transformation string, expression string, description string"
)


@dataclass(frozen=True)
class ScanConfig:
    """What a scan covers: a target and everything above it, or datasets, or all; depth in dataset hops."""

    target: str | None = None
    datasets: tuple[str, ...] = ()
    depth: int | None = None


@dataclass
class LineageGraph:
    """A graph as four tables; ``prune_points`` are node ids whose upstream is hidden."""

    nodes: DataFrame
    columns: DataFrame
    edges: DataFrame
    mappings: DataFrame
    prune_points: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    parse_errors: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def column_edges(self) -> DataFrame:
        """(edge_id, source_node, source_column, target_node, target_column), names in lower case."""
        return self.mappings.select(
            "edge_id",
            "source_node",
            "target_node",
            F.lower("target_column").alias("target_column"),
            F.explode("source_columns").alias("source_column"),
        ).select("edge_id", "source_node", F.lower("source_column").alias("source_column"), "target_node", "target_column")


def empty_graph(spark: SparkSession) -> LineageGraph:
    return LineageGraph(*(spark.createDataFrame([], s) for s in (NODES, COLUMNS, EDGES, MAPPINGS)))
