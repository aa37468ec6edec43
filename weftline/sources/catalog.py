"""Catalogue of datasets, tables, view texts and columns, from saved rows or from Spark's own catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import COLUMNS, NODES, LineageGraph
from weftline.sources.tables import named_id, newest, read_table


def table_type(kind: Column) -> Column:
    """Node type of a catalogue's table type; what is unknown is a table."""
    return F.when(F.upper(kind) == "VIEW", "view").when(F.upper(kind) == "MATERIALIZED VIEW", "materialized").otherwise("table")


def list_datasets(nodes: DataFrame) -> DataFrame:
    """(dataset, tables, views): how many of each a dataset holds; null datasets are left out."""
    return nodes.where("dataset is not null").groupBy("dataset").agg(
        F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "view").alias("views")
    )


def list_tables(nodes: DataFrame, dataset: str | None = None) -> DataFrame:
    found = nodes if dataset is None else nodes.where(F.col("dataset") == dataset)
    return found.select("node_id", "dataset", "name", "type")


def view_definitions(nodes: DataFrame, dataset: str | None = None) -> DataFrame:
    found = nodes if dataset is None else nodes.where(F.col("dataset") == dataset)
    return found.where("sql is not null").select("node_id", "sql")


def columns_of(columns: DataFrame, node_id: str | None = None) -> DataFrame:
    found = columns if node_id is None else columns.where(F.col("node_id") == node_id)
    return found.select("node_id", "ordinal", "name", "data_type")


def assemble_nodes(tables: DataFrame, views: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and columns from (dataset, name, table_type), (dataset, name, sql), (dataset, name, ordinal, column, data_type)."""
    key = ["dataset", "name"]
    joined = tables.join(views.select(*key, "sql"), key, "left")
    kind = table_type(F.col("table_type"))
    nodes = joined.select(
        F.concat_ws(".", *key).alias("node_id"),
        kind.alias("type"),
        *key,
        F.when(kind == "view", "bigquery_view").otherwise("ingestion").alias("source"),
        "sql",
        F.lit(None).cast("string").alias("description"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("status_message"),
    )
    known = columns.join(tables.select(*key), key, "left_semi")
    cols = known.select(
        F.concat_ws(".", *key).alias("node_id"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("column").alias("name"),
        F.lower("column").alias("name_lc"),
        "data_type",
        F.lit("resolved").alias("lineage_status"),
    )
    return nodes, cols


class SparkCatalog:
    """Spark's own databases, each read once when first asked for; one that cannot be read is an error, not the end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.errors: list[str] = []
        self._read: dict[str, tuple[list[tuple], list[tuple]]] = {}

    def databases(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def rows(self, db: str) -> tuple[list[tuple], list[tuple]]:
        """Node and column rows of a database."""
        if db not in self._read:
            try:
                self._read[db] = self._all(db)
            except Exception as e:
                self.errors.append(f"Failed to extract dataset {db}: {type(e).__name__}")
                self._read[db] = [], []
        return self._read[db]

    def _all(self, db: str) -> tuple[list[tuple], list[tuple]]:
        nodes, cols = [], []
        for t in self.spark.catalog.listTables(db):
            if t.isTemporary:
                continue
            sql, view = None, t.tableType == "VIEW"
            if view:
                found = self.spark.sql(f"DESCRIBE TABLE EXTENDED `{db}`.`{t.name}`").where("col_name = 'View Text'").collect()
                sql = found[0].data_type if found else None
            source = ("bigquery_view" if sql else "unknown") if view else "ingestion"
            nodes.append((f"{db}.{t.name}", "view" if view else "table", db, t.name, source, sql, t.description, "ok", None))
            for i, f in enumerate(self.spark.table(f"`{db}`.`{t.name}`").schema.fields):
                cols.append((f"{db}.{t.name}", i, f.name, f.name.lower(), f.dataType.simpleString(), "resolved"))
        return nodes, cols

    def view_sql(self, db: str, name: str) -> str | None:
        return next((n[5] for n in self.rows(db)[0] if n[3] == name), None)

    def table_type(self, db: str, name: str) -> str | None:
        """None if there is no such table."""
        return next((n[1] for n in self.rows(db)[0] if n[3] == name), None)

    def frames(self, databases: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and columns of the databases, or of all."""
        read = [self.rows(db) for db in (self.databases() if databases is None else databases)]
        nodes, cols = ([row for part in read for row in part[k]] for k in (0, 1))
        return self.spark.createDataFrame(nodes, NODES), self.spark.createDataFrame(cols, COLUMNS)


def from_spark_catalog(spark: SparkSession, databases: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes, columns and errors of Spark's own databases."""
    read = SparkCatalog(spark)
    return *read.frames(databases), read.errors


def graph_from_rows(nodes: DataFrame, edges: DataFrame, shared_nodes: DataFrame | None = None) -> LineageGraph:
    """A graph from rows with nested columns and mappings; the newest row of each id counts.

    Null ids are no record, null arrays are empty, endpoints are taken as the ids they name.
    """
    want = ["type", "dataset", "name", "source", "sql", "description", "status", "status_message", "columns"]
    rows = newest(nodes, ["id"], "scanned_at", want) if "scanned_at" in nodes.columns else nodes.select("id", *want)
    if shared_nodes is not None:
        more = shared_nodes.withColumn("sql", F.lit(None).cast("string")).select("id", *want)
        rows = rows.unionByName(more.join(rows.select("id"), "id", "left_anti"))
    rows = rows.where("id is not null").withColumnRenamed("id", "node_id")
    cols = rows.select("node_id", F.posexplode("columns").alias("ordinal", "c")).select(
        "node_id",
        "ordinal",
        F.col("c.name").alias("name"),
        F.lower("c.name").alias("name_lc"),
        F.col("c.data_type").alias("data_type"),
        F.coalesce("c.lineage_status", F.lit("resolved")).alias("lineage_status"),
    )
    keep = ["source_node", "target_node", "edge_type", "description", "column_mappings"]
    ends = newest(edges, ["id"], "scanned_at", keep) if "scanned_at" in edges.columns else edges.select("id", *keep)
    ends = ends.where("id is not null").select(
        F.col("id").alias("edge_id"),
        named_id(F.col("source_node")).alias("source_node"),
        named_id(F.col("target_node")).alias("target_node"),
        F.coalesce("edge_type", F.lit("automatic")).alias("edge_type"),
        "description",
        "column_mappings",
    )
    maps = ends.select("edge_id", "source_node", "target_node", F.explode("column_mappings").alias("m")).select(
        "edge_id",
        "source_node",
        "target_node",
        F.col("m.target_column").alias("target_column"),
        F.coalesce("m.source_columns", F.array().cast("array<string>")).alias("source_columns"),
        F.coalesce("m.transformation", F.lit("unknown")).alias("transformation"),
        F.col("m.expression").alias("expression"),
        F.col("m.description").alias("description"),
    )
    return LineageGraph(rows.drop("columns"), cols, ends.drop("column_mappings"), maps)


def saved_graph(spark: SparkSession, directory: str) -> LineageGraph:
    """The current graph of a directory of tables, shared nodes included."""
    return graph_from_rows(*(read_table(spark, directory, t) for t in ("nodes", "edges", "shared_nodes")))
