"""Reading the graph tables and picking the newest delivery of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def newest(df: DataFrame, keys: list[str], time: str, keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``time`` (null counts as oldest).

    Rows of equal time are ordered by a hash of their kept columns, so exact repeats collapse and
    conflicting ties resolve alike on every run.  Spark limits each key to one row before the
    shuffle, so a key with many deliveries does not grow a task.  Rows with a null key count as one
    key each way the key is null.  Columns outside ``keep`` are never read.
    """
    keep = keep or [c for c in df.columns if c != time]
    cols = list(dict.fromkeys([*keys, *keep]))
    hashable = [c for c in cols if not _has_map(df.schema[c].dataType)]
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.xxhash64(*hashable))
    kept = df.select(*dict.fromkeys([*cols, time])).withColumn("__rank", F.row_number().over(order))
    return kept.where("__rank = 1").select(*cols)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def named_id(endpoint: Column) -> Column:
    """The id an endpoint names: no backticks, no outer blanks, last two dotted parts."""
    bare = F.trim(F.translate(endpoint, "`", ""))
    parts = F.split(bare, r"\.", -1)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(bare)


def iso_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO-8601 text; no offset means UTC, unreadable is null.

    Accepts ``T`` or a blank between date and time, either case, ``Z``, ``+hh``, ``+hhmm`` and ``+hh:mm``.
    """
    flat = F.regexp_replace(F.upper(F.trim(text)), r"[,](\d+)", r".$1")
    flat = F.regexp_replace(flat, r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([+-]\d{2})(\d{2})?$", r"$1$2:$3")
    flat = F.regexp_replace(flat, r"([+-]\d{2}):$", r"$1:00")
    zoned = F.when(flat.rlike(r"(Z|UTC|[+-]\d{2}:\d{2})$"), flat).otherwise(F.concat(flat, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def scan_order(metadata: DataFrame) -> DataFrame:
    """(snapshot_id, project_id, ord, prev_id): scans in order of generated_at within a project.

    Repeated headers count once (newest by received_at); equal times are ordered by snapshot_id;
    a scan whose time is unreadable comes first in its project.
    """
    heads = newest(metadata, ["snapshot_id"], "received_at", ["project_id", "generated_at"])
    heads = heads.where("snapshot_id is not null").select(
        "snapshot_id", "project_id", iso_micros(F.col("generated_at")).alias("at")
    )
    order = Window.partitionBy("project_id").orderBy(F.col("at").asc_nulls_first(), "snapshot_id")
    return heads.select(
        "snapshot_id",
        "project_id",
        F.row_number().over(order).cast("bigint").alias("ord"),
        F.lag("snapshot_id").over(order).alias("prev_id"),
    )
