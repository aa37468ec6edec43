"""Progress events of scans as an append-only table, read as a stream or folded to a status."""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import EVENT_TYPES

SCHEMA = "scan_id string, seq bigint, type string, message string, ts double"
#: Event types that end a scan.
TERMINAL = ("complete", "error")


class EventLog:
    """Appends events of one scan as small JSON files; anyone may read them from the start, at any time."""

    def __init__(self, spark: SparkSession, path: str, scan_id: str | None = None):
        self.spark, self.path, self.scan_id = spark, path, scan_id or uuid.uuid4().hex
        self._seq = itertools.count()

    def publish(self, kind: str, message: str = "") -> None:
        if kind not in EVENT_TYPES:
            raise ValueError(f"unknown event type {kind}")
        seq = next(self._seq)
        row = {"scan_id": self.scan_id, "seq": seq, "type": kind, "message": message, "ts": time.time()}
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.scan_id}-{seq:06d}.json")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{self.scan_id}-{seq:06d}.tmp")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(part, True)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        fs.rename(part, target)  # whole files only ever appear


def reset(spark: SparkSession, path: str) -> None:
    """Forget all events; those who follow see no more of them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


#: Event files taken into one batch of a stream, and events handed over at a time.
FILES, CHUNK = 1000, 500


def stream_events(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """All events from the first on, then new ones as they come; late readers miss nothing."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def follow(
    spark: SparkSession,
    path: str,
    on_rows: Callable[[list], None],
    checkpoint: str,
    timeout: float = 600.0,
    on_idle: Callable[[], None] | None = None,
    idle: float = 30.0,
    files: int = FILES,
) -> None:
    """Hand events to ``on_rows`` (lists of rows, in order) until a scan's terminal event or the timeout.

    A backlog is taken in batches of at most ``files`` files and handed over in short lists, so that it
    never lies in memory whole.  ``on_idle`` is called when nothing has come for ``idle`` seconds.
    """
    ended, heard = [], [time.time()]

    def batch(df: DataFrame, _: int) -> None:
        part = []
        for row in df.orderBy("ts", "seq").toLocalIterator():
            part.append(row)
            if row.type in TERMINAL:
                ended.append(row)
            if len(part) >= CHUNK:
                on_rows(part)
                part = []
        if part:
            on_rows(part)
        heard[0] = time.time()

    query = stream_events(spark, path, files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    began = time.time()
    try:
        while not ended and time.time() - began < timeout and query.isActive:
            query.processAllAvailable()
            if on_idle and time.time() - heard[0] >= idle:
                on_idle()
                heard[0] = time.time()
            time.sleep(0.1)
    finally:
        query.stop()


def normalised(events: DataFrame) -> DataFrame:
    """Events with types outside the list read as progress."""
    known = F.col("type").isin(*EVENT_TYPES)
    return events.withColumn("type", F.when(known, F.col("type")).otherwise("progress"))


def fold_status(events: DataFrame, scan: str = "scan_id", seq: str = "seq", kind: str = "type") -> DataFrame:
    """(scan, status, last_type, n_events): a scan's state; its first terminal event decides, whatever follows."""
    first_end = F.min_by(kind, F.when(F.col(kind).isin(*TERMINAL), F.col(seq))).alias("ending")
    ends = F.max(F.col(kind).isin(*TERMINAL)).alias("ends")
    out = events.groupBy(scan).agg(first_end, ends, F.max_by(kind, seq).alias("last_type"), F.count("*").alias("n_events"))
    return out.select(scan, F.when(F.col("ends"), F.col("ending")).otherwise("running").alias("status"), "last_type", "n_events")
