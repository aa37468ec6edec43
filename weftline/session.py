"""Session defaults and the scratch area in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app: str = "weftline", **conf: str) -> SparkSession:
    """A session for tests, the bench and the command line; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEFTLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


#: Areas not dropped yet, oldest first.
_areas: list[Scratch] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Drops on leaving all scratch areas made inside; write results before that.

    Results of operators are read from scratch tables, so these must outlive them: a long session
    wraps each step, from building a result to writing it, in a scope.
    """
    before = set(map(id, _areas))
    try:
        yield
    finally:
        for area in [a for a in _areas if id(a) not in before]:
            area.drop()


class Scratch:
    """Parquet tables under the checkpoint folder, one sub-folder per operator run.

    A written table cuts the lineage (a lost executor re-reads it), is computed once whatever
    the number of readers, and stays columnar.  Tables live until :meth:`drop`, the end of a
    :func:`scratch_scope` or of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _areas.append(self)

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the written table."""
        return self.read([self.write(df, name)], df.schema)

    def write(self, df: DataFrame, name: str = "t") -> str:
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        df.write.parquet(path)
        return path

    def read(self, paths: list[str], schema: StructType) -> DataFrame:
        """Several written tables of one schema by a single scan, however many they are."""
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self) -> None:
        """Delete the whole area."""
        if self in _areas:
            _areas.remove(self)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for area in list(_areas):
        try:
            area.drop()
        except Exception:  # the session may be gone at process end
            continue
