"""Level-by-level walks over tables of links, for any kind of start and step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import heavy_keys, salted, spread
from weftline.session import Scratch

Step = Callable[[DataFrame], DataFrame]


def walk(start: DataFrame, step: Step, keys: list[str], scratch: Scratch, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows reached from ``start``, each key once, with its level as ``depth``.

    ``step`` gives the next rows of a level, in the columns of ``start``.  Of several arrivals at a
    level the least by ``order`` (all other columns, if not given) is kept.  Levels are written, so
    plans do not grow; loops end, since keys seen before are dropped.  ``limit`` bounds the levels.
    """
    cols = start.columns
    rest = order or [c for c in cols if c not in keys]

    def once(df: DataFrame) -> DataFrame:
        if len(cols) == len(keys):
            return df.select(*cols).distinct()
        others = [c for c in cols if c not in keys]
        best = F.min(F.struct(*rest, *[c for c in others if c not in rest])).alias("best")
        return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in cols))

    # levels are read together by one scan, so plans stay the same size
    level = once(start).withColumn("depth", F.lit(0).cast("bigint"))
    schema, paths = level.schema, [scratch.write(level, "level")]
    while limit is None or len(paths) <= limit:
        last = scratch.read(paths[-1:], schema)
        if last.isEmpty():
            break
        seen = scratch.read(paths, schema).select(*keys)
        fresh = once(step(last.select(*cols)).select(*cols)).join(seen, keys, "left_anti")
        paths.append(scratch.write(fresh.select(*cols, F.lit(len(paths)).cast("bigint").alias("depth")), "level"))
    return scratch.read(paths, schema)


class Ways:
    """Links that a walk follows again and again, by the column they start from.

    Hubs, which hold more than 1/64 of all links each, are met in several tasks; ``by`` spreads their links.
    """

    def __init__(self, links: DataFrame, key: str, by: str, scratch: Scratch):
        self.key, self.salts = key, max(16, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        links = scratch.cut(links, "links")
        self.hubs = scratch.cut(heavy_keys(links.groupBy(key).agg(F.count("*").alias("n")), [key], parts=64), "hubs")
        self.flat = self.hubs.isEmpty()
        self.links = links if self.flat else scratch.cut(salted(links, self.hubs, key, by, self.salts), "salted")

    def follow(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` joined with the links out of its rows."""
        if self.flat:
            return frontier.join(self.links, self.key)
        return spread(frontier, self.hubs, self.key, self.salts).join(self.links, [self.key, "salt"]).drop("salt")


def closure(links: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth): everything reached from ``seeds`` (node) along ``links`` (src, dst), seeds at 0."""
    ways = Ways(links.select("src", "dst"), "src", "dst", scratch)
    return walk(
        seeds.select("node"), lambda f: ways.follow(f.select(F.col("node").alias("src"))).select(F.col("dst").alias("node")), ["node"], scratch
    )
