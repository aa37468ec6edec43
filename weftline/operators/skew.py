"""Pieces shared by operators that must survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/MAX_HEAVY of all rows.
MAX_HEAVY = 256


def heavy_keys(counts: DataFrame, keys: list[str], count: str = "n", parts: int = MAX_HEAVY) -> DataFrame:
    """Keys that hold more than 1/``parts`` of all counted rows.

    There are fewer than ``parts`` such keys whatever the data, which is the size bound for
    broadcasting them.  ``counts`` holds pre-aggregated rows; keys may repeat.
    """
    per_key = counts.groupBy(*keys).agg(F.sum(count).alias("__n"))
    return per_key.where(F.col("__n") * parts > F.lit(total_of(counts, count))).select(*keys)


def total_of(df: DataFrame, column: str) -> int:
    """The sum of a column of a written table; 0 if it has no rows."""
    return df.agg(F.sum(column)).collect()[0][0] or 0


def salted(df: DataFrame, heavy: DataFrame, key: str, by: str, salts: int) -> DataFrame:
    """Add ``salt``: 0, but for heavy keys spread over ``salts`` by a hash of ``by``."""
    mark = heavy.select(F.col(key), F.lit(True).alias("__heavy"))
    return df.join(F.broadcast(mark), key, "left").select(
        *df.columns,
        F.when(F.col("__heavy"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"),
    )


def spread(df: DataFrame, heavy: DataFrame, key: str, salts: int) -> DataFrame:
    """The other side of :func:`salted`: heavy keys once for each salt, others once."""
    mark = heavy.select(F.col(key), F.lit(True).alias("__heavy"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return df.join(F.broadcast(mark), key, "left").select(
        *df.columns, F.explode(F.when(F.col("__heavy"), every).otherwise(F.array(F.lit(0)))).alias("salt")
    )
