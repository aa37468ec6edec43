"""Fuzzy scores of names against a pattern, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a match.
BASE, PER_CHAR, AT_START, AT_WORD, PER_EXTRA = 100.0, 10.0, 50.0, 30.0, 0.5
HIT, RUN, GAP, WORD_HIT, FIRST_HIT, LOOSE_EXTRA = 5.0, 15.0, 0.5, 20.0, 25.0, 0.3
LIMIT = 50


def _boundary(text: Column, at: Column) -> Column:
    """Whether a 1-based place begins a word: the start, after a separator, or where case rises."""
    before, here = F.substring(text, at - 1, F.lit(1)), F.substring(text, at, F.lit(1))
    rises = before.rlike("^[a-z]$") & here.rlike("^[A-Z]$")
    return (at == 1) | before.isin("_", ".", " ", "-") | rises


def fuzzy_match(pattern: str, text: Column) -> Column:
    """(score, places) of ``pattern`` in ``text``, case ignored; null if it does not match, 0 for an empty pattern.

    A contiguous match scores by length and place; otherwise characters are matched greedily from
    the left, with points for runs and word starts and a price for gaps.  ``places`` are the matched
    characters, from 0.  A null text does not match.
    """
    low, p = F.lower(text), pattern.lower()
    n = len(p)
    none = F.array().cast("array<int>")
    if not n:
        return F.when(text.isNotNull(), F.struct(F.lit(0.0).alias("score"), none.alias("places")))
    at = F.instr(low, p)
    extra = F.length(text) - F.lit(n)
    whole = (
        F.lit(BASE + PER_CHAR * n)
        + F.when(at == 1, AT_START).otherwise(0.0)
        + F.when(_boundary(text, at), AT_WORD).otherwise(0.0)
        - extra * PER_EXTRA
    )
    # greedy fold over the pattern's characters: last place matched (0: none yet), score, alive, places
    chars = F.split(F.lit(p), "")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"), none.alias("places"))

    def take(acc: Column, ch: Column) -> Column:
        last, first = acc["last"], acc["last"] == 0
        here = F.call_function("locate", ch, low, last + 1)
        gain = (
            F.lit(HIT)
            + F.when(here == last + 1, RUN).when(first, 0.0).otherwise((last + 1 - here) * GAP)
            + F.when(_boundary(text, here), WORD_HIT).otherwise(0.0)
            + F.when(first & (here == 1), FIRST_HIT).otherwise(0.0)
        )
        hit = acc["ok"] & (here > 0)
        return F.struct(
            F.when(hit, here).otherwise(last).alias("last"),
            F.when(hit, acc["score"] + gain).otherwise(0.0).alias("score"),
            hit.alias("ok"),
            F.array_append(acc["places"], here - 1).alias("places"),
        )

    steps = F.aggregate(chars, start, take)
    loose = F.when(steps["ok"], F.struct((steps["score"] - extra * LOOSE_EXTRA).alias("score"), steps["places"].alias("places")))
    block = F.struct(whole.alias("score"), F.sequence(at - 1, at + F.lit(n - 2)).alias("places"))
    return F.when(F.length(text) < n, F.lit(None)).when(at > 0, block).otherwise(loose)


def fuzzy_score(pattern: str, text: Column) -> Column:
    """The score of :func:`fuzzy_match`."""
    return fuzzy_match(pattern, text)["score"]


def search(nodes: DataFrame, columns: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """(kind, node_id, column, data_type, score, places): best tables, then best columns, ``limit`` in all.

    Queries under 2 characters find nothing.  A table counts by its name or its whole id, whichever
    scores better; places are those in the id.  A table's data_type is its type.
    """
    text = query
    by_name, by_id = fuzzy_match(text, F.col("name")), fuzzy_match(text, F.col("node_id"))
    shift = F.length("node_id") - F.length("name")
    named = F.struct(by_name["score"].alias("score"), F.transform(by_name["places"], lambda i: i + shift).alias("places"))
    best = F.when(by_id.isNull() | (by_name["score"] >= by_id["score"]), F.when(by_name.isNotNull(), named)).otherwise(by_id)
    tables = nodes.select(F.lit("table").alias("kind"), "node_id", F.lit("").alias("column"), F.col("type").alias("data_type"), best.alias("m"))
    cols = columns.select(F.lit("column").alias("kind"), "node_id", F.col("name").alias("column"), "data_type", fuzzy_match(text, F.col("name")).alias("m"))
    found = tables.unionByName(cols).where(F.col("m").isNotNull() & F.lit(len(text) >= 2))
    found = found.select("kind", "node_id", "column", "data_type", F.col("m.score").alias("score"), F.col("m.places").alias("places"))
    rank = [F.when(F.col("kind") == "table", 0).otherwise(1), F.desc("score"), "node_id", "column"]
    return found.orderBy(*rank).limit(limit)
