"""Passages that stand word for word in more than one record.

:class:`SharedSpans` measures, character by character, what lies in a stretch of a least length
that another record holds too.  Its units are not lines, since a stretch may begin and end inside
one: they are character windows.  Winnowed short windows (every stretch of the least length holds
one) tell where records can have anything in common; only there, windows of the full length are
hashed and grouped globally.

:func:`line_duplicates` is the line-wise operator: lines are normalised, their digests grouped over
all records, the earliest occurrence kept, and the others listed for removal with their offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.hashing import BASE, OTHER, Windows, winnow
from weftline.operators.skew import MAX_HEAVY, total_of
from weftline.session import Scratch

PROBE = 64
#: Texts are hashed in pieces of this many characters, so that a very long one fits in memory.
PIECE = 1 << 20


def _pieces(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    for start in range(0, max(1, len(text)), PIECE):
        yield start, text[start : start + PIECE + overlap]


def _probes(length: int):
    width = length - PROBE + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, places, hashes = [], [], []
            for doc, text in zip(batch.doc, batch.text, strict=True):
                for start, piece in _pieces(text, length - 1):
                    grams = Windows(piece).of(PROBE)
                    at = winnow(grams, width)
                    docs.append(np.full(len(at), doc, np.int64))
                    places.append(at + start)
                    hashes.append(grams[at].view(np.int64))
            yield pd.DataFrame(
                {"doc": np.concatenate(docs), "at": np.concatenate(places), "h": np.concatenate(hashes)}
                if docs
                else {"doc": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "h": np.zeros(0, np.int64)}
            )

    return run


def _windows(length: int):
    """128-bit hashes of the windows that contain a marked probe, as runs of consecutive starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, marks in zip(batch.doc, batch.text, batch.marks, strict=True):
                marks = np.unique(np.asarray(marks, np.int64))
                for start, piece in _pieces(text, length - 1):
                    full, other = (Windows(piece, base).of(length)[:PIECE] for base in (BASE, OTHER))
                    near = marks[(marks >= start) & (marks < start + len(full) + length)] - start
                    if not len(near) or not len(full):
                        continue
                    edge = np.zeros(len(full) + 1, np.int64)
                    np.add.at(edge, np.clip(near + PROBE - length, 0, len(full)), 1)
                    np.add.at(edge, np.clip(near + 1, 0, len(full)), -1)
                    wanted = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    for part in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
                        if len(part):
                            rows.append((doc, int(part[0]) + start, full[part].view(np.int64), other[part].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc", "first", "hs", "gs"])

    return run


def _in_several(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (doc, key, ...) whose key stands in more than one doc.

    Keys are grouped with partial sums of (least doc, greatest doc, count); those that hold more
    than 1/MAX_HEAVY of all rows are few and come back by broadcast, the others by a shuffled join.
    """
    found = rows.groupBy(*key).agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count("*").alias("k"))
    found = scratch.cut(found.where("x <> y").select(*key, "k"), "several")
    return _split_join(rows, found, key, "left_semi")


def _split_join(rows: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``keys`` (key, k, ...), where k counts the rows of a key: the few heavy ones by broadcast."""
    marked = keys.withColumn("hot", F.col("k") * MAX_HEAVY > F.lit(total_of(keys, "k"))).drop("k")
    hot = rows.join(F.broadcast(marked.where("hot").drop("hot")), key, how)
    return hot.unionByName(rows.join(marked.where("not hot").drop("hot"), key, how))


class SharedSpans:
    """Shared characters of (id, text) with distinct ids; null texts and ids are no record.

    Equal texts are treated as one text with several ids.  A text shorter than ``length`` shares
    nothing.  Characters are code points.
    """

    def __init__(self, texts: DataFrame, length: int = 150):
        if length < 2 * PROBE:
            raise ValueError(f"length must be at least {2 * PROBE}")
        self.length = length
        self.scratch = Scratch(texts.sparkSession, "spans")
        rows = texts.where("id is not null and text is not null").where(F.length("text") >= length)
        rows = self.scratch.cut(rows.select("id", "text", F.unhex(F.md5("text")).alias("digest")), "texts")
        # texts are numbered, so that later rows are small and no two texts are ever taken for one
        docs = rows.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        docs = self.scratch.cut(docs.select(F.monotonically_increasing_id().alias("doc"), "digest", "text", "copies"), "docs")
        self.docs = docs.select("doc", "text")
        self.ids, self.copies = rows.select("id", "digest"), docs.select("doc", "digest", "copies", F.length("text").cast("bigint").alias("n_chars"))

    def spans(self) -> DataFrame:
        """(doc, start): first characters of all windows that another text holds too."""
        probes = self.scratch.cut(self.docs.mapInPandas(_probes(self.length), "doc bigint, at bigint, h bigint"), "probes")
        common = _in_several(probes, ["h"], self.scratch)
        marks = common.groupBy("doc").agg(F.collect_list("at").alias("marks"))
        runs = self.docs.join(marks, "doc").mapInPandas(_windows(self.length), "doc bigint, first bigint, hs array<bigint>, gs array<bigint>")
        runs = self.scratch.cut(runs, "windows")
        rows = runs.select("doc", "first", F.posexplode(F.arrays_zip("hs", "gs")).alias("k", "w"))
        rows = rows.select("doc", (F.col("first") + F.col("k")).alias("start"), F.col("w.hs").alias("h"), F.col("w.gs").alias("g"))
        return _in_several(rows, ["h", "g"], self.scratch).select("doc", "start")

    def shared_chars(self) -> DataFrame:
        """(id, shared_chars) of the ids that share anything."""
        order = Window.partitionBy("doc").orderBy("start")
        step = F.lead("start").over(order) - F.col("start")
        gained = self.spans().select("doc", F.least(F.coalesce(step, F.lit(self.length)), F.lit(self.length)).alias("gain"))
        by_doc = gained.groupBy("doc").agg(F.sum("gain").alias("part"))
        known = self.copies.join(by_doc, "doc", "left").where("copies > 1 or part is not null")
        chars = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("part")).cast("bigint")
        known = self.scratch.cut(known.select("digest", F.col("copies").alias("k"), chars.alias("shared_chars")), "known")
        return _split_join(self.ids, known, ["digest"], "inner").select("id", "shared_chars")


LINE = "id string, start bigint, stop bigint, norm string"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find, blank = re.compile(r"[^\r\n]+").finditer, re.compile(r"\s+")
    for batch in batches:
        rows = [
            (i, m.start(), m.end(), norm)
            for i, text in zip(batch.id, batch.text, strict=True)
            for m in find(text)
            if (norm := blank.sub(" ", m.group()).strip().lower())
        ]
        yield pd.DataFrame(rows, columns=["id", "start", "stop", "norm"])


def line_duplicates(texts: DataFrame, least: int = 20) -> DataFrame:
    """(id, start, stop, kept_id, kept_start): lines that stand earlier elsewhere, with original offsets.

    Lines are compared in lower case with runs of blanks as one; those shorter than ``least`` then
    are left alone.  Earlier means the lesser (id, start).  Null texts have no lines.
    """
    rows = texts.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")
    lines = rows.mapInPandas(_lines, LINE).where(F.length("norm") >= least)
    lines = lines.select("id", "start", "stop", F.unhex(F.md5("norm")).alias("digest"))
    scratch = Scratch(texts.sparkSession, "lines")
    lines = scratch.cut(lines, "lines")
    first = lines.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("kept"), F.count("*").alias("k")).where("k > 1")
    later = _split_join(lines, scratch.cut(first, "first"), ["digest"], "inner").where("id <> kept.id or start <> kept.start")
    return later.select("id", "start", "stop", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"))
