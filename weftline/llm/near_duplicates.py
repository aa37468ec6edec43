"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a fixed universe replace one per coordinate: the first scatters a record's
members, the second is read circularly shifted by k for coordinate k.  Records with equal member
sets (by 128 bits) form a class first and are compared once.  Bands, classes and texts that hold a
large share of all rows are spread over several tasks wherever rows meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import BASE, Tokens, mix
from weftline.operators.skew import heavy_keys, salted, spread
from weftline.session import Scratch

#: Members are folded into this many places; a power of two.
UNIVERSE = 1 << 20
#: 4 rows and 80 bands miss a pair of similarity 0.6 once in 60,000.
BANDS, ROWS = 80, 4
SQL_TOKEN = r"[A-Za-z0-9_]+"
WORD = r"\w+"


@lru_cache(maxsize=2)
def _permutations(width: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows [i] of the second one: its values shifted by 0 .. width - 1."""
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    ring = np.concatenate([second, second[: width - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, width)


def signature(members: np.ndarray, width: int) -> np.ndarray:
    """``width`` coordinates: k holds the least value of the second permutation, shifted by k, over the members."""
    scatter, shifted = _permutations(width)
    at = scatter[(mix(members.view(np.uint64)) & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = shifted[at[:256]].min(axis=0)
    for start in range(256, len(at), 256):
        np.minimum(out, shifted[at[start : start + 256]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One long for each band, different between bands."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        out = mix(out * np.uint64(BASE) + parts[:, k])
    return out.view(np.int64)


def member_sets(texts: DataFrame, token: str, length: int, least: int) -> DataFrame:
    """(id, digest, n, members) of texts with at least ``least`` distinct runs of ``length`` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, tokens = re.compile(token).findall, Tokens()
        for batch in batches:
            sets = [tokens.runs(find(t.lower()), length) for t in batch.text]
            rows = [(i, xxhash.xxh3_128_digest(s.tobytes()), len(s), s) for i, s in zip(batch.id, sets, strict=True) if len(s) >= least]
            yield pd.DataFrame(rows, columns=["id", "digest", "n", "members"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.select("id", "text").where("id is not null and text is not null")
    return found.mapInPandas(run, f"id {kind}, digest binary, n int, members array<bigint>")


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [band_keys(signature(np.asarray(m, np.int64), bands * rows), bands, rows) for m in batch.members]
            yield pd.DataFrame({"c": batch.c, "n": batch.n, "bands": keys})

    return run


class NearDuplicates:
    """Classes of equal sets and the pairs of classes at or above a similarity.

    ``texts`` is (id, text) with distinct ids.  Null ids, null texts and texts with fewer than ``least``
    members belong to no class; an empty table gives empty results.  ``share`` is a fraction in
    whole numbers, compared exactly.  Text is taken in lower case.
    """

    def __init__(
        self,
        texts: DataFrame,
        share: tuple[int, int] = (4, 5),
        token: str = WORD,
        length: int = 5,
        least: int = 1,
        bands: int = BANDS,
        rows: int = ROWS,
    ):
        self.share, self.bands, self.rows = share, bands, rows
        self.scratch = Scratch(texts.sparkSession, "near")
        self.salts = max(16, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sets = self.scratch.cut(member_sets(texts, token, length, least), "sets")
        # classes are numbered, so that later rows are small and no two classes are ever taken for one
        one = sets.groupBy("digest").agg(F.first("n").alias("n"), F.first("members").alias("members"))
        one = self.scratch.cut(one.select(F.monotonically_increasing_id().alias("c"), "digest", "n", "members"), "classes")
        self.classes = one.select("c", "n", "members")
        self.membership = self.scratch.cut(sets.select("id", "digest").join(one.select("digest", "c"), "digest").select("id", "c"), "membership")
        self._links: DataFrame | None = None

    def _meet(self, many: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
        """``many`` joined with ``other`` on ``key``; keys with a large share of ``many`` meet in several tasks."""
        heavy = self.scratch.cut(heavy_keys(many.groupBy(key).agg(F.count("*").alias("n")), [key]), "heavy")
        return salted(many, heavy, key, by, self.salts).join(spread(other, heavy, key, self.salts), [key, "salt"]).drop("salt")

    def candidates(self) -> DataFrame:
        """(a, b), a < b: classes that agree in some band and whose sizes allow the similarity."""
        up, down = self.share
        banded = self.scratch.cut(self.classes.mapInPandas(_bands(self.bands, self.rows), "c bigint, n int, bands array<bigint>"), "bands")
        keys = banded.select("c", "n", F.explode("bands").alias("band"))
        # a band key seen once pairs with nothing: only the others are sorted and joined
        often = keys.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band")
        kept = self.scratch.cut(keys.join(often.hint("shuffle_hash"), "band", "left_semi"), "kept")
        other = kept.select("band", F.col("c").alias("b"), F.col("n").alias("m"))
        pairs = self._meet(kept, other, "band", "c").where(
            (F.col("c") < F.col("b")) & (F.least("n", "m") * down >= F.greatest("n", "m") * up)
        )
        return pairs.select(F.col("c").alias("a"), "b").distinct()

    def links(self) -> DataFrame:
        """(a, b): pairs of classes whose similarity reaches the share, verified on the whole sets."""
        if self._links is None:
            up, down = self.share
            one = self.classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
            two = self.classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
            found = self.scratch.cut(self.candidates(), "candidates")
            both = self._meet(self._meet(found, one, "a", "b"), two, "b", "a")
            common = F.size(F.array_intersect("ma", "mb"))
            both = both.withColumn("common", common).where(F.col("common") * down >= (F.col("na") + F.col("nb") - F.col("common")) * up)
            self._links = self.scratch.cut(both.select("a", "b"), "links")
        return self._links

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of ids, within and between classes."""
        links = self.links()
        several = self.membership.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
        inside = self.scratch.cut(self.membership.join(several, "c", "left_semi"), "inside")
        left = self.membership.select(F.col("c").alias("a"), F.col("id").alias("x"))
        right = self.membership.select(F.col("c").alias("b"), F.col("id").alias("y"))
        between = self._meet(right, self._meet(left, links, "a", "x"), "b", "y").select(
            F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
        )
        same = self._meet(inside.select("c", F.col("id").alias("id_a")), inside.select("c", F.col("id").alias("id_b")), "c", "id_a")
        return between.unionByName(same.where("id_a < id_b").select("id_a", "id_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, n_links): one row per text, the least id of its class and the number of classes it is linked to."""
        least = self.membership.groupBy("c").agg(F.min("id").alias("class_id"))
        ends = self.links().select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
        named = self.scratch.cut(least.join(ends, "c", "left").select("c", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "named")
        return self._meet(self.membership, named, "c", "id").select("id", "class_id", "n_links")

    def class_links(self) -> DataFrame:
        """(class_a, class_b), class_a < class_b: linked classes by their least ids; with :meth:`groups` these tell all pairs."""
        least = self.scratch.cut(self.membership.groupBy("c").agg(F.min("id").alias("least")), "least")
        one, two = (least.select(F.col("c").alias(x), F.col("least").alias(f"id_{x}")) for x in "ab")
        both = self._meet(self._meet(self.links(), one, "a", "b"), two, "b", "a")
        return both.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"))
