"""Mixing sources to target shares of the total size by pivotal dependent rounding.

Every record of a source begins with the same fractional number of copies.  Fractions are rounded by
pairing: mass moves at random between two units until one of them is whole, with their joint size
unchanged.  In a bucket of its source a record's partner is the pool of all lighter ones, so that the
heavy are settled first and the one record left fractional is light; record against record would leave
a heavy one.  What buckets leave is paired record by record up a tree, so a source misses its size by
less than one record.  Buckets and draws depend on ids alone: the result is the same however the rows
are partitioned.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch

#: Records of a source that a bucket holds, and buckets joined at each level of the tree.
BUCKET, FAN = 20_000, 16
EPS = 1e-9
UNITS = "source string, doc_id bigint, n_tokens bigint, base bigint, p double, part bigint"


def allocate(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Size of each source: its share of ``total``, but at most max_repeats times what it has.

    What limited sources cannot give is shared by the others in proportion to their targets.
    """
    limit = {s: available.get(s, 0.0) * max(0, r or 0) for s, (_, r) in targets.items()}
    out = {s: 0.0 for s in targets}
    free = {s for s, (share, _) in targets.items() if share and share > 0}
    left = total
    while free:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / weight >= limit[s]}
        if not over:
            out |= {s: left * targets[s][0] / weight for s in free}
            break
        out |= {s: limit[s] for s in over}
        left = max(0.0, left - sum(limit[s] for s in over))
        free -= over
    return out


def _chance(first: int, second: int, seed: int) -> float:
    return xxhash.xxh64_intdigest(f"{first}:{second}", seed) / 2.0**64


def pivot(units: list[tuple[int, int, float]], seed: int) -> list[tuple[int, float]]:
    """(doc_id, p) of (doc_id, size, p) units after pairing: all whole but at most one.

    Keeps the sum of size times p exactly, and each p in expectation.  Heavy units come first, so
    that the one left over is light.
    """
    out: list[tuple[int, float]] = []
    held: tuple[int, int, float] | None = None
    for doc, size, p in sorted(units, key=lambda u: (-u[1], u[0])):
        if p <= EPS or p >= 1 - EPS or size <= 0:
            out.append((doc, float(round(p)) if size > 0 else 0.0))
            continue
        if held is None:
            held = (doc, size, p)
            continue
        other, weight, q = held
        up, down = min(weight * (1 - q), size * p), min(weight * q, size * (1 - p))
        if _chance(other, doc, seed) * (up + down) < down:
            q, p = q + up / weight, p - up / size
        else:
            q, p = q - down / weight, p + down / size
        whole = [(d, float(round(x))) for d, x in ((other, q), (doc, p)) if x <= EPS or x >= 1 - EPS]
        out += whole
        held = None if len(whole) == 2 else (doc, size, p) if whole[0][0] == other else (other, weight, q)
    if held:
        out.append((held[0], held[2]))
    return out


def pool_pivot(units: list[tuple[int, int]], p: float, seed: int) -> list[tuple[int, float]]:
    """(doc_id, p) of (doc_id, size) units that all begin at ``p``: all whole but at most one.

    Keeps the sum of size times p exactly, and each p in expectation: moving mass between a record
    and the pool of lighter ones moves the common fraction of the pool.
    """
    order = sorted(units, key=lambda u: (-u[1], u[0]))
    rest, out = float(sum(size for _, size in order)), []
    for doc, size in order:
        rest = max(0.0, rest - size)
        if size <= 0:
            out.append((doc, 0.0))
            continue
        if p <= EPS or p >= 1 - EPS:
            p = float(round(p))
            out.append((doc, p))
            continue
        up, down = min(size * (1 - p), rest * p), min(size * p, rest * (1 - p))
        if rest < 1 or up + down <= EPS:
            out.append((doc, p))
            p = 0.0
        elif _chance(doc, size, seed) * (up + down) < down:
            out.append((doc, p + up / size))
            p -= up / rest
        else:
            out.append((doc, p - down / size))
            p += down / rest
    return [(d, float(round(x)) if x <= EPS or x >= 1 - EPS else x) for d, x in out]


def _rounder(seed: int, first: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        docs, sizes, shares = group.doc_id.tolist(), group.n_tokens.tolist(), group.p.tolist()
        if first:
            p = dict(pool_pivot(list(zip(docs, sizes, strict=True)), shares[0], seed))
        else:
            p = dict(pivot(list(zip(docs, sizes, shares, strict=True)), seed))
        return group.assign(p=group.doc_id.map(p).astype(float))

    return run


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of all records of the targeted sources.

    ``sized`` is (doc_id, source, n_tokens) with distinct doc_id; ``targets`` (source, target_share,
    max_repeats) is a fixed list and comes to the driver.  Records of other or null sources take no
    part; empty records get no copies.  The total is what the targeted sources hold, unless given.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "mix")
    plan = {r.source: (r.target_share, r.max_repeats) for r in targets.collect() if r.source is not None}
    rows = sized.where(F.col("source").isin(list(plan))).select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    rows = scratch.cut(rows, "rows")
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()  # one row per target
    has = {r.source: float(r.n) for r in totals}
    buckets = {r.source: -(-r.k // BUCKET) for r in totals}
    sizes = allocate(has, plan, sum(has.values()) if total_tokens is None else total_tokens)
    copies = [(s, min(sizes[s] / has[s], float(plan[s][1])) if has.get(s) else 0.0) for s in plan]
    wanted = spark.createDataFrame([(s, f, buckets.get(s, 1)) for s, f in copies] or [("", 0.0, 1)], "source string, f double, buckets bigint")
    units = rows.join(F.broadcast(wanted), "source").select(  # one row per target
        "source",
        "doc_id",
        "n_tokens",
        F.floor(F.col("f") + EPS).alias("base"),
        F.greatest(F.lit(0.0), F.col("f") - F.floor(F.col("f") + EPS)).alias("p"),
        F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("part"),
    )
    whole, fraction = "p <= 0 or p >= 1", "p > 0 and p < 1"
    # records that need no rounding do not move
    done, open_units = [units.where(whole)], units.where(fraction)
    parts, turn = max(buckets.values(), default=1), 0
    while True:
        level = scratch.cut(open_units.groupBy("source", "part").applyInPandas(_rounder(seed + turn, turn == 0), UNITS), "rounded")
        done.append(level.where(whole))
        turn += 1
        if parts == 1:
            break
        open_units = level.where(fraction).withColumn("part", F.floor(F.col("part") / FAN))
        parts = -(-parts // FAN)
    # at most one record of each source is left: it is drawn with its own chance
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    done.append(level.where(fraction).withColumn("p", F.when(drawn < F.col("p"), 1.0).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "source", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("base") + F.round("p").cast("bigint")).otherwise(0).alias("copies")
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share, most_copies) of every target."""
    used = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("available_tokens"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"),
        F.max("copies").alias("most_copies"),
    )
    total = used.agg(F.sum("used_tokens")).collect()[0][0] or 1
    out = targets.join(used, "source", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("available_tokens", zero).alias("available_tokens"),
        F.coalesce("used_tokens", zero).alias("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.lit(total), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_copies", zero).alias("most_copies"),
    )
