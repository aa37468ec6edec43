"""Filling containers of several permitted capacities with whole items.

Items are spread over blocks of bounded size, and each block is packed by best fit.  A container is
opened for the largest item left: for every permitted capacity it is seen how the items still open
would fill it, each time by the one that fits the room best, and the capacity that leaves the least
share of its room unused is taken.  Closed containers shrink to the least capacity that holds their
contents.  The worst-filled containers of a block give their
items back, to be packed with those of other blocks up a tree of ever fewer blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch

BLOCK = 20_000
#: Blocks joined at each level of the tree, and the worst containers each of them hands on.
FAN, HANDED = 16, 64
#: Containers filled to this share are final.
FULL = 0.985
PACKED = "block bigint, doc_id bigint, part int, n_tokens bigint, bin string, capacity bigint"


class _Open:
    """The items still open, by size."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.items.setdefault(sizes[i], []).append(i)
        self.order = sorted(self.items)

    def filling(self, size: int, capacity: int) -> tuple[int, list[int]]:
        """(room left, sizes added) of a container with an item of ``size``, each added item the largest that fits."""
        room, added, used = capacity - size, [], {size: 1}
        at = bisect_right(self.order, room)
        while at:
            best = self.order[at - 1]
            left = len(self.items[best]) - used.get(best, 0)
            if left <= 0:
                at -= 1
                continue
            n = min(left, room // best)
            added += [best] * n
            used[best] = used.get(best, 0) + n
            room -= n * best
            at = bisect_right(self.order, room, 0, at)
        return room, added

    def take(self, size: int) -> int:
        found = self.items[size]
        item = found.pop()
        if not found:
            del self.items[size]
            self.order.pop(bisect_left(self.order, size))
        return item


def pack(sizes: list[int], capacities: list[int]) -> list[tuple[int, list[int]]]:
    """Containers as (capacity, item numbers); every size must be 1 .. the largest capacity.

    All capacities are weighed for each container by what the items still open leave unused in it;
    of equal shares the larger capacity, which makes fewer containers.
    """
    rising, open_items, out = sorted(set(capacities)), _Open(sizes), []
    while open_items.order:
        size = open_items.order[-1]
        ways = [(*open_items.filling(size, c), c) for c in rising if c >= size]
        _, added, _ = min(ways, key=lambda way: (way[0] / way[2], -way[2]))
        items = [open_items.take(s) for s in (size, *added)]
        total = size + sum(added)
        out.append((rising[bisect_left(rising, total)], items))
    return out


def _packer(capacities: list[int], level: int, last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        sizes = group.n_tokens.tolist()
        bins = pack(sizes, capacities)
        fill = [(sum(sizes[i] for i in items) / cap, n) for n, (cap, items) in enumerate(bins)]
        handed = set() if last else {n for f, n in sorted(fill)[:HANDED] if f < FULL}
        names, caps = [None] * len(sizes), [0] * len(sizes)
        for n, (cap, items) in enumerate(bins):
            for i in items:
                caps[i] = cap
                names[i] = None if n in handed else f"{level}-{key[0]}-{n}"
        return group.assign(bin=names, capacity=caps)[["block", "doc_id", "part", "n_tokens", "bin", "capacity"]]

    return run


def pack_items(items: DataFrame, capacities: list[int], block: int = BLOCK) -> DataFrame:
    """(doc_id, part, n_tokens, bin, capacity): the container of every item.

    ``items`` is (doc_id, n_tokens) with distinct doc_id; null, zero and negative sizes need no
    container and are left out.  An item beyond the largest capacity is cut into parts that fill it
    and a rest; all other items are whole, part 0.  No items give no containers.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    scratch = Scratch(items.sparkSession, "pack")
    whole = items.where("doc_id is not null and n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("size"))
    parts = whole.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / most).cast("int") - 1)).alias("part"))
    parts = parts.select(
        "doc_id", "part", F.least(F.lit(most), F.col("size") - F.col("part").cast("bigint") * most).alias("n_tokens")
    )
    parts = scratch.cut(parts, "parts")
    blocks = max(1, -(-parts.count() // block))
    todo = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)).cast("bigint"))
    level, done = 0, []
    while True:
        last = blocks == 1
        run = _packer(list(capacities), level, last)
        packed = scratch.cut(todo.groupBy("block").applyInPandas(run, PACKED), "level")
        done.append(packed.where("bin is not null"))
        if last:
            break
        todo = packed.where("bin is null").select("doc_id", "part", "n_tokens", F.floor(F.col("block") / FAN).alias("block"))
        blocks, level = -(-blocks // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "part", "n_tokens", "bin", "capacity")


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity, n_bins, n_items, n_tokens, unused_share) for each capacity used."""
    bins = packed.groupBy("bin", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return bins.groupBy("capacity").agg(
        F.count("*").alias("n_bins"),
        F.sum("n").alias("n_items"),
        F.sum("used").alias("n_tokens"),
        (1 - F.sum("used") / F.sum("capacity")).alias("unused_share"),
    )
