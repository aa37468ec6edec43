"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables.

A record is the pair (hash of its key, digest of its key and content), 128 bits in all.  Pairs are moved
once, to hash buckets that all scans of a project share; there each scan's bucket is folded into one
small table of cells holding counts and xors, so that only cells, not records, are compared between
scans.  Subtracting two tables cancels what both hold; the rest is peeled into the differing pairs.
Buckets that do not peel are folded again with more cells, and after the last enlargement compared row
by row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch
from weftline.sources.tables import newest, scan_order

CELLS, GROWTH, ROUNDS = 60, 4, 4
#: Records a bucket should hold: the cells above recover about 40 differing pairs.
BUCKET = 256
SEED = 42
HASHES = 3
#: A list of at most this many scans is broadcast.
SCANS = 100_000
PIECE = 20  # bits of the position hash for each of the three cells
PLACE = ["project_id", "entity", "bucket"]
PEELED_COLUMNS = [*PLACE, "snapshot_id", "kh", "ch", "sign"]
PEELED = "project_id string, entity string, bucket bigint, snapshot_id bigint, kh bigint, ch bigint, sign int"


def node_content(columns: Column) -> Column:
    """Digest input of a node: its columns in order as (name ignoring case, type, status)."""
    rows = F.transform(
        F.coalesce(columns, F.array()),
        lambda c: F.struct(F.lower(c["name"]).alias("n"), c["data_type"].alias("t"), c["lineage_status"].alias("s")),
    )
    return F.to_json(rows, {"ignoreNullFields": "false"})


def edge_content(mappings: Column) -> Column:
    """Digest input of an edge: its mappings as a sorted set, source columns as sorted sets."""
    rows = F.transform(
        F.coalesce(mappings, F.array()),
        lambda m: F.struct(
            F.array_sort(F.array_distinct(F.transform(F.coalesce(m["source_columns"], F.array()), F.lower))).alias("s"),
            F.lower(m["target_column"]).alias("t"),
            m["transformation"].alias("k"),
            F.coalesce(m["expression"], F.lit("")).alias("e"),
        ),
    )
    return F.to_json(F.array_sort(F.array_distinct(rows)), {"ignoreNullFields": "false"})


def records(node_snapshots: DataFrame, edge_snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, entity, id, kh, ch) of the newest rows; kh and ch are 64-bit hashes of id, and of id and content.

    Contents are hashed where they are read, so that only hashes are moved.
    """
    parts = []
    for df, entity, column, content in (
        (node_snapshots, "node", "columns", node_content),
        (edge_snapshots, "edge", "column_mappings", edge_content),
    ):
        hashed = df.where("snapshot_id is not null and id is not null").select(
            "snapshot_id", "id", "received_at", F.xxhash64("id", content(F.col(column))).alias("ch")
        )
        rows = newest(hashed, ["snapshot_id", "id"], "received_at", ["ch"])
        parts.append(rows.select("snapshot_id", F.lit(entity).alias("entity"), "id", F.xxhash64("id").alias("kh"), "ch"))
    return parts[0].unionByName(parts[1])


def _paired(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows once for each pair of scans they belong to: ``snapshot_id`` is the later one, ``role`` 1 or -1."""
    pairs = scans.select(
        "snapshot_id",
        F.explode(
            F.array(
                F.struct(F.when(F.col("prev_id").isNotNull(), F.col("snapshot_id")).alias("pair"), F.lit(1).alias("role")),
                F.struct(F.col("next_id").alias("pair"), F.lit(-1).alias("role")),
            )
        ).alias("x"),
    ).select("snapshot_id", "x.*").where("pair is not null")
    return rows.join(pairs, "snapshot_id").withColumn("snapshot_id", F.col("pair")).drop("pair")


def _tables(items: DataFrame, scans: DataFrame, per_table: int) -> DataFrame:
    """(place, snapshot_id, cells): differing cells (cell, n, kx, cx, gx) of each scan against the one before.

    ``items`` is partitioned by PLACE, which all steps keep: nothing is moved again.
    """
    spot = F.xxhash64("kh", "ch")
    cell = [
        F.pmod(F.shiftright(spot, PIECE * j).bitwiseAND(F.lit((1 << PIECE) - 1)), F.lit(per_table)) + F.lit(j * per_table)
        for j in range(HASHES)
    ]
    keys = [*PLACE, "snapshot_id", "cell"]
    xors = ("kx", "cx", "gx")
    each = items.withColumn("gx", F.xxhash64("ch", "kh")).withColumn("cell", F.explode(F.array(*cell)))
    each = each.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("ch").alias("cx"), F.bit_xor("gx").alias("gx")
    )
    left = _paired(each, scans).groupBy(*keys).agg(F.sum(F.col("n") * F.col("role")).alias("n"), *(F.bit_xor(c).alias(c) for c in xors))
    left = left.where("n <> 0 or kx <> 0 or cx <> 0 or gx <> 0")
    return left.groupBy(*PLACE, "snapshot_id").agg(F.collect_list(F.struct("cell", "n", *xors)).alias("cells"))


def _hash(first: int, second: int) -> int:
    """Spark's xxhash64 of two longs, as a signed long."""
    at = xxhash.xxh64_intdigest(struct.pack("<q", first), SEED)
    at = xxhash.xxh64_intdigest(struct.pack("<q", second), at)
    return at - (1 << 64) if at >= 1 << 63 else at


def peel(cells: dict[int, list[int]], per_table: int) -> list[tuple[int, int, int]] | None:
    """(kh, ch, sign) of all differing pairs, or None if the table does not peel to nothing."""
    out: list[tuple[int, int, int]] = []
    todo = list(cells)
    while todo:
        at = todo.pop()
        n, kh, ch, g = cells[at]
        if n not in (1, -1) or _hash(ch, kh) != g:
            continue
        spot = _hash(kh, ch)
        places = [((spot >> PIECE * j) & ((1 << PIECE) - 1)) % per_table + j * per_table for j in range(HASHES)]
        if at not in places or any(p not in cells for p in places):
            continue
        out.append((kh, ch, n))
        if len(out) > len(cells):
            return None
        for p in places:
            c = cells[p]
            c[0] -= n
            c[1] ^= kh
            c[2] ^= ch
            c[3] ^= g
            todo.append(p)
    return None if any(any(c) for c in cells.values()) else out


def _peeler(per_table: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, entity, bucket, sid, cells in zip(batch.project_id, batch.entity, batch.bucket, batch.snapshot_id, batch.cells, strict=True):
                table = {i: [0, 0, 0, 0] for i in range(HASHES * per_table)}
                for c in cells:
                    table[c["cell"]] = [int(c["n"]), int(c["kx"]), int(c["cx"]), int(c["gx"])]
                found = peel(table, per_table)
                for kh, ch, sign in [(0, 0, 0)] if found is None else found:
                    rows.append((project, entity, bucket, sid, kh, ch, sign))
            yield pd.DataFrame(rows, columns=PEELED_COLUMNS)

    return run


def _in(items: DataFrame, places: DataFrame) -> DataFrame:
    """Items whose place is among ``places``; a null project is a project."""
    flat = [F.coalesce(F.concat(F.lit("p"), "project_id"), F.lit("")).alias("p"), "entity", "bucket"]
    return items.withColumn("p", flat[0]).join(places.select(*flat).distinct(), ["p", "entity", "bucket"], "left_semi").drop("p").select(*items.columns)


def _exact(items: DataFrame, scans: DataFrame) -> DataFrame:
    """The differing pairs of ``items``, row by row."""
    both = _paired(items, scans).groupBy(*PLACE, "snapshot_id", "kh", "ch").agg(F.sum("role").cast("int").alias("sign"))
    return both.where("sign <> 0").select(*PEELED_COLUMNS)


def differing(items: DataFrame, scans: DataFrame, scratch: Scratch, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(snapshot_id, entity, kh, ch, sign): +1 pairs only in the scan, -1 only in the one before.

    ``items`` is (project_id, entity, bucket, snapshot_id, kh, ch) with distinct pairs in a scan,
    ``scans`` (snapshot_id, prev_id, next_id).  The result is exact; cells and rounds only decide how
    it is found.
    """
    found: list[DataFrame] = []
    scans = F.broadcast(scans) if scans.count() <= SCANS else scans
    # one partition holds a bucket of all scans of a project, so that folding and subtracting move nothing
    todo = items.repartition(*PLACE)
    for turn in range(rounds):
        per_table = cells // HASHES * GROWTH**turn
        peeled = scratch.cut(_tables(todo, scans, per_table).mapInPandas(_peeler(per_table), PEELED), "peeled")
        failed = peeled.where("sign = 0")
        if failed.isEmpty():
            found.append(peeled)
            break
        # a failed bucket is folded again for all its scans: what it gave before is left out
        found.append(_not_in(peeled.where("sign <> 0"), failed))
        todo = scratch.cut(_in(items, failed), "again").repartition(*PLACE)
    else:
        found.append(_exact(todo, scans))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("snapshot_id", "entity", "kh", "ch", "sign")


def _not_in(items: DataFrame, places: DataFrame) -> DataFrame:
    flat = [F.coalesce(F.concat(F.lit("p"), "project_id"), F.lit("")).alias("p"), "entity", "bucket"]
    return items.withColumn("p", flat[0]).join(places.select(*flat).distinct(), ["p", "entity", "bucket"], "left_anti").drop("p").select(*items.columns)


def snapshot_changes(
    node_snapshots: DataFrame,
    edge_snapshots: DataFrame,
    graph_metadata: DataFrame,
    cells: int = CELLS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(snapshot_id, entity, record_id, change) for each scan after the first of its project.

    Only scans with a header count.  Rows with a null snapshot_id or id are no record; a null array
    equals an empty one.  Records are compared by 128 bits of hashes and told apart by their ids.  Empty
    tables give no rows.
    """
    scratch = Scratch(node_snapshots.sparkSession, "changes")
    order = scratch.cut(scan_order(graph_metadata), "order")
    later = order.where("prev_id is not null").select(F.col("prev_id").alias("snapshot_id"), F.col("snapshot_id").alias("next_id"))
    scans = scratch.cut(order.join(later, "snapshot_id", "left").select("snapshot_id", "project_id", "prev_id", "next_id"), "scans")
    rows = scratch.cut(records(node_snapshots, edge_snapshots), "records")
    # one bucket count per project, so that its scans are split alike
    sizes = rows.groupBy("snapshot_id", "entity").count().join(scans, "snapshot_id")
    sizes = sizes.groupBy(F.col("project_id").alias("of")).agg(F.ceil(F.max("count") / BUCKET).alias("buckets"))
    split = scans.join(sizes, F.col("project_id").eqNullSafe(F.col("of"))).select("snapshot_id", "project_id", "buckets")
    items = rows.join(scratch.cut(split, "split"), "snapshot_id").select(
        "project_id", "entity", F.pmod(F.xxhash64("kh"), F.col("buckets")).cast("bigint").alias("bucket"), "snapshot_id", "kh", "ch"
    )
    diff = scratch.cut(differing(items, scans, scratch, cells, rounds), "diff")
    # the records give their ids back, and their digests confirm what was peeled
    placed = diff.join(scans.select("snapshot_id", "prev_id"), "snapshot_id").withColumn("held_in", F.when(F.col("sign") > 0, F.col("snapshot_id")).otherwise(F.col("prev_id")))
    named = rows.select(F.col("snapshot_id").alias("held_in"), "entity", "kh", "ch", F.col("id").alias("record_id"))
    sides = placed.join(named, ["held_in", "entity", "kh", "ch"]).groupBy("snapshot_id", "entity", "record_id").agg(
        F.max("sign").alias("now"), F.min("sign").alias("was")
    )
    change = F.when(F.col("was") > 0, "added").when(F.col("now") < 0, "removed").otherwise("changed")
    return sides.select("snapshot_id", "entity", "record_id", change.alias("change"))
