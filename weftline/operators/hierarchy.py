"""Links between parents and children turned into roots, depths, paths, descendants and cycles.

Frontiers move down from the roots, all roots at once; a (root, node) pair is kept at its least depth
only, so loops end by themselves.  A frontier join may take several levels at a time over a table of
ways of a few links, if that table is measured to stay small.  What the walk repeats or never reaches
reveals the cycles: round a loop depths cannot always rise, so one of its links leads to a node that was
met before, unless no root leads there at all; and nodes of one loop hang on the same roots.  Links of
such sets of nodes are split exactly into sets that reach each other.  Nodes are numbered, without
collisions, until the result is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.skew import heavy_keys, salted, spread
from weftline.session import Scratch
from weftline.sources.tables import named_id, newest

#: Levels that one frontier join may take, and how many times the links the table for it may hold.
STRIDE, GROWTH = 8, 6
#: Links that one task splits into cycles; more are split by all tasks together.
ONE_TASK = 200_000


def node_ids(nodes: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """(node_id): distinct non-null ids of both tables."""
    return nodes.select(F.col("id").alias("node_id")).unionByName(shared_nodes.select(F.col("id").alias("node_id"))).where(
        "node_id is not null"
    ).distinct()


def named_links(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(parent, child): distinct links of the newest edges whose ends are both known."""
    ends = newest(edges, ["id"], "scanned_at", ["source_node", "target_node"]).where("id is not null")
    pairs = ends.select(named_id(F.col("source_node")).alias("parent"), named_id(F.col("target_node")).alias("child"))
    pairs = pairs.where("parent is not null and child is not null").distinct()
    for end in ("parent", "child"):
        pairs = pairs.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return pairs.select("parent", "child")


class Hierarchy:
    """Reach, paths and cycles of one set of (parent, child) links.

    Null ends are no link, repeated links count once, extra columns are not read; no links give
    empty results.  Among shortest paths the one least in text order, node by node, is reported.
    ``stride`` and ``one_task`` decide how results are found, not what they are.
    """

    def __init__(self, links: DataFrame, stride: int = STRIDE, one_task: int = ONE_TASK):
        spark: SparkSession = links.sparkSession
        self.spark, self.stride, self.one_task = spark, stride, one_task
        self.scratch = Scratch(spark, "hierarchy")
        self.salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        clean = self.scratch.cut(links.where("parent is not null and child is not null").select("parent", "child").distinct(), "named")
        ids = clean.select(F.explode(F.array("parent", "child")).alias("id")).distinct()
        self.names = self.scratch.cut(ids.select(F.monotonically_increasing_id().alias("h"), "id"), "names")
        src = self.names.select(F.col("id").alias("parent"), F.col("h").alias("src"))
        dst = self.names.select(F.col("id").alias("child"), F.col("h").alias("dst"))
        self.links = self.scratch.cut(clean.join(src, "parent").join(dst, "child").select("src", "dst"), "links")
        self._reach: DataFrame | None = None

    def roots(self) -> DataFrame:
        """(h): nodes with links out and none in."""
        return self.links.select(F.col("src").alias("h")).distinct().join(
            self.links.select(F.col("dst").alias("h")), "h", "left_anti"
        )

    def _by_parent(self, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Parents with a large share of all ways, and the ways with those parents salted."""
        fan = ways.groupBy("src").agg(F.count("*").alias("n"))
        heavy = self.scratch.cut(heavy_keys(fan, ["src"], parts=64), "heavy")  # under 64 rows
        return heavy, self.scratch.cut(salted(ways, heavy, "src", "dst", self.salts), "salted")

    def _ways(self) -> tuple[DataFrame, int]:
        """(src, dst, h): the least number of links between nodes at most ``length`` links apart, and that length.

        The length is doubled while a count of what meets at each node shows that the table stays small.
        """
        ways, length = self.links.select("src", "dst", F.lit(1).cast("bigint").alias("h")).where("src <> dst"), 1
        most = GROWTH * max(ways.count(), 1)
        while length < self.stride:
            outs = ways.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("o"))
            ins = ways.groupBy(F.col("dst").alias("at")).agg(F.count("*").alias("i"))
            if (outs.join(ins, "at").agg(F.sum(F.col("o") * F.col("i"))).collect()[0][0] or 0) > most:
                break
            first = ways.select("src", F.col("dst").alias("at"), F.col("h").alias("h1"))
            then = ways.select(F.col("src").alias("at"), "dst", F.col("h").alias("h2"))
            longer = first.join(then, "at").where("src <> dst").select("src", "dst", (F.col("h1") + F.col("h2")).alias("h"))
            ways = self.scratch.cut(ways.unionByName(longer).groupBy("src", "dst").agg(F.min("h").alias("h")), "ways")
            length *= 2
        return ways, length

    def reach(self, starts: DataFrame | None = None) -> DataFrame:
        """(root, node, depth) of every node that a root reaches; roots at depth 0.

        ``starts`` (h) takes other nodes in place of the roots.
        """
        if starts is None and self._reach is not None:
            return self._reach
        ways, length = self._ways()
        heavy, ways = self._by_parent(ways)
        start = (self.roots() if starts is None else starts).select(F.col("h").alias("root"), F.col("h").alias("node"))
        level = start.withColumn("depth", F.lit(0).cast("bigint"))
        # levels are read together by one scan, so that every round has the same plan
        schema, paths, at = level.schema, [self.scratch.write(level, "level")], 0
        while True:
            # the outermost ring leads to all nodes of the next ``length`` levels
            ring = self.scratch.read(paths[-1:], schema).where(F.col("depth") == at)
            if ring.isEmpty():
                break
            found = spread(ring.select("root", F.col("node").alias("src")), heavy, "src", self.salts).join(ways, ["src", "salt"])
            found = found.groupBy("root", F.col("dst").alias("node")).agg((F.min("h") + F.lit(at)).alias("depth"))
            seen = self.scratch.read(paths, schema).select("root", "node")
            paths.append(self.scratch.write(found.join(seen, ["root", "node"], "left_anti").select("root", "node", "depth"), "level"))
            at += length
        out = self.scratch.read(paths, schema)
        if starts is None:
            self._reach = out
        return out

    def _reach_paths(self) -> DataFrame:
        """(root, node, path, depth): as :meth:`reach`, one level at a time, with the least shortest path."""
        heavy, links = self._by_parent(self.links)
        names = self.names.select(F.col("h").alias("dst"), "id")
        start = self.roots().select(F.col("h").alias("root"), F.col("h").alias("node"))
        start = start.join(self.names, start.node == self.names.h).select("root", "node", F.array("id").alias("path"))
        level = start.withColumn("depth", F.lit(0).cast("bigint"))
        schema, paths = level.schema, [self.scratch.write(level, "level")]
        while not (last := self.scratch.read(paths[-1:], schema)).isEmpty():
            frontier = last.select("root", F.col("node").alias("src"), "path")
            found = spread(frontier, heavy, "src", self.salts).join(links, ["src", "salt"]).join(names, "dst")
            found = found.groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("id"))).alias("path"))
            seen = self.scratch.read(paths, schema).select("root", "node")
            fresh = found.join(seen, ["root", "node"], "left_anti")
            paths.append(self.scratch.write(fresh.select("root", "node", "path", F.lit(len(paths)).cast("bigint").alias("depth")), "level"))
        return self.scratch.read(paths, schema)

    def _suspects(self) -> DataFrame:
        """(src, dst): links among which all cycles of several nodes lie, told by the walk from the roots.

        Nodes of a cycle hang on the same roots, and one link of a cycle leads to a node met at no
        greater depth (a repeated node), or the nodes were never reached.
        """
        facts = self.reach().groupBy(F.col("node").alias("h")).agg(
            F.min("depth").alias("level"),
            # equal for equal sets of roots; chance equality only adds links, which are split exactly
            F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("root")).alias("x"), F.sum(F.xxhash64("root") / 2**20).cast("bigint").alias("s")).alias("roots"),
        )
        facts = self.scratch.cut(facts, "facts")
        up = facts.select(F.col("h").alias("src"), F.col("level").alias("l1"), F.col("roots").alias("r1"))
        down = facts.select(F.col("h").alias("dst"), F.col("level").alias("l2"), F.col("roots").alias("r2"))
        both = self.links.where("src <> dst").join(up, "src", "left").join(down, "dst", "left").where(F.col("r1").eqNullSafe(F.col("r2")))
        both = self.scratch.cut(both.select("src", "dst", "r1", (F.col("l2") <= F.col("l1")).alias("repeated")), "alike")
        told = both.where("repeated").select("r1").distinct()
        return both.where("r1 is null").unionByName(both.join(told, "r1", "left_semi").select(*both.columns)).select("src", "dst")

    def _trimmed(self, links: DataFrame) -> DataFrame:
        """Links on or between cycles: ends without links in or without links out go, again and again."""
        left = links.count()
        while left:
            ins, outs = links.select(F.col("dst").alias("src")), links.select(F.col("src").alias("dst"))
            inner = links.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")
            links = self.scratch.cut(inner, "trim")
            now = links.count()
            if now == left:
                break
            left = now
        return links

    def cycles(self) -> DataFrame:
        """(pivot, h): each node that can reach itself with the mark of its strongly connected set."""
        loops = self.links.where("src = dst").select(F.col("src").alias("h"))
        links = self.scratch.cut(self._suspects(), "suspects")
        sets = self._split_here(links) if links.count() <= self.one_task else self._split_apart(links)
        # a set of one node is a cycle only if the node is linked to itself
        alone = loops.join(sets.select("h"), "h", "left_anti").select(F.col("h").alias("pivot"), "h")
        return sets.unionByName(alone)

    def _split_here(self, links: DataFrame) -> DataFrame:
        """Sets of several nodes that reach each other, by one task over at most ``one_task`` links."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs = [p for b in batches for p in zip(b.src.tolist(), b.dst.tolist(), strict=True)]
            rows = [(min(part), h) for part in strong_sets(pairs) if len(part) > 1 for h in part]
            yield pd.DataFrame(rows, columns=["pivot", "h"])

        return self.scratch.cut(links.coalesce(1).mapInPandas(run, "pivot bigint, h bigint"), "sets")

    def _split_apart(self, links: DataFrame) -> DataFrame:
        """As :meth:`_split_here` by all tasks: ends are trimmed, and what is left is coloured."""
        links = self._trimmed(links)
        found = [self.links.select(F.col("src").alias("pivot"), F.col("src").alias("h")).where("false")]
        while not links.isEmpty():
            # every node takes the least mark among the nodes that reach it
            colour = self.scratch.cut(
                links.select(F.explode(F.array("src", "dst")).alias("h")).distinct().withColumn("mark", F.col("h")), "colour"
            )
            while True:
                sent = colour.join(links, colour.h == links.src).select(F.col("dst").alias("h"), "mark")
                lowest = colour.unionByName(sent).groupBy("h").agg(F.min("mark").alias("mark"))
                after = self.scratch.cut(lowest, "colour")
                same = after.join(colour, ["h", "mark"], "left_anti").isEmpty()
                colour = after
                if same:
                    break
            # within a mark, what reaches the marked node back is its set
            ends = links.join(colour.select(F.col("h").alias("src"), F.col("mark").alias("m1")), "src").join(
                colour.select(F.col("h").alias("dst"), F.col("mark").alias("m2")), "dst"
            )
            inner = self.scratch.cut(ends.where("m1 = m2").select("src", "dst"), "inner")
            members = self.scratch.cut(colour.where("h = mark").select(F.col("mark").alias("pivot"), "h"), "members")
            frontier = members
            while not frontier.isEmpty():
                back = inner.join(frontier.withColumnRenamed("h", "dst"), "dst").select("pivot", F.col("src").alias("h"))
                frontier = self.scratch.cut(back.distinct().join(members, "h", "left_anti"), "back")
                members = self.scratch.cut(members.unionByName(frontier), "members")
            found.append(members)
            gone = members.select("h")
            rest = links.join(gone.withColumnRenamed("h", "src"), "src", "left_anti")
            rest = rest.join(gone.withColumnRenamed("h", "dst"), "dst", "left_anti")
            links = self._trimmed(self.scratch.cut(rest.select("src", "dst"), "rest"))
        sets = found[0]
        for members in found[1:]:
            sets = sets.unionByName(members)
        size = sets.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1")
        return sets.join(size.select("pivot"), "pivot", "left_semi")

    def named_cycles(self) -> DataFrame:
        """(root_id, node_id, depth): each node that can reach itself, the least id of its set and the set's size."""
        sets = self.cycles().join(self.names, "h")
        sets = self.scratch.cut(sets.select("pivot", F.col("id").alias("node_id")), "cycles")
        whole = sets.groupBy("pivot").agg(F.min("node_id").alias("root_id"), F.count("*").alias("depth"))
        return sets.join(whole, "pivot").select("root_id", "node_id", "depth")

    def table(self) -> DataFrame:
        """(kind, root_id, node_id, depth): ``root`` rows of :meth:`reach`, ``cycle`` rows of :meth:`named_cycles`."""
        near = self.names.select(F.col("h").alias("root"), F.col("id").alias("root_id"))
        far = self.names.select(F.col("h").alias("node"), F.col("id").alias("node_id"))
        reach = self.reach().where("depth > 0").join(far, "node").join(near, "root")
        cols = ["root_id", "node_id", "depth"]
        return reach.select(F.lit("root").alias("kind"), *cols).unionByName(self.named_cycles().select(F.lit("cycle").alias("kind"), *cols))

    def paths(self) -> DataFrame:
        """(root_id, node_id, depth, path): one shortest path for each reached node, roots included."""
        reach = self._reach_paths()
        return reach.select(
            F.element_at("path", 1).alias("root_id"), F.element_at("path", -1).alias("node_id"), "depth", "path"
        )

    def descendants(self) -> DataFrame:
        """(root_id, n_descendants, max_depth) of every root."""
        near = self.names.select(F.col("h").alias("root"), F.col("id").alias("root_id"))
        sums = self.reach().where("depth > 0").groupBy("root").agg(
            F.count("*").alias("n_descendants"), F.max("depth").alias("max_depth")
        )
        return sums.join(near, "root").select("root_id", "n_descendants", "max_depth")

    def pairs(self) -> DataFrame:
        """(node_id, descendant_id, depth): every node, inner ones and those on loops too, with all that it reaches.

        Depth is the least number of links between the two; no node is its own descendant (that a
        node reaches itself is told by :meth:`cycles`).  n nodes on one loop give n * (n - 1) pairs.
        """
        near = self.names.select(F.col("h").alias("root"), F.col("id").alias("node_id"))
        far = self.names.select(F.col("h").alias("node"), F.col("id").alias("descendant_id"))
        reach = self.reach(starts=self.links.select(F.col("src").alias("h")).distinct()).where("depth > 0")
        return reach.join(far, "node").join(near, "root").select("node_id", "descendant_id", "depth")


def strong_sets(links: list[tuple[int, int]]) -> list[list[int]]:
    """Sets of nodes that reach each other, by one depth-first pass without recursion."""
    out_of: dict[int, list[int]] = {}
    for a, b in links:
        out_of.setdefault(a, []).append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    waiting: list[int] = []
    inside: set[int] = set()
    found: list[list[int]] = []
    for first in out_of:
        if first in order:
            continue
        todo = [(first, iter(out_of[first]))]
        order[first] = low[first] = len(order)
        waiting.append(first)
        inside.add(first)
        while todo:
            at, ways = todo[-1]
            step = next(ways, None)
            if step is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
                if low[at] == order[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(waiting.pop())
                    inside.difference_update(part)
                    found.append(part)
            elif step not in order:
                order[step] = low[step] = len(order)
                waiting.append(step)
                inside.add(step)
                todo.append((step, iter(out_of.get(step, ()))))
            elif step in inside:
                low[at] = min(low[at], order[step])
    return found


def graph_hierarchy(edges: DataFrame, nodes: DataFrame, shared_nodes: DataFrame) -> Hierarchy:
    """The hierarchy over the newest edges between known nodes."""
    return Hierarchy(named_links(edges, node_ids(nodes, shared_nodes)))
