import random
from collections import deque

import pytest

from weftline.operators.hierarchy import Hierarchy, graph_hierarchy, strong_sets


def brute(links):
    out, nodes = {}, {x for l in links for x in l}
    for p, c in links:
        out.setdefault(p, set()).add(c)
    has_in = {c for _, c in links}

    def reach(start):
        dist, queue = {}, deque([(start, 0)])
        while queue:
            n, d = queue.popleft()
            for m in out.get(n, ()):
                if m not in dist:
                    dist[m] = d + 1
                    queue.append((m, d + 1))
        return dist

    reached = {n: reach(n) for n in nodes}
    rows = set()
    for n in nodes:
        if n in out and n not in has_in:
            rows |= {("root", n, m, d) for m, d in reached[n].items()}
        if n in reached[n]:
            both = {m for m in reached[n] if n in reached[m]}
            rows.add(("cycle", min(both), n, len(both)))
    return rows


def got(spark, links, **how):
    df = spark.createDataFrame([(*l, "x") for l in links], "parent string, child string, root string")
    rows = [tuple(r) for r in Hierarchy(df, **how).table().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("how", [{}, {"stride": 1, "one_task": 0}, {"stride": 4}])
def test_random_graph(spark, how):
    rng = random.Random(11)
    links = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)} | {("hot", f"n{i}") for i in range(30)}
    links |= {("x", "x"), ("x", "y"), ("a1", "a2"), ("a2", "a1")}
    links |= {("r0", "q0"), *((f"q{i}", f"q{i + 1}") for i in range(14)), ("q9", "q3"), ("q12", "q11"), ("r1", "q5")}
    assert got(spark, list(links) + list(links)[:3], **how) == brute(links)


def test_strong_sets():
    rng = random.Random(5)
    for n in (3, 8, 30):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]
        rows = brute({(f"{a:02}", f"{b:02}") for a, b in links})
        want = {n: d for k, _, n, d in rows if k == "cycle" and d > 1}
        assert {f"{h:02}": len(p) for p in strong_sets(links) if len(p) > 1 for h in p} == want
    assert [len(p) for p in strong_sets([(i, i + 1) for i in range(5000)] + [(5000, 0)])] == [5001] and strong_sets([]) == []


def test_null_ends_and_nothing(spark):
    assert got(spark, [("a", None), (None, "b")]) == set()
    assert got(spark, []) == set()


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("a", "c"), ("b", "c"), ("c", "d")], "parent string, child string")
    h = Hierarchy(df)
    paths = {r.node_id: (r.depth, r.path) for r in h.paths().collect()}
    assert paths["d"] == (3, ["r", "a", "c", "d"]) and paths["r"] == (0, ["r"])
    assert [tuple(r) for r in h.descendants().collect()] == [("r", 4, 3)]


def test_descendants_of_every_node(spark):
    rng = random.Random(12)
    links = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)}
    links |= {("x", "x"), ("x", "y"), ("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("a3", "b"), *((f"c{i}", f"c{i + 1}") for i in range(12))}
    out = {}
    for p, c in links:
        out.setdefault(p, set()).add(c)
    want = set()
    for n in out:
        dist, queue = {n: 0}, deque([n])
        while queue:
            at = queue.popleft()
            for m in out.get(at, set()) - set(dist):
                dist[m] = dist[at] + 1
                queue.append(m)
        want |= {(n, m, d) for m, d in dist.items() if d}
    df = spark.createDataFrame(list(links), "parent string, child string")
    got = [tuple(r) for r in Hierarchy(df).pairs().collect()]
    assert {("a3", "b", 1), ("a1", "b", 3), ("c5", "c12", 7)} < want and len(got) == len(want) and set(got) == want


def test_only_known_ends_and_newest_edges_link(spark):
    edges = spark.createDataFrame(
        [("e1", " d.a", "`p.d.b`", 1), ("e2", "d.b", "d.zz", 1), ("e3", "d.b", "core.s", 2), ("e3", "d.a", "d.a", 1), (None, "d.b", "d.a", 1)],
        "id string, source_node string, target_node string, scanned_at int",
    )
    nodes = spark.createDataFrame([("d.a",), ("d.b",), ("d.b",), (None,)], "id string")
    shared = spark.createDataFrame([("core.s",)], "id string")
    rows = {tuple(r) for r in graph_hierarchy(edges, nodes, shared).table().collect()}
    assert rows == {("root", "d.a", "d.b", 1), ("root", "d.a", "core.s", 2)}
