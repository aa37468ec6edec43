import random

import pytest

from weftline.operators.snapshot_diff import HASHES, _hash, peel, snapshot_changes
from tests.test_orphans import COL, MAP, META


def expected(snaps, order):
    out = set()
    for prev, cur in zip(order, order[1:], strict=False):
        a, b = snaps.get(prev, {}), snaps.get(cur, {})
        for k in a.keys() | b.keys():
            if k not in a:
                out.add((cur, "node", k, "added"))
            elif k not in b:
                out.add((cur, "node", k, "removed"))
            elif a[k] != b[k]:
                out.add((cur, "node", k, "changed"))
    return out


def frames(spark, snaps, edges=()):
    nodes = [(s, "p", k, [(c, "INT", "ok") for c in v], 1) for s, held in snaps.items() for k, v in held.items()]
    n = spark.createDataFrame(nodes, f"snapshot_id bigint, project_id string, id string, columns {COL}, received_at int")
    e = spark.createDataFrame(list(edges), f"snapshot_id bigint, project_id string, id string, column_mappings {MAP}, received_at int")
    return n, e


@pytest.mark.parametrize("cells,rounds", [(60, 4), (6, 1)])
def test_random_snapshots(spark, cells, rounds):
    rng = random.Random(5)
    snaps = {10: {f"n{i}": ("a", str(rng.randrange(3))) for i in range(700)}}
    for prev, cur in ((10, 4), (4, 8)):
        held = dict(snaps[prev])
        for k in rng.sample(sorted(held), 60):
            del held[k]
        for k in rng.sample(sorted(held), 50):
            held[k] = (*held[k], "more")
        held |= {f"new{cur}-{i}": ("z",) for i in range(40)}
        snaps[cur] = held
    snaps[9] = {}  # a scan that holds nothing
    meta = spark.createDataFrame([(s, "p", f"2025-01-0{i}T00:00:00Z", 1) for i, s in enumerate((10, 4, 8, 9), 1)], META)
    got = snapshot_changes(*frames(spark, snaps), meta, cells=cells, rounds=rounds).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(snaps, [10, 4, 8, 9])


def test_what_counts_as_change(spark):
    def edge(s, i, maps):
        return (s, "p", i, maps, 1)

    one = (["B", "a"], "T", "direct", None, "x")
    edges = [
        edge(1, "same", [one, (["c"], "u", "rename", "e", None)]), edge(2, "same", [(["c"], "U", "rename", "e", "other"), (["A", "b", "b"], "t", "direct", "", None)]),
        edge(1, "kind", [one]), edge(2, "kind", [(["b", "a"], "t", "rename", None, None)]),
        edge(1, "empty", None), edge(2, "empty", []), edge(2, None, None),
    ]
    nodes, e = frames(spark, {1: {"n": ("A", "b"), "o": ("a", "b"), "null": ()}, 2: {"n": ("a", "B"), "o": ("b", "a"), "null": ()}}, edges)
    meta = spark.createDataFrame([(1, "p", "2025-01-01T00:00:00Z", 1), (2, "p", "2025-01-01T09:00:00+01:00", 1)], META)
    got = {tuple(r) for r in snapshot_changes(nodes, e, meta).collect()}
    assert got == {(2, "edge", "kind", "changed"), (2, "node", "o", "changed")}


def test_empty(spark):
    nodes, e = frames(spark, {})
    assert snapshot_changes(nodes, e, spark.createDataFrame([], META)).count() == 0


def test_peeling_gives_all_or_none():
    def table(items, size):
        cells = {i: [0, 0, 0, 0] for i in range(HASHES * size)}
        for kh, ch, sign in items:
            spot = _hash(kh, ch)
            for j in range(HASHES):
                c = cells[((spot >> 20 * j) & 0xFFFFF) % size + j * size]
                c[0] += sign
                c[1] ^= kh
                c[2] ^= ch
                c[3] ^= _hash(ch, kh)
        return cells

    items = [(i * 7919, i * 104729, 1 if i % 2 else -1) for i in range(1, 30)]
    assert sorted(peel(table(items, 30), 30)) == sorted(items)
    assert peel(table(items, 3), 3) is None
    assert peel(table([], 3), 3) == []


def test_hash_is_sparks(spark):
    for a, b in ((1, 2), (-5, 7), (2**62, -(2**61))):
        assert spark.sql(f"select xxhash64({a}L, {b}L) h").collect()[0].h == _hash(a, b)
