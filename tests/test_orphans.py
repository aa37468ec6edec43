import pytest

from weftline.operators import orphans
from weftline.operators.orphans import find_orphans

COL = "array<struct<name:string,data_type:string,lineage_status:string>>"
MAP = "array<struct<source_columns:array<string>,target_column:string,transformation:string,expression:string,description:string>>"
EDGE = f"snapshot_id bigint, project_id string, id string, source_node string, target_node string, column_mappings {MAP}, received_at int, node string, col string"
NODE = f"snapshot_id bigint, project_id string, id string, columns {COL}, received_at int, cols string"
META = "snapshot_id bigint, project_id string, generated_at string, received_at int"


def cols(*names):
    return [(n, "STRING", "resolved") for n in names]


def maps(*sources):
    return [(list(s) if s is not None else None, "t", "direct", None, None) for s in sources]


def run(spark, edges, nodes, shared=(), meta=((1, "p", "2025-01-01T00:00:00Z", 1), (2, "p", "2025-01-02T00:00:00Z", 1), (3, "p", "2025-01-03T00:00:00Z", 1))):
    e = spark.createDataFrame([(*x, None, None) for x in edges], EDGE)
    n = spark.createDataFrame([(*x, None) for x in nodes], NODE)
    s = spark.createDataFrame(list(shared), f"id string, columns {COL}")
    m = spark.createDataFrame(list(meta), META)
    return sorted(tuple(r) for r in find_orphans(e, n, s, m).collect())


def test_kinds_and_fields(spark):
    nodes = [
        (1, "p", "d.a", cols("X", "gone"), 1), (2, "p", "d.a", cols("x"), 1), (3, "p", "d.a", cols("x", "late"), 1),
        (1, "p", "d.old", None, 1), (3, "p", "d.new", [], 1), (2, "p", "d.b", cols("y"), 1), (2, "p", "d.none", [], 1),
    ]
    edges = [
        (2, "p", "e1", "`pr.d.a`", "d.b", maps(["X", "gone", "late", "nope", "*", None], None), 1),
        (2, "p", "e2", "d.old", "d.new", maps(["z"]), 1),
        (2, "p", "e3", "d.none", "d.never", maps(["q"]), 1),
        (2, "p", "e3", "d.a", "d.b", None, 0),  # an outdated delivery
        (2, "p", "e4", None, "d.b", [], 1),
        (2, "p", None, "d.x", "d.y", None, 1),
    ]
    shared = [("core.s", cols("k")), ("core.empty", None)]
    more = [(2, "p", "e5", "core.s", "d.b", maps(["K", "w"]), 1), (2, "p", "e6", "core.empty", "d.b", maps(["w"]), 1)]
    assert run(spark, edges + more, nodes, shared) == [
        (2, "e1", "source_columns", "gone", "deleted"),
        (2, "e1", "source_columns", "late", "late"),
        (2, "e1", "source_columns", "nope", "missing"),
        (2, "e2", "source_node", "d.old", "deleted"),
        (2, "e2", "target_node", "d.new", "late"),
        (2, "e3", "target_node", "d.never", "missing"),
        (2, "e5", "source_columns", "w", "missing"),
    ]


@pytest.mark.parametrize("few,hot", [(200_000, 100_000), (0, 0)])
def test_hot_reference_is_complete(spark, monkeypatch, few, hot):
    monkeypatch.setattr(orphans, "FEW_KEYS", few)  # all keys by broadcast, or the heavy ones only
    monkeypatch.setattr(orphans, "HOT_ROWS", hot)
    edges = [(1, "p", f"e{i}", "d.hot", "d.b", maps(["c"]), 1) for i in range(500)] + [(1, "p", "f", "d.b", "d.b", None, 1)]
    got = run(spark, edges, [(1, "p", "d.b", cols("y"), 1)])
    assert len(got) == 500 and {g[2:] for g in got} == {("source_node", "d.hot", "missing")}
    got = run(spark, edges + [(1, "p", "g", "d.gone", "d.b", None, 1)], [(1, "p", "d.b", cols("y"), 1), (1, "p", "d.hot", cols("k"), 1)])
    assert len(got) == 501 and {g[2:] for g in got} == {("source_columns", "c", "missing"), ("source_node", "d.gone", "missing")}


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "p", "e", "a.b", "c.d", None, 1)], [], (), ()) == [
        (1, "e", "source_node", "a.b", "missing"), (1, "e", "target_node", "c.d", "missing"),
    ]
