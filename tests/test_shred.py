import json

from weftline.operators.shred import SAVED_GRAPH, TABLES, Shredder, complete_json, export_items, flat_table, flatten_exports

GRAPH = {
    "nodes": {
        "d.a": {"name": "a", "columns": [{"name": "x"}, {"name": None}, {}]},
        "d.b": {"name": "b", "columns": None},
        "d.c": {},
    },
    "edges": [
        {"id": "e1", "column_mappings": [{"target_column": "t", "source_columns": ["x", "y"]}, {"target_column": "u", "source_columns": "bare"}, {"target_column": "v"}]},
        {"id": "e2", "column_mappings": None},
        {"id": "e3", "column_mappings": [{"source_columns": [None, "z"]}]},
    ],
}


def items(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "export_id bigint, payload string, owner_id string, pos int")
    return sorted((tuple(r) for r in export_items(df).collect()), key=str)


def test_items(spark):
    as_list = {**GRAPH, "nodes": [{"id": k, **v} for k, v in GRAPH["nodes"].items()]}
    want = [
        ("d.a", 0, -1, "x"), ("d.a", 1, -1, None), ("d.a", 2, -1, None), ("e1", 0, -1, "t"), ("e1", 0, 0, "x"), ("e1", 0, 1, "y"),
        ("e1", 1, -1, "u"), ("e1", 1, 0, "bare"), ("e1", 2, -1, "v"), ("e3", 0, -1, None), ("e3", 0, 0, None), ("e3", 0, 1, "z"),
    ]
    text = json.dumps(GRAPH)
    rows = [(1, text), (1, text), (2, json.dumps(as_list, indent=2)), (3, text[:-5]), (4, None), (5, ""), (6, "[]"), (7, "{}"), (8, '{"nodes": []}')]
    assert items(spark, rows) == sorted(((e, *w) for e in (1, 2) for w in want), key=str)
    assert items(spark, []) == []


def test_tables_keep_links(spark):
    df = spark.createDataFrame([(1, json.dumps(GRAPH))], "export_id bigint, payload string")
    rows = flatten_exports(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.entry, []).append((r.owner_id, r.owner_pos))
    assert sorted(by["nodes"]) == [("d.a", 0), ("d.b", 1), ("d.c", 2)]
    assert sorted(by["edges"]) == [("e1", 0), ("e2", 1), ("e3", 2)]


def test_levels_of_a_record():
    s = Shredder(SAVED_GRAPH)
    s.write({"edges": [{"id": "e", "column_mappings": [{"source_columns": ["a", "b"]}, {"source_columns": []}]}, {"id": "f"}]})
    c = s.columns["edges.column_mappings.source_columns"]
    assert (c.values, c.rep, c.defs) == (["a", "b", None, None], [0, 3, 2, 1], [4, 4, 2, 1])
    assert s.columns["nodes.columns.name"].defs == [0]


def test_complete_json():
    assert complete_json('{"a": 1} ')[0] and not complete_json('{"a": 1')[0]
    assert not complete_json("[NaN]")[0] and not complete_json("[" * 100_000)[0] and not complete_json(None)[0]


def test_whole_tables(spark):
    config = {"target": "d.b", "datasets": ["d", "e"], "depth": 2}
    graph = {
        "metadata": {"project_id": "p", "generated_at": "now", "scan_config": config, "scan_stats": {"total_nodes": 2, "nodes_by_type": {"view": 1}}},
        "nodes": {
            "d.a": {"type": "table", "dataset": "d", "name": "a", "source": "s", "status": "ok", "columns": [{"name": "x", "data_type": "INT64"}]},
            "d.b": {"type": "view", "sql": "SELECT 1", "description": None, "status_message": "m", "columns": [{"lineage_status": "resolved"}, {"name": "z"}]},
        },
        "edges": [
            {"id": "e1", "source_node": "d.a", "target_node": "d.b", "edge_type": "manual", "column_mappings": None},
            {"id": "e2", "description": "w", "column_mappings": [{"target_column": "z", "transformation": "direct", "expression": "x", "description": "y", "source_columns": "x"}, {"source_columns": ["p", "q"]}]},
        ],
        "prune_points": ["d.a"],
    }
    df = spark.createDataFrame([(1, "{}"), (7, json.dumps(graph)), (7, json.dumps(graph)), (8, json.dumps(graph)[:-1]), (9, None)], "export_id bigint, payload string")
    got = {t: sorted(tuple(r) for r in flat_table(df, t).where("export_id = 7").collect()) for t in TABLES}
    none = (None,) * 4
    assert got == {
        "metadata": [(7, "p", "now", None, "d.b", "2", "2", None, '{"view":1}', *none)],
        "datasets": [(7, 0, "d"), (7, 1, "e")],
        "nodes": [(7, 0, "d.a", "table", "d", "a", "s", None, None, "ok", None), (7, 1, "d.b", "view", None, None, None, "SELECT 1", None, None, "m")],
        "columns": [(7, "d.a", 0, 0, "x", "INT64", None), (7, "d.b", 1, 0, None, None, "resolved"), (7, "d.b", 1, 1, "z", None, None)],
        "edges": [(7, 0, "e1", "d.a", "d.b", "manual", None), (7, 1, "e2", None, None, None, "w")],
        "mappings": [(7, "e2", 1, 0, "z", "direct", "x", "y"), (7, "e2", 1, 1, *none)],
        "source_columns": [(7, "e2", 1, 0, 0, "x"), (7, "e2", 1, 1, 0, "p"), (7, "e2", 1, 1, 1, "q")],
        "prune_points": [(7, 0, "d.a")],
    }
    assert {t: flat_table(df, t).where("export_id <> 7").count() for t in TABLES} == {t: int(t == "metadata") for t in TABLES}


def test_deep_payloads_count(spark):
    deep = "[" * 100_000 + "]" * 100_000
    text = json.dumps(GRAPH)[:-1] + f', "other": {deep}, "metadata": {{"description": {deep}}}}}'
    assert items(spark, [(1, text)]) == items(spark, [(1, json.dumps(GRAPH))]) != []
    df = spark.createDataFrame([(1, text)], "export_id bigint, payload string")
    assert flat_table(df, "metadata").collect()[0].description == deep


def test_deep_reading_is_json():
    import random

    from weftline.operators.shred import _deep_json, _deep_text

    whole = {"a": [1, -2.5e3, True, None, "\u00e9\\\"", {}, [], {"b": {"c": [[]]}}], "": {"d": "x"}}
    for indent in (None, 2):
        text = json.dumps(whole, indent=indent)
        assert _deep_json(text) == whole and _deep_text(whole) == json.dumps(whole, ensure_ascii=False, separators=(",", ":"))
        rng = random.Random(5)
        for _ in range(3000):
            at = rng.randrange(len(text))
            broken = text[:at] + rng.choice(["", ",", "]", "}", "1", '"', " ", ":", "["]) + text[at + rng.randrange(2) :]
            try:
                want = json.loads(broken)
            except ValueError:
                want = ValueError
            try:
                got = _deep_json(broken)
            except ValueError:
                got = ValueError
            assert got == want, broken
