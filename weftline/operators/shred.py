"""Nested JSON to flat tables by columnar shredding with repetition and definition levels.

A schema is a tree of groups and leaves.  Every leaf becomes a column of (value, repetition level,
definition level) triples, as columnar file formats store nested data; the flat tables, one per
repeated ancestor, are then read back from those level sequences alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch


@dataclass(frozen=True)
class Group:
    """A field of objects; ``repeated`` fields hold any number of them, in a list or keyed by ``key``."""

    name: str
    children: tuple[Group | Leaf, ...] = field(default=())
    repeated: bool = True
    key: str | None = None


@dataclass(frozen=True)
class Leaf:
    """A field of plain values; a bare value of a repeated leaf is a list of one."""

    name: str
    repeated: bool = False


#: The saved graph: metadata, nodes with columns, edges with mappings with source columns, prune points.
SAVED_GRAPH = (
    Group(
        "metadata",
        (
            *map(Leaf, ("project_id", "generated_at", "description")),
            Group("scan_config", (Leaf("target"), Leaf("datasets", repeated=True), Leaf("depth")), repeated=False),
            Group(
                "scan_stats",
                tuple(map(Leaf, ("total_nodes", "total_edges", "nodes_by_type", "orphan_nodes", "terminal_nodes", "truncated_nodes", "parse_errors"))),
                repeated=False,
            ),
        ),
        repeated=False,
    ),
    Group(
        "nodes",
        (
            *map(Leaf, ("id", "type", "dataset", "name", "source", "sql", "description", "status", "status_message")),
            Group("columns", (Leaf("name"), Leaf("data_type"), Leaf("lineage_status"))),
        ),
        key="id",
    ),
    Group(
        "edges",
        (
            *map(Leaf, ("id", "source_node", "target_node", "edge_type", "description")),
            Group(
                "column_mappings",
                (
                    *map(Leaf, ("target_column", "transformation", "expression", "description")),
                    Leaf("source_columns", repeated=True),
                ),
            ),
        ),
        key="id",
    ),
    Leaf("prune_points", repeated=True),
)


class Column:
    """One leaf's values and levels; ``tops`` are the definition levels of its repeated ancestors."""

    def __init__(self, tops: list[int], full: int):
        self.values: list[str | None] = []
        self.rep: list[int] = []
        self.defs: list[int] = []
        self.tops, self.full = tops, full

    def add(self, value: str | None, rep: int, level: int) -> None:
        self.values.append(value)
        self.rep.append(rep)
        self.defs.append(level)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return _deep_text(value)


def _deep_text(value: object) -> str:
    """What ``json.dumps`` gives, for values nested beyond its stack."""
    out, todo = [], [(value, False)]  # values, and text that is written already
    while todo:
        x, written = todo.pop()
        if written:
            out.append(x)
        elif isinstance(x, dict | list) and x:
            keyed = isinstance(x, dict)
            todo.append(("}" if keyed else "]", True))
            for i, item in reversed(list(enumerate(x.items() if keyed else x))):
                todo.append((item[1] if keyed else item, False))
                todo.append(("," * (i > 0) + (f"{json.dumps(item[0], ensure_ascii=False)}:" if keyed else ""), True))
            out.append("{" if keyed else "[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _items(value: object, shape: Group | Leaf) -> list:
    """The occurrences of a repeated field, whatever way it was written."""
    if value is None:
        return []
    if isinstance(shape, Leaf):
        return value if isinstance(value, list) else [value]
    if isinstance(value, dict) and shape.key:
        return [{**x, shape.key: k} if isinstance(x, dict) else {shape.key: k} for k, x in value.items()]
    return value if isinstance(value, list) else [value]


class Shredder:
    """Writes records into columns and reads flat tables back."""

    def __init__(self, schema: tuple[Group | Leaf, ...]):
        self.schema = schema
        self.columns: dict[str, Column] = {}
        self.leaves: dict[str, list[str]] = {}  # by the path of the last repeated ancestor, "" for the record
        self._declare(schema, "", [], 0, "")

    def _declare(self, shapes: tuple, path: str, tops: list[int], level: int, above: str) -> None:
        for s in shapes:
            own = [*tops, level + 1] if s.repeated else tops
            name = f"{path}{s.name}"
            under = name if s.repeated else above
            if isinstance(s, Leaf):
                self.columns[name] = Column(own, level + 1 + s.repeated)
                self.leaves.setdefault(under, []).append(name)
            else:
                self._declare(s.children, f"{name}.", own, level + 1, under)

    def write(self, record: object) -> None:
        self._write(record if isinstance(record, dict) else {}, self.schema, "", 0, 0, 0)

    def _write(self, obj: object, shapes: tuple, path: str, rep: int, level: int, depth: int) -> None:
        """``depth``: repeated ancestors so far; ``level``: definition level of ``obj``."""
        here = obj if isinstance(obj, dict) else {}
        for s in shapes:
            name, value = f"{path}{s.name}", here.get(s.name)
            if not s.repeated:
                if isinstance(s, Leaf):
                    self.columns[name].add(_text(value), rep, level + (value is not None))
                else:
                    self._write(value, s.children, f"{name}.", rep, level + (value is not None), depth)
                continue
            found = _items(value, s)
            if not found:
                self._absent(s, name, rep, level)
            for i, x in enumerate(found):
                r = rep if i == 0 else depth + 1
                if isinstance(s, Leaf):
                    self.columns[name].add(_text(x), r, level + 1 + (x is not None))
                else:
                    self._write(x, s.children, f"{name}.", r, level + 1, depth + 1)

    def _absent(self, shape: Group | Leaf, name: str, rep: int, level: int) -> None:
        if isinstance(shape, Leaf):
            self.columns[name].add(None, rep, level)
        else:
            for child in shape.children:
                self._absent(child, f"{name}.{child.name}", rep, level)

    def read(self, path: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(record number, place in each repeated ancestor, value) of each entry of a leaf column.

        An entry exists if its definition level reaches its last repeated ancestor; record numbers
        and places follow from the repetition levels only.
        """
        c = self.columns[path]
        rep, defs = np.asarray(c.rep, np.int64), np.asarray(c.defs, np.int64)
        values = np.empty(len(c.values), object)
        values[:] = c.values
        record = np.cumsum(rep == 0) - 1
        places = []
        for k in range(1, len(c.tops) + 1):
            ticks = np.cumsum(rep == k)  # a repetition at level k starts the next item there
            starts = np.maximum.accumulate(np.where(rep < k, np.arange(len(rep)), 0)) if len(rep) else rep
            places.append(ticks - ticks[starts])
        there = defs >= (c.tops[-1] if c.tops else 0)
        return record[there], [p[there] for p in places], values[there]

    def table(self, above: str) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
        """(record number, place in each repeated ancestor, values by leaf) of each item of a repeated ancestor.

        Every leaf under the ancestor has an entry for each of its items, in the same order.
        """
        found = {leaf: self.read(leaf) for leaf in self.leaves[above]}
        record, places, _ = next(iter(found.values()))
        return record, places, {leaf: values for leaf, (_, _, values) in found.items()}


BLANKS = re.compile(r"[ \t\n\r]*")
ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")


def _deep_json(text: str) -> object:
    """What ``json.loads`` gives, for texts nested beyond its stack."""

    def skip(at: int) -> int:
        return BLANKS.match(text, at).end()

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(at)
        key, at = scanstring(text, at + 1, True)
        if text[(at := skip(at)) : at + 1] != ":":
            raise ValueError(at)
        return key, skip(at + 1)

    around: list[dict | list] = []
    keys: list[str | None] = []
    at = skip(0)
    while True:
        first = text[at : at + 1]
        if first in ("{", "["):
            value: object = {} if first == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if first == "{" else "]"):
                key, at = name(at) if first == "{" else (None, at)
                around.append(value)
                keys.append(key)
                continue
            at += 1
        elif first == '"':
            value, at = scanstring(text, at + 1, True)
        elif atom := ATOM.match(text, at):
            value, at = json.loads(atom.group()), atom.end()
        else:
            raise ValueError(at)
        while around:  # a value has ended
            top = around[-1]
            if keyed := isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            at = skip(at)
            end = text[at : at + 1]
            if end == ",":
                at = skip(at + 1)
                if keyed:
                    keys[-1], at = name(at)
                break
            if end != ("}" if keyed else "]"):
                raise ValueError(at)
            at += 1
            value = around.pop()
            keys.pop()
        else:
            if skip(at) != len(text):
                raise ValueError(at)
            return value


def complete_json(text: str | None) -> tuple[bool, object]:
    """Whether the text is one complete JSON value, however deep, and the value."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        try:
            return True, json.loads(text, parse_constant=refuse)
        except RecursionError:
            return True, _deep_json(text)
    except (ValueError, TypeError):
        return False, None


#: Flat tables by name: (leaf of the owner's id, leaf read, names of the places).
ENTRIES = {
    "nodes": ("nodes.id", "nodes.name", ("pos",)),
    "columns": ("nodes.id", "nodes.columns.name", ("owner", "pos")),
    "edges": ("edges.id", "edges.id", ("pos",)),
    "mappings": ("edges.id", "edges.column_mappings.target_column", ("owner", "pos")),
    "source_columns": ("edges.id", "edges.column_mappings.source_columns", ("owner", "pos", "src_pos")),
}
FLAT = "export_id bigint, entry string, owner_id string, owner_pos bigint, pos bigint, src_pos bigint, item string"
BATCH = 64


def _shredded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Shredder]]:
    """(export ids by record number, shredder) of some complete payloads at a time."""
    for batch in batches:
        for start in range(0, len(batch), BATCH):
            part = batch.iloc[start : start + BATCH]
            good = [(e, v) for e, (ok, v) in zip(part.export_id, map(complete_json, part.payload), strict=True) if ok]
            if not good:
                continue
            shredder = Shredder(SAVED_GRAPH)
            for _, value in good:
                shredder.write(value)
            yield np.array([e for e, _ in good], object), shredder


def _flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for exports, shredder in _shredded(batches):
        for entry, (owner, leaf, names) in ENTRIES.items():
            own_record, own_places, own_ids = shredder.read(owner)
            record, places, values = shredder.read(leaf)
            # the owner's id is found by its record and place: both columns list owners in order
            first = np.searchsorted(own_record, record) + places[0]
            at = dict(zip(names if names[0] == "owner" else ("owner", *names[1:]), places, strict=True))
            none = np.full(len(record), -1, np.int64)
            yield pd.DataFrame(
                {
                    "export_id": exports[record],
                    "entry": entry,
                    "owner_id": own_ids[first],
                    "owner_pos": at["owner"],
                    "pos": at.get("pos", none),
                    "src_pos": at.get("src_pos", none),
                    "item": values,
                }
            ).astype({"export_id": "Int64"})


@dataclass(frozen=True)
class Flat:
    """A flat table: all leaves under one repeated ancestor, with ``places`` in it and those around it."""

    above: str
    places: tuple[str, ...] = ()
    owner: tuple[str, str] | None = None  # name and leaf of the outermost ancestor's key, if that is another

    def fields(self) -> dict[str, str]:
        """Leaf by column name."""
        leaves = Shredder(SAVED_GRAPH).leaves[self.above]
        if leaves == [self.above]:
            return {"item": self.above}
        return {leaf.removeprefix(f"{self.above or 'metadata'}.").replace(".", "_"): leaf for leaf in leaves}

    def schema(self) -> str:
        owner = [f"{self.owner[0]} string"] if self.owner else []
        return ", ".join(["export_id bigint", *owner, *(f"{p} bigint" for p in self.places), *(f"{f} string" for f in self.fields())])


TABLES = {
    "metadata": Flat(""),
    "datasets": Flat("metadata.scan_config.datasets", ("pos",)),
    "nodes": Flat("nodes", ("pos",)),
    "columns": Flat("nodes.columns", ("node_pos", "pos"), ("node_id", "nodes.id")),
    "edges": Flat("edges", ("pos",)),
    "mappings": Flat("edges.column_mappings", ("edge_pos", "pos"), ("edge_id", "edges.id")),
    "source_columns": Flat("edges.column_mappings.source_columns", ("edge_pos", "mapping_pos", "pos"), ("edge_id", "edges.id")),
    "prune_points": Flat("prune_points", ("pos",)),
}


#: Keys of repeated payloads that are broadcast; if there are more, all payloads move once.
REPEATS = 200_000


def _once(graph_exports: DataFrame) -> DataFrame:
    """(export_id, payload), each pair once: only payloads that repeat are moved to be told apart."""
    texts = graph_exports.select("export_id", "payload").where("payload is not null")
    key = [F.coalesce(F.col("export_id").cast("string"), F.lit("")).alias("e"), F.unhex(F.md5("payload")).alias("d")]
    repeats = texts.select(*key).groupBy("e", "d").agg(F.count("*").alias("n")).where("n > 1").select("e", "d")
    repeats = Scratch(graph_exports.sparkSession, "exports").cut(repeats, "repeats")
    if repeats.count() > REPEATS:
        return texts.distinct()
    marked = texts.select("*", *key)
    alone = marked.join(F.broadcast(repeats), ["e", "d"], "left_anti").select("export_id", "payload")
    return alone.unionByName(marked.join(F.broadcast(repeats), ["e", "d"], "left_semi").select("export_id", "payload").distinct())


def flat_table(graph_exports: DataFrame, name: str) -> DataFrame:
    """One of :data:`TABLES` whole: (export_id, owner's id, places, all fields), values as text.

    The owner's id and place lead to the node or edge, ``mapping_pos`` to the mapping.  Fields of
    other kinds than text are JSON text.  Otherwise as :func:`flatten_exports`.
    """
    flat = TABLES[name]
    fields = flat.fields()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for exports, shredder in _shredded(batches):
            record, places, values = shredder.table(flat.above)
            out = {"export_id": exports[record]}
            if flat.owner:
                own_record, _, own_ids = shredder.read(flat.owner[1])
                out[flat.owner[0]] = own_ids[np.searchsorted(own_record, record) + places[0]]
            out |= dict(zip(flat.places, places, strict=True))
            yield pd.DataFrame(out | {f: values[leaf] for f, leaf in fields.items()}).astype({"export_id": "Int64"})

    return _once(graph_exports).mapInPandas(rows, flat.schema())


def flatten_exports(graph_exports: DataFrame) -> DataFrame:
    """(export_id, entry, owner_id, owner_pos, pos, src_pos, item) of all complete payloads.

    ``entry`` names the flat table: nodes, columns, edges, mappings or source_columns; owner_id and
    owner_pos lead to the node or edge, pos to the column or mapping.  Repeated rows count once.
    Null, empty and cut payloads give nothing; absent and null lists are empty; an item without the
    named field has a null item; a single object or text in place of a list is a list of one.
    """
    return _once(graph_exports).mapInPandas(_flatten, FLAT)


def export_items(graph_exports: DataFrame) -> DataFrame:
    """(export_id, owner_id, pos, src_pos, item): columns, mappings and source columns."""
    flat = flatten_exports(graph_exports).where(F.col("entry").isin("columns", "mappings", "source_columns"))
    return flat.select("export_id", "owner_id", "pos", "src_pos", "item")
