"""From a view's SQL to its column mappings: which source columns feed which output column, and how."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.sqltext import AGGREGATES, Expr, Query, Select, Source, Unreadable, is_dynamic, read, table_references

Schemas = dict[str, dict[str, str]]


@dataclass(frozen=True)
class Step:
    """One expression on the way from an output column to its sources."""

    text: str
    bare: bool = False
    window: bool = False
    aggregate: bool = False
    columns: bool = True


@dataclass
class Trace:
    """Source columns (table, column) of an output column, and the expressions passed, outermost first."""

    leaves: list[tuple[str, str]] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    unnested: bool = False
    nested: bool = False  # a field of a column

    def add(self, other: Trace) -> None:
        self.leaves += other.leaves
        self.steps += other.steps
        self.unnested |= other.unnested


class Unresolved(LookupError):
    """A column that belongs to no source."""


@dataclass(frozen=True)
class Mapping:
    source_node: str
    target_column: str
    source_columns: tuple[str, ...]
    transformation: str
    expression: str | None


class Scope:
    """The sources of one SELECT, within those around it."""

    def __init__(self, tracer: Tracer, select: Select, ctes: dict[str, tuple[Query, dict]], outer: Scope | None):
        self.tracer, self.select, self.ctes, self.outer = tracer, select, ctes, outer
        self.outputs_known: list[tuple[str | None, object]] | None = None

    def label(self, source: Source) -> str:
        return (source.alias or (source.path[-1] if source.path else "")).lower()

    def columns_of(self, source: Source) -> list[str] | None:
        """Column names, None if they are not known."""
        if source.array is not None:
            return [n for n in ((source.alias or "").lower(), (source.offset or "").lower()) if n]
        if (inner := self.query_of(source)) is not None:
            return [n.lower() for n, _ in inner.outputs() if n]
        schema = self.tracer.schema(source.path)
        return None if schema is None else list(schema)

    def query_of(self, source: Source) -> QueryScope | None:
        if source.query is not None:
            return self.tracer.scope(source.query, self.ctes, self)
        if len(source.path) == 1 and source.path[0].lower() in self.ctes:
            query, around = self.ctes[source.path[0].lower()]
            return self.tracer.scope(query, around, None)
        return None

    def from_source(self, source: Source, column: str, patch: bool) -> Trace | None:
        """The column of this source; ``patch`` takes one that a table does not list."""
        if source.array is not None:
            # items and their offsets both come from the array
            inside = list(parts_in(source.array))
            trace = Trace([], [Step(f"UNNEST({self.tracer.text(source.array)})", columns=bool(inside))], True)
            for part in inside:
                trace.leaves += self.part(part).leaves
            return trace
        if (inner := self.query_of(source)) is not None:
            return inner.trace(column)
        schema = self.tracer.schema(source.path)
        if patch or schema is not None and column in schema:
            return Trace([(self.tracer.node_id(source.path), column)])
        return None

    def resolve(self, parts: tuple[str, ...]) -> Trace:
        """A column reference: alias.column, column, or either with struct fields after it."""
        low = [p.lower() for p in parts]
        sources = self.select.sources
        if len(low) > 1:
            for source in sources:
                path = [p.lower() for p in source.path]
                # table.column in full, with or without the project before it
                full = next((n for n in (2, 3) if len(low) > n and path and low[n - len(path) : n] == path), 0)
                if self.label(source) == low[0] or full:
                    rest = low[1:] if self.label(source) == low[0] else low[full:]
                    if source.array is not None and self.label(source) == low[0]:
                        return self.from_source(source, low[0], True)
                    if (found := self.from_source(source, rest[0], True)) is not None:
                        found.nested = len(rest) > 1
                        return found
                    raise Unresolved(".".join(parts))
        for source in sources:
            if source.array is not None and low[0] not in (self.columns_of(source) or []):
                continue
            if (found := self.from_source(source, low[0], False)) is not None:
                found.nested = len(low) > 1
                return found
        open_sources = [s for s in sources if self.columns_of(s) is None]
        only = sources if len(sources) == 1 and sources[0].array is None and self.query_of(sources[0]) is None else open_sources
        if len(only) == 1:
            found = self.from_source(only[0], low[0], True)
            found.nested = len(low) > 1
            return found
        # an array alias over structs lends its fields
        arrays = [s for s in sources if s.array is not None]
        if self.outer is not None:
            return self.outer.resolve(parts)
        if len(arrays) == 1:
            return self.from_source(arrays[0], (arrays[0].alias or low[0]).lower(), True)
        raise Unresolved(".".join(parts))

    def outputs(self) -> list[tuple[str | None, object]]:
        """(name, how) of each output column; how is an expression or (source, column)."""
        if self.outputs_known is not None:
            return self.outputs_known
        out: list[tuple[str | None, object]] = []
        for item in self.select.items:
            e = item.expr
            if e.kind == "star":
                replaced = {(a or "").lower(): c for c, a in zip(e.children, e.aliases, strict=True)}
                for source in self.select.sources:
                    if e.parts and self.label(source) != e.parts[-1].lower():
                        continue
                    for column in self.columns_of(source) or []:
                        if column not in e.drop:
                            out.append((column, replaced.get(column, (source, column))))
            elif e.struct_star:
                out += struct_fields(e, self.tracer.sql)
            else:
                out.append((item.alias or (e.parts[-1] if e.kind == "column" else None), e))
        self.outputs_known = out
        return out

    def trace_output(self, how: object) -> Trace:
        if isinstance(how, Expr):
            return self.trace(how)
        source, column = how
        found = self.from_source(source, column, True)
        out = Trace([], [Step(column, bare=True)])
        if found is None:
            raise Unresolved(column)
        out.add(found)
        return out

    def trace(self, e: Expr) -> Trace:
        out = Trace([], [self.tracer.step(e)])
        for part in parts_in(e):
            found = self.part(part)
            if part is e and found.nested:
                out.steps[0] = replace(out.steps[0], bare=False)
            out.add(found)
        return out

    def part(self, part: Expr) -> Trace:
        """A column reference or a sub-query's first column."""
        if part.kind == "column":
            return self.resolve(part.parts)
        return self.tracer.scope(part.query, self.ctes, self).trace_at(0)


class QueryScope:
    """A query with its branches; columns of a set operation come from all branches by place."""

    def __init__(self, tracer: Tracer, query: Query, ctes: dict, outer: Scope | None):
        self.tracer, self.query, self.ctes = tracer, query, dict(ctes)
        for name, inner in query.ctes:
            around = dict(self.ctes)
            self.ctes[name.lower()] = (inner, around)
            if query.recursive:  # the name stands for the query in its own text, too
                around[name.lower()] = (inner, around)
        self.branches: list[Scope | QueryScope] = [
            Scope(tracer, b, self.ctes, outer) if isinstance(b, Select) else QueryScope(tracer, b, self.ctes, outer)
            for b in query.branches
        ]

    def outputs(self) -> list[tuple[str | None, object]]:
        found = self.branches[0].outputs()
        names = (*self.query.names, *(name for name, _ in found[len(self.query.names) :]))
        return [(name, how) for name, (_, how) in zip(names, found, strict=False)]

    def trace_at(self, place: int) -> Trace:
        """What feeds a column; a recursive query adds nothing to itself."""
        out, key = Trace(), (id(self.query), place)
        if key in self.tracer.open:
            return out
        self.tracer.open.add(key)
        try:
            return self._trace_at(place, out)
        finally:
            self.tracer.open.discard(key)

    def _trace_at(self, place: int, out: Trace) -> Trace:
        for branch in self.branches:
            if isinstance(branch, QueryScope):
                out.add(branch.trace_at(place))
                continue
            outputs = branch.outputs()
            if place < len(outputs):
                out.add(branch.trace_output(outputs[place][1]))
        return out

    def trace(self, column: str) -> Trace | None:
        for place, (name, _) in enumerate(self.outputs()):
            if name is not None and name.lower() == column:
                return self.trace_at(place)
        return None


def parts_in(e: Expr) -> Iterator[Expr]:
    """Column references and sub-queries of an expression, left to right."""
    if e.kind in ("column", "query"):
        yield e
    for child in e.children:
        yield from parts_in(child)


def calls_in(e: Expr) -> Iterator[Expr]:
    if e.kind == "call":
        yield e
    for child in e.children:
        yield from calls_in(child)
    if e.query is not None:
        for branch in e.query.branches:
            if isinstance(branch, Select):
                for item in branch.items:
                    yield from calls_in(item.expr)


def struct_fields(e: Expr, sql: str) -> list[tuple[str | None, Expr]]:
    """The fields of ARRAY_AGG(STRUCT(...) ORDER BY ...)[...].*, each as an aggregate of its own."""
    end = sql.rfind(".", e.start, e.stop)
    for call in calls_in(e):
        if call.name == "STRUCT":
            around = [c for c in calls_in(e) if c.name in AGGREGATES]
            order = [x for c in around for x in c.children if x is not call]
            return [
                (alias or (x.parts[-1] if x.kind == "column" else None),
                 Expr("call", e.start, e.stop, children=[x, *order], name="ARRAY_AGG",
                      text=sql[e.start : call.start] + sql[x.start : x.stop] + sql[call.stop : end]))
                for x, alias in zip(call.children, call.aliases, strict=True)
            ]
    return []


class Tracer:
    def __init__(self, sql: str, schemas: Schemas):
        self.sql, self.schemas = sql, schemas
        self.scopes: dict[tuple[int, int], QueryScope] = {}
        self.open: set[tuple[int, int]] = set()  # columns being traced

    def node_id(self, path: tuple[str, ...]) -> str:
        return ".".join(path)

    def schema(self, path: tuple[str, ...]) -> dict[str, str] | None:
        found = self.schemas.get(self.node_id(path))
        return None if not found else {c.lower(): t for c, t in found.items()}

    def text(self, e: Expr) -> str:
        return " ".join((e.text or self.sql[e.start : e.stop]).split())

    def scope(self, query: Query, ctes: dict, outer: Scope | None) -> QueryScope:
        key = (id(query), id(outer))
        if key not in self.scopes:
            self.scopes[key] = QueryScope(self, query, ctes, outer)
        return self.scopes[key]

    def step(self, e: Expr) -> Step:
        calls = list(calls_in(e))
        window = any(c.windowed for c in calls)
        aggregate = any(c.name in AGGREGATES for c in calls)
        return Step(self.text(e), e.kind == "column", window, aggregate, any(True for _ in parts_in(e)))


def classify(steps: list[Step], target: str, columns: list[str], unnested: bool) -> tuple[str, str | None]:
    """The transformation and its text: the outermost expression that is more than a column decides."""
    for step in steps:
        if not step.bare:
            kind = "aggregation" if step.aggregate and not step.window else "expression"
            return kind, step.text
    if len(columns) == 1:
        return ("direct" if columns[0] == target.lower() else "rename"), (f"UNNEST({columns[0]})" if unnested else None)
    return "expression", None


def _branch_mappings(tracer: Tracer, scope: Scope | QueryScope, wanted: list[tuple[str, int | None]], tables: list[str]) -> list[Mapping]:
    """Mappings of the wanted (target column, place or None) outputs of one SELECT or set operation."""
    out: list[Mapping] = []
    for target, place in wanted:
        first = tables[0] if tables else None
        unknown = [Mapping(first, target, (), "unknown", None)] if first else []
        try:
            if place is None:
                raise Unresolved(target)
            if isinstance(scope, Scope):
                trace = scope.trace_output(scope.outputs()[place][1])
            else:
                trace = scope.trace_at(place)
        except (Unresolved, RecursionError):
            out += unknown
            continue
        if not trace.leaves:
            out += _without_source(trace, target, first) or unknown
            continue
        by_table: dict[str, list[str]] = {}
        for table, column in trace.leaves:
            columns = by_table.setdefault(table, [])
            if column not in columns:
                columns.append(column)
        for table, columns in by_table.items():
            kind, text = classify(trace.steps, target, columns, trace.unnested)
            out.append(Mapping(table, target, tuple(sorted(columns)), kind, text))
    return out


def _without_source(trace: Trace, target: str, first: str | None) -> list[Mapping]:
    if first is None:
        return []
    for step in trace.steps:
        if step.window:
            return [Mapping(first, target, ("*",), "expression", step.text)]
        if step.aggregate:
            return [Mapping(first, target, ("*",), "aggregation", step.text)]
    if trace.steps and not any(s.columns for s in trace.steps):
        return [Mapping(first, target, (), "literal", trace.steps[0].text)]
    return []


def _selects(scope: QueryScope) -> list[Scope]:
    out: list[Scope] = []
    for b in scope.branches:
        out += _selects(b) if isinstance(b, QueryScope) else [b]
    return out


def view_mappings(view_id: str, sql: str, schemas: Schemas) -> list[Mapping]:
    """One mapping per source table and output column of the view, one hop back.

    The view's own columns come from ``schemas``; a view without any has no lineage.  Only what is
    selected counts, filters and join keys do not.  Branches of a top-level union are read by place,
    and of several branches on the same table the last one holds.  What cannot be traced is
    ``unknown`` on the first table.  Raises Unreadable for text that is not SQL.
    """
    columns = list(schemas.get(view_id) or {})
    if not columns:
        return []
    query, reader = read(sql)
    if query is None:
        return []
    tracer = Tracer(sql, schemas)
    scope = QueryScope(tracer, query, {}, None)
    lower_ctes = {n.lower() for n in reader.cte_names}
    own = [p for d, _, p in sorted(reader.tables) if len(p) > 1 or p and p[0].lower() not in lower_ctes]
    tables = [".".join(p) for p in own if ".".join(p) != view_id]
    if query.setop:
        merged: dict[tuple[str, str], Mapping] = {}
        for branch in _selects(scope):
            outputs = branch.outputs()
            wanted = [(c, i) for i, c in enumerate(columns) if i < len(outputs)]
            mine = [tracer.node_id(s.path) for s in branch.select.sources if s.path and s.path[0].lower() not in lower_ctes]
            for m in _branch_mappings(tracer, branch, wanted, mine or tables):
                merged[m.source_node, m.target_column] = m
        return list(merged.values())
    select = scope.branches[0]
    names = {}
    for place, (name, _) in enumerate(select.outputs()):
        if name is not None:
            names.setdefault(name.lower(), place)
    return _branch_mappings(tracer, select, [(c, names.get(c.lower())) for c in columns], tables)


# -- on tables of views

REFS = "node_id string, ord int, ref_dataset string, ref_table string"
PARSED = (
    "target_node string, outcome string, source_node string, target_column string, source_columns array<string>,"
    " transformation string, expression string"
)


def view_references(views: DataFrame) -> DataFrame:
    """(node_id, ord, ref_dataset, ref_table) of every table a view's SQL names, repeats kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (node, i, dataset, table)
                for node, sql in zip(batch.node_id, batch.sql, strict=True)
                for i, (dataset, table) in enumerate(table_references(sql))
            ]
            yield pd.DataFrame(rows, columns=["node_id", "ord", "ref_dataset", "ref_table"])

    return views.select("node_id", "sql").where("sql is not null").mapInPandas(run, REFS)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for node, sql, tables in zip(batch.node_id, batch.sql, batch.tables, strict=True):
            schemas = {t["id"]: {c: "" for c in t["cols"]} for t in ([] if tables is None else tables)}
            if is_dynamic(sql):
                rows.append((node, "dynamic", None, None, None, None, None))
                continue
            if not schemas.get(node):
                rows.append((node, "no_schema", None, None, None, None, None))
                continue
            try:
                found = view_mappings(node, sql, schemas)
            except (Unreadable, RecursionError, IndexError) as e:
                rows.append((node, "failed", None, None, None, None, str(e)[:200]))
                continue
            if not found:
                rows.append((node, "empty", None, None, None, None, None))
            rows += [
                (node, "ok", m.source_node, m.target_column, list(m.source_columns), m.transformation, m.expression)
                for m in found
            ]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def parse_views(nodes: DataFrame, columns: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Parse results of all nodes with SQL: (target_node, outcome, source_node, target_column, ...).

    ``nodes`` is (node_id, sql), ``columns`` (node_id, ordinal, name); ``only`` (node_id) restricts
    which views are read.  Each view travels with the columns of the tables it names, so views are
    read in parallel and no catalogue is broadcast.  outcome: ok, dynamic, no_schema, failed or empty.
    """
    views = nodes.where("sql is not null and trim(sql) <> ''").select("node_id", "sql")
    if only is not None:
        views = views.join(only.select("node_id"), "node_id", "left_semi")
    named = view_references(views).select(
        F.col("node_id").alias("view"),
        F.when(F.col("ref_dataset").isNull(), F.col("ref_table")).otherwise(F.concat_ws(".", "ref_dataset", "ref_table")).alias("node_id"),
    )
    wanted = named.unionByName(views.select(F.col("node_id").alias("view"), "node_id")).distinct()
    held = columns.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("cols"))
    held = held.select("node_id", F.transform("cols", lambda c: c["name"]).alias("cols"))
    known = wanted.join(held, "node_id").groupBy("view").agg(
        F.collect_list(F.struct(F.col("node_id").alias("id"), "cols")).alias("tables")
    )
    full = views.join(known, views.node_id == known.view, "left").select("node_id", "sql", "tables")
    return full.mapInPandas(_parse, PARSED)
