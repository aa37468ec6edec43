"""Reading warehouse SQL: just enough structure to follow columns and tables.

Views are read where they lie, by tasks on the executors, so this is plain Python without a session.
Expressions keep what lineage needs (columns, calls, windows, sub-queries, source text), not precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<str>[rRbB]{0,2}(?:'''(?:\\.|.)*?'''|\"\"\"(?:\\.|.)*?\"\"\"|'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*"))
    |(?P<quoted>`[^`]*`)
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<id>@{0,2}[^\W\d]\w*)
    |(?P<op><=>|<>|!=|<=|>=|\|\||::|=>|<<|>>|[-+*/%=<>.,;()\[\]{}?&|^~!:])
    |(?P<other>.)""",
    re.X | re.S,
)

# Words that end an expression, join two operands, or stand before one.
ENDS = frozenset(
    "FROM WHERE GROUP HAVING QUALIFY WINDOW ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN ON USING INNER LEFT RIGHT FULL CROSS "
    "NATURAL WHEN THEN ELSE END AS ROWS RANGE GROUPS ASC DESC NULLS IGNORE RESPECT SEPARATOR WITH FOR TABLESAMPLE PIVOT UNPIVOT PARTITION".split()
)
BINARY = frozenset("AND OR IN IS LIKE ILIKE RLIKE BETWEEN NOT COLLATE DIV MOD ESCAPE AT".split())
PREFIX = frozenset("NOT DISTINCT ALL ANY SOME".split())
LITERALS = frozenset("TRUE FALSE NULL CURRENT_DATE CURRENT_TIMESTAMP CURRENT_TIME CURRENT_DATETIME UNKNOWN".split())
TYPED = frozenset("DATE TIMESTAMP DATETIME TIME NUMERIC BIGNUMERIC JSON DECIMAL".split())
PARTS = frozenset(
    "YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND MILLISECOND MICROSECOND NANOSECOND ISOWEEK ISOYEAR DAYOFWEEK DAYOFYEAR DATE TIME".split()
)
PART_CALL = re.compile(r"^(DATE|TIME|TIMESTAMP|DATETIME)_?(DIFF|TRUNC|ADD|SUB|BUCKET)$|^LAST_DAY$|^EXTRACT$")
AGGREGATES = frozenset(  # fixed values: names by which an expression counts as an aggregation
    "COUNT SUM AVG MIN MAX COUNT_IF COUNTIF APPROX_COUNT_DISTINCT ANY_VALUE ARRAY_AGG STRING_AGG STDDEV VARIANCE CORR "
    "STDDEV_POP STDDEV_SAMP VAR_POP VAR_SAMP COVAR_POP COVAR_SAMP BIT_AND BIT_OR BIT_XOR LOGICAL_AND LOGICAL_OR ARRAY_CONCAT_AGG "
    "APPROX_QUANTILES MAX_BY MIN_BY".split()
)


class Unreadable(ValueError):
    """The text is not SQL that this module can read."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "id" else ""


@dataclass
class Expr:
    """kind: column, star, call, literal, query, or other; ``over`` holds the columns of a window."""

    kind: str
    start: int
    stop: int
    parts: tuple[str, ...] = ()
    children: list[Expr] = field(default_factory=list)
    name: str = ""
    windowed: bool = False
    query: Query | None = None
    aliases: list[str | None] = field(default_factory=list)
    drop: frozenset[str] = frozenset()
    struct_star: bool = False
    text: str = ""  # in place of what stands between start and stop


@dataclass
class Item:
    expr: Expr
    alias: str | None


@dataclass
class Source:
    """A table (path), a derived table (query) or an unnested array (array)."""

    alias: str | None
    path: tuple[str, ...] = ()
    query: Query | None = None
    array: Expr | None = None
    offset: str | None = None
    depth: int = 0
    start: int = 0


@dataclass
class Select:
    items: list[Item]
    sources: list[Source]


@dataclass
class Query:
    ctes: list[tuple[str, Query]]
    branches: list[Select | Query]
    setop: bool = False
    recursive: bool = False
    names: tuple[str, ...] = ()  # of its columns, if the WITH query lists them


def tokens(sql: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(sql):
        if m.lastgroup != "blank":
            out.append(Token(m.lastgroup, m.group(), m.start(), m.end()))
    out.append(Token("end", "", len(sql), len(sql)))
    return out


def split_path(parts: list[str]) -> tuple[str, ...]:
    """Dotted names inside back-ticks are several parts; the last two count."""
    flat = [p for part in parts for p in part.split(".") if p]
    return tuple(flat[-2:])


class Reader:
    def __init__(self, sql: str):
        self.sql = sql
        self.toks = tokens(sql)
        self.at = 0
        self.tables: list[tuple[int, int, tuple[str, ...]]] = []  # (depth, place, path)
        self.cte_names: set[str] = set()

    # -- token steps
    @property
    def tok(self) -> Token:
        return self.toks[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def step(self) -> Token:
        t = self.tok
        self.at = min(self.at + 1, len(self.toks) - 1)
        return t

    def accept(self, *words: str) -> bool:
        if self.tok.word in words or self.tok.kind == "op" and self.tok.text in words:
            self.step()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.accept(text):
            raise Unreadable(f"{text} expected at {self.tok.start}, found {self.tok.text!r}")

    def name(self) -> str:
        t = self.step()
        if t.kind not in ("id", "quoted"):
            raise Unreadable(f"name expected at {t.start}, found {t.text!r}")
        return t.text.strip("`")

    def skip_group(self) -> None:
        """Past a bracketed group whose opening was just read."""
        depth = 1
        while depth:
            t = self.step()
            if t.kind == "end":
                raise Unreadable("bracket left open")
            depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0

    # -- statements
    def statements(self) -> list[Query | None]:
        """The query of each statement; None for a statement without one."""
        out: list[Query | None] = []
        while self.tok.kind != "end":
            if self.accept(";"):
                continue
            out.append(self.statement())
            while self.tok.kind != "end" and self.tok.text != ";":
                self.step()
        return out

    def statement(self) -> Query | None:
        while self.tok.kind != "end" and self.tok.text != ";":
            if self.tok.word in ("SELECT", "WITH") or self.tok.text == "(" and self._query_after_brackets():
                return self.query(0)
            if self.tok.word in ("TABLE", "VIEW", "INTO", "UPDATE", "MERGE"):
                self.step()
                while self.tok.word in ("IF", "NOT", "EXISTS", "INTO"):
                    self.step()
                if self.tok.kind in ("id", "quoted") and self.tok.word not in ("SELECT", "WITH"):
                    start = self.tok.start
                    self.tables.append((1, start, self.path()))
                continue
            if self.step().text == "(":
                self.skip_group()
        return None

    def _query_after_brackets(self) -> bool:
        n = 0
        while self.ahead(n).text == "(":
            n += 1
        return self.ahead(n).word in ("SELECT", "WITH")

    # -- queries
    def query(self, depth: int) -> Query:
        ctes, recursive = [], False
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")
            while True:
                name, names = self.name(), []
                self.cte_names.add(name)
                if self.accept("("):
                    while not self.accept(")"):
                        names.append(self.name())
                        self.accept(",")
                self.need("AS")
                self.need("(")
                inner = self.query(depth + 3)
                inner.names = tuple(names)
                ctes.append((name, inner))
                self.need(")")
                if not self.accept(","):
                    break
        branches = [self.branch(depth)]
        while self.tok.word in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            self.step()
            self.accept("ALL", "DISTINCT")
            branches.append(self.branch(depth + 1))
        self.tail(depth)
        return Query(ctes, branches, len(branches) > 1, recursive)

    def branch(self, depth: int) -> Select | Query:
        if self.accept("("):
            inner = self.query(depth + 1)
            self.need(")")
            return inner
        return self.select(depth)

    def tail(self, depth: int) -> None:
        while True:
            if self.accept("ORDER"):
                self.need("BY")
                self.expressions(depth)
            elif self.accept("LIMIT", "OFFSET"):
                self.expression(depth)
            else:
                return

    def select(self, depth: int) -> Select:
        self.need("SELECT")
        self.accept("ALL", "DISTINCT")
        if self.tok.word == "AS" and self.ahead().word in ("STRUCT", "VALUE"):
            self.step()
            self.step()
        items = []
        while True:
            if self.tok.word == "FROM" or self.tok.kind == "end" or self.tok.text == ")":
                break
            expr = self.expression(depth)
            items.append(Item(expr, self.alias()))
            if not self.accept(","):
                break
        sources: list[Source] = []
        if self.accept("FROM"):
            self.sources(sources, depth)
        while True:
            if self.accept("WHERE", "HAVING", "QUALIFY"):
                self.expression(depth)
            elif self.accept("GROUP"):
                self.need("BY")
                self.expressions(depth)
            elif self.accept("WINDOW"):
                while True:
                    self.name()
                    self.need("AS")
                    self.need("(")
                    self.skip_group()
                    if not self.accept(","):
                        break
            else:
                break
        return Select(items, sources)

    def alias(self) -> str | None:
        if self.accept("AS"):
            return self.name()
        t = self.tok
        if t.kind == "quoted" or t.kind == "id" and t.word not in ENDS and t.word not in BINARY:
            return self.step().text.strip("`")
        return None

    def sources(self, out: list[Source], depth: int) -> None:
        self.source(out, depth)
        while True:
            if self.accept(","):
                self.source(out, depth)
                continue
            n = 0
            while self.ahead(n).word in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "SEMI", "ANTI"):
                n += 1
            if self.ahead(n).word != "JOIN":
                return
            for _ in range(n + 1):
                self.step()
            self.source(out, depth)
            if self.accept("ON"):
                self.expression(depth)
            elif self.accept("USING"):
                self.need("(")
                self.skip_group()

    def source(self, out: list[Source], depth: int) -> None:
        start = self.tok.start
        self.accept("LATERAL")
        if self.tok.text == "(":
            if self._query_after_brackets():
                self.step()
                query = self.query(depth + 3)
                self.need(")")
                out.append(Source(self.alias(), query=query, start=start))
            else:
                self.step()
                self.sources(out, depth)
                self.need(")")
            return
        if self.tok.word == "UNNEST" and self.ahead().text == "(":
            self.step()
            self.step()
            array = self.expression(depth)
            self.need(")")
            alias = self.alias()
            out.append(Source(alias, array=array, offset=self.with_offset(), start=start))
            return
        raw = self.raw_path()
        known = {(s.alias or (s.path[-1] if s.path else "")).lower() for s in out}
        if len(raw) > 1 and raw[0].lower() in known:
            array = Expr("column", start, self.toks[self.at - 1].stop, tuple(raw))
            out.append(Source(self.alias(), array=array, offset=self.with_offset(), start=start))
            return
        if self.tok.text == "(":  # a table function
            self.step()
            self.skip_group()
        path = split_path(raw)
        if self.tok.word == "FOR":
            while self.tok.word in ("FOR", "SYSTEM_TIME", "AS", "OF"):
                self.step()
            self.expression(depth)
        alias = self.alias()
        if self.tok.word in ("TABLESAMPLE", "PIVOT", "UNPIVOT"):
            while self.tok.text != "(" and self.tok.kind != "end":
                self.step()
            self.step()
            self.skip_group()
            alias = self.alias() or alias
        self.tables.append((depth + 2, start, path))
        out.append(Source(alias, path=path, depth=depth, start=start))

    def with_offset(self) -> str | None:
        if self.tok.word == "WITH" and self.ahead().word == "OFFSET":
            self.step()
            self.step()
            return self.alias() or "offset"
        return None

    def raw_path(self) -> list[str]:
        parts = [self.name()]
        while True:
            before = self.toks[self.at - 1]
            if self.tok.text == "-" and self.tok.start == before.stop and self.ahead().kind in ("id", "num"):
                self.step()
                parts[-1] += "-" + self.step().text  # project names hold dashes
            elif self.tok.text == "." and self.ahead().kind in ("id", "quoted", "num"):
                self.step()
                parts.append(self.step().text.strip("`"))
            else:
                return parts

    def path(self) -> tuple[str, ...]:
        return split_path(self.raw_path())

    # -- expressions
    def expressions(self, depth: int) -> list[Expr]:
        out = []
        while True:
            out.append(self.expression(depth))
            while self.tok.word in ("ASC", "DESC", "NULLS", "FIRST", "LAST"):
                self.step()
            if not self.accept(","):
                return out

    def expression(self, depth: int) -> Expr:
        """Operands and operators up to what cannot continue an expression."""
        start, found, plain, awaits = self.tok.start, [], True, True
        while True:
            t = self.tok
            if t.kind == "end" or t.kind == "op" and t.text in (",", ")", "]", ";", "}"):
                break
            if awaits:
                if t.word in PREFIX and not (t.word in ("ANY", "SOME", "ALL") and self.ahead().text != "("):
                    plain = False
                    self.step()
                    continue
                if t.word in ENDS and not (t.word in ("LEFT", "RIGHT", "OFFSET", "GROUPS", "RANGE") and self.ahead().text == "("):
                    break
                if t.kind == "op" and t.text in "+-~!":
                    plain = False
                    self.step()
                    continue
                found.append(self.operand(depth))
                awaits = False
            elif t.word in BINARY:
                plain, awaits = False, True
                self.step()
                if t.word == "AT":  # AT TIME ZONE
                    self.accept("TIME")
                    self.accept("ZONE")
            elif t.word in ENDS or t.kind in ("id", "quoted", "str", "num"):
                break
            elif t.text == "::":
                plain = False
                self.step()
                self.type_name()
            else:
                plain, awaits = False, True
                self.step()
        stop = self.toks[self.at - 1].stop
        if not found:
            raise Unreadable(f"expression expected at {start}")
        if len(found) == 1 and plain:
            return found[0]
        return Expr("other", start, stop, children=found)

    def type_name(self) -> None:
        self.name()
        if self.accept("<"):
            self.skip_angles()
        if self.accept("("):
            self.skip_group()

    def skip_angles(self) -> None:
        depth = 1
        while depth:
            t = self.step()
            if t.kind == "end":
                raise Unreadable("type left open")
            depth += (t.text == "<") - (t.text == ">") - 2 * (t.text == ">>")

    def operand(self, depth: int) -> Expr:
        out = self.primary(depth)
        while True:
            if self.tok.text == "[":
                self.step()
                inner = self.expression(depth)
                self.need("]")
                out = Expr("other", out.start, self.toks[self.at - 1].stop, children=[out, inner], name="item")
            elif self.tok.text == "." and self.ahead().text == "*":
                self.step()
                self.step()
                out = Expr("other", out.start, self.toks[self.at - 1].stop, children=[out], name="item", struct_star=True)
            elif self.tok.text == "." and self.ahead().kind in ("id", "quoted"):
                self.step()
                self.step()
                out = Expr("other", out.start, self.toks[self.at - 1].stop, children=[out], name="field")
            else:
                return out

    def primary(self, depth: int) -> Expr:
        t = self.step()
        word = t.word
        if t.text == "(" and t.kind == "op":
            if self.tok.word in ("SELECT", "WITH") or self.tok.text == "(" and self._query_after_brackets():
                query = self.query(depth + 3)
                self.need(")")
                return Expr("query", t.start, self.toks[self.at - 1].stop, query=query)
            inner = self.arguments(depth, ")")
            if len(inner.children) == 1:
                only = inner.children[0]
                return only if only.kind == "column" else Expr("other", t.start, inner.stop, children=[only])
            return Expr("other", t.start, inner.stop, children=inner.children)
        if t.text == "[":
            inner = self.arguments(depth, "]")
            return Expr("other", t.start, inner.stop, children=inner.children)
        if t.text == "*":
            return self.star(t, ())
        if t.kind in ("str", "num") or t.text == "?" or t.text.startswith("@"):
            return Expr("literal", t.start, t.stop)
        if word in LITERALS and self.tok.text not in ("(", "."):
            return Expr("literal", t.start, t.stop)
        if word in TYPED and self.tok.kind == "str":
            return Expr("literal", t.start, self.step().stop)
        if word == "INTERVAL":
            value = self.expression(depth)
            if self.tok.word in PARTS:
                self.step()
            return Expr("other", t.start, self.toks[self.at - 1].stop, children=[value])
        if word == "CASE":
            return self.case(t, depth)
        if word == "EXISTS" and self.tok.text == "(":
            self.step()
            self.query(depth + 3)
            self.need(")")
            return Expr("other", t.start, self.toks[self.at - 1].stop)
        if word in ("ARRAY", "STRUCT") and self.tok.text == "<":
            self.step()
            self.skip_angles()
        if t.kind not in ("id", "quoted"):
            raise Unreadable(f"operand expected at {t.start}, found {t.text!r}")
        if word in ("ARRAY", "STRUCT") and self.tok.text == "[":
            self.step()
            inner = self.arguments(depth, "]")
            return Expr("other", t.start, inner.stop, children=inner.children)
        parts = [t.text.strip("`")]
        while self.tok.text == "." and self.ahead().kind in ("id", "quoted"):
            self.step()
            parts.append(self.step().text.strip("`"))
        if self.tok.text == "." and self.ahead().text == "*":
            self.step()
            return self.star(self.step(), tuple(parts), t.start)
        if self.tok.text == "(":
            return self.call(t, parts[-1].upper(), depth)
        if t.kind == "quoted" and len(parts) == 1 and "." in parts[0]:
            parts = parts[0].split(".")
        return Expr("column", t.start, self.toks[self.at - 1].stop, tuple(parts))

    def star(self, t: Token, qualifier: tuple[str, ...], start: int | None = None) -> Expr:
        out = Expr("star", t.start if start is None else start, t.stop, qualifier)
        if self.tok.word == "EXCEPT" and self.ahead().text == "(":
            self.step()
            self.step()
            names = []
            while not self.accept(")"):
                names.append(self.name().lower())
                self.accept(",")
            out.drop = frozenset(names)
        if self.tok.word == "REPLACE" and self.ahead().text == "(":
            self.step()
            self.step()
            inner = self.arguments(depth=0, close=")")
            out.children, out.aliases = inner.children, inner.aliases
        return out

    def case(self, t: Token, depth: int) -> Expr:
        children = []
        while not self.accept("END"):
            if self.tok.kind == "end":
                raise Unreadable("CASE left open")
            if not self.accept("WHEN", "THEN", "ELSE"):
                children.append(self.expression(depth))
        return Expr("other", t.start, self.toks[self.at - 1].stop, children=children)

    def arguments(self, depth: int, close: str) -> Expr:
        """Everything up to a closing bracket: expressions with aliases, orders, limits and modifiers."""
        out = Expr("other", self.tok.start, self.tok.stop)
        while not self.accept(close):
            if self.tok.kind == "end":
                raise Unreadable("bracket left open")
            if self.accept(",", "DISTINCT", "ALL", "IGNORE", "RESPECT", "NULLS", "ASC", "DESC", "FIRST", "LAST", "=>"):
                continue
            if self.tok.word in ("SELECT", "WITH"):
                query = self.query(depth + 3)
                out.children.append(Expr("query", self.tok.start, self.tok.stop, query=query))
                out.aliases.append(None)
                continue
            if self.accept("ORDER", "PARTITION"):
                self.need("BY")
                continue
            if self.accept("LIMIT"):
                self.expression(depth)
                continue
            if self.tok.word in ("ROWS", "RANGE", "GROUPS") and self.ahead().text != "(":
                while self.tok.text != close and self.tok.kind != "end":
                    self.step()
                continue
            if self.accept("HAVING"):
                self.accept("MAX", "MIN")
            out.children.append(self.expression(depth))
            alias = None
            if self.tok.word == "AS":
                self.step()
                alias = self.name()
                if self.accept("<"):
                    self.skip_angles()
                elif self.accept("("):
                    self.skip_group()
            out.aliases.append(alias)
            if self.tok.word == "FORMAT":
                self.step()
        out.stop = self.toks[self.at - 1].stop
        return out

    def call(self, t: Token, name: str, depth: int) -> Expr:
        self.need("(")
        if name == "EXTRACT":
            self.step()
            while self.tok.word != "FROM" and self.tok.kind != "end":
                self.step()
            self.accept("FROM")
        inner = self.arguments(depth, ")")
        if PART_CALL.match(name):
            for child in inner.children:
                if child.kind == "column" and len(child.parts) == 1 and child.parts[0].upper() in PARTS:
                    child.kind = "literal"
        out = Expr("call", t.start, inner.stop, children=inner.children, name=name, aliases=inner.aliases)
        if self.tok.word in ("WITHIN", "FILTER") and self.ahead().text != ",":
            self.step()
            self.accept("GROUP")
            self.need("(")
            self.accept("WHERE")
            more = self.arguments(depth, ")")
            out.children, out.stop = [*out.children, *more.children], more.stop
        if self.tok.word == "OVER":
            self.step()
            out.windowed = True
            if self.accept("("):
                if self.tok.kind in ("id", "quoted") and self.tok.word not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
                    self.name()
                frame = self.arguments(depth, ")")
                out.children = [*out.children, *frame.children]
            else:
                self.name()
            out.stop = self.toks[self.at - 1].stop
        return out


def read(sql: str) -> tuple[Query | None, Reader]:
    """The first query of a script, and the reader that knows its tables."""
    reader = Reader(sql)
    found = [q for q in reader.statements() if q is not None]
    return (found[0] if found else None), reader


def table_references(sql: str | None) -> list[tuple[str | None, str]]:
    """(dataset or None, table) of every table named in the script, outermost first, repeats kept.

    Names of WITH queries are no tables; what cannot be read names none.
    """
    if not sql:
        return []
    out: list[tuple[str | None, str]] = []
    start = 0
    try:
        whole = tokens(sql)
    except Exception:
        return []
    cuts = [t.start for t in whole if t.text == ";" and t.kind == "op"] + [len(sql)]
    for cut in cuts:  # names of WITH queries hold for one statement
        reader = Reader(sql[start:cut])
        start = cut + 1
        try:
            reader.statements()
        except (Unreadable, RecursionError, IndexError):
            return []
        for _, _, path in sorted(reader.tables):
            if len(path) > 1:
                out.append((path[-2], path[-1]))
            elif path and path[0] not in reader.cte_names:
                out.append((None, path[0]))
    return out


DYNAMIC = r"(?i)\bEXECUTE\s+IMMEDIATE\b"


def is_dynamic(sql: str | None) -> bool:
    """Whether the text builds SQL at run time; a comment that says so counts, too."""
    return bool(sql) and re.search(DYNAMIC, sql) is not None
