"""Syntax tree.  All nodes are frozen so that equal expressions compare and hash equal."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Node:
    """Base of all nodes."""


def node(cls):
    return dataclass(frozen=True)(cls)


# ------------------------------------------------------------- expressions
@node
class Lit(Node):
    value: Any  # str, int, float, None, or tuple of str for an array
    text: str = ""  # of a number, as written


@node
class Col(Node):
    name: str
    table: str | None = None


@node
class Var(Node):
    name: str


@node
class Star(Node):
    table: str | None = None  # '_p' for the parent of nested rows


@node
class Bin(Node):
    op: str
    left: Node
    right: Node


@node
class Neg(Node):
    value: Node


@node
class Func(Node):
    name: str
    args: tuple


@node
class Agg(Node):
    name: str
    arg: Node | None  # None: *
    distinct: bool = False
    separator: str = ","


@node
class Grouping(Node):
    key: Node


@node
class Case(Node):
    whens: tuple  # of (condition, value)
    other: Node | None


@node
class Window(Node):
    name: str
    args: tuple
    partition: tuple
    order: tuple  # of Order
    frame: str | None  # 'rows', 'range' or None


@node
class Scalar(Node):
    query: Node


# -------------------------------------------------------------- predicates
@node
class Cmp(Node):
    op: str
    left: Node
    right: Node


@node
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool = False


@node
class In(Node):
    value: Node
    items: Any  # tuple of nodes, Var or query
    negated: bool = False


@node
class IsNull(Node):
    value: Node
    negated: bool = False


@node
class Like(Node):
    value: Node
    pattern: Node
    negated: bool = False
    keyword: bool = False  # KLIKE


@node
class Exists(Node):
    query: Node
    negated: bool = False


@node
class Not(Node):
    value: Node


@node
class Logic(Node):
    op: str  # AND, OR
    parts: tuple


# ----------------------------------------------------------------- queries
@node
class Item(Node):
    value: Node
    alias: str | None = None


@node
class Order(Node):
    value: Node
    descending: bool = False


@node
class Source(Node):
    name: str
    alias: str | None = None


@node
class Join(Node):
    kind: str  # inner, left, right, cross
    source: Source
    left: Node | None = None
    right: Node | None = None


@node
class GroupBy(Node):
    keys: tuple
    sets: tuple | None = None  # of tuples of keys
    how: str = "plain"


@node
class Select(Node):
    items: tuple
    source: Source | None = None
    joins: tuple = ()
    where: Node | None = None
    group: GroupBy | None = None
    having: Node | None = None
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    source_order: bool = False  # KORDER BY


@node
class Union(Node):
    first: Node
    rest: tuple  # of (query, all)


@node
class Series(Node):
    start: Node
    stop: Node
    step: Node | None = None
    column: str = "generate_series"


@node
class Cte(Node):
    name: str
    query: Node
    columns: tuple = ()
    cycle: tuple | None = None  # column, mark, value, default


@node
class With(Node):
    ctes: tuple
    body: Node
    recursive: bool = False


@node
class ShowTables(Node):
    pass


@node
class Describe(Node):
    table: str


@node
class Explain(Node):
    query: Node


# -------------------------------------------------------------- statements
@node
class CreateTemp(Node):
    name: str
    query: Node


@node
class DropTemp(Node):
    name: str


@node
class SetVar(Node):
    name: str
    value: Node
    declare: bool = False
    relative: bool = False


@node
class Assert(Node):
    condition: Node
    message: Node | None = None
    warn: bool = False


@node
class Exit(Node):
    condition: Node
    message: Node | None = None


@node
class Checks(Node):
    """What may follow a writing statement."""

    groups: tuple = ()  # CHECK groups: tuples of (condition, message)
    validate_only: bool = False
    skip: bool = False
    into: str | None = None
    reject_limit: int | None = None


@node
class Apply(Node):
    column: str
    operations: tuple  # of (kind, payload dict items)


@node
class Insert(Node):
    table: str
    columns: tuple
    rows: tuple | None
    query: Node | None
    checks: Checks = field(default_factory=Checks)


@node
class Upsert(Node):
    table: str
    columns: tuple
    rows: tuple | None
    query: Node | None
    keys: tuple = ()
    checks: Checks = field(default_factory=Checks)


@node
class Update(Node):
    table: str
    assignments: tuple  # of (column, value)
    where: Node
    source: Source | None = None
    applies: tuple = ()
    checks: Checks = field(default_factory=Checks)


@node
class Delete(Node):
    table: str
    where: Node


@node
class Reorder(Node):
    table: str
    keys: tuple
    where: Node | None = None


@node
class Validate(Node):
    table: str
    fields: tuple = ()
    where: Node | None = None
    summary: bool = False
    checks: Checks = field(default_factory=Checks)


@node
class Import(Node):
    table: str
    columns: tuple
    format: str  # CSV, JSON
    source: str
    update: bool = False
    encoding: str = "UTF8"
    header: bool = True
    header_columns: tuple = ()
    items: tuple = ()
    by_name: bool = False
    ignore_unknown: bool = False
    record_number: str | None = None
    keys: tuple = ()
    replace: tuple = ()
    checks: Checks = field(default_factory=Checks)


def walk(x: Any):
    """A node and all nodes below it, but not inside nested queries."""
    if isinstance(x, Node):
        yield x
        if isinstance(x, Scalar | Exists):
            return
        for name in x.__dataclass_fields__:
            v = getattr(x, name)
            if isinstance(x, In) and name == "items" and isinstance(v, Node):
                continue
            yield from walk(v)
    elif isinstance(x, tuple):
        for v in x:
            yield from walk(v)


def rewrite(x: Any, f):
    """Bottom-up copy with f(node) applied, nested queries included."""
    if isinstance(x, Node):
        return f(type(x)(**{n: rewrite(getattr(x, n), f) for n in x.__dataclass_fields__}))
    if isinstance(x, tuple):
        return tuple(rewrite(v, f) for v in x)
    return x
