"""Two-valued predicates in negation normal form.

A NULL cell is the lowest value, and every comparison is true or false.  NOT is pushed down
to the leaves, so that a leaf that comes out NULL means false, and ``x < k`` becomes
``x < k OR x IS NULL``: forms that Parquet scans can still push down.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillframe.functions.values import Value, date, kind_of, literal, maybe_number, stamp, text

NEGATED = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
FLIPPED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def aligned(x: Value, y: Value) -> tuple[Column, Column]:
    """Both sides in the kind of the left one; a literal left side takes that of the right."""
    lead = y if x.is_literal and not y.is_literal else x
    if lead.kind == "num":
        return maybe_number(x), maybe_number(y)
    if lead.kind == "date" and (x.kind, y.kind) != ("ts", "ts"):
        return date(x), date(y)
    if lead.kind == "ts":
        return stamp(x), stamp(y)
    if lead.kind == "bool" and x.kind == y.kind:
        return x.col, y.col
    if x.kind == y.kind == "num":
        return maybe_number(x), maybe_number(y)
    return text(x), text(y)


def compare(op: str, x: Value, y: Value) -> Column:
    if x.is_literal and not y.is_literal:
        return compare(FLIPPED[op], y, x)
    if y.is_literal and y.literal == "":
        a = text(x) if x.kind == "array" else x.col
        return {"=": a.isNull(), "<=": a.isNull(), "!=": a.isNotNull(), ">": a.isNotNull(), "<": F.lit(False), ">=": F.lit(True)}[op]
    a, b = aligned(x, y)
    if y.is_literal:
        plain = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return plain | a.isNull() if op in ("!=", "<", "<=") else plain
    if op in ("=", "!="):
        same = a.eqNullSafe(b)
        if {x.kind, y.kind} == {"num", "str"} and x.kind == "num":  # text that is no number equals none
            same &= ~F.coalesce(F.isnan(b), F.lit(False))
        return same if op == "=" else ~same
    if op in (">", ">="):
        a, b, op = b, a, {">": "<", ">=": "<="}[op]
    return (a < b) | (a.isNull() & b.isNotNull()) if op == "<" else (a <= b) | a.isNull()


def member(x: Value, items: list[Value], negated: bool) -> Column:
    """IN: any overlap for several values, typed equality else.  An empty list holds nothing."""
    if not items:
        return F.lit(negated)
    if x.kind == "array":
        wanted = [str(i.literal) for i in items if not (i.is_literal and i.literal == "")]
        own = x.col
        if kind_of(x.type.elementType) == "struct":
            own = F.transform(own, lambda e: e["code"])
        hit = F.arrays_overlap(own, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
        if len(wanted) < len(items):
            hit |= own.isNull() | (F.size(own) == 0)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if negated else hit
    if x.kind == "struct":
        x = Value(x.col["code"], literal("x").type)
    given = [i for i in items if not (i.is_literal and i.literal == "")]
    empty = len(given) < len(items)
    if all(i.is_literal for i in given) and given:
        a = aligned(x, given[0])[0]
        hit = a.isin([aligned(x, i)[1] for i in given])
        if negated:
            return ~hit & a.isNotNull() if empty else ~hit | a.isNull()
        return hit | a.isNull() if empty else hit
    parts = [compare("!=" if negated else "=", x, i) for i in items]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if negated else out | p
    return out


def like(x: Value, pattern: str, negated: bool) -> Column:
    """% and _ do not cross lines; a pattern without them means contains."""
    a = text(x)
    if not re.search("[%_]", pattern):
        hit, empty = a.contains(pattern), pattern == ""
    else:
        body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
        hit, empty = a.rlike(f"^{body}\\z"), set(pattern) == {"%"}
    if negated:
        return ~hit if empty else ~hit | a.isNull()
    return hit | a.isNull() if empty else hit


def keyword(x: Value, word: str, negated: bool) -> Column:
    """Keyword search: the value has all words of the keyword among its words, whatever the case.  An approximation of an index search."""
    words = [w for w in re.split(r"\W+", word.lower()) if w]
    own = F.split(F.lower(text(x)), r"[^\p{L}\p{N}_]+")
    hit = F.lit(True)
    for w in words:
        hit &= F.array_contains(own, w)
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if negated else hit
