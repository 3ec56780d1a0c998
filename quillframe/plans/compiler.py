"""From syntax trees to DataFrames, one stage after another:

source, joins, WHERE, grouping, HAVING, windows, DISTINCT, ORDER BY, OFFSET/LIMIT, projection.

Columns are renamed to plain internal names at the source, so nothing is ever ambiguous and
pruning and push-down reach the scan.  What a later stage needs beyond its output travels as
hidden columns until the last projection.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quillframe.errors import AnalysisError, ArgumentError
from quillframe.functions import predicates
from quillframe.functions.clock import Clock
from quillframe.functions.names import RELATIVE
from quillframe.functions.scalars import FUNCTIONS, arithmetic, common
from quillframe.functions.values import LONG, STRING, Value, kind_of, literal, maybe_number, number, text, whole_text
from quillframe.operators import aggregates
from quillframe.operators.recursion import recurse
from quillframe.operators.series import series
from quillframe.plans import nodes as n

_ids = itertools.count(1)


def fresh(prefix: str) -> str:
    return f"{prefix}_{next(_ids)}"


@dataclass(frozen=True)
class Field:
    table: str
    name: str
    internal: str
    type: T.DataType
    meta: dict = field(default_factory=dict, hash=False, compare=False)
    hidden: bool = False  # the parent's columns of nested rows
    required: bool = False  # not nullable

    def value(self) -> Value:
        return Value(F.col(self.internal), self.type, meta=self.meta)


def never_empty(f: Field) -> bool:
    """By the schema, or by the catalog: a ``required`` column holds no empty cells."""
    return f.required or bool(f.meta.get("required"))


def same(x: Column, y: Column, known: bool) -> Column:
    """Equality of join keys: empty cells are equal, which a plain = says as well where one side has none; that keeps partitioning, buckets and runtime filters."""
    return x == y if known else x.eqNullSafe(y)


@dataclass
class Relation:
    """A DataFrame whose columns have internal names, and what they are called."""

    df: DataFrame
    fields: list[Field]


class Scope:
    """Where names and finished expressions are found while an expression is compiled."""

    def __init__(self, fields: list[Field], done: dict[n.Node, Value] | None = None, grouped: bool = False, aliases: dict[str, Value] | None = None):
        self.fields, self.done, self.grouped, self.aliases = fields, done or {}, grouped, aliases or {}

    def find(self, c: n.Col) -> Field | None:
        if c.table == "_p":
            return next((f for f in self.fields if f.hidden and f.name == c.name), None)
        hits = [f for f in self.fields if not f.hidden and (c.table is None or f.table.lower() == c.table.lower())]
        exact = [f for f in hits if f.name == c.name] or [f for f in hits if f.name.lower() == c.name.lower()]
        return exact[-1] if exact else None  # of several tables the last wins


class Compiler:
    def __init__(self, spark: SparkSession, table, clock: Clock, variables: dict | None = None, limits: dict | None = None):
        """table(name) gives (DataFrame, {column: meta}, hidden columns)."""
        self.spark, self.table, self.clock = spark, table, clock
        self.variables, self.limits = variables if variables is not None else {}, limits or {}
        self.ctes: list[dict[str, DataFrame]] = [{}]

    # ------------------------------------------------------------- queries
    def query(self, q: n.Node) -> DataFrame:
        if isinstance(q, n.Select):
            return self.select(q)
        if isinstance(q, n.Union):
            return self.union(q)
        if isinstance(q, n.With):
            return self.with_(q)
        raise AnalysisError(f"{type(q).__name__} is no query")

    def union(self, q: n.Union) -> DataFrame:
        out = self.query(q.first)
        for branch, every in q.rest:
            df = self.query(branch)
            if len(df.columns) != len(out.columns):
                raise AnalysisError(f"UNION of {len(out.columns)} and {len(df.columns)} columns")
            casts = []
            for a, b in zip(out.schema, df.schema, strict=True):
                if kind_of(a.dataType) != kind_of(b.dataType) and "null" not in (kind_of(a.dataType), kind_of(b.dataType)):
                    casts.append(a.name)
            if casts:
                out = out.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in casts else F.col(f"`{c}`") for c in out.columns])
                df = df.toDF(*out.columns).select(*[F.col(f"`{c}`").cast("string").alias(c) if c in casts else F.col(f"`{c}`") for c in out.columns])
            out = out.union(df)
            if not every:
                out = out.distinct()
        return out

    def with_(self, q: n.With) -> DataFrame:
        self.ctes.append(dict(self.ctes[-1]))
        try:
            for c in q.ctes:
                self.ctes[-1][c.name.lower()] = self.cte(c, q.recursive)
            return self.query(q.body)
        finally:
            self.ctes.pop()

    def cte(self, c: n.Cte, recursive: bool) -> DataFrame:
        if isinstance(c.query, n.Series):
            s = c.query
            ends = [self.constant(x) if x is not None else None for x in (s.start, s.stop, s.step)]
            return series(self.spark, *ends, s.column)
        if isinstance(c.query, n.ShowTables | n.Describe):
            return self.table.describe(c.query)
        branches = [c.query.first, *(b for b, _ in c.query.rest)] if isinstance(c.query, n.Union) else []
        named = [s for b in branches if isinstance(b, n.Select) for s in (b.source, *(j.source for j in b.joins)) if s]
        own = any(s.name.lower() == c.name.lower() for s in named)
        if recursive and own:
            if len(c.query.rest) != 1 or not c.query.rest[0][1]:
                raise AnalysisError("a recursive query is a seed UNION ALL one term")
            term = c.query.rest[0][0]
            if len(term.joins) != 1 or term.joins[0].kind != "inner" or term.group or term.distinct or term.order or term.limit is not None:
                raise AnalysisError("a recursive term has one INNER JOIN and no grouping, order or limit")
            seed = self.query(c.query.first)
            if c.columns:
                if len(c.columns) != len(seed.columns):
                    raise AnalysisError("the column list and the query differ in length")
                seed = seed.toDF(*c.columns)

            def step(frontier: DataFrame) -> DataFrame:
                self.ctes.append(dict(self.ctes[-1]) | {c.name.lower(): frontier})
                try:
                    extra = [x for x in frontier.columns if x.startswith("__")]
                    name = next(s.alias or s.name for s in [term.source, term.joins[0].source] if s.name.lower() == c.name.lower())
                    items = (*term.items, *(n.Item(n.Col(x, name), x) for x in extra))
                    return self.query(replace(term, items=items))
                finally:
                    self.ctes.pop()

            return recurse(seed, step, c.cycle, self.limits)
        df = self.query(c.query)
        return df.toDF(*c.columns) if c.columns else df

    # -------------------------------------------------------------- source
    def relation(self, s: n.Source) -> Relation:
        cte = self.ctes[-1].get(s.name.lower())
        df, metas, hidden = (cte, {}, set()) if cte is not None else self.table(s.name)
        alias = s.alias or s.name
        fields, cols = [], []
        for f in df.schema.fields:
            internal = fresh("c")
            c = F.col(f"`{f.name}`")
            meta = dict(f.metadata) | metas.get(f.name, {})
            shown = f.name.removeprefix("_p.") if f.name in hidden else f.name
            fields.append(Field(alias, shown, internal, f.dataType, meta, f.name in hidden, not f.nullable))
            cols.append(c.alias(internal, metadata=meta) if meta else c.alias(internal))
        return Relation(df.select(*cols), fields)

    def source(self, q: n.Select) -> Relation:
        if q.source is None:
            return Relation(self.spark.range(1).select(), [])
        out = self.relation(q.source)
        for j in q.joins:
            right = self.relation(j.source)
            if j.kind == "cross":
                out = Relation(out.df.crossJoin(right.df), out.fields + right.fields)
                continue
            both = Scope(out.fields + right.fields)
            ends = []
            for side in (j.left, j.right):
                if not isinstance(side, n.Col):
                    raise AnalysisError("JOIN compares two columns")
                f = both.find(side)
                if f is None:
                    raise AnalysisError(f"unknown column {side.name}")
                ends.append(f)
            own = {f.internal for f in out.fields}
            if (ends[0].internal in own) == (ends[1].internal in own):
                # a bare name that both tables have: take one from each side
                left, right_ = Scope(out.fields).find(j.left), Scope(right.fields).find(j.right)
                left, right_ = (left, right_) if left and right_ else (Scope(out.fields).find(j.right), Scope(right.fields).find(j.left))
                if not left or not right_:
                    raise AnalysisError("JOIN compares a column of either table")
                ends = [left, right_]
            a, b = (e.value() for e in ends)
            x, y = (a.col, b.col) if a.type == b.type else predicates.aligned(a, b)
            out = Relation(out.df.join(right.df, same(x, y, any(never_empty(e) for e in ends)), j.kind), out.fields + right.fields)
        return out

    # -------------------------------------------------------------- select
    def select(self, q: n.Select) -> DataFrame:
        rel = self.source(q)
        df, fields = rel.df, rel.fields
        items = self.expand(q.items, fields)
        if q.where is not None:
            df, where, done = self.subqueries(df, q.where, Scope(fields))
            if where is not None:
                df = df.filter(self.condition(where, Scope(fields, done)))
        aliases = {i.alias.lower(): i.value for i in items if i.alias}
        order = [self.order_item(o, items) for o in q.order]
        parts = [i.value for i in items] + [v for v, _ in order] + ([q.having] if q.having is not None else [])
        aggs = [x for p in parts for x in _deep(p, aliases) if isinstance(x, n.Agg)]
        grouped = q.group is not None or bool(aggs)
        done: dict[n.Node, Value] = {}
        if grouped:
            df, done = self.group(df, fields, q.group, items, dict.fromkeys(aggs), parts)
        scope = Scope(fields, done, grouped)
        if q.having is not None:
            if q.group is None:
                raise AnalysisError("HAVING needs GROUP BY")
            having = n.rewrite(q.having, lambda x: aliases.get(x.name.lower(), x) if isinstance(x, n.Col) and x.table is None else x)
            df, having, more = self.subqueries(df, having, scope)
            scope.done.update(more)
            if having is not None:
                df = df.filter(self.condition(having, scope))
        for v in parts:
            df, _, more = self.subqueries(df, v, scope, False)
            scope.done.update(more)
        windows = dict.fromkeys(x for p in parts for x in n.walk(p) if isinstance(x, n.Window))
        for w in windows:
            v = self.window(w, scope)
            name = fresh("w")
            df = df.withColumn(name, v.col)
            scope.done[w] = Value(F.col(name), v.type)
        values = [self.expression(i.value, scope) for i in items]
        names = self.names(items)
        out = [(fresh("o"), v, name) for v, name in zip(values, names, strict=True)]
        by_value = {i.value: Value(F.col(o), v.type, meta=v.meta) for i, (o, v, _) in zip(items, out, strict=True)}
        keys = []
        for value, down in order:
            v = by_value.get(value) or self.expression(value, scope)
            keys.append((fresh("s"), self.sort_key(v), down))
        shown = dict.fromkeys(name for _, _, name in out)
        last = {name: o for o, _, name in out}
        named = [v.col.alias(o, metadata=v.meta) if v.meta else v.col.alias(o) for o, v, _ in out]
        if keys:  # keys may name outputs
            df = df.select("*", *named).select(*[o for o, _, _ in out], *[k.alias(s) for s, k, _ in keys])
        else:
            df = df.select(*named)
        if q.distinct:
            df = df.dropDuplicates([o for o, _, _ in out])
        if keys:
            df = df.orderBy(*[F.col(s).desc_nulls_last() if down else F.col(s).asc_nulls_first() for s, _, down in keys])
        if q.limit is not None:
            df = df.limit(q.limit + (q.offset or 0))
        if q.offset:
            df = df.offset(q.offset)
        return df.select(*[F.col(last[name]).alias(name) for name in shown])

    def expand(self, items: tuple, fields: list[Field]) -> list[n.Item]:
        out = []
        for i in items:
            if not isinstance(i.value, n.Star):
                out.append(i)
            elif i.value.table == "_p":
                out += [n.Item(n.Col(f.name, "_p"), f"_p.{f.name}") for f in sorted((f for f in fields if f.hidden), key=lambda f: f.name)]
            else:
                seen = set()
                for f in fields:
                    if not f.hidden and (i.value.table is None or f.table.lower() == i.value.table.lower()) and f.name not in seen:
                        seen.add(f.name)
                        out.append(n.Item(n.Col(f.name, i.value.table)))
        return out

    def names(self, items: list[n.Item]) -> list[str]:
        out, seen = [], {}
        for i in items:
            if i.alias:
                out.append(i.alias if i.alias.startswith(("__", "_p.")) else i.alias.lower())
                continue
            name = i.value.name if isinstance(i.value, n.Col) else describe(i.value)
            k = seen.setdefault(name, [])
            if i.value not in k:
                k.append(i.value)
            out.append(name if k.index(i.value) == 0 else f"{name}_{k.index(i.value) + 1}")
        return out

    def order_item(self, o: n.Order, items: list[n.Item]) -> tuple[n.Node, bool]:
        """Names are aliases first, then columns."""
        aliases = {i.alias.lower(): i.value for i in items if i.alias}
        value = n.rewrite(o.value, lambda x: aliases[x.name.lower()] if isinstance(x, n.Col) and x.table is None and x.name.lower() in aliases else x)
        return value, o.descending

    def sort_key(self, v: Value) -> Column:
        order = v.meta.get("optionOrder")
        if order:
            known = F.array(*map(F.lit, order))
            if v.kind == "array":
                return F.array_sort(F.transform(v.col, lambda x: F.coalesce(F.nullif(F.array_position(known, x), F.lit(0)), F.lit(len(order) + 1))))
            return F.when(v.col.isNotNull(), F.coalesce(F.nullif(F.array_position(known, v.col), F.lit(0)), F.lit(len(order) + 1)))
        if v.meta.get("fieldType") == "RECORD_NUMBER" and v.kind == "str":
            return F.regexp_extract(v.col, r"(\d+)$", 1).try_cast("decimal(38,0)")
        return v.col

    # ------------------------------------------------------------ grouping
    def group(self, df: DataFrame, fields: list[Field], g: n.GroupBy | None, items: list[n.Item], aggs: dict, parts: list[n.Node]):
        scope = Scope(fields)
        aliases = {i.alias.lower(): i.value for i in items if i.alias}
        resolve = lambda k: aliases[k.name.lower()] if isinstance(k, n.Col) and k.table is None and scope.find(k) is None and k.name.lower() in aliases else k
        keys = dict.fromkeys(resolve(k) for k in g.keys) if g else {}
        done: dict[n.Node, Value] = {}
        prepared: list[Column] = []
        key_names: dict[n.Node, str] = {}
        for k in keys:
            v = self.expression(k, scope)
            name = fresh("k")
            key_names[k] = name
            prepared.append(v.col.alias(name))
            done[k] = Value(F.col(name), v.type, meta=v.meta)
            if isinstance(k, n.Col):
                f = scope.find(k)
                for other in (n.Col(f.name), n.Col(f.name, f.table)):
                    if scope.find(other) == f:
                        done[other] = done[k]
        exprs: list[str] = []
        for a in aggs:
            column, t = None, LONG
            if a.arg is not None:
                v = aggregates.checked(a.name, self.expression(a.arg, scope))
                column = fresh("x")
                c = v.col
                t = v.type
                if aggregates.wants_number(a.name):
                    c = text(v).cast("double") if v.kind == "str" and a.name in aggregates.STATISTICS else maybe_number(v)
                    t = v.type if v.kind == "num" else T.DoubleType()
                elif a.name == "GROUP_CONCAT":
                    c, t = text(v), STRING
                prepared.append(c.alias(column))
            skips = isinstance(a.arg, n.Case) and a.arg.other is None
            sql, out = aggregates.sql(a.name, column, t, a.distinct, a.separator, skips)
            name = fresh("a")
            exprs.append(f"{sql} AS {name}")
            done[a] = Value(F.col(name), out)
        df = df.select(*prepared) if prepared else df.select(F.lit(1).alias("one"))
        sets = g.sets if g else None
        marks = list(dict.fromkeys(x for p in parts for x in n.walk(p) if isinstance(x, n.Grouping)))
        for m in marks:
            key = resolve(m.key)
            if key not in done and not (sets and key in key_names):
                raise AnalysisError("GROUPING takes a grouping key")
            if sets is None:
                done[m] = literal(0)
                continue
            name = fresh("g")
            exprs.append(f"cast(grouping({key_names.get(key) or self._key_of(key, key_names, scope)}) AS int) AS {name}")
            done[m] = Value(F.col(name), T.IntegerType())
        names = list(key_names.values())
        if sets is None:
            if names:
                shape = df.groupBy(*names)
                df = shape.agg(*[F.expr(e) for e in exprs]) if exprs else df.select(*names).distinct()
            else:
                df = df.agg(*[F.expr(e) for e in exprs])
            return df, done
        limit = self.limits.get("grouping_sets")
        if limit and len(sets) > limit:
            raise AnalysisError(f"more than {limit} grouping sets")
        listed = ", ".join("(" + ", ".join(dict.fromkeys(key_names[resolve(k)] for k in s)) + ")" for s in sets)
        before = df
        df = self.spark.sql(f"SELECT {', '.join([*names, *exprs])} FROM {{source}} GROUP BY GROUPING SETS ({listed})", source=before)
        totals = [s for s in sets if not s]
        if totals:  # a grand total of no rows is a row
            none = before.limit(1).agg(F.count(F.lit(1)).alias("rows")).filter("rows = 0")
            row = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c in names else (F.lit(1).alias(c) if c.startswith("g_") else F.lit(0).cast(df.schema[c].dataType).alias(c) if self._zero(c, done) else F.lit(None).cast(df.schema[c].dataType).alias(c)) for c in df.columns]
            for _ in totals:
                df = df.unionByName(none.select(*row))
        return df, done

    @staticmethod
    def _key_of(key: n.Node, key_names: dict, scope: Scope) -> str:
        f = scope.find(key) if isinstance(key, n.Col) else None
        for k, name in key_names.items():
            if isinstance(k, n.Col) and scope.find(k) == f:
                return name
        raise AnalysisError("GROUPING takes a grouping key")

    @staticmethod
    def _zero(column: str, done: dict) -> bool:
        return any(isinstance(a, n.Agg) and a.name in ("COUNT", "SUM", "AVG") and str(v.col) == str(F.col(column)) for a, v in done.items())

    # ------------------------------------------------------------- windows
    def window(self, w: n.Window, scope: Scope) -> Value:
        spec = Window.partitionBy(*[self.expression(p, scope).col for p in w.partition]) if w.partition else Window.partitionBy(F.lit(0))
        keys = [(self.sort_key(self.expression(o.value, scope)), o.descending) for o in w.order]
        order = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys]
        if w.name in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            f = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[w.name]()
            return Value(f.over(spec.orderBy(*(order or [F.lit(1)]))), T.IntegerType())
        if w.name in ("LAG", "LEAD"):
            v = self.expression(w.args[0], scope)
            k = self.constant(w.args[1]) if len(w.args) > 1 else 1
            if not isinstance(k, int) or k < 0:
                raise ArgumentError(f"{w.name}'s offset is an integer from 0 on")
            return Value((F.lag if w.name == "LAG" else F.lead)(v.col, k).over(spec.orderBy(*order)), v.type, meta=v.meta)
        if order:
            spec = spec.orderBy(*order)
            spec = (spec.rowsBetween if w.frame == "rows" else spec.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
        v = self.expression(w.args[0], scope) if w.args else None
        if w.name == "COUNT":
            return Value(F.count(v.col if v else F.lit(1)).over(spec), LONG)
        if v is None:
            raise ArgumentError(f"{w.name} takes a value")
        if w.name in ("SUM", "AVG"):
            c = maybe_number(v)
            whole = v.kind == "num" and v.type.simpleString() in ("tinyint", "smallint", "int", "bigint")
            return Value(F.coalesce((F.sum if w.name == "SUM" else F.avg)(c).over(spec), F.lit(0)), LONG if whole and w.name == "SUM" else T.DoubleType())
        return Value((F.min if w.name == "MIN" else F.max)(v.col).over(spec), v.type)

    # ---------------------------------------------------------- subqueries
    def subqueries(self, df: DataFrame, root: n.Node, scope: Scope, filters: bool = True):
        """IN (query) leaves of a filter become semi and anti joins, others a joined mark.  Returns what is left of the filter."""
        done: dict[n.Node, Value] = {}
        left: list[n.Node] = []
        for part in root.parts if filters and isinstance(root, n.Logic) and root.op == "AND" else (root,):
            flip = False
            inner = part
            while isinstance(inner, n.Not):
                inner, flip = inner.value, not flip
            if filters and isinstance(inner, n.In) and isinstance(inner.items, n.Node) and not isinstance(inner.items, n.Var):
                v = self.expression(inner.value, scope)
                keys = self._keys(inner.items, False)
                a, b = self._matched(v, keys)
                known = not keys.schema[0].nullable or bool(keys.schema[0].metadata.get("required")) or bool(v.meta.get("required"))
                df = df.join(keys, same(a, b, known), "left_anti" if inner.negated != flip else "left_semi")
                continue
            left.append(part)
            for x in n.walk(part):
                if isinstance(x, n.In) and isinstance(x.items, n.Node) and not isinstance(x.items, n.Var) and x not in done:
                    v = self.expression(x.value, scope)
                    keys = self._keys(x.items)
                    mark = fresh("m")
                    a, b = self._matched(v, keys)
                    df = df.join(keys.withColumn(mark, F.lit(True)), a.eqNullSafe(b), "left").drop(keys.columns[0])
                    hit = F.col(mark).isNotNull()
                    done[x] = Value(~hit if x.negated else hit, T.BooleanType())
        rest = None if not left else left[0] if len(left) == 1 else n.Logic("AND", tuple(left))
        return df, rest, done

    def _keys(self, q: n.Node, once: bool = True) -> DataFrame:
        """The values of a subquery; semi and anti joins don't need them once."""
        df = self.query(q)
        keys = df.select(F.col(f"`{df.columns[0]}`").alias(fresh("q"), metadata=df.schema[0].metadata or None))
        return keys.distinct() if once else keys

    @staticmethod
    def _matched(v: Value, keys: DataFrame) -> tuple[Column, Column]:
        k = Value(F.col(keys.columns[0]), keys.schema[0].dataType)
        return (v.col, k.col) if v.type == k.type else predicates.aligned(v, k)

    # --------------------------------------------------------- expressions
    def constant(self, x: n.Node):
        """The Python value of a literal, variable, clock function or arithmetic on them."""
        if isinstance(x, n.Lit):
            return x.value
        if isinstance(x, n.Var):
            return self.variable(x.name)
        if isinstance(x, n.Func) and x.name.startswith("@"):
            return self.clock.scalar(x.name[1:])
        if isinstance(x, n.Func) and x.name in ("TODAY", "NOW", "CURRENT_DATE", "CURRENT_TIMESTAMP"):
            return self.clock.scalar(x.name)
        return self.evaluate(x)

    def variable(self, name: str):
        if name not in self.variables:
            raise AnalysisError(f"unknown variable @{name}")
        return self.variables[name]

    def evaluate(self, x: n.Node):
        """A single value by one small job; a subquery must give one row of one column."""
        if isinstance(x, n.Scalar):
            rows = self.query(x.query).limit(2).collect()
            if len(rows) != 1 or len(rows[0]) != 1:
                raise ArgumentError("a scalar subquery gives one row of one column")
            v = rows[0][0]
        else:
            v = self.spark.range(1).select(self.expression(x, Scope([])).col.alias("v")).first()[0]
        return v.isoformat() if isinstance(v, date | datetime) else "" if v is None else v

    def expression(self, x: n.Node, scope: Scope) -> Value:
        if x in scope.done:
            return scope.done[x]
        if isinstance(x, n.Lit):
            return literal(x.value)
        if isinstance(x, n.Var):
            return literal(self.variable(x.name))
        if isinstance(x, n.Col):
            f = scope.find(x)
            if f is None:
                raise AnalysisError(f"unknown column {x.table + '.' if x.table else ''}{x.name}")
            if scope.grouped:
                raise AnalysisError(f"{x.name} is neither grouped nor aggregated")
            return f.value()
        if isinstance(x, n.Bin):
            a, b = self.expression(x.left, scope), self.expression(x.right, scope)
            return FUNCTIONS["CONCAT"](a, b) if x.op == "||" else arithmetic(x.op, a, b)
        if isinstance(x, n.Neg):
            v = self.expression(x.value, scope)
            return Value(-number(v), v.type if v.kind == "num" else T.DoubleType())
        if isinstance(x, n.Case):
            values = [self.expression(v, scope) for _, v in x.whens] + ([self.expression(x.other, scope)] if x.other is not None else [])
            cols, t = common(values)
            out = None
            for (c, _), v in zip(x.whens, cols, strict=False):
                p = self.condition(c, scope)
                out = F.when(p, v) if out is None else out.when(p, v)
            return Value(out.otherwise(cols[-1]) if x.other is not None else out, t)
        if isinstance(x, n.Scalar):
            df = self.query(x.query)
            return Value(df.select(F.col(f"`{df.columns[0]}`")).scalar(), df.schema[0].dataType)
        if isinstance(x, n.Func):
            return self.call(x, scope)
        if isinstance(x, n.Agg):
            raise AnalysisError(f"{x.name} can't be used here")
        if isinstance(x, n.Window):
            raise AnalysisError(f"{x.name} OVER can't be used here")
        return Value(self.condition(x, scope), T.BooleanType())

    def call(self, x: n.Func, scope: Scope) -> Value:
        if x.name.startswith("@") or x.name in ("CURRENT_DATE", "CURRENT_TIMESTAMP", "TODAY", "NOW"):
            return literal(self.clock.scalar(x.name.removeprefix("@")))
        if x.name in ("LOGINUSER", "PRIMARY_ORGANIZATION"):
            return literal(self.limits.get(x.name.lower(), ""))
        if x.name in RELATIVE:
            s, e = self.clock.span(x.name, tuple(a.value for a in x.args))
            if (e - s).days != 1:
                raise AnalysisError(f"{x.name} is a range: compare with it")
            return literal(s.isoformat())
        return FUNCTIONS[x.name](*[self.expression(a, scope) for a in x.args])

    # ---------------------------------------------------------- conditions
    def condition(self, x: n.Node, scope: Scope, negated: bool = False) -> Column:
        if x in scope.done:
            c = scope.done[x].col
            return ~c if negated else c
        if isinstance(x, n.Not):
            return self.condition(x.value, scope, not negated)
        if isinstance(x, n.Logic):
            parts = [self.condition(p, scope, negated) for p in x.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if (x.op == "AND") != negated else out | p
            return out
        if isinstance(x, n.Cmp):
            op = predicates.NEGATED[x.op] if negated else x.op
            ranged = self._range(x.right)
            if ranged:
                return self._in_range(op, self.expression(x.left, scope), *ranged)
            a, b = self.expression(x.left, scope), self.expression(x.right, scope)
            return predicates.compare(op, canonical(b, a), canonical(a, b))
        if isinstance(x, n.Between):
            a, low, high = (self.expression(v, scope) for v in (x.value, x.low, x.high))
            if x.negated != negated:
                return predicates.compare("<", a, low) | predicates.compare(">", a, high)
            return predicates.compare(">=", a, low) & predicates.compare("<=", a, high)
        if isinstance(x, n.IsNull):
            v = self.expression(x.value, scope)
            empty = v.col.isNull() | ((v.col == "") if v.kind == "str" and not isinstance(x.value, n.Col) else F.lit(False))
            return ~empty if x.negated != negated else empty
        if isinstance(x, n.Like):
            pattern = str(self.constant(x.pattern))
            f = predicates.keyword if x.keyword else predicates.like
            return f(self.expression(x.value, scope), pattern, x.negated != negated)
        if isinstance(x, n.In):
            v = self.expression(x.value, scope)
            if isinstance(x.items, n.Var):
                given = self.variable(x.items.name)
                given = given if isinstance(given, list | tuple) else [given]
                items = [literal(g) for g in given]
            elif isinstance(x.items, tuple):
                items = [canonical(v, self.expression(i, scope)) for i in x.items]
            else:
                raise AnalysisError("IN (SELECT) can't be used here")
            return predicates.member(v, items, x.negated != negated)
        if isinstance(x, n.Exists):
            hit = self.query(x.query).exists()
            return ~hit if x.negated != negated else hit
        v = self.expression(x, scope)
        c = v.col if v.kind == "bool" else whole_text(v) == "1"
        return ~c if negated else c

    def _range(self, x: n.Node) -> tuple[date, date] | None:
        if isinstance(x, n.Func) and x.name in RELATIVE:
            return self.clock.span(x.name, tuple(a.value for a in x.args))
        if isinstance(x, n.Func) and x.name == "TODAY":
            return self.clock.span("TODAY", ())
        if isinstance(x, n.Var) and isinstance(self.variables.get(x.name), RelativeDate):
            r = self.variables[x.name]
            return self.clock.span(r.name, r.args)
        return None

    def _in_range(self, op: str, v: Value, start: date, end: date) -> Column:
        a, b = literal(start.isoformat()), literal(end.isoformat())
        if op == "=":
            return predicates.compare(">=", v, a) & predicates.compare("<", v, b) & v.col.isNotNull()
        if op == "!=":
            return predicates.compare("<", v, a) | predicates.compare(">=", v, b)
        return predicates.compare({"<": "<", "<=": "<", ">": ">=", ">=": ">="}[op], v, a if op in ("<", ">=") else b)


@dataclass(frozen=True)
class RelativeDate:
    name: str
    args: tuple


def _deep(p: n.Node, aliases: dict):
    yield from n.walk(p)
    for x in list(n.walk(p)):
        if isinstance(x, n.Col) and x.table is None and x.name.lower() in aliases and aliases[x.name.lower()] != x:
            yield from n.walk(aliases[x.name.lower()])


def canonical(column: Value, v: Value) -> Value:
    """A literal that is the display name of one of the column's options, as the option itself."""
    names = column.meta.get("optionNames") or {}
    return literal(names[v.literal]) if v.is_literal and v.literal in names else v


def describe(x: n.Node) -> str:
    """The name of an expression without an alias."""
    if isinstance(x, n.Agg):
        return f"{x.name}({'DISTINCT ' * x.distinct}{describe(x.arg) if x.arg is not None else '*'})"
    if isinstance(x, n.Col):
        return x.name
    if isinstance(x, n.Lit):
        return f"'{x.value}'" if isinstance(x.value, str) else x.text or str(x.value)
    if isinstance(x, n.Func):
        return f"{x.name}({','.join(map(describe, x.args))})"
    if isinstance(x, n.Bin):
        return f"{describe(x.left)} {x.op} {describe(x.right)}"
    if isinstance(x, n.Window):
        return f"{x.name}({','.join(map(describe, x.args))}) OVER"
    if isinstance(x, n.Grouping):
        return f"GROUPING({describe(x.key)})"
    if isinstance(x, n.Var):
        return f"@{x.name}"
    if isinstance(x, n.Scalar):
        return "(subquery)"
    return "case" if isinstance(x, n.Case) else re.sub(r"(?<!^)(?=[A-Z])", "_", type(x).__name__).lower()
