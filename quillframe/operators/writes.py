"""Writing statements as rewrites of a snapshot: a new DataFrame replaces the old one."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillframe.errors import AnalysisError, ArgumentError, LimitError
from quillframe.functions.values import Value, date, maybe_number, stamp, text
from quillframe.operators import validation
from quillframe.plans import nodes as n
from quillframe.plans.compiler import Compiler, Scope, canonical


def converted(v: Value, t: T.DataType) -> Column:
    """A value as the column's type: dates with slashes, comma lists, local text of times."""
    if isinstance(t, T.ArrayType) and v.kind == "str":
        if isinstance(t.elementType, T.StructType):  # rows as JSON, cells as text
            plain = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in t.elementType]))
            return F.coalesce(F.from_json(text(v), plain), F.array()).cast(t)
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, T.StructType):
        return v.col.cast(t) if v.kind == "array" else F.when(text(v).isNotNull() & (text(v) != ""), F.split(text(v), r"\s*,\s*")).cast(t)
    if isinstance(t, T.DateType):
        return date(Value(F.replace(text(v), F.lit("/"), F.lit("-")), T.StringType())) if v.kind == "str" else date(v)
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return (stamp(Value(F.replace(text(v), F.lit("/"), F.lit("-")), T.StringType())) if v.kind == "str" else stamp(v)).cast(t)
    if isinstance(t, T.NumericType):
        return maybe_number(v).cast(t) if v.kind == "num" else F.nullif(text(v), F.lit("")).try_cast(t)
    if isinstance(t, T.StringType):
        return text(v)
    return v.col.cast(t)


class Writer:
    def __init__(self, compiler: Compiler, catalog, limits: dict):
        self.c, self.catalog, self.limits = compiler, catalog, limits

    # -------------------------------------------------------------- pieces
    def target(self, name: str):
        t = self.catalog.table(name)
        if t.store is None:
            raise AnalysisError(f"{name} can't be written")
        return t, self.catalog.read(t)

    def scope(self, df: DataFrame, table: str, prefix: str = "") -> Scope:
        out = Scope([])
        for f in df.schema:
            v = Value(F.col(f"`{prefix}{f.name}`"), f.dataType, meta=dict(f.metadata) | (self.catalog.tables[table.lower()].metas.get(f.name, {}) if table.lower() in self.catalog.tables else {}))
            for key in (n.Col(f.name), n.Col(f.name, table)):
                out.done[key] = v
        return out

    def rows(self, table: str, columns: tuple, rows: tuple | None, query: n.Node | None, schema: T.StructType) -> DataFrame:
        types = {f.name: f.dataType for f in schema}
        for c in columns:
            if c not in types:
                raise AnalysisError(f"{table} has no column {c}")
        if rows is not None:
            made = []
            for r in rows:
                if len(r) != len(columns):
                    raise AnalysisError("a row has as many values as there are columns")
                made.append(F.struct(*[converted(self.c.expression(v, Scope([])), types[c]).alias(c) for v, c in zip(r, columns, strict=True)]))
            return self.c.spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")
        df = self.c.query(query)
        if len(df.columns) != len(columns):
            raise AnalysisError(f"{len(columns)} columns and {len(df.columns)} values")
        return df.select(*[converted(Value(F.col(f"`{s.name}`"), s.dataType), types[c]).alias(c) for s, c in zip(df.schema, columns, strict=True)])

    def completed(self, df: DataFrame, schema: T.StructType, metas: dict, old: DataFrame) -> DataFrame:
        """All columns of the table: defaults for missing ones, new ids behind the largest."""
        cols = []
        for f in schema:
            if f.name in df.columns:
                cols.append(F.col(f"`{f.name}`"))
            elif f.name == "$id":
                top = old.agg(F.max("`$id`")).first()[0] or 0
                cols.append((F.lit(top + 1) + F.monotonically_increasing_id()).cast(f.dataType).alias("$id"))
            else:
                cols.append(F.lit(metas.get(f.name, {}).get("default")).cast(f.dataType).alias(f.name))
        return df.select(*cols)

    def checks(self, checks: n.Checks, scope: Scope) -> list[Column]:
        out = []
        for group in checks.groups:
            message = None
            for condition, then in group:
                p, m = self.c.condition(condition, scope), text(self.c.expression(then, scope))
                message = F.when(p, m) if message is None else message.when(p, m)
            out.append(validation.problem(message.isNotNull(), "", "ERR_CHECK", message, F.lit(None)))
        return out

    def screened(self, df: DataFrame, table, fields: list[str], checks: n.Checks, rest: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
        """Rows to write, rows with errors (for INTO), and what to report; rest: rows that stay in the table beside them."""
        marked = validation.with_errors(df, fields, table.metas, self.checks(checks, self.scope(df, table.name)), rest=rest)
        bad = marked.where(F.size("__errors") > 0)
        key = "$id" if "$id" in df.columns else None
        if checks.validate_only:
            return df.limit(0), validation.detail(bad, table.name, key), {"validated": True}
        if checks.skip:
            count = bad.count()
            if checks.reject_limit is not None and count > checks.reject_limit:
                raise LimitError(f"{count} rows with errors; the limit is {checks.reject_limit}")
            good = marked.where(F.size("__errors") == 0).drop("__errors")
            quarantine = bad.select(*[c for c in df.columns], F.explode("__errors").alias("e")).select(*[F.col(f"`{c}`") for c in df.columns], F.col("e.field").alias("$err_field"), F.col("e.code").alias("$err_code"), F.col("e.message").alias("$err_message"), F.col("e.value").alias("$err_value"))
            return good, quarantine, {"skipped": count}
        if fields or checks.groups:
            first = bad.select("__errors").first()
            if first:
                e = first[0][0]
                raise ArgumentError(f"{e.code}: {e.message}")
        return df, None, {}

    @staticmethod
    def selective(where: n.Node) -> None:
        """A condition that names no column selects all rows or none: not in a write."""
        if not any(isinstance(x, n.Col | n.In | n.Exists | n.Scalar) for x in n.walk(where)):
            raise AnalysisError("the WHERE of a write names a column")

    def guard(self, count: int) -> None:
        if self.limits.get("dml_rows") is not None and count > self.limits["dml_rows"]:
            raise LimitError(f"{count} rows would change; the limit is {self.limits['dml_rows']}")

    # ---------------------------------------------------------- statements
    def insert(self, s: n.Insert) -> tuple[dict, DataFrame | None]:
        if "$" in s.table.strip("$") and s.table.lower() not in self.catalog.tables:
            return self.nested_insert(s)
        t, old = self.target(s.table)
        new = self.completed(self.rows(s.table, s.columns, s.rows, s.query, old.schema), old.schema, t.metas, old)
        new, errors, report = self.screened(new, t, [c for c in old.columns if c in t.metas], s.checks, old)
        if s.checks.validate_only:
            return report, errors
        count = new.count()
        self.guard(count)
        t.store.write(old.unionByName(new))
        return report | {"inserted": count}, errors

    def upsert(self, s: n.Upsert) -> tuple[dict, DataFrame | None]:
        t, old = self.target(s.table)
        for k in s.keys:
            if k not in s.columns:
                raise AnalysisError(f"the key {k} is not among the columns")
        new = self.rows(s.table, s.columns, s.rows, s.query, old.schema)
        if not new.groupBy(*[F.col(f"`{k}`") for k in s.keys]).count().where("count > 1").isEmpty():
            raise ArgumentError("a key occurs more than once in the source")
        replaced = new.select(*[F.col(f"`{k}`").alias(f"__k_{k}") for k in s.keys])
        stay = old.join(replaced, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__k_{k}`")) for k in s.keys]), "left_anti")
        checked, errors, report = self.screened(new, t, [c for c in s.columns if c in t.metas], s.checks, stay)
        if s.checks.validate_only:
            return report, errors
        side = checked.toDF(*[f"__s_{c}" for c in checked.columns]).withColumn("__hit", F.lit(True))
        on = None
        for k in s.keys:
            e = F.col(f"`{k}`").eqNullSafe(F.col(f"`__s_{k}`"))
            on = e if on is None else on & e
        matched = old.join(side, on, "left_semi")
        if not matched.groupBy(*[F.col(f"`{k}`") for k in s.keys]).count().where("count > 1").isEmpty():
            raise ArgumentError("a key matches several rows of the table")
        updated = old.join(side, on, "left").select(*[(F.when(F.col("__hit"), F.col(f"`__s_{c}`")).otherwise(F.col(f"`{c}`")) if c in s.columns else F.col(f"`{c}`")).alias(c) for c in old.columns])
        fresh = side.join(old, on, "left_anti").select(*[F.col(f"`__s_{c}`").alias(c) for c in s.columns])
        n_new, n_old = fresh.count(), matched.count()
        self.guard(n_new + n_old)
        t.store.write(updated.unionByName(self.completed(fresh, old.schema, t.metas, old)))
        return report | {"inserted": n_new, "updated": n_old}, errors

    def update(self, s: n.Update) -> tuple[dict, DataFrame | None]:
        if "$" in s.table.strip("$") and s.table.lower() not in self.catalog.tables:
            return self.nested_change(s.table, s.where, s.assignments)
        self.selective(s.where)
        t, old = self.target(s.table)
        types = {f.name: f.dataType for f in old.schema}
        for c, _ in s.assignments:
            if c not in types:
                raise AnalysisError(f"{s.table} has no column {c}")
        scope = self.scope(old, s.table)
        df = old
        if s.source is not None:
            df, scope, where = self._from(old, s)
        else:
            df, rest, more = self.c.subqueries(df, s.where, scope, False)
            scope.done.update(more)
            where = self.c.condition(s.where, scope)
        df = df.withColumn("__hit", F.coalesce(where, F.lit(False)))
        hit = F.col("__hit")
        if s.applies:
            df = self.applied(df, s, t, hit)
        out = []
        for c in old.columns:
            change = dict(s.assignments).get(c)
            own = F.col(f"`{c}`")
            out.append((F.when(hit, converted(canonical(Value(own, types[c], meta=t.metas.get(c, {})), self.c.expression(change, scope)), types[c])).otherwise(own) if change is not None else own).alias(c))
        new = df.select(*out, "__hit")
        touched = new.where("__hit").drop("__hit")
        changed = list(dict(s.assignments))
        stay = new.where("not __hit").drop("__hit")
        good, errors, report = self.screened(touched, t, [c for c in changed if c in t.metas], s.checks, stay)
        if s.checks.validate_only:
            return report, errors
        count = touched.count() - report.get("skipped", 0)
        self.guard(count)
        if s.checks.skip and report.get("skipped"):
            marked = validation.with_errors(new.where("__hit"), [c for c in changed if c in t.metas], t.metas, self.checks(s.checks, self.scope(old, s.table)), rest=stay)
            keys = [c for c in ("$id",) if c in old.columns]
            if not keys:
                raise AnalysisError("ON ERROR SKIP on UPDATE needs $id")
            bad = marked.where(F.size("__errors") > 0).select("`$id`")
            new = new.drop("__hit").join(bad, "$id", "left_anti").unionByName(old.join(bad, "$id", "left_semi"))
            t.store.write(new)
        else:
            t.store.write(new.drop("__hit"))
        return report | {"updated": count}, errors

    def _from(self, old: DataFrame, s: n.Update):
        rel = self.c.relation(s.source)
        alias = s.source.alias or s.source.name
        parts = s.where.parts if isinstance(s.where, n.Logic) and s.where.op == "AND" else (s.where,)
        key, rest = None, []
        for p in parts:
            ends = [x for x in (p.left, p.right) if isinstance(x, n.Col)] if isinstance(p, n.Cmp) and p.op == "=" else []
            own = [x for x in ends if (x.table or s.table).lower() == s.table.lower()]
            theirs = [x for x in ends if (x.table or "").lower() == alias.lower()]
            if key is None and len(own) == 1 and len(theirs) == 1:
                key = own[0], theirs[0]
            else:
                rest.append(p)
        if key is None:
            raise AnalysisError("UPDATE FROM joins by one equality")
        field = Scope(rel.fields).find(key[1])
        if field is None:
            raise AnalysisError(f"unknown column {key[1].name}")
        source = rel.df.where(F.col(field.internal).isNotNull())
        if not source.groupBy(field.internal).count().where("count > 1").isEmpty():
            raise ArgumentError("a key occurs more than once in the source")
        scope = self.scope(old, s.table)
        for f in rel.fields:
            scope.done[n.Col(f.name, alias)] = f.value()
            scope.done.setdefault(n.Col(f.name), f.value())
        own = scope.done[n.Col(key[0].name)]
        df = old.join(source.withColumn("__s", F.lit(True)), own.col.cast("string") == F.col(field.internal).cast("string") if own.type != field.type else own.col == F.col(field.internal), "left")
        where = F.col("__s").isNotNull()
        for p in rest:
            where &= F.coalesce(self.c.condition(p, scope), F.lit(False))
        return df, scope, where

    def delete(self, s: n.Delete) -> tuple[dict, DataFrame | None]:
        if "$" in s.table.strip("$") and s.table.lower() not in self.catalog.tables:
            return self.nested_change(s.table, s.where, None)
        self.selective(s.where)
        t, old = self.target(s.table)
        scope = self.scope(old, s.table)
        df, _, more = self.c.subqueries(old, s.where, scope, False)
        scope.done.update(more)
        gone = F.coalesce(self.c.condition(s.where, scope), F.lit(False))
        count = df.where(gone).count()
        self.guard(count)
        t.store.write(df.where(~gone).select(*[F.col(f"`{c}`") for c in old.columns]))
        return {"deleted": count}, None

    # -------------------------------------------------------- nested rows
    def _nested(self, name: str):
        parent, _, column = name.partition("$")
        t, old = self.target(parent)
        f = next((f for f in old.schema if f.name.lower() == column.lower()), None)
        if f is None:
            raise AnalysisError(f"{parent} has no nested column {column}")
        key = "$id" if "$id" in old.columns else old.columns[0]
        return t, old, f, key

    def _row_scope(self, old: DataFrame, f: T.StructField, key: str, row: Column, i: Column) -> Scope:
        scope = Scope([])
        for x in old.schema:
            scope.done[n.Col(x.name, "_p")] = Value(F.col(f"`{x.name}`"), x.dataType)
        for x in f.dataType.elementType:
            scope.done[n.Col(x.name)] = Value(row[x.name], x.dataType)
            if x.name == "id":
                scope.done[n.Col("_rid")] = Value(row[x.name].cast("string"), T.StringType())
        scope.done[n.Col("_pid")] = Value(F.col(f"`{key}`"), old.schema[key].dataType)
        scope.done[n.Col("_idx")] = Value(i, T.IntegerType())
        return scope

    def _patched(self, old: DataFrame, f: T.StructField, key: str, where: n.Node | None, assignments: tuple):
        changes = dict(assignments)

        def one(row: Column, i: Column) -> Column:
            scope = self._row_scope(old, f, key, row, i)
            new = F.struct(*[(converted(self.c.expression(changes[x.name], scope), x.dataType) if x.name in changes else row[x.name]).alias(x.name) for x in f.dataType.elementType])
            return new if where is None else F.when(F.coalesce(self.c.condition(where, scope), F.lit(False)), new).otherwise(row)

        return F.transform(F.col(f"`{f.name}`"), one)

    def _matching(self, old: DataFrame, f: T.StructField, key: str, where: n.Node | None) -> Column:
        c = F.col(f"`{f.name}`")
        if where is None:
            return F.coalesce(F.size(c), F.lit(0))
        return F.coalesce(F.size(F.filter(c, lambda row, i: F.coalesce(self.c.condition(where, self._row_scope(old, f, key, row, i)), F.lit(False)))), F.lit(0))

    def _without(self, old: DataFrame, f: T.StructField, key: str, where: n.Node | None) -> Column:
        c = F.col(f"`{f.name}`")
        if where is None:
            return F.array().cast(f.dataType)
        return F.filter(c, lambda row, i: ~F.coalesce(self.c.condition(where, self._row_scope(old, f, key, row, i)), F.lit(False)))

    def nested_insert(self, s: n.Insert) -> tuple[dict, DataFrame | None]:
        t, old, f, key = self._nested(s.table)
        child = T.StructType([T.StructField("_pid", old.schema[key].dataType), *f.dataType.elementType])
        new = self.rows(s.table, s.columns, s.rows, s.query, child)
        made = F.struct(*[(F.col(f"`{x.name}`") if x.name in s.columns else F.lit(None).cast(x.dataType)).alias(x.name) for x in f.dataType.elementType])
        added = new.groupBy(F.col("_pid").alias("__pid")).agg(F.collect_list(made).alias("__new"))
        both = old.join(added, F.col(f"`{key}`") == F.col("__pid"), "left")
        none = F.array().cast(f.dataType)
        out = both.select(*[(F.concat(F.coalesce(F.col(f"`{c}`"), none), F.coalesce(F.col("__new").cast(f.dataType), none)) if c == f.name else F.col(f"`{c}`")).alias(c) for c in old.columns])
        count = new.count()
        self.guard(count)
        t.store.write(out)
        return {"inserted": count}, None

    def nested_change(self, name: str, where: n.Node, assignments: tuple | None) -> tuple[dict, DataFrame | None]:
        """UPDATE (assignments) or DELETE (None) of nested rows; needs a condition on _rid."""
        t, old, f, key = self._nested(name)
        if not any(isinstance(x, n.Col) and x.name == "_rid" for x in n.walk(where)):
            raise AnalysisError("changes of nested rows need a condition on _rid")
        count = old.agg(F.sum(self._matching(old, f, key, where))).first()[0] or 0
        self.guard(count)
        new = self._patched(old, f, key, where, assignments) if assignments is not None else self._without(old, f, key, where)
        t.store.write(old.select(*[(new if c == f.name else F.col(f"`{c}`")).alias(c) for c in old.columns]))
        return {"updated" if assignments is not None else "deleted": count}, None

    def applied(self, df: DataFrame, s: n.Update, t, hit: Column) -> DataFrame:
        """APPLY blocks: selectors and values see the rows as they were; appended rows come last."""
        key = "$id" if "$id" in df.columns else df.columns[0]
        for a in s.applies:
            f = next((f for f in df.schema if f.name.lower() == a.column.lower()), None)
            if f is None or not isinstance(f.dataType, T.ArrayType):
                raise AnalysisError(f"{s.table} has no column of rows or values {a.column}")
            c = F.col(f"`{f.name}`")
            none = F.array().cast(f.dataType)
            if not isinstance(f.dataType.elementType, T.StructType):
                out = F.coalesce(c, none)
                for kind, values, *_ in a.operations:
                    given = F.array(*map(F.lit, values)).cast(f.dataType)
                    out = F.array_union(out, given) if kind == "ADD_VALUE" else F.array_except(out, given)
                df = df.withColumn(f.name, F.when(hit, out).otherwise(c))
                continue
            fields = f.dataType.elementType
            drops: list = []
            changes: list[tuple[tuple, n.Node | None]] = []
            appended = none
            for kind, what, extra, expected in a.operations:
                if expected is not None:
                    low, high = expected
                    m = self._matching(df, f, key, extra)
                    if not df.where(hit & ((m < low) | (m > high))).isEmpty():
                        raise ArgumentError(f"{f.name}: not as many rows as expected")
                if kind == "PATCH":
                    changes.append((what, extra))
                elif kind == "REMOVE":
                    drops.append(extra)
                elif kind == "APPEND":
                    rows = [F.struct(*[(converted(self.c.expression(dict(zip(what, r, strict=True))[x.name], Scope([])), x.dataType) if x.name in what else F.lit(None).cast(x.dataType)).alias(x.name) for x in fields]) for r in extra]
                    appended = F.concat(appended, F.array(*rows).cast(f.dataType))
                elif kind == "APPEND_SELECT":
                    if [k for k, *_ in a.operations if k != "APPEND_SELECT"] != ["REMOVE"] or None not in [e for k, _, e, _ in a.operations if k == "REMOVE"]:
                        raise ArgumentError("APPEND SELECT goes with REMOVE ALL ROWS alone")
                    if df.where(hit).count() > 1:
                        raise ArgumentError("APPEND SELECT changes one parent")
                    got = self.rows(s.table, what, None, extra, fields)
                    made = F.struct(*[(F.col(f"`{x.name}`") if x.name in what else F.lit(None).cast(x.dataType)).alias(x.name) for x in fields])
                    df = df.crossJoin(F.broadcast(got.agg(F.collect_list(made).cast(f.dataType).alias("__appended"))))
                    appended = F.col("__appended")

            one = self._changed(df, f, key, changes, drops)
            kept = F.filter(F.transform(F.coalesce(c, none), one), lambda x: x.isNotNull())
            df = df.withColumn(f.name, F.when(hit, F.concat(kept.cast(f.dataType), appended)).otherwise(c)).drop("__appended")
        return df

    def _changed(self, df: DataFrame, f: T.StructField, key: str, changes: list, drops: list):
        """A row as PATCH leaves it, NULL where REMOVE takes it."""
        fields = f.dataType.elementType

        def one(row: Column, i: Column) -> Column:
            scope = self._row_scope(df, f, key, row, i)
            out = {x.name: row[x.name] for x in fields}
            for sets, where in changes:
                p = F.lit(True) if where is None else F.coalesce(self.c.condition(where, scope), F.lit(False))
                for name, value in sets:
                    out[name] = F.when(p, converted(self.c.expression(value, scope), fields[name].dataType)).otherwise(out[name])
            keep = F.lit(True)
            for where in drops:
                keep &= F.lit(False) if where is None else ~F.coalesce(self.c.condition(where, scope), F.lit(False))
            return F.when(keep, F.struct(*[v.alias(k) for k, v in out.items()]))

        return one

    def reorder(self, s: n.Reorder) -> tuple[dict, DataFrame | None]:
        t, old, f, key = self._nested(s.table)
        c = F.col(f"`{f.name}`")

        def order(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for k in reversed(s.keys):
                x, y = (self.c.sort_key(self.c.expression(k.value, self._row_scope(old, f, key, r, F.lit(0)))) for r in (a, b))
                less, more = (F.lit(1), F.lit(-1)) if k.descending else (F.lit(-1), F.lit(1))
                out = F.when(x.eqNullSafe(y), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).otherwise(more)
            return out

        hit = F.lit(True)
        if s.where is not None:
            scope = Scope([])
            for x in old.schema:
                scope.done[n.Col(x.name, "_p")] = Value(F.col(f"`{x.name}`"), x.dataType)
            scope.done[n.Col("_pid")] = Value(F.col(f"`{key}`"), old.schema[key].dataType)
            hit = F.coalesce(self.c.condition(s.where, scope), F.lit(False))
        new = F.when(hit, F.array_sort(c, order)).otherwise(c)
        count = old.where(hit).count()
        t.store.write(old.select(*[(new if x == f.name else F.col(f"`{x}`")).alias(x) for x in old.columns]))
        return {"reordered": count}, None

    def validate(self, s: n.Validate) -> DataFrame:
        t = self.catalog.table(s.table)
        df = self.catalog.read(t)
        scope = self.scope(df, s.table)
        if s.where is not None:
            df = df.where(self.c.condition(s.where, scope))
        fields = list(s.fields) or [c for c in df.columns if c in t.metas]
        marked = validation.with_errors(df, fields, t.metas, self.checks(s.checks, scope))
        return validation.summary(marked, t.name) if s.summary else validation.detail(marked, t.name, "$id" if "$id" in df.columns else None)
