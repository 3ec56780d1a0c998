"""Constraints as columns: what is wrong with a row, as an array of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ERROR = "array<struct<field:string,code:string,message:string,value:string,subtable:string,subrow:int,subrow_id:string>>"


def problem(when: Column, field: str, code: str, message: str | Column, value: Column, subtable: Column | None = None, subrow: Column | None = None, subrow_id: Column | None = None) -> Column:
    made = F.struct(
        F.lit(field).alias("field"), F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).cast("string").alias("message"), value.cast("string").alias("value"),
        (subtable if subtable is not None else F.lit(None)).cast("string").alias("subtable"), (subrow if subrow is not None else F.lit(None)).cast("int").alias("subrow"), (subrow_id if subrow_id is not None else F.lit(None)).cast("string").alias("subrow_id"),
    )
    return F.when(when, F.array(made)).otherwise(F.array().cast(ERROR))


def field_problems(name: str, c: Column, t: T.DataType, meta: dict, **place) -> list[Column]:
    """required, minimum, maximum, maxLength, minLength, options; minimum and maximum of numbers."""
    out = []
    several = isinstance(t, T.ArrayType)
    empty = c.isNull() | (F.size(c) == 0) if several else c.isNull() | (c.cast("string") == "")
    shown = F.array_join(c.cast("array<string>"), ",") if several and not isinstance(t.elementType, T.StructType) else c
    if meta.get("required"):
        out.append(problem(empty, name, "ERR_REQUIRED", f"{name} is required", F.lit(None), **place))
    if meta.get("min") is not None:
        out.append(problem(c.cast("double") < float(meta["min"]), name, "ERR_RANGE_MIN", f"{name} is below {meta['min']}", c, **place))
    if meta.get("max") is not None:
        out.append(problem(c.cast("double") > float(meta["max"]), name, "ERR_RANGE_MAX", f"{name} is above {meta['max']}", c, **place))
    if meta.get("maxLength") is not None:
        out.append(problem(F.length(c) > int(meta["maxLength"]), name, "ERR_LENGTH_MAX", f"{name} is longer than {meta['maxLength']}", c, **place))
    if meta.get("minLength") is not None:
        out.append(problem(~empty & (F.length(c) < int(meta["minLength"])), name, "ERR_LENGTH_MIN", f"{name} is shorter than {meta['minLength']}", c, **place))
    if meta.get("optionOrder"):
        known = F.array(*map(F.lit, meta["optionOrder"]))
        bad = F.size(F.array_except(c, known)) > 0 if several else ~empty & ~F.array_contains(known, c)
        out.append(problem(bad, name, "ERR_CHOICE_INVALID", f"{name} has an unknown option", shown, **place))
    return out


def with_errors(df: DataFrame, fields: list[str], metas: dict[str, dict], extra: list[Column] = (), key: str | None = None, rest: DataFrame | None = None) -> DataFrame:
    """df and a column ``__errors``; rest: the rows of the table that stay beside df, for ``unique``."""
    parts = list(extra)
    types = {f.name: f.dataType for f in df.schema}
    for f in fields:
        meta, t = metas.get(f, {}), types[f]
        c = F.col(f"`{f}`")
        parts += field_problems(f, c, t, meta)
        if meta.get("unique"):
            # empty cells may repeat, so they are left out; only values that occur several times travel to the join
            values = df.select(c.alias("__v")).where("__v is not null")
            if rest is not None:
                values = values.unionByName(rest.select(c.alias("__v")).where("__v is not null"))
            several = values.groupBy("__v").count().where("count > 1").select(F.col("__v").alias(f"__n_{f}"))
            df = df.join(several, c == F.col(f"`__n_{f}`"), "left")
            parts.append(problem(F.col(f"`__n_{f}`").isNotNull(), f, "ERR_DUPLICATE", f"{f} occurs more than once", c))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and meta.get("children"):
            has_id = any(x.name == "id" for x in t.elementType)

            def inner(row: Column, i: Column, f=f, t=t, meta=meta, has_id=has_id) -> Column:
                found = [p for child in t.elementType if child.name in meta["children"] for p in field_problems(child.name, row[child.name], child.dataType, meta["children"][child.name], subtable=F.lit(f), subrow=i, subrow_id=row["id"] if has_id else None)]
                return F.concat(*found) if found else F.array().cast(ERROR)

            parts.append(F.coalesce(F.flatten(F.transform(c, inner)), F.array().cast(ERROR)))
    out = df.withColumn("__errors", F.concat(*parts) if parts else F.array().cast(ERROR))
    return out.drop(*[c for c in out.columns if c.startswith("__n_")])


def detail(df: DataFrame, table: str, key: str | None) -> DataFrame:
    """A row for each error."""
    rows = df.select((F.col(f"`{key}`") if key else F.lit(None)).cast("string").alias("$id"), F.explode("__errors").alias("e"))
    return rows.select("$id", F.lit(table).alias("$err_table"), *[F.col(f"e.{c}").alias(f"$err_{c}") for c in ("field", "code", "message", "value", "subtable", "subrow", "subrow_id")])


def summary(df: DataFrame, table: str) -> DataFrame:
    return detail(df, table, None).groupBy("$err_table", "$err_subtable", "$err_field", "$err_code").agg(F.count(F.lit(1)).alias("$err_count"))
