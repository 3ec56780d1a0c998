"""Typed column expressions and the conversions between kinds of values.

An empty cell is NULL.  Strings that come out empty are made NULL again by ``filled``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    literal: Any = None  # of a literal: its Python value
    is_literal: bool = False
    meta: dict = field(default_factory=dict, compare=False)

    @property
    def kind(self) -> str:
        return kind_of(self.type)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "ts"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "array"
    return "struct" if isinstance(t, T.StructType) else "null"


STRING, LONG, INT, DOUBLE, DATE, STAMP = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.TimestampType()


def literal(v: Any) -> Value:
    if v is None or v == "":
        return Value(F.lit(None).cast("string"), STRING, "", True)
    if isinstance(v, bool):
        return Value(F.lit(v), T.BooleanType(), v, True)
    if isinstance(v, int) and not -(1 << 63) <= v < 1 << 63:
        v = float(v)
    if isinstance(v, int):
        big = not -(1 << 31) <= v < 1 << 31
        return Value(F.lit(v).cast("bigint" if big else "int"), LONG if big else INT, v, True)
    if isinstance(v, float):
        return Value(F.lit(v), DOUBLE, v, True)
    if isinstance(v, tuple | list):
        return Value(F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>"), T.ArrayType(STRING), tuple(v), True)
    return Value(F.lit(str(v)), STRING, str(v), True)


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def num_to_text(c: Column, t: T.DataType) -> Column:
    """Plain digits from 1e-6 up to 1e21, beyond that 1.5e+21 and 1e-7."""
    if isinstance(t, T.DoubleType | T.FloatType):
        size = F.abs(c)
        plain = F.when(size < 1e-3, c.cast("decimal(38,25)")).otherwise(c.cast("decimal(38,14)")).cast("string")
        short = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), r"E(?=\d)", "e+"), "E-", "e-")
        return (
            F.when((size < 1e15) & (F.floor(c) == c), c.cast("bigint").cast("string"))
            .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
            .when((size >= 1e15) & (size < 1e21), c.cast("decimal(38,0)").cast("string"))
            .when((size >= 1e-6) & (size < 1e15), F.regexp_replace(plain, r"\.?0+$", ""))
            .otherwise(short)
        )
    if isinstance(t, T.DecimalType):
        return F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$|\.$", "$1").cast("string")
    return c.cast("string")


def text(v: Value) -> Column:
    """As text, NULL where empty."""
    if v.kind == "str":
        return v.col
    if v.kind == "num":
        return num_to_text(v.col, v.type)
    if v.kind == "ts":
        return F.date_format(utc(v), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if v.kind == "array":
        return filled(F.array_join(v.col.cast("array<string>"), ","))
    return v.col.cast("string")


def utc(v: Value) -> Column:
    """A timestamp whose fields, in the session's zone, are those in UTC."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return v.col if isinstance(v.type, T.TimestampNTZType) or zone in ("UTC", "Etc/UTC", "GMT", "Z") else F.to_utc_timestamp(v.col, zone)


def whole_text(v: Value) -> Column:
    """As text, '' where empty."""
    return F.coalesce(text(v), F.lit(""))


def maybe_number(v: Value) -> Column:
    """As a number, NULL where empty, NaN where it is none."""
    if v.is_literal and v.literal == "":
        return F.lit(None).cast("double")
    if v.kind == "num":
        return v.col
    t = text(v)
    return F.when(t.isNotNull() & (t != ""), F.coalesce(t.try_cast("double"), F.lit(float("nan"))))


def number(v: Value) -> Column:
    """As a number, 0 where empty."""
    if v.is_literal and v.kind == "num":
        return v.col
    return F.coalesce(maybe_number(v), F.lit(0))


def number_type(v: Value) -> T.DataType:
    return v.type if v.kind == "num" else DOUBLE


def date(v: Value) -> Column:
    if v.kind == "date":
        return v.col
    if v.kind == "ts":
        return utc(v).cast("date")
    return F.substring(text(v), 1, 10).try_cast("date")


def stamp(v: Value) -> Column:
    if v.kind in ("date", "ts"):
        return v.col.cast("timestamp")
    return text(v).try_cast("timestamp")
