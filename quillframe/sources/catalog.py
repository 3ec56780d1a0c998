"""Names to tables: Parquet paths, DataFrames, nested columns, profiles and logical names.

A name is looked up without regard to case.  ``NAME$column`` is the virtual table of a
nested column: a row for each element, with ``_pid``, ``_rid``, ``_idx`` and the parent's
columns under ``_p.``; parents without elements give no row.  ``NAME@profile`` names a
table of a profile; a logical name stands for another name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillframe.errors import AnalysisError
from quillframe.plans import nodes as n


@dataclass
class Table:
    name: str
    load: Callable[[], DataFrame]
    metas: dict[str, dict] = field(default_factory=dict)  # column -> fieldType, optionOrder, required, unique, min, max, maxLength, default, label
    store: object | None = None  # of tables that can be written
    description: str = ""


class Catalog:
    def __init__(self, spark: SparkSession, empty_strings: bool = False):
        """empty_strings: sources hold '' for empty cells; make them NULL on reading."""
        self.spark, self.empty_strings = spark, empty_strings
        self.tables: dict[str, Table] = {}
        self.logical: dict[str, str] = {}
        self.temps: dict[str, DataFrame] = {}

    def add(self, name: str, source: str | DataFrame | Callable[[], DataFrame], metas: dict | None = None, store: object | None = None, description: str = "") -> Table:
        if isinstance(source, str):
            load = lambda: self.spark.read.parquet(source)
        else:
            load = (lambda: source) if isinstance(source, DataFrame) else source
        t = self.tables[name.lower()] = Table(name, load, metas or {}, store, description)
        return t

    def alias(self, logical: str, name: str) -> None:
        self.logical[logical.lower()] = name

    def table(self, name: str) -> Table:
        key = self.logical.get(name.lower(), name).lower()
        if key not in self.tables:
            raise AnalysisError(f"unknown table {name}")
        return self.tables[key]

    def __call__(self, name: str) -> tuple[DataFrame, dict, set]:
        if name.startswith("#"):
            if name.lower() not in self.temps:
                raise AnalysisError(f"unknown temporary table {name}")
            return self.temps[name.lower()], {}, set()
        key = self.logical.get(name.lower(), name)
        parent, dollar, column = key.partition("$")
        if dollar and column and key.lower() not in self.tables:
            return self.nested(parent, column)
        t = self.table(key)
        return self.read(t), t.metas, set()

    def read(self, t: Table) -> DataFrame:
        df = t.load()
        if not self.empty_strings:
            return df
        return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])

    def nested(self, parent: str, column: str) -> tuple[DataFrame, dict, set]:
        t = self.table(parent)
        df = self.read(t)
        match = next((f for f in df.schema if f.name.lower() == column.lower()), None)
        if match is None or not isinstance(match.dataType, T.ArrayType) or not isinstance(match.dataType.elementType, T.StructType):
            raise AnalysisError(f"{parent} has no nested column {column}")
        keys = [f.name for f in df.schema if f.name in ("$id", "_pid", "id")] or [df.columns[0]]
        rest = [c for c in df.columns if c != match.name]
        child = [f.name for f in match.dataType.elementType if f.name != "id"]
        has_id = any(f.name == "id" for f in match.dataType.elementType)
        rows = df.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(F.col(f"`{match.name}`")).alias("_idx", "__row"))
        out = rows.select(
            F.col(f"`{keys[0]}`").alias("_pid"),
            (F.col("__row.id").cast("string") if has_id else F.lit(None).cast("string")).alias("_rid"),
            F.col("_idx"),
            *[F.col("__row").getField(c).alias(c) for c in child],
            *[F.col(f"`{c}`").alias(f"_p.{c}") for c in rest],
        )
        return out, t.metas.get(match.name, {}).get("children", {}), {f"_p.{c}" for c in rest}

    def describe(self, q: n.Node) -> DataFrame:
        if isinstance(q, n.ShowTables):
            rows = [(t.name, t.name, t.description) for t in self.tables.values()]
            return self.spark.createDataFrame(rows, "id string, name string, description string")
        t = self.table(q.table)
        yes = lambda v: "YES" if v else ""
        rows = []
        for f in t.load().schema:
            m = dict(f.metadata) | t.metas.get(f.name, {})
            nested = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
            rows.append((f.name, m.get("label", f.name), m.get("fieldType", f.dataType.simpleString()), "", yes(m.get("lookup")), yes(m.get("copied")), yes(m.get("unique")), yes(m.get("calc"))))
            if nested:
                rows += [(c.name, c.name, c.dataType.simpleString(), f.name, "", "", "", "") for c in f.dataType.elementType]
        return self.spark.createDataFrame(rows, "code string, label string, type string, subtable string, lookup string, copied string, unique string, calc string")
