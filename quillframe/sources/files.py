"""CSV and JSON files in and out."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from datetime import UTC, date, datetime
from decimal import Decimal
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillframe.errors import ArgumentError
from quillframe.shipping import ship

ENCODINGS = {"UTF8": "UTF-8", "UTF-8": "UTF-8", "SJIS": "Shift_JIS", "SHIFT_JIS": "Shift_JIS"}


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF8", header: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """RFC 4180, every cell text, '' read as NULL.  Duplicate headers and rows of another length are errors."""
    if encoding not in ENCODINGS:
        raise ArgumentError(f"unknown encoding {encoding}")
    if ENCODINGS[encoding] != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", ENCODINGS[encoding]).option("mode", "FAILFAST").option("enforceSchema", "false").option("nullValue", "")
    names = list(columns)
    if header:
        first = reader.option("header", False).csv(path).limit(1).collect()
        names = [str(v).lstrip("\ufeff") for v in first[0]] if first else []
        if len(set(names)) < len(names):
            raise ArgumentError("a header occurs twice")
    elif not names:
        names = [f"_{k + 1}" for k in range(len(reader.option("header", False).csv(path).columns))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return reader.option("header", header).schema(schema).csv(path)


def _strict(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key occurs twice")
    return out


def read_json(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Objects, one a line or in arrays; numbers keep their digits, nested values stay JSON text, duplicate keys at any level are errors."""
    names = list(columns)
    ship(spark)

    def parse(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if text and text.strip():
                    v = json.loads(text, object_pairs_hook=_strict, parse_float=str, parse_int=str)
                    rows += v if isinstance(v, list) else [v]
            cells = {c: [None if (x := r.get(c)) is None or x == "" else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for r in rows] for c in names}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string()) for c, v in cells.items()})

    head = spark.read.text(path).limit(1).collect()
    whole = bool(head) and head[0][0].lstrip("\ufeff").strip().startswith("[")
    return spark.read.option("wholetext", whole).text(path).mapInArrow(parse, ", ".join(f"`{c}` string" for c in names))


def cell(v: object, zone: str | None = None) -> str:
    """A value as text: arrays by lines, codes of users, decimals without exponent, UTC or local times."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else format(Decimal(repr(v)), "f")
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, datetime):
        v = v if v.tzinfo else v.replace(tzinfo=UTC)
        return v.astimezone(ZoneInfo(zone)).isoformat() if zone else v.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, list):
        return "\n".join(cell(x, zone) for x in v)
    if hasattr(v, "asDict"):
        d = v.asDict()
        return cell(d.get("code"), zone)
    return str(v)


def csv_lines(df: DataFrame, zone: str | None = None) -> Iterator[str]:
    """Header and rows, streamed partition by partition; CRLF, quotes only where needed."""
    if len(set(df.columns)) < len(df.columns):
        raise ArgumentError("a header occurs twice")
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and "code" not in f.dataType.elementType.names:
            raise ArgumentError(f"{f.name} holds rows: select from the virtual table")
    buffer = io.StringIO()
    out = csv.writer(buffer, lineterminator="\r\n")

    def line(values) -> str:
        out.writerow(values)
        text = buffer.getvalue()
        buffer.seek(0), buffer.truncate()
        return text

    yield line(df.columns)
    for row in df.toLocalIterator():
        yield line([cell(v, zone) for v in row])


def write_csv(df: DataFrame, path: str, encoding: str = "UTF8", zone: str | None = None) -> int:
    """One file, written beside and renamed; characters the encoding lacks are an error."""
    import os

    data = 0
    with open(f"{path}.part", "wb") as f:
        for text in csv_lines(df, zone):
            raw = text.encode(ENCODINGS[encoding])
            data += len(raw)
            f.write(raw)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)
    return data


def write_csv_files(df: DataFrame, path: str) -> None:
    """In bulk: a file for each partition."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    df.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), "\n").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)


def markdown(df: DataFrame) -> str:
    rows = [[cell(v) for v in r] for r in df.toLocalIterator()]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(v.replace("|", "\\|").replace("\n", "<br>") for v in r) + " |" for r in rows])


def jsonl(df: DataFrame) -> Iterator[str]:
    yield from df.toJSON().toLocalIterator()
