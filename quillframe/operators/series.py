"""GENERATE_SERIES: integers, or dates by day, month or year; the stop is included."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.errors import ArgumentError


def series(spark: SparkSession, start, stop, step, column: str) -> DataFrame:
    if isinstance(start, int) and isinstance(stop, int):
        by = 1 if step is None else step
        if not isinstance(by, int) or by == 0:
            raise ArgumentError("the step must be an integer other than 0")
        return spark.range(start, stop + (1 if by > 0 else -1), by).toDF(column)
    m = re.fullmatch(r"\s*([+-]?\d+)\s*(day|month|year)s?\s*", "1 day" if step is None else str(step), re.I)
    if not m or int(m[1]) == 0:
        raise ArgumentError(f"unknown step {step!r}")
    try:
        a, b = date.fromisoformat(str(start)[:10]), date.fromisoformat(str(stop)[:10])
    except ValueError as e:
        raise ArgumentError(f"dates are YYYY-MM-DD: {e}") from e
    n, unit = int(m[1]), m[2].lower()
    if (unit == "month" and a.day != 1) or (unit == "year" and (a.month, a.day) != (1, 1)):
        raise ArgumentError(f"a series by {unit} begins on the first of a {unit}")
    if unit == "day":
        count = (b - a).days // n if n > 0 else (a - b).days // -n
        count = count if (b >= a) == (n > 0) or a == b else -1
        return spark.range(0, count + 1).select(F.date_add(F.lit(a), (F.col("id") * n).cast("int")).alias(column))
    months = n * (12 if unit == "year" else 1)
    apart = (b.year - a.year) * 12 + b.month - a.month
    count = apart // months if (apart >= 0) == (months > 0) or apart == 0 else -1
    if months < 0 and count >= 0:  # the stop may lie behind the first of its month
        while count >= 0 and _moved(a, months * count) < b:
            count -= 1
    return spark.range(0, count + 1).select(F.add_months(F.lit(a), (F.col("id") * months).cast("int")).alias(column))


def _moved(d: date, months: int) -> date:
    m = d.year * 12 + d.month - 1 + months
    return date(m // 12, m % 12 + 1, d.day)
