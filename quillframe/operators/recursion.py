"""Recursive queries with path-scoped cycle marks.

Level by level: the frontier is stored in the shared folder, so its lineage does not grow
with the depth.  Depth, rows and expansions can be limited; only the depth is by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillframe.errors import LimitError
from quillframe.sources.storage import materialize

DEPTH = 100


def recurse(seed: DataFrame, step: Callable[[DataFrame], DataFrame], cycle: tuple | None, limits: dict) -> DataFrame:
    """seed and all that step makes of each level.  cycle: (column, mark, yes, no): a row whose value its own path has is given once with the mark and not followed."""
    names = seed.columns
    depth, rows = 0, 0
    if cycle:
        column, mark, yes, no = cycle
        column = next(c for c in names if c.lower() == column.lower())
        seed = seed.withColumn("__path", F.array(F.col(f"`{column}`"))).withColumn(mark.lower(), F.lit(no))
    out: list[DataFrame] = []
    level = materialize(seed, "recursion")
    while not level.isEmpty():
        out.append(level)
        if limits.get("recursion_rows"):
            rows += level.count()
            if rows > limits["recursion_rows"]:
                raise LimitError(f"more than {limits['recursion_rows']} rows")
        depth += 1
        if depth > limits.get("recursion_depth", DEPTH):
            raise LimitError(f"recursion deeper than {limits.get('recursion_depth', DEPTH)}")
        follow = level.where(F.col(mark.lower()) == no).drop(mark.lower()) if cycle else level
        new = step(follow)
        new = new.toDF(*names, *(["__path"] if cycle else []))
        types = {f.name: f.dataType for f in level.schema}
        new = new.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in new.columns])
        if cycle:
            again = F.array_contains("__path", F.col(f"`{column}`"))
            new = new.withColumn(mark.lower(), F.when(again, yes).otherwise(no)).withColumn("__path", F.array_append("__path", F.col(f"`{column}`")))
        level = materialize(new, "recursion")
    result = out[0] if out else level
    for x in out[1:]:
        result = result.unionByName(x)
    return result.drop("__path") if cycle else result
