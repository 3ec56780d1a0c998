"""Every registered query against its SQL at the smallest scale; and what must hold without the optional folders."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillframe import queries

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    rel = oracle.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=order)
    assert got == want


def test_entry_without_optional_folders(tmp_path):
    for f in ("quillframe", "__spark_entry__.py"):
        src = ROOT / f
        if src.is_dir():
            shutil.copytree(src, tmp_path / f, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / f)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(queries.queries())), "False", "False"]


@pytest.mark.parametrize("name", ["arithmetic", "running_range"])
def test_all_of_lineitem(spark, name):
    larger = DATA.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{larger}/lineitem.parquet").count()
    assert queries.queries()[name](spark, larger).count() == rows


def test_reorder_of_every_parent(spark, tmp_path):
    """Keys from zero down are parents like any other."""
    spark.createDataFrame([(k, 7) for k in (-1, 0, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, i, part, float(q)) for k in (-1, 0, 1) for i, part, q in ((1, 30, 5), (2, 20, 9), (3, 10, 5))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in queries.queries()["reorder_lines"](spark, str(tmp_path)).select("pid", "idx", "partkey", "quantity").collect())
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["reorder_lines"]).fetchall())
    assert got == want == [(k, *row) for k in (-1, 0, 1) for row in ((0, 20, 9.0), (1, 10, 5.0), (2, 30, 5.0))]
