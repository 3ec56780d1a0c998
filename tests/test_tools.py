"""Command line and saved queries."""

import json

import pytest

from quillframe.__main__ import main
from quillframe.errors import AnalysisError
from quillframe.plans.saved import SavedQueries
from quillframe.plans.session import Session


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a"), (2, None)], "id int, s string").coalesce(1).write.parquet(f"{tmp_path}/d/t.parquet")
    sql = "DECLARE @low = 0; SELECT id, s FROM t WHERE id > @low ORDER BY id"
    out = {}
    for f in ("table", "json", "jsonl", "csv", "markdown", "envelope"):
        assert main(["-f", f, "-e", sql, f"{tmp_path}/d"]) == 0
        out[f] = capsys.readouterr().out
    assert out["csv"] == "id,s\r\n1,a\r\n2,\r\n\n" and json.loads(out["json"]) == [{"id": 1, "s": "a"}, {"id": 2}] and "| 1 | a |" in out["markdown"]
    assert [r["kind"] for r in json.loads(out["envelope"])] == ["variable", "rows"] and out["table"].splitlines()[0] == "id  s"
    assert main(["-e", sql, "-v", "low=1", f"{tmp_path}/d"]) == 0
    assert main(["-e", "SELECT nope FROM t", f"{tmp_path}/d"]) == 1


def test_saved_queries(spark, tmp_path):
    q = SavedQueries(f"{tmp_path}/q.json")
    q.save("one", "DECLARE @x = 1; SELECT @x AS x", {"x": 5})
    assert q.run("one", Session(spark))[-1].frame.first()[0] == 5 and q.run("one", Session(spark), {"x": 6})[-1].frame.first()[0] == 6
    q.delete("one")
    with pytest.raises(AnalysisError):
        q.get("one")
