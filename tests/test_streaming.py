"""A compiled statement over a streaming source."""

from quillframe.plans.session import Session
from quillframe.sources.catalog import Catalog


def test_statement_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "click", 2.0), (2, "view", None), (3, "click", 5.0)], "id long, kind string, value double").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("click", "Click")], "kind string, label string").write.parquet(f"{tmp_path}/names")
    c = Catalog(spark)
    c.add("events", spark.readStream.schema("id long, kind string, value double").parquet(f"{tmp_path}/in"))
    c.add("names", f"{tmp_path}/names")
    df = Session(spark, c).sql("SELECT e.id, n.label, e.value * 2 AS twice FROM events AS e INNER JOIN names AS n ON e.kind = n.kind WHERE e.value < 4")
    df.writeStream.format("memory").queryName("out").trigger(availableNow=True).start().awaitTermination(60)
    assert [tuple(r) for r in spark.table("out").collect()] == [(1, "Click", 4.0)]
