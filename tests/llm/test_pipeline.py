"""The pipeline's stages on a small corpus, each held against a plain version on its own input."""

import random

import corpus_pipeline
from quillframe.llm.common import store
from test_operators import brute_components, brute_leaks, brute_words


def test_stages(spark, tmp_path):
    dice = random.Random(4)
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 8))) for _ in range(2000)]
    text = lambda k: " ".join(dice.choice(words) for _ in range(k)) + "."
    passage, leak = text(60), text(30)
    rows = []
    for i in range(200):
        t = text(dice.randint(60, 120))
        if i % 10 == 0:
            t = t.upper().replace(" ", "!! ")
        elif i % 10 == 1:
            t = f"{t}\n{passage}\nend {i}"
        elif i % 10 == 2:
            t = f"{t} {leak}"
        elif i % 10 == 3 and i > 10:
            t = rows[4][1] + (" tail" if i % 20 == 3 else "")
        rows.append((i, t, "en", "s", len(t)))
    rows += [(500, None, "en", "s", None), (501, "", None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as spans", "'x' as items", "1.5 as score", "2 as part").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, text(20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = store(stage(spark, docs, d), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert set(kept[name]) == {w["component_id"] for w in brute_components(before).values()}
        if name == "repeated_passages":
            want = brute_words(before)
            assert {i: len((r.text or "").split()) for i, r in kept[name].items()} == {i: w["n_words"] - w["n_removed"] for i, w in want.items()}
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in kept[name].values())
        if name == "benchmark":
            want = brute_leaks(before, [(1, leak)])
            assert set(kept[name]) == {i for i, w in want.items() if not w["contaminated"]}
    assert not {i for i in range(0, 200, 10)} & set(kept["quality"]) and len(kept["quality"]) >= 178
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(kept["encode"])


def test_no_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
