"""Extra columns of documents, named like those that operators add."""

from pyspark.sql import functions as F

import corpus_pipeline
from flowgraph.llm import language_id, queries, sharding

EXTRA = ("n", "d1", "node", "row", "_row", "token", "part", "cell", "rows", "spot", "doc", "tie", "score", "lang_pred", "held_out", "shard", "slot", "_step", "window", "gram", "_id", "_host", "item_id", "spans", "start", "end")


def test_clashing_columns(spark, tmp_path):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, long, "xx", "s", 55), (2, long, "xx", "s", 55), (3, None, None, None, None), (4, "call +1 (988) 555-2485", "xx", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    wide = docs.withColumns({c: F.lit(7) for c in EXTRA})
    wide.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any document here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, d).count() == (0 if name.startswith("op8") else 4), name
    rows = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = stage(spark, rows, d)
        assert rows.columns == wide.columns, k
    assert sorted((x.doc_id, x.text) for x in rows.collect()) == [(1, long), (4, "call [phone]")]
    assert sharding.assign(wide).columns == [c for c in wide.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert language_id.predict(wide, {}).columns[-2:] == ["lang_pred", "score"]
