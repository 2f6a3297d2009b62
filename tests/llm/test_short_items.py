from flowgraph.llm import decontaminate


def test_short_items_are_held_as_whole_words(spark):
    texts = ["So: WHO  wrote\nHamlet? He did.", "who wrote hamlets?", "who wrote hamlet", "awho wrote hamlet? 42", "nothing 142", "x42 then 42!", None, "who wrote hamlet??"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "42"), (3, ""), (4, None)], "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.hits(docs, items).collect())
    assert got == [(0, 1, 0, 17, 4), (3, 2, 0, 2, 19), (5, 2, 0, 2, 9), (7, 1, 0, 17, 0)]
    assert sorted(x.doc_id for x in decontaminate.clean(docs, items).collect()) == [1, 2, 4, 6]
