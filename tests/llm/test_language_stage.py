from flowgraph.llm import language_id


def test_stage_drops_texts_without_a_known_gram(spark):
    texts = ["kalo mi nu", "\u6f22\u5b57 \u6f22", "123", None, "\u0436\u0443\u043a k"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    ranked = language_id.learn(docs.where("doc_id = 0"))
    assert sorted(x.doc_id for x in language_id.recognised(docs, ranked).collect()) == [0, 4]
    assert [x.lang_pred for x in language_id.predict(docs, ranked).orderBy("doc_id").collect()] == ["en", "en", "und", "und", "en"]
