"""Every label is taught, and no document takes the words of the others."""

from shelfmark.llm import language as L


def test_quotas():
    assert L.quotas({"a": 10_000, "b": 3, "c": 500}, 300) == {"b": 3, "c": 148, "a": 149}
    assert L.quotas({"a": 9, "b": 9, "c": 9}, 2) == {"a": 1, "b": 1, "c": 1}


def test_rare_labels_and_long_texts(spark):
    rows = [(i, "the whing " * 30, "en") for i in range(3000)] + [(5000 + i, "quéado ción " * 30, "es") for i in range(4)]
    rows += [(9000 + i, "the whing " * 40_000, "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["text"], r["label"]) for r in L.sampled(df, "doc_id", "text", "lang", 200, 4000).collect()]
    assert {label for _, label in got} == {"en", "es"} and len(got) == 200
    assert all(1 <= len(text.split()) <= 20 for text, _ in got)
    model = L.fit(df, sample=200, words=4000)
    assert model.labels == ["en", "es"] and L.label_texts(model, ["ción quéado quéado"])[0] == ["es"]


def test_texts_in_no_learned_language(spark):
    """A score under the threshold goes; where nothing is learned, rows with letters stay as they are."""
    rows = [(i, w * 30, l) for i in range(200) for w, l in [("the whing is ", "en"), ("quéado ción es ", "es")]]
    model = L.train([(t, l) for _, t, l in rows])
    docs = spark.createDataFrame([(1, "the whing is", "xx"), (2, "ción quéado", None), (3, None, "en"), (4, "12 | 3", "en")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, L.keep_known(docs, model).collect())) == [(1, "the whing is", "en"), (2, "ción quéado", "es")]
    assert L.keep_known(docs, model, least=1.01).count() == 0
    assert sorted(r["doc_id"] for r in L.keep_known(docs, None).collect()) == [1, 2]
    assert L.fit(docs.filter("lang IS NULL")) is None
