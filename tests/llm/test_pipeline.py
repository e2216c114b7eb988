import re

import corpus_pipeline


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "PII", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 | 34", "en", "s", 7), (90003, "Write to someone@example.org at once, the thing is near", "en", "s", 54)], docs.schema)
    docs, columns = docs.union(extra), docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.common.keep(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "language ID":
            assert set(before) - set(after) == {90001, 90002} and all(before[d] == t for d, t in after.items())
        elif name == "exact dedup":
            norm = {}
            for d, t in sorted(before.items()):
                norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert set(after) == set(norm.values())
        elif name == "PII":
            assert set(after) == set(before) and after[90003] == "Write to [EMAIL] at once, the thing is near"
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after) and len(whole) > len(after)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.keep(stage(spark, docs, sf), "none")
    assert docs.count() == 0
