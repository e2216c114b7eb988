"""Queries read whole tables and whole texts, and no group is gathered."""

from types import SimpleNamespace

from shelfmark.functions.media import perceptual_hash


def test_tiles_cover_whole_texts(spark):
    from shelfmark.operators.scalars import tile_hashes

    texts = {1: "a" * 768 + "same start, other end", 2: "a" * 768 + "x" * 1000, 3: "", 4: None, 5: "b" * 768}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["tile"]): r["phash"] for r in tile_hashes(SimpleNamespace(documents=docs)).collect()}
    want = {(d, k // 768): None if t is None else perceptual_hash(t.encode()[k : k + 768], 16) for d, t in texts.items() for k in range(0, max(len(t or ""), 1), 768)}
    assert got == want and len(got) == 8


def test_every_video_is_aligned(spark, sf):
    from shelfmark.operators.sequences import alignments, demo_videos
    from shelfmark.sources.catalog import Catalog

    c = Catalog(spark, sf)
    ids = {r["id"] for r in demo_videos(c)[1].select("id").distinct().collect()}
    got = {(r["a"], r["b"]) for r in alignments(c).select("a", "b").collect()}
    assert {x for pair in got for x in pair} == ids
    assert got == {(a, b) for a in ids for b in range(a + 1, a // 4 * 4 + 3) if b in ids}


def gathers(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("collect_list", "FlatMapGroupsInArrow", "row_number") if x in plan]


def test_no_group_is_gathered(spark, sf):
    from shelfmark.operators import vectors as V
    from shelfmark.operators.mutations import folded, observations
    from shelfmark.operators.relational import ordinals, stable_sort
    from shelfmark.operators.scalars import weighted_means
    from shelfmark.sources.catalog import Catalog

    c = Catalog(spark, sf)
    for df in (V.label_centroids(c), weighted_means(c), V.greedy(c), folded(observations(c)), V.clusters(V.dbscan_labels(c)).filter("place > 0"), ordinals(c).filter("ord > 0"), stable_sort(c).filter("place > 0")):
        assert not gathers(df)


def test_states_pass_from_batch_to_batch(spark, sf):
    from shelfmark.operators.mutations import FOLD_COLUMNS, FOLD_KEYS, fold, folded, observations
    from shelfmark.sources.catalog import Catalog

    rows = observations(Catalog(spark, sf))
    states = {}
    for r in sorted((x.asDict() for x in rows.collect()), key=lambda x: x["seq"]):
        key = tuple(r[k] for k in FOLD_KEYS)
        states[key] = fold(states.get(key), {k: r[k] for k in FOLD_COLUMNS})
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [x.asDict() for x in folded(rows).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert len(got) == len(states)
    assert all({k: v for k, v in r.items() if k not in FOLD_KEYS} == states[tuple(r[k] for k in FOLD_KEYS)] for r in got)


def test_unfinished_components_are_no_result(spark):
    import pytest

    from shelfmark.operators.graph import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=2)
    assert {r["component"] for r in components(chain).collect()} == {0}
