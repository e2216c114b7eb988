import pytest
from pyspark.sql import functions as F

from shelfmark.operators import mutations as X
from shelfmark.sources.catalog import Catalog
from shelfmark.streaming import feed, ingest


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = X.observations(Catalog(spark, sf))
    for part in rows.filter("seq < 300").randomSplit([1.0, 1.0, 1.0], 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), rows.schema)
    states = ingest.drained(ingest.folded_stream(stream), "test", "update")
    last = X.latest(states, list(X.FOLD_KEYS), ["batch"])
    assert states.agg(F.max("batch")).first()[0] >= 2
    newest = {(r["group_id"], r["message_id"]): r["v"] for r in rows.filter("seq < 300").groupBy("group_id", "message_id").agg(F.max("version").alias("v")).collect()}
    assert {(r["group_id"], r["message_id"]): r["version"] for r in last.collect()} == newest


def test_rate_window_starts_with_its_first_request():
    held, seen = None, []
    for at in (0, 10, 20, 99, 100, 150, 201):
        held, fine = ingest.admitted(held, at, 2, 100)
        seen.append(fine)
    assert seen == [True, True, False, False, True, True, True]


def change(key, revision, kind="upsert", payload="p"):
    return (key, revision, kind, payload)


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, revision long, kind string, payload string")


def test_feed_pages_lose_nothing(spark):
    log = frame(spark, [change(i % 7, i, "delete" if i % 5 == 0 else "upsert", "x" * 40) for i in range(1, 60)])
    whole = feed.compacted(log)
    after, seen = 0, []
    while rows := sorted(feed.feed_page(whole, after, 3, 100).collect(), key=lambda r: r["revision"]):
        assert len(rows) <= 2
        seen += [r["revision"] for r in rows]
        after = seen[-1]
    assert seen == sorted(r["revision"] for r in whole.collect())


def test_an_oversized_change_still_comes(spark):
    assert feed.feed_page(frame(spark, [change(1, 1, payload="x" * 999)]), 0, 5, 10).count() == 1


def test_apply_is_idempotent_and_resets(spark):
    table = spark.createDataFrame([(1, 3, "old"), (2, 4, "old")], "key long, revision long, payload string")
    page = frame(spark, [change(1, 5, "delete"), change(3, 6, payload="new")])
    once = feed.applied(table, page, False)
    assert sorted(tuple(r) for r in once.collect()) == [(2, 4, "old"), (3, 6, "new")]
    assert sorted(tuple(r) for r in feed.applied(once, page.filter("kind = 'upsert'"), False).collect()) == [(2, 4, "old"), (3, 6, "new")]
    assert [tuple(r) for r in feed.applied(table, page, True).collect()] == [(3, 6, "new")]


def test_pages_are_checked(spark):
    page = frame(spark, [change(1, 5), change(2, 7)])
    cursor = feed.Cursor("e", 4)
    assert feed.checked(page, cursor, "e", 4, 7) is False
    assert feed.checked(page, cursor, "f", 0, 7) is True
    for first, last in ((3, 7), (4, 9), (4, 3)):
        with pytest.raises(ValueError):
            feed.checked(page, cursor, "e", first, last)
    with pytest.raises(ValueError):
        feed.checked(frame(spark, [change(1, 5), change(1, 7)]), cursor, "e", 4, 7)


def test_claims_go_by_lane(spark):
    rows = [(1, "pending", 0, "a", 0, 0, "history"), (2, "pending", 0, "a", 0, 0, "live"), (3, "pending", 0, "a", 0, 30, "history"), (4, "pending", 1, "a", 0, 0, "url"), (5, "pending", 0, "b", 0, 0, "url"), (6, "pending", 0, "a", 99, 0, "url")]
    work = spark.createDataFrame(rows, "id long, status string, paused int, account_id string, retry_at long, ttl_seconds int, origin string")
    assert [r["id"] for r in feed.claimed(work, ["a"], 50, 10).collect()] == [3, 2, 1]
    assert [r["id"] for r in feed.claimed(work, ["a"], 50, 10, manual_only=True).collect()] == [3, 1]


def test_account_order_in_streams_and_folders_without_files(spark, tmp_path):
    spec = "group_id string, message_id long, account_id string, version long, source_pts long, identity string, origin string, ttl_seconds long, comparable boolean, seq long"
    (tmp_path / "none").mkdir()
    empty = ingest.source(spark, str(tmp_path / "none"), spark.createDataFrame([], spec).schema)
    assert ingest.drained(ingest.folded_stream(empty), "nothing", "update").count() == 0
    for k, (account, pts, identity) in enumerate([("a", 1, "x"), ("b", 2, "y")]):
        spark.createDataFrame([(g, 1, account, 5, pts, identity, "live", 0, g == "c", k) for g in "cu"], spec).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), spark.createDataFrame([], spec).schema, files_per_trigger=9)
    got = ingest.latest(ingest.drained(ingest.folded_stream(stream), "accounts", "update"), ["group_id", "message_id"], ["batch"])
    assert {r["group_id"]: r["identity"] for r in got.collect()} == {"c": "y", "u": "x"}


def test_rows_wait_in_the_store(spark, tmp_path):
    """More rows of a key than a task sorts: the same results, in the same order."""
    import random

    rows = [("c", at, seq) for seq, at in enumerate(random.Random(2).sample(range(1000), 90))] + [("d", 5, 900)]
    spark.createDataFrame(rows, "client string, at long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    want, held = {}, {}
    for client, at, seq in sorted(rows):
        held[client], want[seq] = ingest.admitted(held.get(client), at, 3, 100)
    for most in (10_000, 7):
        stream = ingest.source(spark, str(tmp_path / "in"), schema)
        got = ingest.drained(ingest.rate_limited(stream, 3, 100, most=most), f"waiting-{most}")
        assert {r["seq"]: r["allowed"] for r in got.collect()} == want


def test_idle_clients_are_forgotten(spark, tmp_path):
    import time

    def request(seq):
        spark.createDataFrame([("c", 10, seq)], "client string, at long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        out = ingest.drained(ingest.rate_limited(stream, 1, 1_000_000, idle=3000), "idle", root=f"file:{tmp_path}/run")
        return {r["seq"]: r["allowed"] for r in out.collect()}[seq]

    began = time.time()
    first, second = request(1), request(2)
    soon = time.time() - began < 3
    time.sleep(4)
    assert first and (not second or not soon) and request(3)
