import itertools
import random

from pyspark.sql import functions as F
from shelfmark.operators import mutations as X


def test_eviction_against_a_walk(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(i, f"p{rng.randrange(6)}", rng.randrange(1, 9), rng.randrange(20), rng.random() < 0.2) for i in range(25)]
        used = sum(max(r[2] for r in rows if r[1] == p) for p in {r[1] for r in rows})
        cap, left, gone, free = used // 2, {r[0] for r in rows}, [], used
        for r in sorted((r for r in rows if not r[4]), key=lambda r: (r[3], r[0]))[:12]:
            if free <= cap:
                break
            left.remove(r[0])
            last = not any(o[0] in left and o[1] == r[1] for o in rows)
            gone.append((r[0], r[2] if last else 0))
            free -= r[2] if last else 0
        df = spark.createDataFrame(rows, "id long, path string, size long, created_at long, keep boolean")
        assert sorted((r["id"], r["freed"]) for r in X.eviction(df, cap, 12, F.col("keep")).collect()) == sorted(gone)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2")], "k string, v int, h string")
    new = spark.createDataFrame([("b", None, None), ("c", 3, None)], "k string, v int, h string")
    got = sorted(tuple(r) for r in X.upsert(old, new, ["k"], ("h",)).collect())
    assert got == [("a", 1, "h1"), ("b", None, "h2"), ("c", 3, None)]


def observation(version, pts, identity="i", origin="live", account="1", ttl=0):
    return {"account_id": account, "version": version, "source_pts": pts, "identity": identity, "origin": origin, "ttl_seconds": ttl}


def test_fold_rules():
    s = X.fold(None, observation(5, 10))
    assert (s["generation"], s["status"]) == (0, "pending")
    assert X.newer(s, observation(4, 99)) == "ignore"
    assert X.newer(s, observation(6, 1)) == "replace"
    assert X.newer(s, observation(5, 11, "other")) == "replace"
    assert X.newer(s, observation(5, 9, "other")) == "ignore"
    assert X.newer(s, observation(5, 11, "other", account="2"), comparable=False) == "ignore"
    assert X.fold(s, observation(5, 30))["source_pts"] == 30
    assert X.fold(s, observation(5, 30))["generation"] == 0
    lifted = X.fold(s, observation(5, 10, origin="url", ttl=9))
    assert (lifted["origin"], lifted["generation"], lifted["ttl_seconds"]) == ("url", 1, 9)
    done = s | {"status": "completed"}
    assert X.newer(done, observation(5, 10)) == "watermark" and X.newer(done, observation(5, 10), repair=True) == "replace"
    assert X.fold(s | {"status": "processing"}, observation(6, 1))["status"] == "processing"


def test_delayed_edit_after_a_later_watermark():
    rows = [observation(1, 1, "a"), observation(1, 5, "a"), observation(1, 3, "b")]
    state = None
    for r in rows:
        state = X.fold(state, r)
    assert (state["identity"], state["source_pts"]) == ("a", 5)


def test_newest_version_wins_in_any_order():
    rows = [observation(v, p, i) for v, p, i in ((1, 5, "a"), (2, 1, "b"), (3, 9, "c"))]
    for order in itertools.permutations(rows):
        state = None
        for r in order:
            state = X.fold(state, r)
        assert (state["version"], state["identity"]) == (3, "c")


def test_integrity_verdicts(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5), (4, "d", None), (5, "e", 5)], "id long, path string, size long")
    found = spark.createDataFrame([("a", 5, True), ("b", 6, True), ("c", 0, True), ("d", 4, True)], "path string, found long, regular boolean")
    got = {r["id"]: (r["verdict"], r["size"]) for r in X.integrity_verdicts(rows, found).collect()}
    assert got == {1: ("keep", None), 2: ("fix-size", 6), 3: ("prune", None), 4: ("fix-size", 4), 5: ("prune", None)}


def test_rekey_refuses_collisions(spark):
    import pytest

    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "group_id string, message_id long")
    with pytest.raises(ValueError):
        X.rekeyed({"t": df}, "a", "b")
    assert X.rekeyed({"t": df}, "a", "c")["t"].filter("group_id = 'c'").count() == 1


def test_disagreeing_hashes_are_no_evidence(spark):
    files = spark.createDataFrame([(1, "p", "photo", "9", 5, "AA"), (2, "p", "photo", "8", 5, "bb"), (3, "q", "photo", "7", 5, "cc")], "id long, path string, kind string, media_id string, size long, hash string")
    items = spark.createDataFrame([(1, "photo", "9", 5, "aa"), (2, "photo", "7", 5, "x"), (3, "photo", "0", 5, "CC")], "item long, kind string, media_id string, size long, hash string")
    got = {r["item"]: (r["path"], r["by"]) for r in X.reusable(items, files).collect()}
    assert got == {1: (None, None), 2: ("q", "identity"), 3: ("q", "content")}


def test_fold_by_account(spark):
    """An edit of the same version from another account wins where order numbers compare (channels), else not; in batch and as a stream's state."""
    row = lambda group, account, pts, identity, seq, comparable: (group, 1, account, 5, pts, identity, "live", 0, seq, comparable)
    rows = [row("c", "a", 1, "x", 1, True), row("c", "b", 2, "y", 2, True), row("u", "a", 1, "x", 3, False), row("u", "b", 2, "y", 4, False), row("n", "a", 1, "x", 5, None), row("n", "a", 2, "y", 6, None)]
    df = spark.createDataFrame(rows, "group_id string, message_id long, account_id string, version long, source_pts long, identity string, origin string, ttl_seconds long, seq long, comparable boolean")
    got = {r["group_id"]: r["identity"] for r in X.folded(df).collect()}
    assert got == {"c": "y", "u": "x", "n": "y"}
