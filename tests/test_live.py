import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shelfmark.sources.versioned import VersionedTable
from shelfmark.streaming import live


class Catalogue:
    def __init__(self, spark):
        self.spark = spark


def update(seq, change="new", account="a", group="g", message=1, identity="x"):
    return {"seq": seq, "account_id": account, "change": change, "group_id": group, "message_id": message, "pts": seq, "identity": identity}


def log_file(folder, number, rows, groups=2):
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, schema=live._arrow(live.UPDATES)), folder / f"part-{number:05d}.parquet", row_group_size=groups)


def rows_of(reader, start, end):
    return [r for part in reader.partitions(start, end) for batch in reader.read(part) for r in batch.to_pylist()]


def test_offsets_replay_and_grow(tmp_path):
    reader = live.UpdateLogReader(f"file:{tmp_path}/log")
    assert reader.latestOffset() == reader.initialOffset() and rows_of(reader, {"seq": -1}, {"seq": -1}) == []
    log_file(tmp_path / "log", 0, [update(s) for s in range(5)])
    assert reader.latestOffset() == {"seq": 4} and len(reader.partitions({"seq": -1}, {"seq": 4})) == 3  # a task for each row group
    log_file(tmp_path / "log", 1, [update(s) for s in range(5, 9)])
    assert [r["seq"] for r in rows_of(reader, {"seq": -1}, {"seq": 4})] == [0, 1, 2, 3, 4]  # later files don't change what was planned
    for _ in range(2):
        assert [r["seq"] for r in rows_of(reader, {"seq": 2}, {"seq": 6})] == [3, 4, 5, 6]


def test_deletes_reach_tombstones_and_edits_replace(spark, tmp_path):
    c, table = Catalogue(spark), live.messages_table(Catalogue(spark), f"file:{tmp_path}/table")
    steps = [
        [update(0), update(1, message=2), update(2, "edit", identity="y"), update(3, account="b", message=3)],
        [update(4, "delete"), update(5, "delete", account="b", message=9), update(6, "edit", account="b", identity="z")],
        [update(7, "edit", identity="w")],
    ]
    for k, rows in enumerate(steps):
        log_file(tmp_path / "log", k, rows)
        live.followed_updates(c, f"file:{tmp_path}/log", table, f"file:{tmp_path}/state", ["a"])
    got = {r["message_id"]: (r["seq"], r["identity"], r["deleted_seq"]) for r in table.read().collect()}
    assert got == {1: (7, "w", 4), 2: (1, "x", None), 9: (None, None, 5)}  # b only works by hand: its new message isn't seen, its delete is
    version = table.versions()[-1]
    live.followed_updates(c, f"file:{tmp_path}/log", table, f"file:{tmp_path}/state", ["a"])
    assert table.versions()[-1] == version  # nothing new


def feed_file(folder, number, rows):
    folder.mkdir(parents=True, exist_ok=True)
    spec = pa.schema([("revision", pa.int64()), ("change", pa.string()), ("key", pa.int64()), ("payload", pa.string())])
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), spec.types, strict=True)], schema=spec), folder / f"part-{number}.parquet", row_group_size=3)


def test_pages_are_bounded_and_lose_nothing(tmp_path):
    feed_file(tmp_path / "p" / "a", 0, [(r, "upsert", r % 8, "é" * 10) for r in range(1, 20)])
    peers, after, seen = live.PeerFolder(f"{tmp_path}"), 0, []
    assert peers.heads() == {"p": ("a", 19)}
    while page := live.checked_page(peers.page("p", "a", "a", after, 19, rows=5, size=60), after):
        if not page.changes:
            break
        assert len(page.changes) <= 3 and not page.reset
        seen += [c[0] for c in page.changes]
        after = page.next
    assert seen == list(range(1, 20))
    assert len(peers.page("p", "a", "a", 0, 19, size=1).changes) == 1  # an oversized change still comes
    whole = live.checked_page(peers.page("p", "a", "a", 0, 19), 0)
    assert [c[0] for c in whole.changes] == list(range(12, 20)) and whole.next == 19  # overtaken changes of a key are left out


@pytest.mark.parametrize("page,after", [(live.Page("a", 9, False, 5, [(4, "upsert", 1, "")]), 3), (live.Page("a", 9, False, 3, [(3, "upsert", 1, "")]), 3), (live.Page("a", 9, False, 10, [(10, "upsert", 1, "")]), 3), (live.Page("a", 9, False, 6, [(5, "upsert", 1, ""), (6, "upsert", 1, "")]), 3), (live.Page("a", 9, False, 5, [(6, "upsert", 1, ""), (5, "upsert", 2, "")]), 3)])
def test_pages_that_contradict_themselves(page, after):
    with pytest.raises(ValueError):
        live.checked_page(page, after)


def test_peers_keep_their_cursors(tmp_path):
    reader = live.PeerPagesReader(f"{tmp_path}")
    feed_file(tmp_path / "p" / "a", 0, [(1, "upsert", 1, "x"), (2, "upsert", 2, "y")])
    feed_file(tmp_path / "q" / "a", 0, [(7, "upsert", 1, "z")])
    first = reader.latestOffset()
    assert {(r["peer_id"], r["change"], r["revision"]) for r in rows_of(reader, {}, first)} == {("p", "reset", 0), ("p", "upsert", 1), ("p", "upsert", 2), ("q", "reset", 0), ("q", "upsert", 7)}
    feed_file(tmp_path / "p" / "a", 1, [(3, "delete", 1, None)])
    then = {k: v for k, v in reader.latestOffset().items() if k == "p"}  # q can't be reached now
    assert [(r["peer_id"], r["change"], r["revision"]) for r in rows_of(reader, first, then)] == [("p", "delete", 3)]
    feed_file(tmp_path / "p" / "b", 0, [(1, "upsert", 5, "new")])
    anew = reader.latestOffset()
    got = [(r["change"], r["revision"], r["epoch"]) for r in rows_of(reader, first | then, anew)]
    assert got == [("reset", 0, "b"), ("upsert", 1, "b")]


def test_reset_wipes_one_peer(spark, tmp_path):
    c = Catalogue(spark)
    table = live.peers_table(c, f"file:{tmp_path}/table")
    feed_file(tmp_path / "feeds" / "p" / "a", 0, [(1, "upsert", 1, "x"), (2, "upsert", 2, "y")])
    feed_file(tmp_path / "feeds" / "q" / "a", 0, [(1, "upsert", 1, "z"), (2, "upsert", 3, "old"), (3, "delete", 3, None)])
    run = lambda: live.followed_peers(c, f"file:{tmp_path}/feeds", table, f"file:{tmp_path}/state")
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [("p", 1, 1, "x"), ("p", 2, 2, "y"), ("q", 1, 1, "z")]
    feed_file(tmp_path / "feeds" / "p" / "b", 0, [(1, "upsert", 9, "only")])
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [("p", 9, 1, "only"), ("q", 1, 1, "z")]


def test_versions(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string, w string").schema
    table = VersionedTable(spark, f"file:{tmp_path}/t", schema, ["k"], keep_old=("w",), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, w string, gone boolean, extra int")
    assert table.read().collect() == [] and table.versions() == []
    first = frame([(k, "a", "kept", False, 1) for k in range(20)] + [(None, "n", None, False, 1)])
    assert table.merge(first, ("writer", 0), "gone") == 1
    assert table.merge(first.withColumn("v", first.k.cast("string")), ("writer", 0), "gone") == 1  # the batch was written already
    before = table.manifest()["folders"]
    assert table.merge(frame([(3, "b", None, False, 1), (4, None, None, True, 1), (99, "new", None, False, 1), (98, "never", None, True, 1)]), ("writer", 1), "gone") == 2
    rows = {r["k"]: (r["v"], r["w"]) for r in table.read().collect()}
    assert rows == {None: ("n", None), **{k: ("a", "kept") for k in range(20) if k not in (3, 4)}, 3: ("b", "kept"), 99: ("new", None)}
    assert table.read(1).count() == 21
    assert [k for k, f in table.manifest()["folders"].items() if before.get(k) == f] or len(before) <= 3  # buckets without a change stay as they are
    with pytest.raises(RuntimeError):
        table._publish({"version": 2})
    assert table.merge(frame([(None, "only", None, False, 1)]), None, "gone", ("k", list(range(20)))) == 3
    assert {r["k"] for r in table.read().collect()} == {None, 99}
    assert table.vacuum(1) > 0 and table.versions() == [3] and table.read().count() == 2
