import hashlib
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.sources import files


def tree(root):
    made = {"g1/images/12_a.jpg": b"abc", "g1/videos/x.mp4": b"video", "g2/o/notes": b"n", "g2/o/empty.txt": b""}
    for name, data in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return made


def test_walk_and_hashes(spark, tmp_path):
    made = {k: v for k, v in tree(tmp_path).items() if v}  # empty files aren't listed
    listing = {r["path"].split(str(tmp_path) + "/")[1]: r["size"] for r in files.walk(spark, str(tmp_path)).collect()}
    assert listing == {k: len(v) for k, v in made.items()}
    found = {r["path"].split(str(tmp_path) + "/")[1]: r["sha256"] for r in files.hashes(spark, str(tmp_path)).collect()}
    assert found == {k: hashlib.sha256(v).hexdigest() for k, v in made.items()}


def test_stat_of_missing_files(spark, tmp_path):
    tree(tmp_path)
    listing = files.walk(spark, str(tmp_path))
    asked = listing.select("path").limit(1).union(spark.createDataFrame([("nowhere",)], "path string"))
    assert sorted(r["size"] is None for r in files.stats(listing, asked).collect()) == [False, True]


def test_reindex(spark, tmp_path):
    tree(tmp_path)
    known = spark.createDataFrame([("g1", 12)], "group_id string, message_id long")
    listing = files.walk(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    rows = {r["file_path"]: r for r in files.reindexed(listing, str(tmp_path), known).collect()}
    assert set(rows) == {"g1/videos/x.mp4", "g2/o/notes"}
    assert rows["g2/o/notes"]["file_type"] == "photo" and rows["g1/videos/x.mp4"]["file_type"] == "video"
    assert rows["g2/o/notes"]["message_id"] == -int(hashlib.sha256(b"g2/o/notes").hexdigest()[:8], 16)
    assert S is not None


def test_archives(spark):
    rows = spark.createDataFrame([("a.txt", b"one"), ("b/c.txt", b"two")], "path string, content binary")
    z = zipfile.ZipFile(io.BytesIO(files.archive(rows)))
    assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"one", "b/c.txt": b"two"}
    t = tarfile.open(fileobj=io.BytesIO(files.archive(rows, "tar")))
    assert {m.name: t.extractfile(m).read() for m in t.getmembers()} == {"a.txt": b"one", "b/c.txt": b"two"}


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    files.write_ndjson(df, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 5
    path = files.snapshot(df, str(tmp_path / "s"), 3)
    assert path.endswith("v0000000003") and spark.read.parquet(path).count() == 5


def test_table_probe(spark):
    assert not files.exists(spark, "no_such_table")


def test_history(spark):
    messages = spark.createDataFrame([(i, i * 10) for i in range(1, 301)], "id long, date long")
    got = [r["id"] for r in files.history(messages, before=250, after=10, since=500, until=2000, limit=500).collect()]
    assert got == list(range(199, 99, -1))


def test_intermediate_tables_can_be_cleared(spark, tmp_path):
    from shelfmark.sources import scratch

    kept = scratch.written(spark.range(7), "seven")
    assert kept.count() == 7 and scratch.scratch(spark).endswith(spark.sparkContext.applicationId)
    path = scratch.scratch(spark).removeprefix("file://")
    scratch.clear(spark)
    import os

    assert not os.path.exists(path)


def test_archive_parts_hold_all_files(spark):
    rows = [("a", b"x" * 70), ("a", b"y"), ("b", None), ("c", b""), (None, b"lost"), ("d", b"z" * 500)]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    want = sorted((p, bytes(c or b"")) for p, c in rows if p is not None)
    for kind in ("zip", "tar"):
        parts = files.archive_parts(df, kind, most=100)
        assert parts.count() == 2 and parts.agg(F.sum("files")).first()[0] == 5
        assert sorted((r["path"], bytes(r["content"])) for r in files.archived_files(parts).collect()) == want
    assert files.archive_parts(df.limit(0)).count() == 0
