"""Files as rows: listings, hashes, re-indexing of a media tree, and sinks."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.define import query
from .catalog import Catalog
from .scratch import new_path, written


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table scan by a declared schema: only filters and columns that are used are read."""
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of all files below a folder; contents aren't read.

    Spark's file sources pass over empty files: they are treated like missing ones, as re-indexing and integrity checks do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stats(listing: DataFrame, paths: DataFrame) -> DataFrame:
    """size and modified of each asked path, null where there is no such file. paths has path."""
    return paths.join(listing, "path", "left")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of all files below a folder; a file that can't be read has a null hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def reindexed(listing: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """Rows that a media tree adds to the catalogue: group/folder/file below root; empty files and known messages are left out.

    The message id is the number that the file's name starts with, else a negative one from the path. known has
    group_id, message_id.
    """
    rel = F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit(""))
    name = S.basename(rel)
    number = F.regexp_extract(name, r"^(\d+)[_.]", 1)
    rows = listing.filter("size > 0").select(F.split(rel, "/")[0].alias("group_id"), F.coalesce(number.try_cast("long"), S.synthetic_id(rel)).alias("message_id"), name.alias("file_name"), F.col("size").alias("file_size"), S.file_type(rel).alias("file_type"), rel.alias("file_path"))
    return rows.dropDuplicates(["group_id", "message_id"]).join(known, ["group_id", "message_id"], "left_anti")


def zip_bytes(rows: Iterator[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in rows:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def tar_bytes(rows: Iterator[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def archive_parts(files: DataFrame, kind: str = "zip", most: int = 32 << 20) -> DataFrame:
    """Archives (content, kind, files) of files (path, content), built where the rows are: each holds `most` bytes of content, or one file of more.

    A file without content is empty; equal paths stay as entries of their own. No rows give no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zip_bytes if kind == "zip" else tar_bytes
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array([pack(iter(rows))], pa.binary()), pa.array([kind]), pa.array([len(rows)], pa.int64())], names=["content", "kind", "files"])
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                if held and size + len(data) > most:
                    yield done(held)
                    held, size = [], 0
                held.append((path.as_py(), data))
                size += len(data)
        if held:
            yield done(held)

    return files.filter("path IS NOT NULL").select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "content binary, kind string, files long")


def archived_files(parts: DataFrame) -> DataFrame:
    """(path, content) of each file in archives (content, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda path, data: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "content"])
        for batch in batches:
            for content, kind in zip(batch.column(0), batch.column(1), strict=True):
                data = io.BytesIO(content.as_py())
                if kind.as_py() == "zip":
                    with zipfile.ZipFile(data) as z:
                        yield from (row(info.filename, z.read(info)) for info in z.infolist())
                else:
                    with tarfile.open(fileobj=data) as t:
                        yield from (row(m.name, t.extractfile(m).read()) for m in t)

    return parts.select("content", "kind").mapInArrow(run, "path string, content binary")


def archive(files: DataFrame, kind: str = "zip") -> bytes:
    """One archive of a few files (path, content) as a download: it is built in the caller's memory. For more see archive_parts()."""
    rows = ((r["path"], bytes(r["content"])) for r in files.select("path", "content").toLocalIterator())
    return (zip_bytes if kind == "zip" else tar_bytes)(rows)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """A table as a versioned folder."""
    path = f"{root.rstrip('/')}/v{version:010d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def history(messages: DataFrame, before: int | None = None, after: int = 0, since: int | None = None, until: int | None = None, limit: int = 100) -> DataFrame:
    """A page of a channel's history, newest first: ids below the cursor and above the floor, within a window of seconds. messages has id, date."""
    rows = messages.filter(F.col("id") > after)
    rows = rows.filter(F.col("id") < before) if before else rows
    rows = rows.filter(F.col("date") >= since) if since is not None else rows
    rows = rows.filter(F.col("date") < until) if until is not None else rows
    return rows.orderBy(F.desc("id")).limit(min(max(limit, 1), 100))


@query("s1_table_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def customers(c: Catalog) -> DataFrame:
    fields = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    return scan(c.spark, f"{c.path}/customer.parquet", fields).filter("c_acctbal > 9000").select("c_custkey", "c_name")


@query("s2_consistent_count_and_page", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def count_and_page(c: Catalog) -> DataFrame:
    rows = c.orders.filter("o_orderstatus = 'P'")
    return rows.select("o_orderkey").orderBy("o_orderkey").limit(20).crossJoin(rows.agg(F.count("*").alias("total")))


@query("s6_history_page", "SELECT event_id AS id FROM events WHERE event_id < 800 AND event_id > 100 AND floor(epoch(ts)) >= 1704070000 ORDER BY event_id DESC LIMIT 100")
def history_page(c: Catalog) -> DataFrame:
    messages = c.events.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("date"))
    return history(messages, before=800, after=100, since=1_704_070_000).select("id")


@query("s5_reindex", "SELECT source AS group_id, doc_id AS message_id FROM documents d WHERE n_chars > 0 AND NOT EXISTS (SELECT 1 FROM peer_downloads p WHERE p.group_id = d.source AND p.message_id = d.doc_id)")
def reindex(c: Catalog) -> DataFrame:
    listing = c.documents.select(F.concat(F.lit("/media/"), "source", F.lit("/videos/"), F.col("doc_id").cast("string"), F.lit("_x.mp4")).alias("path"), F.col("n_chars").alias("size"))
    known = c.peer_downloads.select("group_id", "message_id")
    return reindexed(listing, "/media", known).select("group_id", "message_id")


@query("s9_content_hashes", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size FROM pages")
def content_hashes(c: Catalog) -> DataFrame:
    return c.pages.select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))


@query("s15_schema_probe", "SELECT 'documents' AS name, 5 AS columns UNION ALL SELECT 'labels', 3")
def schema_probe(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([(n, len(c.table(n).columns)) for n in ("documents", "labels")], "name string, columns int")


@query("s3_walk")
def listing(c: Catalog) -> DataFrame:
    """All files below the data directory: metadata only."""
    return walk(c.spark, c.path).select(S.basename(F.col("path")).alias("name"), "size")


@query("s4_batch_stat")
def batch_stat(c: Catalog) -> DataFrame:
    """Sizes of asked names, null for what isn't there."""
    names = c.spark.createDataFrame([("region.parquet",), ("no-such-file",)], "path string")
    return stats(walk(c.spark, c.path).withColumn("path", S.basename(F.col("path"))).select("path", "size"), names)


@query("s13_metrics", "SELECT kind, count(*) AS n, max(ts) AS last FROM audit GROUP BY kind")
def metrics(c: Catalog) -> DataFrame:
    """Gauges by kind; the totals are observed while the rows pass (see the session's listeners)."""
    return c.audit.observe("audit", F.count("*").alias("rows"), F.max("ts").alias("last")).groupBy("kind").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


_ARCHIVED = "SELECT 'pages/' || page_id || '.html' AS path, coalesce(octet_length(encode(html)), 0) AS size, sha256(coalesce(html, '')) AS sha256 FROM pages"


def _round_trip(c: Catalog, kind: str) -> DataFrame:
    """All pages put into archives, which are written and read again."""
    pages = c.pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return archived_files(written(archive_parts(pages, kind), f"{kind}-parts")).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("s11_zip_archives", _ARCHIVED)
def zip_archives(c: Catalog) -> DataFrame:
    return _round_trip(c, "zip")


@query("s11_tar_archives", _ARCHIVED)
def tar_archives(c: Catalog) -> DataFrame:
    return _round_trip(c, "tar")


@query("s12_ndjson_results", "SELECT id, kind, ts, props FROM audit")
def ndjson_results(c: Catalog) -> DataFrame:
    """The audit log as lines of JSON, read again."""
    rows, path = c.audit.select("id", "kind", "ts", "props"), new_path(c.spark, "ndjson")
    write_ndjson(rows, path)
    return c.spark.read.schema(rows.schema).json(path)


@query("s14_snapshot", "SELECT peer_id, remote_id, file_hash, file_size, group_id FROM peer_downloads")
def snapshot_of_peers(c: Catalog) -> DataFrame:
    """A snapshot of the peers' files, read again: what is written to the table later doesn't change it."""
    rows = c.peer_downloads.select("peer_id", "remote_id", "file_hash", "file_size", "group_id")
    return c.spark.read.schema(rows.schema).parquet(snapshot(rows, new_path(c.spark, "snapshots"), 1))
