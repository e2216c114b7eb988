"""Live sources: updates of messages (new, edit, delete) from a log, and peers' change pages, as streams with offsets of their own.

Both are Python data sources: offsets are planned on the driver from footers alone, rows are read in tasks. The logs are
folders that others only add files to, in a store that Arrow's file systems open (local, HDFS, S3, GCS); everything
between two offsets can be read again and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.mutations import latest
from ..plans.define import query
from ..sources.catalog import Catalog
from ..sources.scratch import new_path
from ..sources.versioned import VersionedTable
from .feed import PAGE_BYTES, PAGE_ROWS, compacted

#: An update: its place in the log, who saw it, what it does to a message ('new', 'edit' or 'delete'), and the message's order number and media.
UPDATES = "seq long, account_id string, change string, group_id string, message_id long, pts long, identity string"
#: A row of a peer's feed; change 'reset' says that the rows after it start the peer's table anew.
CHANGES = "peer_id string, epoch string, revision long, change string, key long, payload string"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _arrow(spec: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in spec.split(", ")])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if ":" not in path.split("/")[0]:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _files(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and "/_" not in f.path[len(root) :])


def _ranges(fs: pafs.FileSystem, path: str, column: str) -> list[tuple[int, int, int]]:
    """(row group, least, greatest) of a column, from the footer."""
    with fs.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
    at = meta.schema.to_arrow_schema().get_field_index(column)
    stats = [(g, meta.row_group(g).column(at).statistics) for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
    return [(g, s.min, s.max) for g, s in stats]


@dataclass
class LogPart(InputPartition):
    path: str
    group: int
    after: int
    upto: int


class UpdateLogReader(DataSourceStreamReader):
    """Offsets are numbers of updates. A row group of a file is a task; footers are read once for each file."""

    def __init__(self, path: str):
        self.path, self.seen = path, {}

    def _groups(self) -> list[tuple[str, int, int, int]]:
        fs, root = opened(self.path)
        for file in _files(fs, root):
            if file not in self.seen:
                self.seen[file] = _ranges(fs, file, "seq")
        return [(f, *g) for f in sorted(self.seen) for g in self.seen[f]]

    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        return {"seq": max((g[3] for g in self._groups()), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = start["seq"], end["seq"]
        return [LogPart(f, g, after, upto) for f, g, low, high in self._groups() if high > after and low <= upto]

    def read(self, partition: LogPart) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(partition.path)
        spec = _arrow(UPDATES)
        with fs.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f).read_row_group(partition.group, columns=spec.names)
        keep = pc.and_(pc.greater(table["seq"], partition.after), pc.less_equal(table["seq"], partition.upto))
        yield from table.filter(keep).select(spec.names).cast(spec).to_batches()


class UpdateLog(DataSource):
    """spark.readStream.format("shelfmark_updates").option("path", folder): Parquet files of UPDATES, seq rising from file to file."""

    @classmethod
    def name(cls) -> str:
        return "shelfmark_updates"

    def schema(self) -> str:
        return UPDATES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return UpdateLogReader(self.options["path"])


@dataclass
class Page:
    """A peer's answer: changes (revision, change, key, payload) after a revision; next is the last of them."""

    epoch: str
    head: int
    reset: bool
    next: int
    changes: list[tuple[int, str, int, str | None]]


class PeerFolder:
    """Peers that publish feeds as folders: {root}/{peer}/{epoch}/*.parquet, compacted to the last change of each key; the last epoch by name is the one in force."""

    def __init__(self, root: str):
        self.root = root

    def heads(self) -> dict[str, tuple[str, int]]:
        """Epoch and last revision of each peer, from footers."""
        fs, root = opened(self.root)
        out: dict[str, tuple[str, int]] = {}
        for file in _files(fs, root):
            peer, epoch = file[len(root) :].strip("/").split("/")[:2]
            top = max((g[2] for g in _ranges(fs, file, "revision")), default=0)
            held = out.get(peer, ("", 0))
            out[peer] = (epoch, top) if epoch > held[0] else (epoch, max(held[1], top)) if epoch == held[0] else held
        return out

    def page(self, peer: str, epoch: str, wanted: str, after: int, upto: int, rows: int = PAGE_ROWS, size: int = PAGE_BYTES) -> Page:
        """The next changes of an epoch, in the order of revisions: bounded by rows and bytes, one at least."""
        fs, root = opened(self.root)
        reset = epoch != wanted
        after = 0 if reset else after
        parts = []
        for file in _files(fs, f"{root.rstrip('/')}/{peer}/{wanted}"):
            groups = [g for g, low, high in _ranges(fs, file, "revision") if high > after and low <= upto]
            if groups:
                with fs.open_input_file(file) as f:
                    table = pq.ParquetFile(f).read_row_groups(groups, columns=["revision", "change", "key", "payload"])
                table = table.filter(pc.and_(pc.greater(table["revision"], after), pc.less_equal(table["revision"], upto)))
                parts.append(table.take(pc.sort_indices(table["revision"]).slice(0, rows)))
        out, held, next_ = [], 0, after
        if parts:
            table = pa.concat_tables(parts)
            for r in table.take(pc.sort_indices(table["revision"]).slice(0, rows)).to_pylist():
                held += len((r["payload"] or "").encode())
                if out and held > size:
                    break
                out.append((r["revision"], r["change"], r["key"], r["payload"]))
                next_ = r["revision"]
        last = {c[2]: c for c in out}  # an earlier change of a key in the same page is overtaken
        return Page(wanted, upto, reset, next_, [c for c in out if last[c[2]] is c])


def checked_page(page: Page, after: int) -> Page:
    """The page, if it follows the cursor: revisions rise from it to the page's end, and no key comes twice. ValueError else."""
    at = 0 if page.reset else after
    for revision, *_ in page.changes:
        if revision <= at or revision > page.head:
            raise ValueError(f"revision {revision} after {at}, head {page.head}")
        at = revision
    if page.next != at or len({c[2] for c in page.changes}) != len(page.changes):
        raise ValueError(f"a page that ends at {page.next} instead of {at}, or repeats a key")
    return page


@dataclass
class PeerPart(InputPartition):
    peer: str
    epoch: str
    after: int
    wanted: str
    head: int


class PeerPagesReader(DataSourceStreamReader):
    """A cursor (epoch, revision) for each peer is the offset; a peer is a task, which asks for page after page up to the head that was planned.

    A peer that can't be reached has no head, so its cursor stays. A new epoch, or a head before the cursor, starts it anew.
    """

    def __init__(self, path: str):
        self.peers = PeerFolder(path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {peer: {"epoch": epoch, "revision": head} for peer, (epoch, head) in sorted(self.peers.heads().items())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        none = {"epoch": "", "revision": 0}
        out = []
        for peer, to in end.items():
            at = start.get(peer, none)
            if at != to:
                epoch = "" if to["revision"] < at["revision"] and to["epoch"] == at["epoch"] else at["epoch"]
                out.append(PeerPart(peer, epoch, at["revision"], to["epoch"], to["revision"]))
        return out

    def read(self, partition: PeerPart) -> Iterator[pa.RecordBatch]:
        spec, epoch, after = _arrow(CHANGES), partition.epoch, partition.after
        while True:
            page = checked_page(self.peers.page(partition.peer, epoch, partition.wanted, after, partition.head), after)
            rows = [(partition.peer, page.epoch, 0, "reset", None, None)] if page.reset else []
            rows += [(partition.peer, page.epoch, *c) for c in page.changes]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), spec.types, strict=True)], schema=spec)
            epoch, after = page.epoch, page.next
            if not page.changes or after >= partition.head:
                return


class PeerPages(DataSource):
    """spark.readStream.format("shelfmark_peers").option("path", folder): the changes of all peers that publish below a folder."""

    @classmethod
    def name(cls) -> str:
        return "shelfmark_peers"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PeerPagesReader(self.options["path"])


def live_stream(c: Catalog, kind: type[DataSource], path: str) -> DataFrame:
    c.spark.dataSource.register(kind)
    return c.spark.readStream.format(kind.name()).option("path", path).load()


def caught_up(stream: DataFrame, put, state: str) -> None:
    """Runs a stream over what is there now; put(batch, number) may see a batch again after a failure."""
    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def routed(updates: DataFrame, observing: list[str]) -> DataFrame:
    """group_id, message_id, seq, pts, identity, deleted_seq: for each message the last new or edit that an observing account saw, and its last delete.

    Deletes count whoever saw them: they protect what is kept while an account only does other work.
    """
    seen = F.when(F.col("change").isin("new", "edit") & F.col("account_id").isin(*observing), F.col("seq"))
    told = updates.withColumns({"seen": seen, "gone": F.when(F.col("change") == "delete", F.col("seq"))}).filter("seen IS NOT NULL OR gone IS NOT NULL")
    return told.groupBy("group_id", "message_id").agg(F.max("seen").alias("seq"), F.max_by("pts", "seen").alias("pts"), F.max_by("identity", "seen").alias("identity"), F.max("gone").alias("deleted_seq"))


def followed_updates(c: Catalog, log: str, table: VersionedTable, state: str, observing: list[str]) -> None:
    """Brings a table of messages up to the log's end: edits replace what they edit, deletes leave a tombstone."""
    caught_up(live_stream(c, UpdateLog, log), lambda batch, number: table.merge(routed(batch, observing), ("updates", number)), state)


def messages_table(c: Catalog, root: str) -> VersionedTable:
    schema = c.spark.createDataFrame([], "group_id string, message_id long, seq long, pts long, identity string, deleted_seq long").schema
    return VersionedTable(c.spark, root, schema, ["group_id", "message_id"], keep_old=("seq", "pts", "identity", "deleted_seq"))


def followed_peers(c: Catalog, feeds: str, table: VersionedTable, state: str) -> None:
    """Brings a table of the peers' rows up to their heads: a reset wipes a peer's rows first, deletes go."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        anew = [r[0] for r in batch.filter("change = 'reset'").select("peer_id").distinct().collect()]  # a name for each peer at most
        last = latest(batch.filter("change <> 'reset'"), ["peer_id", "key"], ["revision"])
        table.merge(last.withColumn("gone", F.col("change") == "delete"), ("peers", number), "gone", ("peer_id", anew))
        batch.unpersist()

    caught_up(live_stream(c, PeerPages, feeds), put, state)


def peers_table(c: Catalog, root: str) -> VersionedTable:
    return VersionedTable(c.spark, root, c.spark.createDataFrame([], "peer_id string, key long, revision long, payload string").schema, ["peer_id", "key"])


def _updates(c: Catalog) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "delete").when(i % 3 == 0, "edit").otherwise("new")
    return c.events.select(i.alias("seq"), (i % 3).cast("string").alias("account_id"), kind.alias("change"), F.col("user_id").cast("string").alias("group_id"), (i % 4).alias("message_id"), ((i * 37) % 1009).alias("pts"), F.col("event_type").alias("identity"))


@query("s7_live_updates", """
WITH u AS (SELECT event_id AS seq, event_id % 3 <> 2 AS observed, event_type = 'error' AS gone, CAST(user_id AS VARCHAR) AS group_id, event_id % 4 AS message_id, (event_id * 37) % 1009 AS pts, event_type AS identity FROM events)
SELECT group_id, message_id, max(seq) FILTER (WHERE observed AND NOT gone) AS seq, arg_max(pts, seq) FILTER (WHERE observed AND NOT gone) AS pts, arg_max(identity, seq) FILTER (WHERE observed AND NOT gone) AS identity, max(seq) FILTER (WHERE gone) AS deleted_seq
FROM u WHERE gone OR observed GROUP BY group_id, message_id""")
def live_updates(c: Catalog) -> DataFrame:
    """The events as a log that grows in two steps; the stream goes on from its offset after each."""
    root, rows = new_path(c.spark, "updates"), _updates(c)
    table = messages_table(c, f"{root}/table")
    middle = rows.agg((F.max("seq") / 2).cast("long").alias("middle"))
    for part in ("seq <= middle", "seq > middle"):
        rows.crossJoin(F.broadcast(middle)).filter(part).drop("middle").write.mode("append").parquet(f"{root}/log")
        followed_updates(c, f"{root}/log", table, f"{root}/state", ["0", "1"])
    return table.read()


_PEER_FEED = "SELECT user_id % 5 AS p, user_id AS key, event_id + 1 AS revision, event_type <> 'error' AS there, props AS payload FROM events"


@query("s8_peer_pages", f"""
WITH f AS ({_PEER_FEED}), middle AS (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) AS m FROM events),
last AS (SELECT 'peer' || p AS peer_id, key, max(revision) AS revision, arg_max(payload, revision) AS payload, arg_max(there, revision) AS there FROM f, middle WHERE p <> 3 OR revision > m GROUP BY p, key)
SELECT peer_id, key, revision, payload FROM last WHERE there""")
def peer_pages(c: Catalog) -> DataFrame:
    """Five peers publish what they have in two steps. One begins a new epoch at the second, with its later half only: its earlier rows go."""
    root = new_path(c.spark, "peers")
    table = peers_table(c, f"{root}/table")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    log = c.events.select((F.col("user_id") % 5).alias("p"), F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("revision"), kind.alias("kind"), F.col("props").alias("payload"))
    log = log.crossJoin(F.broadcast(c.events.agg(F.floor(F.max("event_id") / 2).alias("middle"))))

    def publish(rows: DataFrame, epoch: str) -> None:
        feed = compacted(rows).withColumnRenamed("kind", "change")
        feed.withColumns({"peer": F.concat(F.lit("peer"), (F.col("key") % 5).cast("string"))}).repartition("peer").write.mode("append").partitionBy("peer").parquet(f"{root}/new-{epoch}")
        for peer in c.spark.read.parquet(f"{root}/new-{epoch}").select("peer").distinct().collect():  # five peers
            c.spark.read.parquet(f"{root}/new-{epoch}/peer={peer[0]}").write.mode("append").parquet(f"{root}/feeds/{peer[0]}/{epoch}")

    publish(log.filter("revision <= middle"), "a")
    followed_peers(c, f"{root}/feeds", table, f"{root}/state")
    publish(log.filter("revision > middle AND p <> 3"), "a")
    publish(log.filter("revision > middle AND p = 3"), "b")
    followed_peers(c, f"{root}/feeds", table, f"{root}/state")
    return table.read()


@query("s10_upsert_sink", """
WITH o AS (SELECT CAST(user_id AS VARCHAR) AS group_id, event_id % 4 AS message_id, event_id AS seq, event_type AS identity, CASE WHEN event_id % 11 = 0 THEN 30 END AS ttl_seconds FROM events)
SELECT group_id, message_id, max(seq) AS seq, arg_max(identity, seq) AS identity, CAST(arg_max(ttl_seconds, seq) FILTER (WHERE ttl_seconds IS NOT NULL) AS BIGINT) AS ttl_seconds FROM o GROUP BY group_id, message_id""")
def upsert_sink(c: Catalog) -> DataFrame:
    """Messages written to a table, three micro-batches of events, each written twice as after a failure; an old ttl stays where there is no new one."""
    root, i = new_path(c.spark, "sink"), F.col("event_id")
    rows = c.events.select(F.col("user_id").cast("string").alias("group_id"), (i % 4).alias("message_id"), i.alias("seq"), F.col("event_type").alias("identity"), F.when(i % 11 == 0, 30).cast("long").alias("ttl_seconds"))
    table = VersionedTable(c.spark, f"{root}/table", rows.schema, ["group_id", "message_id"], keep_old=("ttl_seconds",))

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("group_id", "message_id").agg(F.max("seq").alias("seq"), F.max_by("identity", "seq").alias("identity"), F.max_by("ttl_seconds", F.when(F.col("ttl_seconds").isNotNull(), F.col("seq"))).alias("ttl_seconds"))
        for _ in range(2):
            table.merge(last, ("messages", number))

    third = c.events.agg((F.max("event_id") / 3).cast("long").alias("third"))
    for k in range(3):
        part = rows.crossJoin(F.broadcast(third)).filter(F.least(F.floor(F.col("seq") / F.greatest(F.col("third"), F.lit(1))), F.lit(2)) == k).drop("third")
        part.write.mode("append").parquet(f"{root}/in")
        caught_up(c.spark.readStream.schema(rows.schema).parquet(f"{root}/in"), put, f"{root}/state")
    return table.read()
