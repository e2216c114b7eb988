"""Streams: ordered ingest with state per message, watermarks per channel, rate windows, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.mutations import FOLD_COLUMNS, FOLD_KEYS, FOLD_SCHEMA, FOLD_SQL, fold, latest, observations, of_channels, with_comparable
from ..plans.define import query
from ..sources.catalog import Catalog
from ..sources.scratch import new_path


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, name: str = "*") -> DataFrame:
    """Files of a folder (of a name, if given) as a stream, a bounded number for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(path)


#: Set while a stream runs: the state store that streams with state of their own need, and no micro-batches without data
#: (state that lives for a time would ask for one after another, and the run would not end).
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def drained(stream: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and gives what it wrote, with the number of the micro-batch.

    With a root of its own, a stream goes on from where it was.

    Each micro-batch overwrites a folder of its own, so a batch that is run again after a failure counts once.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, name)
    written = []

    def put(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = StructType([*stream.schema.fields]).add("batch", "long")
    return spark.read.schema(schema).parquet(f"{root}/out") if written else spark.createDataFrame([], schema)  # no files, no micro-batch


_STATE = "account_id string, version long, source_pts long, identity string, origin string, ttl_seconds long, generation long, status string"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]
#: Rows of one key and micro-batch that a task sorts in memory; of more, each waits in the state store until its turn.
MOST = 10_000


class InOrder(StatefulProcessor):
    """Sees the rows of a key and micro-batch in an order, whatever their number. state: of the key; waiting: rows by arrival.

    Where the state has a time to live, a key that is idle for so long (in milliseconds of the clock) is forgotten.
    """

    def __init__(self, state: str, rows: str, order: tuple[str, ...], idle: int | None = None, most: int = MOST):
        self.spec, self.rows, self.order, self.idle, self.most = state, rows, order, idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.spec, self.idle) if self.idle else handle.getValueState("state", self.spec)
        self.waiting = handle.getMapState("waiting", "n long", self.rows)

    def held(self) -> tuple | None:
        return self.state.get() if self.state.exists() else None

    def in_order(self, rows: Iterator[Row]) -> Iterator[Row]:
        names = [x.split()[0] for x in self.rows.split(", ")]
        key = lambda r: tuple(r[c] for c in self.order)
        first = list(islice(rows, self.most))
        more = next(rows, None)
        if more is None:
            yield from sorted(first, key=key)
            return
        turns = []
        for n, r in enumerate(chain(first, [more], rows)):
            self.waiting.updateValue((n,), tuple(r[c] for c in names))
            turns.append((key(r), n))
            if n < len(first):
                first[n] = None
        kind = Row(*names)
        for _, n in sorted(turns):
            yield kind(*self.waiting.getValue((n,)))
            self.waiting.removeKey((n,))

    def close(self) -> None:
        pass


class Messages(InOrder):
    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.held()
        held = dict(zip(_STATE_NAMES, before, strict=True)) if before else None
        for r in self.in_order(rows):
            held = fold(held, {k: r[k] for k in FOLD_COLUMNS}, bool(r["comparable"]))
        self.state.update(tuple(held[k] for k in _STATE_NAMES))
        yield Row(**(dict(zip(FOLD_KEYS, key, strict=True)) | {k: held[k] for k in _STATE_NAMES}))


def folded_stream(rows: DataFrame, idle: int | None = None, most: int = MOST) -> DataFrame:
    """The state of each message that a micro-batch touches, by the same fold as in batch; late edits lose to what is known.

    A message's state stays for ever unless idle is given: then one that isn't heard of for so many milliseconds is new again.
    """
    columns = "account_id string, version long, source_pts long, identity string, origin string, ttl_seconds long, comparable boolean, seq long"
    told = with_comparable(rows).select(*FOLD_KEYS, *[F.col(x.split()[0]).cast(x.split()[1]) for x in columns.split(", ")])
    return told.groupBy(*FOLD_KEYS).transformWithState(Messages(_STATE, columns, ("seq",), idle, most), FOLD_SCHEMA, "Update", "ProcessingTime" if idle else "None")


def admitted(held: list | None, now: int, limit: int, window: int) -> tuple[list, bool]:
    """(window end, count) of one client after a request, and whether it is let through: a window starts with its first request."""
    if held is None or now >= held[0]:
        held = [now + window, 0]
    if held[1] >= limit:
        return held, False
    return [held[0], held[1] + 1], True


class Windows(InOrder):
    def __init__(self, limit: int, window: int, *more):
        super().__init__(*more)
        self.limit, self.window = limit, window

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.held()
        for r in self.in_order(rows):
            held, fine = admitted(held, r["at"], self.limit, self.window)
            yield Row(client=key[0], seq=r["seq"], allowed=fine)
        self.state.update(tuple(held))


def rate_limited(requests: DataFrame, limit: int = 60, window: int = 60_000, idle: int | None = None, most: int = MOST) -> DataFrame:
    """requests (client, at, seq) of a stream, with allowed: at most `limit` of a client in a window that its first request anchors.

    idle: a client that makes no request for so many milliseconds is forgotten; a window's length or more changes nothing
    for requests that arrive when they are made.
    """
    told = requests.select("client", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq")).filter("at IS NOT NULL AND seq IS NOT NULL")
    step = Windows(limit, window, "until long, n long", "at long, seq long", ("at", "seq"), idle, most)
    return told.groupBy("client").transformWithState(step, "client string, seq long, allowed boolean", "Append", "ProcessingTime" if idle else "None")


def _events(c: Catalog) -> DataFrame:
    """The events table as a stream, be it a folder of files or one file among others."""
    files = c.events.inputFiles()
    if len(files) == 1 and files[0].endswith("/events.parquet"):
        return source(c.spark, c.path, c.events.schema, name="events.parquet")
    return source(c.spark, f"{c.path}/events.parquet", c.events.schema)


class _Streamed:
    """A catalogue whose events arrive as a stream."""

    def __init__(self, events: DataFrame):
        self.events = events


@query("z1_channel_watermarks", "SELECT CAST(user_id AS VARCHAR) AS channel_id, max(event_id) AS pts, count(*) AS updates FROM events GROUP BY user_id")
def channel_watermarks(c: Catalog) -> DataFrame:
    """The highest order number of each channel: a streaming aggregate, its last state for each key."""
    stream = _events(c).groupBy(F.col("user_id").cast("string").alias("channel_id")).agg(F.max("event_id").alias("pts"), F.count("*").alias("updates"))
    return latest(drained(stream, "watermarks", "update"), ["channel_id"], ["batch"]).select("channel_id", "pts", "updates")


@query("z2_ordered_ingest", FOLD_SQL)
def ordered_ingest(c: Catalog) -> DataFrame:
    states = drained(folded_stream(of_channels(observations(_Streamed(_events(c))))), "ingest", "update")
    return latest(states, list(FOLD_KEYS), ["batch"]).drop("batch")


@query("z8_rate_windows", """
WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_ms(ts) AS came, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
s AS (
  SELECT client, n, came + 3600000 AS ends, 1 AS used, true AS allowed FROM r WHERE n = 1
  UNION ALL
  SELECT r.client, r.n, CASE WHEN r.came >= s.ends THEN r.came + 3600000 ELSE s.ends END, CASE WHEN r.came >= s.ends THEN 1 ELSE least(s.used + 1, 3) END, r.came >= s.ends OR s.used < 3
  FROM s JOIN r ON r.client = s.client AND r.n = s.n + 1)
SELECT client, count(*) AS requests, count(*) FILTER (WHERE allowed) AS allowed FROM s GROUP BY client""")
def rate_windows(c: Catalog) -> DataFrame:
    requests = _events(c).select(F.col("user_id").cast("string").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return drained(rate_limited(requests, 3, 3_600_000), "rates").groupBy("client").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))
