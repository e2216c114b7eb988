"""The change feed: compaction to the last version or tombstone of each key, bounded pages, and applying them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.mutations import latest
from ..operators.relational import lane
from ..plans.define import query
from ..sources.catalog import Catalog

#: Rows and bytes of a page, at most.
PAGE_ROWS, PAGE_BYTES = 500, 512 << 10


def compacted(log: DataFrame) -> DataFrame:
    """The last change of each key. log has key, revision, kind ('upsert' or 'delete'), payload."""
    return latest(log.select("key", "revision", "kind", "payload"), ["key"], ["revision"])


def feed_page(feed: DataFrame, after: int, rows: int = PAGE_ROWS, size: int = PAGE_BYTES) -> DataFrame:
    """The next changes by revision: as many as the bounds let through, but one at least. The running sum is over `rows` rows."""
    next_ = feed.filter(F.col("revision") > after).orderBy("revision").limit(rows)
    before = F.coalesce(F.sum(F.octet_length(F.coalesce("payload", F.lit("")))).over(Window.orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return next_.withColumn("_b", before).withColumn("_k", F.row_number().over(Window.orderBy("revision"))).filter((F.col("_k") == 1) | (F.col("_b") <= size)).drop("_b", "_k")


@dataclass(frozen=True)
class Cursor:
    epoch: str
    revision: int


def checked(page: DataFrame, cursor: Cursor, epoch: str, first: int, last: int) -> bool:
    """Whether a page follows the cursor: a new epoch starts at 0; revisions rise from it and end at `last`.

    ValueError for pages that contradict themselves. True means that the table starts anew.
    """
    reset = epoch != cursor.epoch
    expected = 0 if reset else cursor.revision
    if first != expected or last < first:
        raise ValueError(f"page from {first} to {last}, cursor at {expected}")
    found = page.agg(F.min("revision"), F.max("revision"), F.count("*"), F.countDistinct("key"), F.countDistinct("revision")).first()
    if found[2] and (found[0] <= first or found[1] != last or found[3] != found[2] or found[4] != found[2]):
        raise ValueError("revisions don't rise to the page's end")
    return reset


def applied(table: DataFrame, page: DataFrame, reset: bool) -> DataFrame:
    """table (key, revision, payload) after a page; a change that the table has already, by its revision, changes nothing."""
    rows = page.select("key", "revision", F.when(F.col("kind") == "upsert", F.col("payload")).alias("payload"), (F.col("kind") == "delete").alias("gone"))
    held = table.select("key", "revision", "payload", F.lit(False).alias("gone"))
    held = held.filter(F.lit(False)) if reset else held
    return latest(held.unionByName(rows), ["key"], ["revision"]).filter("NOT gone").drop("gone")


def event_log(c: Catalog) -> DataFrame:
    return c.events.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("revision"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"), F.col("props").alias("payload"))


_FEED = "SELECT user_id AS key, event_id + 1 AS revision, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, props AS payload FROM events e WHERE event_id = (SELECT max(event_id) FROM events f WHERE f.user_id = e.user_id)"


@query("z6_change_feed", _FEED)
def change_feed(c: Catalog) -> DataFrame:
    return compacted(event_log(c))


@query("z6_feed_page", f"SELECT key, revision, kind, payload FROM ({_FEED}) WHERE revision > 500 ORDER BY revision LIMIT 50")
def first_page(c: Catalog) -> DataFrame:
    return feed_page(change_feed(c), 500, 50)


@query("z7_apply_feed", f"SELECT key, revision, payload FROM ({_FEED}) WHERE kind = 'upsert'")
def apply_feed(c: Catalog) -> DataFrame:
    """Half of the log makes a table; the feed's later changes are applied to it."""
    log = event_log(c)
    middle = log.agg(F.floor(F.max("revision") / 2)).first()[0] or 0
    base = applied(log.limit(0).select("key", "revision", "payload"), compacted(log.filter(F.col("revision") <= middle)), True)
    return applied(base, compacted(log.filter(F.col("revision") > middle)), False)


def gaps(updates: DataFrame, channel: str = "channel_id", number: str = "pts") -> DataFrame:
    """channel, from, to of order numbers that are missing between two updates."""
    before = F.lag(number).over(Window.partitionBy(channel).orderBy(number))
    return updates.select(channel, F.col(number).alias("to_pts"), before.alias("from_pts")).filter("to_pts > from_pts + 1")


@query("z3_gaps", "SELECT channel_id, from_pts, to_pts FROM (SELECT event_type AS channel_id, event_id AS to_pts, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS from_pts FROM events) WHERE to_pts > from_pts + 1")
def gap_list(c: Catalog) -> DataFrame:
    return gaps(c.events.select(F.col("event_type").alias("channel_id"), F.col("event_id").alias("pts")))


def claimed(work: DataFrame, accounts: list[str], now: int, most: int = 1, manual_only: bool = False) -> DataFrame:
    """The next rows to work on: pending, not paused, due, of active accounts; by lane, then id."""
    rows = work.filter((F.col("status") == "pending") & (F.col("paused") == 0) & F.col("account_id").isin(*accounts) & (F.col("retry_at") <= now))
    rows = rows.filter("origin <> 'live'") if manual_only else rows
    return rows.orderBy(lane(), "id").limit(most)


@query("z4_priority_claim", "SELECT id, generation AS claim_generation FROM work WHERE status = 'pending' AND paused = 0 AND account_id IN ('0', '2') AND retry_at <= 1700000300000 ORDER BY CASE WHEN ttl_seconds > 0 THEN 0 WHEN origin = 'history' THEN 2 ELSE 1 END, id LIMIT 40")
def claim(c: Catalog) -> DataFrame:
    return claimed(c.work, ["0", "2"], 1_700_000_300_000, 40).select("id", F.col("generation").alias("claim_generation"))


def finished(work: DataFrame, status: Column) -> DataFrame:
    """Work after its claims end: a claim of an older generation puts the row back in the queue."""
    fresh = F.col("generation") == F.col("claim_generation")
    ends = (F.col("status") == "processing") & F.col("claim_generation").isNotNull()
    return work.withColumn("status", F.when(ends, F.when(fresh, status).otherwise("pending")).otherwise(F.col("status"))).withColumn("retry_at", F.when(ends & ~fresh, 0).otherwise(F.col("retry_at")))


@query("z5_fenced_finish", "SELECT id, CASE WHEN status = 'processing' THEN CASE WHEN generation = claim_generation THEN 'completed' ELSE 'pending' END ELSE status END AS status FROM work")
def finish(c: Catalog) -> DataFrame:
    return finished(c.work, F.lit("completed")).select("id", "status")


@query("z10_rescue_receipts", "SELECT d.id, CASE WHEN w.n IS NOT NULL THEN 1700000000000 + d.id * 50 END AS rescued_at, d.pending_until FROM downloads d LEFT JOIN (SELECT message_id, count(*) AS n FROM tombstones t GROUP BY message_id) w ON w.message_id = d.message_id + 100000 WHERE d.pending_until IS NOT NULL")
def rescue_receipts(c: Catalog) -> DataFrame:
    """Receipts meet downloads whichever came first: here as a join of both tables; a receipt marks its message rescued."""
    receipts = c.tombstones.groupBy((F.col("message_id") - 100_000).alias("message_id")).agg(F.count("*").alias("n"))
    rows = c.downloads.filter("pending_until IS NOT NULL").join(receipts, "message_id", "left")
    return rows.select("id", F.when(F.col("n").isNotNull(), F.col("id") * 50 + 1_700_000_000_000).alias("rescued_at"), "pending_until")
