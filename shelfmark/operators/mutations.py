"""Changes of tables as rewrites: merges, eviction, expiry, re-keying, ingest deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.define import query
from ..sources.catalog import Catalog
from .projections import page


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """changes replace rows of equal keys; for columns in keep_old an old value stays where the new one is null. Keys are unique on each side."""
    rest = [c for c in table.columns if c not in keys]
    old, new = table.withColumn("_old", F.lit(True)), changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_new"))
    value = lambda c: F.when(F.col("_new"), F.coalesce(f"_{c}", c) if c in keep_old else F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return old.join(new, keys, "full").select(*keys, *[value(c) for c in rest]).select(*table.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose keys are new; of new rows with equal keys one is added."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order; partial aggregation, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def eviction(files: DataFrame, cap: int, most: int, protected: Column) -> DataFrame:
    """id, freed of rows that go until the disk is under its cap, oldest first, `most` rows at most.

    files has id, path, size, created_at. A path counts its largest size once. A row frees its size if it is its path's
    last eligible row and the path has no protected row. Only `most` rows can go, so the oldest `most` are taken before
    anything is added up: the running sum is over that many rows.
    """
    used = files.filter("path <> ''").groupBy("path").agg(F.max(F.coalesce("size", F.lit(0))).alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("used"))
    marked = files.withColumn("kept", F.coalesce(protected, F.lit(False)))
    paths = marked.groupBy("path").agg(F.max("kept").alias("held"), F.max_by("id", F.when(~F.col("kept"), F.struct("created_at", "id"))).alias("last"))
    oldest = page(marked.filter("NOT kept AND path <> ''").select("id", "path", "size", "created_at"), [F.asc("created_at"), F.asc("id")], most)
    frees = oldest.join(paths, "path").withColumn("freed", F.when(~F.col("held") & (F.col("id") == F.col("last")), F.coalesce("size", F.lit(0))).otherwise(0))
    before = F.coalesce(F.sum("freed").over(Window.orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frees.withColumn("before", before).crossJoin(used).filter(F.col("used") - F.col("before") > cap).select("id", "freed")


@query("w4_eviction", """
WITH f AS (SELECT id, file_path AS path, file_size AS size, created_at, pinned = 1 OR rescued_at IS NOT NULL OR EXISTS (SELECT 1 FROM ingest_files i WHERE i.path = downloads.file_path) AS kept FROM downloads WHERE file_path IS NOT NULL),
used AS (SELECT sum(s) AS used FROM (SELECT max(size) AS s FROM f GROUP BY path)),
p AS (SELECT path, bool_or(kept) AS held, arg_max(id, [created_at, id]) FILTER (WHERE NOT kept) AS last FROM f GROUP BY path),
o AS (SELECT * FROM f WHERE NOT kept ORDER BY created_at, id LIMIT 200),
r AS (SELECT o.id, o.created_at, CASE WHEN NOT p.held AND o.id = p.last THEN o.size ELSE 0 END AS freed FROM o JOIN p ON p.path = o.path),
s AS (SELECT id, freed, coalesce(sum(freed) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT id, CAST(freed AS BIGINT) AS freed FROM s, used WHERE used - before > used * 9 // 10""")
def evicted(c: Catalog, most: int = 200) -> DataFrame:
    files = c.downloads.filter("file_path IS NOT NULL").select("id", F.col("file_path").alias("path"), F.col("file_size").alias("size"), "created_at", "pinned", "rescued_at")
    files = files.join(c.ingest_files.distinct().withColumn("busy", F.lit(True)), "path", "left")
    used = files.groupBy("path").agg(F.max("size").alias("s")).agg(F.sum("s")).first()[0] or 0
    return eviction(files, used * 9 // 10, most, (F.col("pinned") == 1) | F.col("rescued_at").isNotNull() | F.coalesce("busy", F.lit(False)))


@query("x1_upsert", "SELECT coalesce(d.group_id, n.group_id) AS group_id, coalesce(d.message_id, n.message_id) AS message_id, CASE WHEN n.message_id IS NULL THEN d.file_size ELSE n.file_size END AS file_size, CASE WHEN n.message_id IS NULL THEN d.file_hash ELSE coalesce(n.file_hash, d.file_hash) END AS file_hash FROM downloads d FULL OUTER JOIN (SELECT group_id, message_id, file_size * 2 AS file_size, CASE WHEN remote_id % 8 = 1 THEN NULL ELSE file_hash END AS file_hash FROM peer_downloads UNION ALL SELECT group_id, message_id, file_size, file_hash FROM (SELECT group_id, message_id, 0 AS file_size, NULL AS file_hash FROM tombstones)) n ON n.group_id = d.group_id AND n.message_id = d.message_id")
def upserted(c: Catalog) -> DataFrame:
    cols = ("group_id", "message_id", "file_size", "file_hash")
    new = c.peer_downloads.select("group_id", "message_id", (F.col("file_size") * 2).alias("file_size"), F.when(F.col("remote_id") % 8 != 1, F.col("file_hash")).alias("file_hash"))
    new = new.unionByName(c.tombstones.select("group_id", "message_id", F.lit(0).alias("file_size"), F.lit(None).cast("string").alias("file_hash")))
    return upsert(c.downloads.select(*cols), new, ["group_id", "message_id"], ("file_hash",))


@query("x4_insert_or_ignore", "SELECT group_id, message_id FROM downloads UNION SELECT group_id, message_id FROM tombstones")
def inserted(c: Catalog) -> DataFrame:
    keys = ["group_id", "message_id"]
    return insert_or_ignore(c.downloads.select(*keys), c.tombstones.select(*keys), keys)


@query("x5_orphan_paths", "SELECT DISTINCT file_path FROM downloads d WHERE pending_until IS NOT NULL AND rescued_at IS NULL AND file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM downloads o WHERE o.file_path = d.file_path AND (o.pending_until IS NULL OR o.rescued_at IS NOT NULL))")
def orphan_paths(c: Catalog) -> DataFrame:
    """After a cascade deletes rows (here those that expire and weren't rescued), the files that no row owns any more."""
    gone = c.downloads.filter("pending_until IS NOT NULL AND rescued_at IS NULL AND file_path IS NOT NULL").select("file_path").distinct()
    return gone.join(c.downloads.filter("pending_until IS NULL OR rescued_at IS NOT NULL").select("file_path"), "file_path", "left_anti")


@query("x6_tombstones", "SELECT group_id, message_id FROM tombstones UNION SELECT group_id, message_id FROM downloads WHERE nsfw_whitelist = 1")
def tombstoned(c: Catalog) -> DataFrame:
    keys = ["group_id", "message_id"]
    return insert_or_ignore(c.tombstones.select(*keys), c.downloads.filter("nsfw_whitelist = 1").select(*keys), keys)


def rekeyed(tables: dict[str, DataFrame], source: str, target: str, key: str = "group_id", number: str = "message_id") -> dict[str, DataFrame]:
    """Tables with one group renamed to another; ValueError if both hold a message of the same number."""
    for name, df in tables.items():
        if number in df.columns and not df.filter(F.col(key) == source).select(number).join(df.filter(F.col(key) == target).select(number), number, "left_semi").isEmpty():
            raise ValueError(f"{name}: both groups hold a message of the same number")
    return {name: df.withColumn(key, F.when(F.col(key) == source, F.lit(target)).otherwise(F.col(key))) for name, df in tables.items()}


@query("x7_rekey_group", "SELECT CASE WHEN group_id = 'src7' THEN 'src8' ELSE group_id END AS group_id, count(*) AS n FROM downloads GROUP BY 1")
def rekey(c: Catalog) -> DataFrame:
    return rekeyed({"downloads": c.downloads, "tombstones": c.tombstones}, "src7", "src8")["downloads"].groupBy("group_id").agg(F.count("*").alias("n"))


@query("x8_insert_select_where", "SELECT 3 AS destination_id, id AS download_id, file_path AS remote_path FROM downloads d WHERE file_path <> '' AND NOT EXISTS (SELECT 1 FROM backup_jobs j WHERE j.destination_id = 3 AND j.download_id = d.id)")
def jobs_to_add(c: Catalog, destination: int = 3) -> DataFrame:
    rows = c.downloads.filter("file_path <> ''").select(F.col("id").alias("download_id"), F.replace("file_path", F.lit("\\"), F.lit("/")).alias("remote_path"))
    return rows.join(c.backup_jobs.filter(F.col("destination_id") == destination).select("download_id"), "download_id", "left_anti").select(F.lit(destination).alias("destination_id"), "download_id", "remote_path")


@query("x9_expired", "SELECT id, group_id, file_path FROM downloads WHERE pending_until < 1700000060000 AND rescued_at IS NULL AND coalesce(pinned, 0) = 0 ORDER BY pending_until, id LIMIT 500")
def expired(c: Catalog, now: int = 1_700_000_060_000, limit: int = 500) -> DataFrame:
    rows = c.downloads.filter((F.col("pending_until") < now) & F.col("rescued_at").isNull() & (F.coalesce("pinned", F.lit(0)) == 0))
    return page(rows.select("id", "group_id", "file_path", "pending_until"), [F.asc("pending_until"), F.asc("id")], limit).drop("pending_until")


def integrity_verdicts(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """id, verdict, size: rows (id, path, size) against files (path, found, regular): gone or empty files are pruned, other sizes fixed."""
    both = rows.join(listing, "path", "left")
    verdict = F.when(F.col("found").isNull(), "prune").when(~F.coalesce("regular", F.lit(True)), "keep").when(F.col("found") <= 0, "prune").when(~F.col("size").eqNullSafe(F.col("found")), "fix-size").otherwise("keep")
    return both.select("id", verdict.alias("verdict"), F.when(verdict == "fix-size", F.col("found")).alias("size"))


@query("x10_integrity", "SELECT d.id, CASE WHEN p.size IS NULL OR p.size <= 0 THEN 'prune' WHEN p.size <> d.file_size THEN 'fix-size' ELSE 'keep' END AS verdict, CASE WHEN p.size > 0 AND p.size <> d.file_size THEN p.size END AS size FROM downloads d LEFT JOIN (SELECT file_path, max(file_size) - CASE WHEN min(id) % 6 = 0 THEN max(file_size) ELSE 0 END AS size FROM downloads WHERE file_path IS NOT NULL GROUP BY file_path) p ON p.file_path = d.file_path WHERE d.file_path IS NOT NULL")
def integrity(c: Catalog) -> DataFrame:
    listing = c.downloads.filter("file_path IS NOT NULL").groupBy(F.col("file_path").alias("path")).agg((F.max("file_size") - F.when(F.min("id") % 6 == 0, F.max("file_size")).otherwise(0)).alias("found"), F.lit(True).alias("regular"))
    return integrity_verdicts(c.downloads.filter("file_path IS NOT NULL").select("id", F.col("file_path").alias("path"), F.col("file_size").alias("size")), listing)


@query("x11_bulk_reclassify", "SELECT id, CASE WHEN id IN (3, 17, 34) THEN 1 ELSE nsfw_whitelist END AS nsfw_whitelist, CASE WHEN id IN (5, 9) THEN NULL ELSE nsfw_score END AS nsfw_score FROM downloads")
def bulk(c: Catalog, whitelist: tuple[int, ...] = (3, 17, 34), clear: tuple[int, ...] = (5, 9)) -> DataFrame:
    return c.downloads.select("id", F.when(F.col("id").isin(*whitelist), 1).otherwise(F.col("nsfw_whitelist")).alias("nsfw_whitelist"), F.when(~F.col("id").isin(*clear), F.col("nsfw_score")).alias("nsfw_score"))


@query("x12_additive_columns", "SELECT id, file_name, message_id FROM downloads UNION ALL SELECT remote_id AS id, NULL AS file_name, NULL::BIGINT AS message_id FROM peer_downloads")
def additive(c: Catalog) -> DataFrame:
    return c.downloads.select("id", "file_name", "message_id").unionByName(c.peer_downloads.select(F.col("remote_id").alias("id")), allowMissingColumns=True)


def reusable(items: DataFrame, files: DataFrame) -> DataFrame:
    """item, path, by: what an incoming item (item, kind, media_id, size, hash) can reuse: first by identity and size, then by content.

    files has id, path, kind, media_id, size, hash. A path whose rows disagree about its hash is no evidence.
    """
    held = files.filter("path IS NOT NULL")
    sound = held.filter("hash <> ''").groupBy("path").agg((F.min(F.lower("hash")) == F.max(F.lower("hash"))).alias("sound"))
    held = held.join(sound, "path", "left").filter(F.coalesce("sound", F.lit(True)))
    by_id = held.groupBy("kind", "media_id", "size").agg(F.min_by("path", "id").alias("by_id"))
    by_hash = held.filter("hash <> ''").groupBy(F.lower("hash").alias("hash"), "size").agg(F.min_by("path", "id").alias("by_hash"))
    got = items.withColumn("hash", F.lower("hash")).join(by_id, ["kind", "media_id", "size"], "left").join(by_hash, ["hash", "size"], "left")
    return got.select("item", F.coalesce("by_id", "by_hash").alias("path"), F.when(F.col("by_id").isNotNull(), "identity").when(F.col("by_hash").isNotNull(), "content").alias("by"))


@query("x13_ingest_reuse", """
WITH held AS (SELECT d.*, file_path AS path FROM downloads d WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM downloads WHERE file_path IS NOT NULL AND file_hash IS NOT NULL GROUP BY file_path HAVING min(file_hash) <> max(file_hash))),
i AS (SELECT telegram_media_kind AS k, telegram_media_id AS m, file_size AS s, arg_min(path, id) AS p FROM held GROUP BY 1, 2, 3), h AS (SELECT file_hash AS hs, file_size AS s, arg_min(path, id) AS p FROM held WHERE file_hash IS NOT NULL GROUP BY 1, 2)
SELECT n.remote_id AS item, coalesce(i.p, h.p) AS path, CASE WHEN i.p IS NOT NULL THEN 'identity' WHEN h.p IS NOT NULL THEN 'content' END AS by FROM (SELECT p.*, d.telegram_media_kind, d.telegram_media_id FROM peer_downloads p JOIN downloads d ON d.id = p.remote_id) n
LEFT JOIN i ON i.k = n.telegram_media_kind AND i.m = n.telegram_media_id AND i.s = n.file_size LEFT JOIN h ON h.hs = n.file_hash AND h.s = n.file_size""")
def ingest_reuse(c: Catalog) -> DataFrame:
    files = c.downloads.select("id", F.col("file_path").alias("path"), F.col("telegram_media_kind").alias("kind"), F.col("telegram_media_id").alias("media_id"), F.col("file_size").alias("size"), F.col("file_hash").alias("hash"))
    known = c.downloads.select(F.col("id").alias("item"), F.col("telegram_media_kind").alias("kind"), F.col("telegram_media_id").alias("media_id"))
    return reusable(c.peer_downloads.select(F.col("remote_id").alias("item"), F.col("file_size").alias("size"), F.col("file_hash").alias("hash")).join(known, "item"), files)


@query("x14_identity_reservation", "SELECT lower(trim(telegram_media_kind)) || '|' || trim(telegram_media_id) || '|' || CAST(file_size AS VARCHAR) AS identity, min(id) AS id FROM downloads WHERE telegram_media_id IS NOT NULL GROUP BY 1")
def reserved(c: Catalog) -> DataFrame:
    """One owner for each media identity: the first row that names it."""
    identity = F.concat_ws("|", F.lower(F.trim("telegram_media_kind")), F.trim("telegram_media_id"), "file_size")
    return c.downloads.filter("telegram_media_id IS NOT NULL").groupBy(identity.alias("identity")).agg(F.min("id").alias("id"))


# ---- the ordered fold that batch and stream share ----


def newer(old: dict | None, new: dict, comparable: bool = True, repair: bool = False) -> str:
    """What becomes of an observation of a message: 'replace', 'watermark' (only its order number counts) or 'ignore'."""
    if old is None:
        return "replace"
    same_source = comparable or new["account_id"] == old["account_id"]
    if new["version"] > old["version"]:
        return "replace"
    if new["version"] == old["version"]:
        if new["identity"] != old["identity"]:
            return "replace" if new["source_pts"] > old["source_pts"] and same_source else "ignore"
        lifts = new["origin"] != "live" and ((old["origin"] == "live" and old["status"] == "pending") or (new["origin"] == "url" and old["origin"] != "url" and old["status"] in ("pending", "processing")))
        if lifts or (repair and old["status"] in ("completed", "skipped", "failed")):
            return "replace"
        return "watermark" if same_source else "ignore"
    return "ignore"


def fold(old: dict | None, new: dict, comparable: bool = True, repair: bool = False) -> dict:
    """The state of one message after an observation."""
    what = newer(old, new, comparable, repair)
    if what == "ignore":
        return old
    if what == "watermark":
        return old | {"source_pts": max(old["source_pts"], new["source_pts"])}
    if old is None:
        return new | {"generation": 0, "status": "pending"}
    same = new["version"] == old["version"] and new["identity"] == old["identity"] and (comparable or new["account_id"] == old["account_id"])
    return new | {
        "source_pts": max(old["source_pts"], new["source_pts"]) if same else new["source_pts"],
        "generation": old["generation"] + 1,
        "status": "processing" if old["status"] == "processing" else "pending",
        "origin": "url" if new["origin"] == "url" else old["origin"] if old["origin"] != "live" else new["origin"],
        "ttl_seconds": max(old["ttl_seconds"], new["ttl_seconds"]),
    }


FOLD_KEYS = ("group_id", "message_id")
FOLD_COLUMNS = ("account_id", "version", "source_pts", "identity", "origin", "ttl_seconds")
FOLD_SCHEMA = "group_id string, message_id long, account_id string, version long, source_pts long, identity string, origin string, ttl_seconds long, generation long, status string"


def with_comparable(rows: DataFrame) -> DataFrame:
    return rows if "comparable" in rows.columns else rows.withColumn("comparable", F.lit(True))


def folded(observations: DataFrame) -> DataFrame:
    """The last state of each message, observations taken in the order of `seq`; `comparable` (if there; else true) says of

    an observation whether order numbers of different accounts compare: they do in channels and for stories. Sorted rows pass by: only the state of one message is held."""
    names = [x.split()[0] for x in FOLD_SCHEMA.split(", ")]

    def run(batches):
        import pyarrow as pa

        key = state = None
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string() if n in ("group_id", "account_id", "identity", "origin", "status") else pa.int64()) for n in names], names=names)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mine = tuple(r[k] for k in FOLD_KEYS)
                if state is not None and mine != key:
                    out.append(dict(zip(FOLD_KEYS, key, strict=True)) | state)
                    state = None
                key, state = mine, fold(state, {k: r[k] for k in FOLD_COLUMNS}, bool(r["comparable"]))
            if out:
                yield done(out)
        if state is not None:
            yield done([dict(zip(FOLD_KEYS, key, strict=True)) | state])

    rows = with_comparable(observations).select(*FOLD_KEYS, *FOLD_COLUMNS, "comparable", "seq").repartition(*FOLD_KEYS)
    return rows.sortWithinPartitions(*FOLD_KEYS, "seq").mapInArrow(run, FOLD_SCHEMA)


def observations(c: Catalog) -> DataFrame:
    """Updates of messages, as the events at hand give them."""
    i = F.col("event_id")
    return c.events.select(F.col("user_id").cast("string").alias("group_id"), (i % 4).alias("message_id"), (i % 3).cast("string").alias("account_id"), F.floor(i / 700).alias("version"), ((i * 37) % 1009).alias("source_pts"), F.col("event_type").alias("identity"), F.when(i % 7 == 0, "url").when(i % 5 == 0, "history").otherwise("live").alias("origin"), F.when(i % 11 == 0, 30).otherwise(0).cast("long").alias("ttl_seconds"), i.alias("seq"))


def of_channels(rows: DataFrame) -> DataFrame:
    """Observations with `comparable`: groups with an even id are channels, so that their order numbers compare across accounts."""
    return rows.withColumn("comparable", F.col("group_id").cast("long") % 2 == 0)


#: The fold in SQL, an observation a step; the messages at hand are always pending.
FOLD_SQL = """
WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS group_id, event_id % 4 AS message_id, CAST(event_id % 3 AS VARCHAR) AS account_id, event_id // 700 AS version, (event_id * 37) % 1009 AS source_pts, event_type AS identity,
  CASE WHEN event_id % 7 = 0 THEN 'url' WHEN event_id % 5 = 0 THEN 'history' ELSE 'live' END AS origin, CAST(CASE WHEN event_id % 11 = 0 THEN 30 ELSE 0 END AS BIGINT) AS ttl_seconds, user_id % 2 = 0 AS comparable,
  row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS n FROM events),
s AS (
  SELECT group_id, message_id, account_id, version, source_pts, identity, origin, ttl_seconds, CAST(0 AS BIGINT) AS generation, 'pending' AS status, n FROM o WHERE n = 1
  UNION ALL
  SELECT group_id, message_id, CASE WHEN wins THEN new.account_id ELSE old.account_id END, CASE WHEN wins THEN new.version ELSE old.version END,
    CASE WHEN wins AND NOT (level AND same_identity AND same_order) THEN new.source_pts WHEN wins OR (level AND same_identity AND same_order) THEN greatest(old.source_pts, new.source_pts) ELSE old.source_pts END,
    CASE WHEN wins THEN new.identity ELSE old.identity END, CASE WHEN wins AND (new.origin = 'url' OR old.origin = 'live') THEN new.origin ELSE old.origin END,
    CASE WHEN wins THEN greatest(old.ttl_seconds, new.ttl_seconds) ELSE old.ttl_seconds END, old.generation + CASE WHEN wins THEN 1 ELSE 0 END, 'pending', n
  FROM (SELECT *, new.version > old.version OR (level AND NOT same_identity AND same_order AND new.source_pts > old.source_pts)
      OR (level AND same_identity AND new.origin <> 'live' AND (old.origin = 'live' OR (new.origin = 'url' AND old.origin <> 'url'))) AS wins
    FROM (SELECT o.group_id, o.message_id, o.n, s AS old, o AS new, o.version = s.version AS level, o.identity IS NOT DISTINCT FROM s.identity AS same_identity, o.comparable OR o.account_id = s.account_id AS same_order
      FROM s JOIN o ON o.group_id = s.group_id AND o.message_id = s.message_id AND o.n = s.n + 1)))
SELECT group_id, message_id, account_id, version, source_pts, identity, origin, ttl_seconds, generation, status FROM (SELECT *, max(n) OVER (PARTITION BY group_id, message_id) AS last FROM s) WHERE n = last"""


@query("x2_guarded_upsert", FOLD_SQL)
def guarded(c: Catalog) -> DataFrame:
    return folded(of_channels(observations(c)))


@query("x3_watermarks", "SELECT group_id, message_id, max(source_pts) AS source_pts FROM (SELECT CAST(user_id AS VARCHAR) AS group_id, event_id % 4 AS message_id, event_id // 700 AS version, (event_id * 37) % 1009 AS source_pts FROM events) o WHERE version = (SELECT max(event_id // 700) FROM events e WHERE CAST(e.user_id AS VARCHAR) = o.group_id AND e.event_id % 4 = o.message_id) GROUP BY group_id, message_id")
def watermarks(c: Catalog) -> DataFrame:
    """The highest order number that was seen of each message's newest version."""
    rows = observations(c).select("group_id", "message_id", F.struct("version", "source_pts").alias("w"))
    return rows.groupBy("group_id", "message_id").agg(F.max("w.source_pts").alias("all"), F.max("w").alias("w")).select("group_id", "message_id", F.col("w.source_pts").alias("source_pts"))
