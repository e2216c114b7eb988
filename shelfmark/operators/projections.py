"""Bounded read projections over the catalogue.

Every listing ends in a sort whose last key is unique, so pages are the same from run to run, and a limit that Spark
plans as a top-k; joins that only decorate a page come after the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.params import bins, candidate_limit, page_limit
from ..plans.define import query
from ..sources.catalog import Catalog

KINDS = {"images": "photo", "videos": "video", "audio": "audio", "documents": "document"}
AI_TYPES = ("photo", "video")
#: Half-open tiers of the review score: (name, from, to).
TIERS = (("def_not", 0.0, 0.3), ("maybe_not", 0.3, 0.5), ("maybe", 0.5, 0.7), ("likely", 0.7, 0.9), ("def", 0.9, 1.01))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def good_name(name: Column) -> Column:
    """Whether a group's name tells more than its id. GLOB '-?[0-9]*' is a minus, any one character, a digit, anything."""
    return name.isNotNull() & (name != "") & ~name.isin("Unknown", "unknown") & ~name.rlike(r"^-.[0-9]") & ~name.rlike(r"^Group [0-9]")


@query("r1_group_aggregates", r"""
SELECT group_id, max(CASE WHEN group_name IS NOT NULL AND group_name NOT IN ('', 'Unknown', 'unknown') AND NOT regexp_matches(group_name, '^-.[0-9]') AND NOT regexp_matches(group_name, '^Group [0-9]') THEN group_name END) AS best_name,
       max(group_name) AS any_name, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS size FROM downloads GROUP BY group_id""")
def group_aggregates(c: Catalog) -> DataFrame:
    name = F.col("group_name")
    return c.downloads.groupBy("group_id").agg(F.max(F.when(good_name(name), name)).alias("best_name"), F.max(name).alias("any_name"), F.count("*").alias("count"), F.sum("file_size").alias("size"))


@query("r2_stats", "SELECT count(*) AS count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS size FROM downloads")
def stats(c: Catalog) -> DataFrame:
    return c.downloads.agg(F.count("*").alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"))


@query("r3_group_stats", """
SELECT count(*) AS total, CAST(coalesce(sum(coalesce(file_size, 0)), 0) AS BIGINT) AS size, min(CASE WHEN file_type IS DISTINCT FROM 'stories' THEN message_id END) AS first_message,
       max(CASE WHEN file_type IS DISTINCT FROM 'stories' THEN message_id END) AS last_message, max(created_at) AS last_created FROM downloads WHERE group_id = 'src3'""")
def group_stats(c: Catalog, group: str = "src3") -> DataFrame:
    told = F.when(~F.col("file_type").eqNullSafe("stories"), F.col("message_id"))
    return c.downloads.filter(F.col("group_id") == group).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.coalesce("file_size", F.lit(0))), F.lit(0)).alias("size"), F.min(told).alias("first_message"), F.max(told).alias("last_message"), F.max("created_at").alias("last_created"))


@query("r3_group_type_counts", "SELECT coalesce(file_type, 'other') AS file_type, count(*) AS n FROM downloads WHERE group_id = 'src3' GROUP BY coalesce(file_type, 'other')")
def group_type_counts(c: Catalog, group: str = "src3") -> DataFrame:
    return c.downloads.filter(F.col("group_id") == group).groupBy(F.coalesce("file_type", F.lit("other")).alias("file_type")).agg(F.count("*").alias("n"))


@query("r4_group_files", """
SELECT p.*, t.total, 10 + 50 < t.total AS has_more FROM (SELECT id, message_id, file_name, file_path, file_type, file_size, created_at, nsfw_score FROM downloads WHERE group_id = 'src3' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10) p
CROSS JOIN (SELECT count(*) AS total FROM downloads WHERE group_id = 'src3') t""")
def group_files(c: Catalog, group: str = "src3", kind: str | None = None, limit: int = 50, offset: int = 10) -> DataFrame:
    rows = c.downloads.filter(F.col("group_id") == group)
    rows = rows.filter(F.col("file_type") == kind) if kind else rows
    limit = page_limit(limit, 50, 500)
    shown = page(rows.select("id", "message_id", "file_name", "file_path", "file_type", "file_size", "created_at", "nsfw_score"), [F.desc("created_at"), F.desc("id")], limit, offset)
    return shown.crossJoin(rows.agg(F.count("*").alias("total"))).withColumn("has_more", F.lit(offset + limit) < F.col("total"))  # one row


_MEDIA = ("id", "group_id", "group_name", "file_name", "file_path", "file_size", "file_type", "created_at", "pending_until", "rescued_at", "pinned")
_MEDIA_SQL = ", ".join(f"d.{x}" for x in _MEDIA)


def _media_page(c: Catalog, rows: DataFrame, pinned_first: bool, limit: int, offset: int) -> DataFrame:
    order = [F.desc("created_at"), F.desc("id")]
    shown = page(rows.select(*_MEDIA), [F.desc("pinned"), *order] if pinned_first else order, limit, offset)
    return shown.join(c.seekbar_sprites.select(F.col("download_id").alias("id"), "duration_sec"), "id", "left")


@query("r5_downloads_all", f"SELECT {_MEDIA_SQL}, sb.duration_sec FROM (SELECT * FROM downloads WHERE file_type = 'video' ORDER BY pinned DESC, created_at DESC, id DESC LIMIT 50) d LEFT JOIN seekbar_sprites sb ON sb.download_id = d.id")
def downloads_all(c: Catalog, kind: str = "videos", pinned_only: bool = False, pinned_first: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = c.downloads.filter(F.col("file_type") == KINDS[kind]) if kind in KINDS else c.downloads
    return _media_page(c, rows.filter("pinned = 1") if pinned_only else rows, pinned_first, page_limit(limit, 50, 500), offset)


@query("r6_downloads_group", f"SELECT {_MEDIA_SQL}, sb.duration_sec FROM (SELECT * FROM downloads WHERE group_id = 'src1' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5) d LEFT JOIN seekbar_sprites sb ON sb.download_id = d.id")
def downloads_group(c: Catalog, group: str = "src1", kind: str = "anything", pinned_only: bool = False, limit: int = 50, offset: int = 5) -> DataFrame:
    rows = c.downloads.filter(F.col("group_id") == group)
    rows = rows.filter(F.col("file_type") == KINDS[kind]) if kind in KINDS else rows  # an unknown type is no filter
    return _media_page(c, rows.filter("pinned = 1") if pinned_only else rows, False, page_limit(limit, 50, 500), offset)


@query("r7_downloads_by_ids", "SELECT id, group_id, file_name, file_size FROM downloads WHERE id IN (1, 5, 7, 150)")
def downloads_by_ids(c: Catalog, ids: tuple[int, ...] = (5, 1, 5, -3, 0, 7, 150, 99_999_999)) -> DataFrame:
    """At most 500 ids; more are refused."""
    if len(ids) > 500:
        raise ValueError(f"{len(ids)} ids, at most 500 are taken")
    wanted = sorted({i for i in ids if i > 0})
    return c.downloads.filter(F.col("id").isin(wanted)).select("id", "group_id", "file_name", "file_size").orderBy("id")


@query("r8_group_download_ids", "SELECT id FROM downloads WHERE group_id = 'src2' AND id < 150 ORDER BY id DESC LIMIT 500")
def group_download_ids(c: Catalog, group: str = "src2", before: int = 150, limit: int = 500) -> DataFrame:
    return page(c.downloads.filter((F.col("group_id") == group) & (F.col("id") < before)).select("id"), [F.desc("id")], candidate_limit(limit, 500, 500))


@query("r10_thumbs_list", "SELECT id, file_name, file_type, file_size, file_path, substring(sha256(CAST(id AS VARCHAR) || ':320'), 1, 32) || '.webp' AS cache_name FROM downloads WHERE file_type IN ('photo', 'video') AND file_path IS NOT NULL AND id < 190 ORDER BY id DESC LIMIT 60")
def thumbs_list(c: Catalog, kinds: tuple[str, ...] = AI_TYPES, before: int = 190, width: int = 320, limit: int = 60) -> DataFrame:
    rows = c.downloads.filter(F.col("file_type").isin(*kinds) & F.col("file_path").isNotNull() & (F.col("id") < before)).select("id", "file_name", "file_type", "file_size", "file_path")
    cache = F.concat(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{width}")), 256), 1, 32), F.lit(".webp"))
    return page(rows, [F.desc("id")], page_limit(limit, 60, 200)).withColumn("cache_name", cache)


@query("r11_seekbar_list", "SELECT s.download_id, s.bytes, s.frames, s.cols, s.row_count, s.duration_sec, s.format, s.generated_at, d.file_name FROM seekbar_sprites s JOIN downloads d ON d.id = s.download_id ORDER BY s.generated_at DESC, s.download_id DESC LIMIT 50")
def seekbar_list(c: Catalog, limit: int = 50, offset: int = 0) -> DataFrame:
    both = c.seekbar_sprites.join(c.downloads.select(F.col("id").alias("download_id"), "file_name"), "download_id")
    return page(both.select("download_id", "bytes", "frames", "cols", "row_count", "duration_sec", "format", "generated_at", "file_name"), [F.desc("generated_at"), F.desc("download_id")], page_limit(limit, 50, 200), offset)


@query("r12_seekbar_stats", "SELECT s.sprites, s.bytes, v.videos FROM (SELECT count(*) AS sprites, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM seekbar_sprites) s CROSS JOIN (SELECT count(*) AS videos FROM downloads WHERE file_type = 'video' AND file_path IS NOT NULL) v")
def seekbar_stats(c: Catalog) -> DataFrame:
    sprites = c.seekbar_sprites.agg(F.count("*").alias("sprites"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sprites.crossJoin(c.downloads.filter("file_type = 'video' AND file_path IS NOT NULL").agg(F.count("*").alias("videos")))  # two single rows


@query("r13_seekbar_candidates", "SELECT d.id, d.file_path FROM downloads d WHERE d.file_type = 'video' AND d.file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seekbar_sprites s WHERE s.download_id = d.id) ORDER BY d.id DESC LIMIT 200")
def seekbar_candidates(c: Catalog, before: int | None = None, limit: int = 200) -> DataFrame:
    rows = c.downloads.filter("file_type = 'video' AND file_path IS NOT NULL")
    rows = rows.filter(F.col("id") < before) if before else rows
    return page(rows.join(c.seekbar_sprites.select(F.col("download_id").alias("id")), "id", "left_anti").select("id", "file_path"), [F.desc("id")], candidate_limit(limit, 200, 2000))


@query("r14_faststart_candidates", "SELECT id, file_path FROM downloads WHERE file_type = 'video' AND file_path IS NOT NULL AND id > 20 ORDER BY id LIMIT 50")
def faststart_candidates(c: Catalog, after: int = 20, limit: int = 50) -> DataFrame:
    return page(c.downloads.filter((F.col("file_type") == "video") & F.col("file_path").isNotNull() & (F.col("id") > after)).select("id", "file_path"), [F.asc("id")], candidate_limit(limit, 50, 500))


@query("r15_faststart_stats", "SELECT count(*) AS videos FROM downloads WHERE file_type = 'video' AND file_path IS NOT NULL")
def faststart_stats(c: Catalog) -> DataFrame:
    return c.downloads.filter("file_type = 'video' AND file_path IS NOT NULL").agg(F.count("*").alias("videos"))


@query("r16_integrity_candidates", "SELECT id, file_path, file_size FROM downloads WHERE file_path IS NOT NULL AND id > 64 ORDER BY id LIMIT 64")
def integrity_candidates(c: Catalog, after: int = 64, limit: int = 64) -> DataFrame:
    return page(c.downloads.filter(F.col("file_path").isNotNull() & (F.col("id") > after)).select("id", "file_path", "file_size"), [F.asc("id")], candidate_limit(limit, 64, 2000))


@query("r17_integrity_check", """
SELECT 'duplicate download id' AS fault, count(*) AS n FROM (SELECT id FROM downloads GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'face without download', count(*) FROM faces f WHERE NOT EXISTS (SELECT 1 FROM downloads d WHERE d.id = f.download_id)
UNION ALL SELECT 'face without person', count(*) FROM faces f WHERE person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.id = f.person_id)
UNION ALL SELECT 'link without download', count(*) FROM share_links s WHERE NOT EXISTS (SELECT 1 FROM downloads d WHERE d.id = s.download_id)""")
def integrity_check(c: Catalog) -> DataFrame:
    def orphans(fault: str, rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col("id").alias(key)), key, "left_anti").agg(F.lit(fault).alias("fault"), F.count("*").alias("n"))

    twice = c.downloads.groupBy("id").count().filter("count > 1").agg(F.lit("duplicate download id").alias("fault"), F.count("*").alias("n"))
    return twice.union(orphans("face without download", c.faces, "download_id", c.downloads)).union(orphans("face without person", c.faces, "person_id", c.people)).union(orphans("link without download", c.share_links, "download_id", c.downloads))


@query("r18_dedup_stats", "SELECT count(*) AS total, count(file_hash) AS hashed, count(*) FILTER (WHERE file_hash IS NULL AND file_path IS NOT NULL AND coalesce(file_size, 0) > 0) AS missing FROM downloads")
def dedup_stats(c: Catalog) -> DataFrame:
    return c.downloads.agg(F.count("*").alias("total"), F.count("file_hash").alias("hashed"), F.count_if(F.expr("file_hash IS NULL AND file_path IS NOT NULL AND coalesce(file_size, 0) > 0")).alias("missing"))


@query("r19_dedup_groups", "SELECT file_hash, count(*) AS n, max(file_size) AS size FROM downloads WHERE file_hash > '1' GROUP BY file_hash HAVING count(*) > 1 ORDER BY file_hash LIMIT 5000")
def dedup_groups(c: Catalog, after: str = "1", limit: int = 5000) -> DataFrame:
    return page(c.downloads.filter(F.col("file_hash") > after).groupBy("file_hash").agg(F.count("*").alias("n"), F.max("file_size").alias("size")).filter("n > 1"), [F.asc("file_hash")], limit)


@query("r20_dedup_files", "SELECT file_hash, id, group_id, file_name, file_size, created_at FROM downloads WHERE file_hash IN (SELECT file_hash FROM downloads WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1 ORDER BY file_hash LIMIT 500)")
def dedup_files(c: Catalog, most: int = 500) -> DataFrame:
    hashes = page(c.downloads.filter("file_hash IS NOT NULL").groupBy("file_hash").agg(F.count("*").alias("n")).filter("n > 1"), [F.asc("file_hash")], most).select("file_hash")
    return c.downloads.join(F.broadcast(hashes), "file_hash", "left_semi").select("file_hash", "id", "group_id", "file_name", "file_size", "created_at").orderBy("file_hash", "created_at", "id")  # at most 500 hashes


@query("r21_dedup_candidates", "SELECT id, file_path, file_size FROM downloads WHERE file_hash IS NULL AND file_path IS NOT NULL AND coalesce(file_size, 0) > 0 AND id > 0 ORDER BY id LIMIT 200")
def dedup_candidates(c: Catalog, after: int = 0, limit: int = 200) -> DataFrame:
    return page(c.downloads.filter("file_hash IS NULL AND file_path IS NOT NULL AND coalesce(file_size, 0) > 0").filter(F.col("id") > after).select("id", "file_path", "file_size"), [F.asc("id")], candidate_limit(limit, 200, 1000))


@query("r22_disk_rotator_candidates", "SELECT id, group_id, file_path, file_size FROM downloads WHERE pinned = 0 ORDER BY created_at, id LIMIT 50")
def disk_rotator_candidates(c: Catalog, limit: int = 50) -> DataFrame:
    return page(c.downloads.filter("pinned = 0").select("id", "group_id", "file_path", "file_size", "created_at"), [F.asc("created_at"), F.asc("id")], candidate_limit(limit, 50, 500)).drop("created_at")


@query("r23_faces_by_download", "SELECT f.id, f.x, f.y, f.w, f.h, f.person_id, f.quality_score, p.label FROM faces f LEFT JOIN people p ON p.id = f.person_id WHERE f.download_id = 17")
def faces_by_download(c: Catalog, download: int = 17) -> DataFrame:
    return c.faces.filter(F.col("download_id") == download).join(c.people.select(F.col("id").alias("person_id"), "label"), "person_id", "left").select("id", "x", "y", "w", "h", "person_id", "quality_score", "label")


@query("r24_face_embeddings", "SELECT id, download_id, quality_score, length(embedding) AS dim FROM faces WHERE id > 100 ORDER BY id LIMIT 500")
def face_embeddings(c: Catalog, after: int = 100, limit: int = 500) -> DataFrame:
    return page(c.faces.filter(F.col("id") > after).select("id", "download_id", "quality_score", F.size("embedding").cast("long").alias("dim")), [F.asc("id")], page_limit(limit, 500, 2000))


@query("r25_person_groups", "SELECT p.id, p.label, p.face_count, f.face AS download_id FROM people p LEFT JOIN (SELECT person_id, min_by(download_id, id) AS face FROM faces GROUP BY person_id) f ON f.person_id = p.id ORDER BY p.face_count DESC, p.id LIMIT 200")
def person_groups(c: Catalog, limit: int = 200) -> DataFrame:
    first = c.faces.filter("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.min_by("download_id", "id").alias("download_id"))
    return page(c.people.join(first, "id", "left").select("id", "label", "face_count", "download_id"), [F.desc("face_count"), F.asc("id")], limit)


@query("r26_person_photos", """
WITH ranked AS (SELECT download_id, id AS face_id, x, y, w, h, row_number() OVER (PARTITION BY download_id ORDER BY coalesce(quality_score, 0) DESC, w * h DESC, id) AS rn FROM faces WHERE person_id = 3)
SELECT d.id, d.file_name, d.file_type, d.created_at, r.face_id, r.x, r.y, r.w, r.h FROM ranked r JOIN downloads d ON d.id = r.download_id WHERE r.rn = 1 ORDER BY d.created_at DESC, d.id DESC LIMIT 50""")
def person_photos(c: Catalog, person: int = 3, limit: int = 50, offset: int = 0) -> DataFrame:
    best = Window.partitionBy("download_id").orderBy(F.desc(F.coalesce("quality_score", F.lit(0.0))), F.desc(F.col("w") * F.col("h")), "id")
    faces = c.faces.filter(F.col("person_id") == person).withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(F.col("download_id"), F.col("id").alias("face_id"), "x", "y", "w", "h")
    rows = c.downloads.select("id", "file_name", "file_type", "created_at").join(faces, F.col("id") == F.col("download_id")).drop("download_id")
    return page(rows, [F.desc("created_at"), F.desc("id")], page_limit(limit, 50, 200), offset)


PEOPLE_ORDERS = {
    ("face_count", "desc"): [F.desc, "face_count"], ("face_count", "asc"): [F.asc, "face_count"],
    ("avg_quality", "desc"): [F.desc, "avg_quality"], ("avg_quality", "asc"): [F.asc, "avg_quality"],
    ("name", "asc"): [F.asc_nulls_first, "name"], ("name", "desc"): [F.desc_nulls_last, "name"],
}


def _people_sql(order: str) -> str:
    return f"""
SELECT p.id, p.label, p.face_count, c.cover_face_id, c.cover_download_id, coalesce(v.n, 0) AS video_face_count, round(coalesce(q.q, 0), 6) AS avg_quality FROM people p
LEFT JOIN (SELECT person_id, arg_max(id, [coalesce(quality_score, 0), w * h, CAST(-id AS DOUBLE)]) AS cover_face_id, arg_max(download_id, [coalesce(quality_score, 0), w * h, CAST(-id AS DOUBLE)]) AS cover_download_id FROM faces GROUP BY person_id) c ON c.person_id = p.id
LEFT JOIN (SELECT f.person_id, count(*) AS n FROM faces f JOIN downloads d ON d.id = f.download_id WHERE d.file_type = 'video' GROUP BY f.person_id) v ON v.person_id = p.id
LEFT JOIN (SELECT person_id, avg(quality_score) AS q FROM faces GROUP BY person_id) q ON q.person_id = p.id ORDER BY {order}, p.id LIMIT 5"""


def people(c: Catalog, sort: str = "face_count", direction: str = "desc", limit: int = 5, offset: int = 0) -> DataFrame:
    """People with their best face, their faces in videos, and mean quality; the page is cut before it is decorated."""
    quality = c.faces.filter("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.max_by(F.struct(F.col("id").alias("f"), "download_id"), F.struct(F.coalesce("quality_score", F.lit(0.0)), F.col("w") * F.col("h"), -F.col("id"))).alias("cover"))
    direction_of, key = PEOPLE_ORDERS[sort, direction]
    rows = c.people.withColumn("name", F.lower("label"))
    rows = page(rows.join(quality, "id", "left").withColumn("avg_quality", F.coalesce("avg_quality", F.lit(0.0))), [direction_of(key), F.asc("id")], page_limit(limit, 50, 500), offset)
    videos = c.faces.join(c.downloads.filter("file_type = 'video'").select(F.col("id").alias("download_id")), "download_id", "left_semi").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(videos, "id", "left").select("id", "label", "face_count", F.col("cover.f").alias("cover_face_id"), F.col("cover.download_id").alias("cover_download_id"), F.coalesce("n", F.lit(0)).alias("video_face_count"), F.round("avg_quality", 6).alias("avg_quality"))


for (_sort, _direction), _order in {("face_count", "desc"): "p.face_count DESC", ("face_count", "asc"): "p.face_count ASC", ("avg_quality", "desc"): "coalesce(q.q, 0) DESC", ("avg_quality", "asc"): "coalesce(q.q, 0) ASC", ("name", "asc"): "lower(p.label) ASC NULLS FIRST", ("name", "desc"): "lower(p.label) DESC NULLS LAST"}.items():
    query(f"r27_people_by_{_sort}_{_direction}", _people_sql(_order))(lambda c, s=_sort, d=_direction: people(c, s, d))


@query("r28_ai_counts", """
SELECT e.total, e.unindexed, i.embedded, t.tagged, p.people, f.with_faces, f.total_faces, f.noise_faces, f.quality_pending FROM
(SELECT count(*) AS total, count(*) FILTER (WHERE ai_indexed_at IS NULL) AS unindexed FROM downloads WHERE file_type IN ('photo', 'video')) e,
(SELECT count(*) AS embedded FROM image_embeddings) i, (SELECT count(DISTINCT download_id) AS tagged FROM image_tags) t, (SELECT count(*) AS people FROM people) p,
(SELECT count(DISTINCT download_id) AS with_faces, count(*) AS total_faces, count(*) FILTER (WHERE person_id IS NULL OR person_id = -1) AS noise_faces, count(*) FILTER (WHERE quality_score IS NULL) AS quality_pending FROM faces) f""")
def ai_counts(c: Catalog, types: tuple[str, ...] = AI_TYPES) -> DataFrame:
    eligible = c.downloads.filter(F.col("file_type").isin(*types)).agg(F.count("*").alias("total"), F.count_if(F.col("ai_indexed_at").isNull()).alias("unindexed"))
    faces = c.faces.agg(F.countDistinct("download_id").alias("with_faces"), F.count("*").alias("total_faces"), F.count_if(F.expr("person_id IS NULL OR person_id = -1")).alias("noise_faces"), F.count_if(F.col("quality_score").isNull()).alias("quality_pending"))
    rows = [c.image_embeddings.agg(F.count("*").alias("embedded")), c.image_tags.agg(F.countDistinct("download_id").alias("tagged")), c.people.agg(F.count("*").alias("people")), faces]
    for one in rows:
        eligible = eligible.crossJoin(one)  # single rows
    return eligible


@query("r29_ai_candidates", "SELECT id, file_path, file_type FROM downloads WHERE file_type IN ('photo', 'video') AND ai_indexed_at IS NULL AND file_path IS NOT NULL AND file_path NOT LIKE '%.part' AND id > 0 ORDER BY id LIMIT 50")
def ai_candidates(c: Catalog, types: tuple[str, ...] = AI_TYPES, after: int = 0, limit: int = 50) -> DataFrame:
    rows = c.downloads.filter(F.col("file_type").isin(*types[:32]) & F.col("ai_indexed_at").isNull() & F.col("file_path").isNotNull() & ~F.lower("file_path").endswith(".part") & (F.col("id") > after))
    return page(rows.select("id", "file_path", "file_type"), [F.asc("id")], candidate_limit(limit, 50, 500))


@query("r30_ai_pending", "SELECT count(*) AS pending FROM downloads WHERE file_type IN ('photo', 'video') AND ai_indexed_at IS NULL AND file_path IS NOT NULL")
def ai_pending(c: Catalog, types: tuple[str, ...] = AI_TYPES) -> DataFrame:
    """Of the first 32 types, as in the list of candidates."""
    return c.downloads.filter(F.col("file_type").isin(*types[:32]) & F.col("ai_indexed_at").isNull() & F.col("file_path").isNotNull()).agg(F.count("*").alias("pending"))


@query("r31_quality_candidates", "SELECT d.id, d.file_path, f.n AS n_faces, f.ids AS face_ids FROM downloads d JOIN (SELECT download_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM faces WHERE quality_score IS NULL GROUP BY download_id) f ON f.download_id = d.id WHERE d.id > 10 ORDER BY d.id LIMIT 50")
def quality_candidates(c: Catalog, after: int = 10, limit: int = 50) -> DataFrame:
    """Downloads with a face that has no quality, and those faces; nested_faces has them as structs."""
    return nested_faces(c, after, limit).select("id", "file_path", F.size("faces").cast("long").alias("n_faces"), F.array_join(F.transform("faces", lambda f: f["id"].cast("string")), ",").alias("face_ids"))


def nested_faces(c: Catalog, after: int = 0, limit: int = 50) -> DataFrame:
    open_ = c.faces.filter("quality_score IS NULL")
    shown = page(c.downloads.filter(F.col("id") > after).join(open_.select(F.col("download_id").alias("id")), "id", "left_semi").select("id", "file_path"), [F.asc("id")], candidate_limit(limit, 50, 500))
    return shown.join(open_.groupBy(F.col("download_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "w", "h"))).alias("faces")), "id")


@query("r32_nsfw_tiers", "SELECT " + ", ".join(f"count(*) FILTER (WHERE nsfw_score IS NOT NULL AND nsfw_whitelist = 0 AND nsfw_score >= {lo} AND nsfw_score < {hi}) AS {name}" for name, lo, hi in TIERS) + ", count(*) FILTER (WHERE nsfw_checked_at IS NOT NULL) AS scanned, count(*) AS eligible, count(*) FILTER (WHERE nsfw_whitelist = 1) AS whitelisted FROM downloads WHERE file_type IN ('photo', 'video')")
def nsfw_tiers(c: Catalog, types: tuple[str, ...] = AI_TYPES) -> DataFrame:
    score = F.col("nsfw_score")
    tiers = [F.count_if(score.isNotNull() & (F.col("nsfw_whitelist") == 0) & (score >= lo) & (score < hi)).alias(name) for name, lo, hi in TIERS]
    return c.downloads.filter(F.col("file_type").isin(*types)).agg(*tiers, F.count("nsfw_checked_at").alias("scanned"), F.count("*").alias("eligible"), F.count_if(F.col("nsfw_whitelist") == 1).alias("whitelisted"))


@query("r33_nsfw_histogram", """
WITH h AS (SELECT least(CAST(trunc(nsfw_score * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM downloads WHERE file_type IN ('photo', 'video') AND nsfw_score IS NOT NULL GROUP BY 1)
SELECT b.bin, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN h ON h.bin = b.bin""")
def nsfw_histogram(c: Catalog, n: int | None = 20, types: tuple[str, ...] = AI_TYPES) -> DataFrame:
    n = bins(n)
    found = c.downloads.filter(F.col("file_type").isin(*types) & F.col("nsfw_score").isNotNull()).groupBy(F.least((F.col("nsfw_score") * n).cast("long"), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return c.spark.range(n).select(F.col("id").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("r34_nsfw_list", "SELECT p.*, t.total, greatest(1, CAST(ceil(t.total / 50.0) AS BIGINT)) AS total_pages FROM (SELECT id, group_id, file_type, nsfw_score, nsfw_whitelist FROM downloads WHERE nsfw_score >= 0.3 AND nsfw_score < 0.7 AND nsfw_whitelist = 0 AND file_type = 'photo' ORDER BY nsfw_score, id LIMIT 50) p CROSS JOIN (SELECT count(*) AS total FROM downloads WHERE nsfw_score >= 0.3 AND nsfw_score < 0.7 AND nsfw_whitelist = 0 AND file_type = 'photo') t")
def nsfw_list(c: Catalog, lo: float = 0.3, hi: float = 0.7, kind: str = "photo", whitelisted: bool = False, number: int = 1, size: int = 50) -> DataFrame:
    size = page_limit(size, 50, 200)
    rows = c.downloads.filter((F.col("nsfw_score") >= lo) & (F.col("nsfw_score") < hi) & (F.col("nsfw_whitelist") == int(whitelisted)) & (F.col("file_type") == kind))
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)))
    return page(rows.select("id", "group_id", "file_type", "nsfw_score", "nsfw_whitelist"), [F.asc("nsfw_score"), F.asc("id")], size, (number - 1) * size).crossJoin(total)


@query("r35_nsfw_candidates", "SELECT id, file_path FROM downloads WHERE nsfw_checked_at IS NULL AND file_type IN ('photo', 'video') AND file_path IS NOT NULL ORDER BY created_at, id LIMIT 50")
def nsfw_candidates(c: Catalog, types: tuple[str, ...] = AI_TYPES, limit: int = 50) -> DataFrame:
    rows = c.downloads.filter(F.col("nsfw_checked_at").isNull() & F.col("file_type").isin(*types) & F.col("file_path").isNotNull())
    return page(rows.select("id", "file_path", "created_at"), [F.asc("created_at"), F.asc("id")], candidate_limit(limit, 50, 500)).drop("created_at")


@query("r36_recovery_stats", "SELECT group_id, count(*) AS n, max(created_at) AS last_created FROM downloads GROUP BY group_id")
def recovery_stats(c: Catalog) -> DataFrame:
    return c.downloads.groupBy("group_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_created"))


_SHARED = ("id", "group_id", "group_name", "file_name", "file_size", "file_type", "file_hash", "message_id", "created_at")


@query("r37_cluster_downloads", f"SELECT {', '.join(_SHARED)} FROM downloads ORDER BY id DESC LIMIT 200 OFFSET 20")
def cluster_downloads(c: Catalog, limit: int = 200, offset: int = 20) -> DataFrame:
    return page(c.downloads.select(*_SHARED), [F.desc("id")], page_limit(limit, 200, 2000), offset)


@query("r38_cluster_downloads_since", f"SELECT {', '.join(_SHARED)} FROM downloads WHERE id > 120 ORDER BY id LIMIT 500")
def cluster_downloads_since(c: Catalog, since: int = 120, limit: int = 500) -> DataFrame:
    return page(c.downloads.filter(F.col("id") > since).select(*_SHARED), [F.asc("id")], page_limit(limit, 500, 2000))


@query("r39_cluster_search", f"SELECT {', '.join(_SHARED)} FROM downloads WHERE contains(lower(file_name), 'fr_1') OR contains(lower(group_name), 'fr_1') ORDER BY created_at DESC, id DESC LIMIT 50")
def cluster_search(c: Catalog, text: str = "FR_1", limit: int = 50) -> DataFrame:
    t = text.lower()
    return page(c.downloads.filter(F.contains(F.lower("file_name"), F.lit(t)) | F.contains(F.lower("group_name"), F.lit(t))).select(*_SHARED), [F.desc("created_at"), F.desc("id")], page_limit(limit, 50, 200))


@query("r40_telegram_media_candidates", "SELECT id, telegram_media_size, file_path FROM downloads WHERE telegram_media_kind = 'photo' AND telegram_media_id = '18' AND file_path IS NOT NULL ORDER BY CASE WHEN telegram_media_size = 500 THEN 0 ELSE 1 END, id LIMIT 100")
def telegram_media_candidates(c: Catalog, kind: str = "photo", media: str = "18", size: int = 500) -> DataFrame:
    rows = c.downloads.filter((F.col("telegram_media_kind") == kind) & (F.col("telegram_media_id") == media) & F.col("file_path").isNotNull())
    return page(rows.select("id", "telegram_media_size", "file_path"), [F.when(F.col("telegram_media_size") == size, 0).otherwise(1).asc(), F.asc("id")], 100)


@query("r41_file_hash_candidates", "SELECT min(id) AS id, file_hash, file_size FROM downloads WHERE file_hash IS NOT NULL GROUP BY file_hash, file_size")
def file_hash_candidates(c: Catalog) -> DataFrame:
    """The first row of each (hash, size): the lookup for all keys at once."""
    return c.downloads.filter("file_hash IS NOT NULL").groupBy("file_hash", "file_size").agg(F.min("id").alias("id"))


@query("r42_file_name_candidates", "SELECT min(id) AS id, group_id, file_name, file_size FROM downloads GROUP BY group_id, file_name, file_size")
def file_name_candidates(c: Catalog) -> DataFrame:
    return c.downloads.groupBy("group_id", "file_name", "file_size").agg(F.min("id").alias("id"))


@query("r43_share_links", "SELECT s.id, s.download_id, s.label, s.revoked_at, d.file_name FROM share_links s JOIN downloads d ON d.id = s.download_id WHERE s.revoked_at IS NULL AND (lower(d.file_name) LIKE '%en_1%' OR lower(s.label) LIKE '%en_1%') ORDER BY s.created_at DESC, s.id DESC LIMIT 500")
def share_links(c: Catalog, include_revoked: bool = False, search: str = "en_1", download: int | None = None, limit: int = 500) -> DataFrame:
    """Links with their file; % and _ of the search text are wildcards here."""
    rows = c.share_links if include_revoked else c.share_links.filter("revoked_at IS NULL")
    rows = rows.filter(F.col("download_id") == download) if download else rows
    rows = rows.join(c.downloads.select(F.col("id").alias("download_id"), "file_name"), "download_id")
    rows = rows.filter(F.lower("file_name").like(f"%{search.lower()}%") | F.lower("label").like(f"%{search.lower()}%")) if search else rows
    return page(rows.select("id", "download_id", "label", "revoked_at", "file_name", "created_at"), [F.desc("created_at"), F.desc("id")], page_limit(limit, 500, 2000)).drop("created_at")


@query("r44_update_history", "SELECT id, from_version, to_version, started_at, finished_at, status FROM update_history ORDER BY id DESC LIMIT 25")
def update_history(c: Catalog, limit: int = 25) -> DataFrame:
    return page(c.update_history.select("id", "from_version", "to_version", "started_at", "finished_at", "status"), [F.desc("id")], page_limit(limit, 25, 200))


@query("r47_peer_stats", "SELECT p.peer_id, p.name, p.status, count(d.remote_id) AS files, CAST(coalesce(sum(d.file_size), 0) AS BIGINT) AS size FROM peers p LEFT JOIN peer_downloads d ON d.peer_id = p.peer_id GROUP BY p.peer_id, p.name, p.status HAVING count(d.remote_id) > 0")
def peer_stats(c: Catalog) -> DataFrame:
    held = c.peer_downloads.groupBy("peer_id").agg(F.count("remote_id").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"))
    return c.peers.select("peer_id", "name", "status").join(held, "peer_id").filter("files > 0")


@query("r48_group_names", "SELECT group_id, coalesce(max(nullif(group_name, '')), group_id) AS name, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS size FROM downloads GROUP BY group_id")
def group_names(c: Catalog) -> DataFrame:
    return c.downloads.groupBy("group_id").agg(F.coalesce(F.max(F.nullif(F.col("group_name"), F.lit(""))), F.col("group_id")).alias("name"), F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"))


@query("r49_recovery_groups", "SELECT group_id, max(group_name) AS group_name, count(*) AS files, min(message_id) AS first_message, max(message_id) AS last_message FROM downloads GROUP BY group_id")
def recovery_groups(c: Catalog) -> DataFrame:
    return c.downloads.groupBy("group_id").agg(F.max("group_name").alias("group_name"), F.count("*").alias("files"), F.min("message_id").alias("first_message"), F.max("message_id").alias("last_message"))


@query("r50_rescue_stats", "SELECT count(*) FILTER (WHERE pending_until IS NOT NULL AND rescued_at IS NULL) AS pending, count(*) FILTER (WHERE rescued_at IS NOT NULL) AS rescued, coalesce(max(rescued_at), 0) AS last_rescue FROM downloads")
def rescue_stats(c: Catalog) -> DataFrame:
    return c.downloads.agg(F.count_if(F.expr("pending_until IS NOT NULL AND rescued_at IS NULL")).alias("pending"), F.count("rescued_at").alias("rescued"), F.coalesce(F.max("rescued_at"), F.lit(0)).alias("last_rescue"))


@query("r51_nsfw_status", "SELECT count(*) AS total, count(nsfw_checked_at) AS checked, count(*) FILTER (WHERE nsfw_score < 0.6 AND nsfw_whitelist = 0) AS below, count(*) FILTER (WHERE nsfw_score >= 0.6) AS above, max(nsfw_checked_at) AS last_checked FROM downloads WHERE file_type IN ('photo', 'video')")
def nsfw_status(c: Catalog, threshold: float = 0.6, types: tuple[str, ...] = AI_TYPES) -> DataFrame:
    return c.downloads.filter(F.col("file_type").isin(*types)).agg(F.count("*").alias("total"), F.count("nsfw_checked_at").alias("checked"), F.count_if((F.col("nsfw_score") < threshold) & (F.col("nsfw_whitelist") == 0)).alias("below"), F.count_if(F.col("nsfw_score") >= threshold).alias("above"), F.max("nsfw_checked_at").alias("last_checked"))


@query("r52_nsfw_results", "SELECT id, group_id, file_name, nsfw_score FROM downloads WHERE nsfw_score < 0.6 AND nsfw_whitelist = 0 AND file_type IN ('photo', 'video') ORDER BY nsfw_score, id LIMIT 50 OFFSET 10")
def nsfw_results(c: Catalog, threshold: float = 0.6, types: tuple[str, ...] = AI_TYPES, limit: int = 50, offset: int = 10) -> DataFrame:
    rows = c.downloads.filter((F.col("nsfw_score") < threshold) & (F.col("nsfw_whitelist") == 0) & F.col("file_type").isin(*types))
    return page(rows.select("id", "group_id", "file_name", "nsfw_score"), [F.asc("nsfw_score"), F.asc("id")], limit, offset)


@query("r53_backup_status", "SELECT destination_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'uploading') AS uploading, count(*) FILTER (WHERE status = 'done' AND finished_at > 1700000050000) AS done, count(*) FILTER (WHERE status = 'failed' AND finished_at > 1700000050000) AS failed FROM backup_jobs GROUP BY destination_id")
def backup_status(c: Catalog, since: int = 1_700_000_050_000) -> DataFrame:
    state = lambda s: F.col("status") == s
    return c.backup_jobs.groupBy("destination_id").agg(F.count_if(state("pending")).alias("pending"), F.count_if(state("uploading")).alias("uploading"), F.count_if(state("done") & (F.col("finished_at") > since)).alias("done"), F.count_if(state("failed") & (F.col("finished_at") > since)).alias("failed"))


@query("r54_recent_backup_jobs", "SELECT j.id, j.destination_id, j.status, d.name AS destination_name, d.provider FROM backup_jobs j JOIN backup_destinations d ON d.id = j.destination_id ORDER BY coalesce(j.finished_at, j.started_at, j.id) DESC, j.id DESC LIMIT 50")
def recent_backup_jobs(c: Catalog, limit: int = 50) -> DataFrame:
    jobs = c.backup_jobs.join(c.backup_destinations.select(F.col("id").alias("destination_id"), F.col("name").alias("destination_name"), "provider"), "destination_id")
    return page(jobs.withColumn("at", F.coalesce("finished_at", "started_at", "id")).select("id", "destination_id", "status", "destination_name", "provider", "at"), [F.desc("at"), F.desc("id")], limit).drop("at")


@query("r55_mirror_inventory", "SELECT destination_id, count(*) AS files, CAST(coalesce(sum(bytes_uploaded), 0) AS BIGINT) AS bytes FROM backup_jobs WHERE status = 'done' AND download_id IS NOT NULL GROUP BY destination_id")
def mirror_inventory(c: Catalog) -> DataFrame:
    return c.backup_jobs.filter("status = 'done' AND download_id IS NOT NULL").groupBy("destination_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes_uploaded"), F.lit(0)).alias("bytes"))


@query("r56_audit_list", "SELECT id, ts, kind, actor FROM audit WHERE kind = 'error' ORDER BY ts DESC, id DESC LIMIT 100")
def audit_list(c: Catalog, kind: str | None = "error", limit: int = 100) -> DataFrame:
    rows = c.audit.filter(F.col("kind") == kind) if kind else c.audit
    return page(rows.select("id", "ts", "kind", "actor"), [F.desc("ts"), F.desc("id")], limit)


@query("r57_queue_snapshot", """
SELECT w.id, w.group_id, w.message_id, w.status, w.updated_at, (SELECT min(file_path) FROM downloads d WHERE d.message_id = w.message_id AND d.group_id = 'src' || w.group_id) AS file_path,
       row_number() OVER (ORDER BY CASE WHEN w.status = 'pending' THEN w.id ELSE -w.updated_at END, w.id DESC) AS position FROM work w
WHERE w.status = 'processing' OR w.id IN (SELECT id FROM work WHERE status = 'pending' ORDER BY id LIMIT 1000) OR w.id IN (SELECT id FROM work WHERE status IN ('completed', 'failed', 'skipped') ORDER BY updated_at DESC, id DESC LIMIT 100)""")
def queue_snapshot(c: Catalog, pending: int = 1000, finished: int = 100) -> DataFrame:
    """Running rows, the first pending ones and the last finished ones, in the order in which they are shown."""
    w = c.work.select("id", "group_id", "message_id", "status", "updated_at")
    shown = w.filter("status = 'processing'").union(page(w.filter("status = 'pending'"), [F.asc("id")], pending)).union(page(w.filter("status IN ('completed', 'failed', 'skipped')"), [F.desc("updated_at"), F.desc("id")], finished))
    paths = c.downloads.filter("file_path IS NOT NULL").groupBy(F.col("group_id").alias("g"), F.col("message_id").alias("m")).agg(F.min("file_path").alias("file_path"))
    shown = shown.join(paths, (F.concat(F.lit("src"), "group_id") == F.col("g")) & (F.col("message_id") == F.col("m")), "left").drop("g", "m")
    from .relational import numbered

    by = F.struct(F.when(F.col("status") == "pending", F.col("id")).otherwise(-F.col("updated_at")).alias("first"), (-F.col("id")).alias("then"))
    return numbered(shown.withColumn("by", by), "by", "position").drop("by")  # running rows have no bound


@query("r58_queue_counts", "SELECT status, count(*) AS n FROM work GROUP BY status")
def queue_counts(c: Catalog) -> DataFrame:
    return c.work.groupBy("status").agg(F.count("*").alias("n"))


@query("r59_message_bounds", "SELECT group_id, min(message_id) AS first_message, max(message_id) AS last_message, count(*) AS n FROM (SELECT group_id, message_id FROM downloads UNION SELECT group_id, message_id FROM tombstones) GROUP BY group_id")
def message_bounds(c: Catalog) -> DataFrame:
    both = c.downloads.select("group_id", "message_id").union(c.tombstones.select("group_id", "message_id")).distinct()
    return both.groupBy("group_id").agg(F.min("message_id").alias("first_message"), F.max("message_id").alias("last_message"), F.count("*").alias("n"))


@query("r60_distinct_groups", "SELECT DISTINCT group_id FROM downloads")
def distinct_groups(c: Catalog) -> DataFrame:
    return c.downloads.select("group_id").distinct()


@query("r61_similar_groups", "SELECT g.id, g.kind, g.confidence, count(*) AS members, string_agg(m.role || ':' || CAST(m.download_id AS VARCHAR), ',' ORDER BY CASE m.role WHEN 'keep' THEN 0 ELSE 1 END, m.download_id) AS ordered FROM similar_groups g JOIN similar_members m ON m.group_id = g.id GROUP BY g.id, g.kind, g.confidence")
def similar_groups(c: Catalog) -> DataFrame:
    """Groups with their members in the order of their roles, as one string; the nested form is an array of structs."""
    rank = F.when(F.col("role") == "keep", 0).otherwise(1).alias("rank")
    members = c.similar_members.groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(rank, "download_id", "role"))).alias("m"))  # a group's members
    text = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["download_id"].cast("string"))), ",")
    return c.similar_groups.join(members, "id").select("id", "kind", "confidence", F.size("m").cast("long").alias("members"), text.alias("ordered"))


@query("r62_scan_stats", "SELECT (SELECT count(*) FROM downloads WHERE file_type = 'video') AS videos, (SELECT count(*) FROM fingerprints) AS fingerprints, (SELECT count(*) FROM similar_groups) AS similar_count")
def scan_stats(c: Catalog) -> DataFrame:
    return c.downloads.filter("file_type = 'video'").agg(F.count("*").alias("videos")).crossJoin(c.fingerprints.agg(F.count("*").alias("fingerprints"))).crossJoin(c.similar_groups.agg(F.count("*").alias("similar_count")))


@query("r63_chat_access", "SELECT chat_id, title, kind, can_read, checked_at FROM chat_access")
def chat_access(c: Catalog) -> DataFrame:
    return c.chat_access.select("chat_id", "title", "kind", "can_read", "checked_at")


@query("r64_pending_recovery", "SELECT r.channel_id, r.wanted_pts, s.pts, r.wanted_pts > coalesce(s.pts, 0) AS open FROM pending_recovery r LEFT JOIN channel_state s ON s.channel_id = r.channel_id")
def pending_recovery(c: Catalog) -> DataFrame:
    return c.pending_recovery.join(c.channel_state, "channel_id", "left").select("channel_id", "wanted_pts", "pts", (F.col("wanted_pts") > F.coalesce("pts", F.lit(0))).alias("open"))


@query("r65_peers", "SELECT peer_id, name, status, row_number() OVER (ORDER BY lower(name), CAST(peer_id AS BIGINT)) AS position FROM peers")
def peers(c: Catalog) -> DataFrame:
    from .relational import numbered

    by = F.struct(F.lower("name").alias("name"), F.col("peer_id").cast("long").alias("id"))
    return numbered(c.peers.select("peer_id", "name", "status", by.alias("by")), "by", "position").drop("by")


@query("r66_catalog_page", f"SELECT {', '.join(_SHARED)} FROM downloads WHERE id > 50 AND (contains(lower(file_name), 'de') OR contains(lower(group_name), 'de')) ORDER BY id LIMIT 100")
def catalog_page(c: Catalog, after: int = 50, search: str = "de", limit: int = 100) -> DataFrame:
    t = F.lit(search.lower())
    return page(c.downloads.filter((F.col("id") > after) & (F.contains(F.lower("file_name"), t) | F.contains(F.lower("group_name"), t))).select(*_SHARED), [F.asc("id")], limit)


@query("r67_seekbar_totals", "SELECT (SELECT count(*) FROM seekbar_sprites) AS sprites, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM seekbar_sprites) AS bytes, (SELECT count(*) FROM downloads WHERE file_type = 'video' AND file_path IS NOT NULL) AS videos")
def seekbar_totals(c: Catalog) -> DataFrame:
    return seekbar_stats(c)


@query("r68_nsfw_ids", "SELECT id FROM downloads WHERE nsfw_score >= 0.7 AND nsfw_score < 0.9 AND nsfw_whitelist = 0")
def nsfw_ids(c: Catalog, tier: str = "likely") -> DataFrame:
    lo, hi = next((a, b) for name, a, b in TIERS if name == tier)
    return c.downloads.filter((F.col("nsfw_score") >= lo) & (F.col("nsfw_score") < hi) & (F.col("nsfw_whitelist") == 0)).select("id").orderBy("nsfw_score", "id")
