"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params
from ..functions import scalars as S
from ..functions.media import tiles_hashed
from ..plans.define import query
from ..sources.catalog import Catalog


@query("t4_string_functions", "SELECT id, trim(file_name) AS trimmed, lower(group_name) AS lowered, replace(file_name, '_', '-') AS replaced, substring(file_hash, 1, 8) AS head, group_id || ':' || CAST(message_id AS VARCHAR) AS joined FROM downloads")
def string_functions(c: Catalog) -> DataFrame:
    return c.downloads.select("id", F.trim("file_name").alias("trimmed"), F.lower("group_name").alias("lowered"), F.replace("file_name", F.lit("_"), F.lit("-")).alias("replaced"), F.substring("file_hash", 1, 8).alias("head"), F.concat_ws(":", "group_id", "message_id").alias("joined"))


@query("t5_human_bytes", """
SELECT id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN rtrim(rtrim(printf('%.2f', b / 1024e0), '0'), '.') || ' KB' WHEN b < 1073741824 THEN rtrim(rtrim(printf('%.2f', b / 1048576e0), '0'), '.') || ' MB' ELSE rtrim(rtrim(printf('%.2f', b / 1073741824e0), '0'), '.') || ' GB' END AS size_text
FROM (SELECT id, file_size * (1 + id % 5 * 3000) AS b FROM downloads)""")
def human_sizes(c: Catalog) -> DataFrame:
    return c.downloads.select("id", S.human_bytes(F.col("file_size") * (1 + F.col("id") % 5 * 3000)).alias("size_text"))


@query("t6_parse_size", """
SELECT id, size_text, CAST(CASE id % 6 WHEN 0 THEN id WHEN 1 THEN id * 1024 WHEN 2 THEN floor((id + 0.5) * 1048576) WHEN 3 THEN id * 1073741824 WHEN 4 THEN 0 ELSE id END AS BIGINT) AS bytes
FROM (SELECT id, CASE id % 6 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN CAST(id AS VARCHAR) || 'KB' WHEN 2 THEN CAST(id AS VARCHAR) || '.5 mb' WHEN 3 THEN CAST(id AS VARCHAR) || ' G' WHEN 4 THEN 'x' || CAST(id AS VARCHAR) ELSE CAST(id AS VARCHAR) || 'B' END AS size_text FROM downloads)""")
def parsed_sizes(c: Catalog) -> DataFrame:
    i = F.col("id").cast("string")
    k = F.col("id") % 6
    text = F.when(k == 0, i).when(k == 1, F.concat(i, F.lit("KB"))).when(k == 2, F.concat(i, F.lit(".5 mb"))).when(k == 3, F.concat(i, F.lit(" G"))).when(k == 4, F.concat(F.lit("x"), i)).otherwise(F.concat(i, F.lit("B")))
    return c.downloads.select("id", text.alias("size_text")).withColumn("bytes", S.parse_size(F.col("size_text")))


@query("t7_version_compare", "SELECT id, from_version, to_version, string_split(to_version, '.')[1]::INT * 10000 + string_split(to_version, '.')[2]::INT > string_split(from_version, '.')[1]::INT * 10000 + string_split(from_version, '.')[2]::INT AS newer FROM update_history")
def version_compare(c: Catalog) -> DataFrame:
    return c.update_history.select("id", "from_version", "to_version", S.version_newer(F.col("to_version"), F.col("from_version")).alias("newer"))


@query("t8_message_links", """
SELECT id, CASE WHEN id % 4 IN (0, 3) THEN '@channel_' || group_id ELSE CAST(-1000000000000 - (id + 1) AS VARCHAR) END AS chat, id + 7 AS message, CASE WHEN id % 4 = 1 THEN id + 2 WHEN id % 4 = 3 THEN 5 END AS topic FROM downloads""")
def message_links(c: Catalog) -> DataFrame:
    i = F.col("id")
    text = lambda x: x.cast("string")
    link = (
        F.when(i % 4 == 0, F.concat(F.lit("t.me/channel_"), "group_id", F.lit("/"), text(i + 7), F.lit("?single")))
        .when(i % 4 == 1, F.concat(F.lit("https://t.me/c/"), text(i + 1), F.lit("/"), text(i + 2), F.lit("/"), text(i + 7)))
        .when(i % 4 == 2, F.concat(F.lit("tg://privatepost?channel="), text(i + 1), F.lit("&post="), text(i + 7)))
        .otherwise(F.concat(F.lit("tg://resolve?domain=channel_"), "group_id", F.lit("&post="), text(i + 7), F.lit("&thread=5")))
    )
    return c.downloads.select("id", S.message_link(link).alias("m")).select("id", "m.chat", "m.message", "m.topic")


@query("t9_chat_queries", "SELECT chat_id, CASE chat_id % 5 WHEN 0 THEN 'username' WHEN 1 THEN 'id' WHEN 2 THEN 'name' WHEN 3 THEN 'invite' ELSE 'message' END AS kind FROM chat_access")
def chat_queries(c: Catalog) -> DataFrame:
    i = F.col("chat_id")
    text = F.when(i % 5 == 0, F.concat(F.lit("@user"), i)).when(i % 5 == 1, F.concat(F.lit("-100"), i)).when(i % 5 == 2, F.col("title")).when(i % 5 == 3, F.concat(F.lit("https://t.me/+Ab"), i)).otherwise(F.concat(F.lit("t.me/name/"), i))
    return c.chat_access.select("chat_id", S.chat_query_kind(text).alias("kind"))


@query("t10_path_safe", r"""SELECT id, coalesce(nullif(regexp_replace(group_name, '[\x00-\x1f<>:"/\\|?*]', '_', 'g'), ''), 'unknown') AS folder, regexp_replace(file_path, '[\x00-\x1f<>:"/\\|?*]', '_', 'g') AS flat FROM downloads""")
def path_safe(c: Catalog) -> DataFrame:
    return c.downloads.select("id", S.path_safe(F.col("group_name")).alias("folder"), F.when(F.col("file_path").isNotNull(), S.path_safe(F.col("file_path"))).alias("flat"))


@query("t11_file_types", """
SELECT id, CASE id % 6 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'photo' WHEN 3 THEN 'audio' WHEN 4 THEN 'document' ELSE 'photo' END AS kind FROM downloads""")
def file_types(c: Catalog) -> DataFrame:
    i = F.col("id") % 6
    name = F.col("id").cast("string")
    path = F.when(i == 0, F.concat(F.lit("g/images/"), name, F.lit(".bin"))).when(i == 1, F.concat(F.lit("g/x/"), name, F.lit(".MKV"))).when(i == 2, F.concat(F.lit("g/"), name, F.lit(".jpeg"))).when(i == 3, F.concat(F.lit("g/x/"), name, F.lit(".flac"))).when(i == 4, F.concat(F.lit("g/x/"), name, F.lit(".pdf"))).otherwise(F.concat(F.lit("g/x/"), name))
    return c.downloads.select("id", S.file_type(path).alias("kind"))


@query("t12_synthetic_ids", "SELECT id, -CAST('0x' || substring(sha256(file_path), 1, 8) AS BIGINT) AS synthetic FROM downloads WHERE file_path IS NOT NULL")
def synthetic_ids(c: Catalog) -> DataFrame:
    return c.downloads.filter("file_path IS NOT NULL").select("id", S.synthetic_id(F.col("file_path")).alias("synthetic"))


@query("t13_basename_extension", "SELECT id, string_split(url_path, '/')[-1] AS base, CASE WHEN contains(string_split(url_path, '/')[-1], '.') THEN '.' || string_split(string_split(url_path, '/')[-1], '.')[-1] ELSE '' END AS ext FROM (SELECT id, coalesce(file_path, '') || CASE WHEN id % 2 = 0 THEN '/a.b.txt' ELSE '/plain' END AS url_path FROM downloads)")
def basenames(c: Catalog) -> DataFrame:
    path = F.concat(F.coalesce("file_path", F.lit("")), F.when(F.col("id") % 2 == 0, "/a.b.txt").otherwise("/plain"))
    return c.downloads.select("id", S.basename(path).alias("base"), S.extension(path).alias("ext"))


@query("js1_json_objects", """SELECT id, '{"peerId":"self","remoteId":' || CAST(id AS VARCHAR) || ',"filePath":"' || file_path || '"}' AS body FROM downloads WHERE file_path IS NOT NULL""")
def json_objects(c: Catalog) -> DataFrame:
    return c.downloads.filter("file_path IS NOT NULL").select("id", S.json_object(peerId=F.lit("self"), remoteId=F.col("id"), filePath=F.col("file_path")).alias("body"))


@query("js2_json_extract", "SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM audit WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_extract(c: Catalog) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return c.audit.select("id", k.alias("k")).filter("k > 50")


@query("js3_json_set", """SELECT id, '{"k":"' || json_extract_string(props, '$.k') || '","group":"g' || CAST(actor AS VARCHAR) || '"}' AS body FROM audit""")
def json_sets(c: Catalog) -> DataFrame:
    return c.audit.select("id", S.json_set(F.col("props"), "group", F.concat(F.lit("g"), "actor")).alias("body"))


@query("js4_json_path", "SELECT kind, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM audit GROUP BY kind")
def json_path(c: Catalog) -> DataFrame:
    parsed = F.try_variant_get(F.parse_json("props"), "$.k", "long")
    return c.audit.groupBy("kind").agg(F.count("*").alias("n"), F.sum(parsed).alias("total"))


@query("d1_epoch_millis", "SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS millis FROM events")
def epoch_millis(c: Catalog) -> DataFrame:
    return c.events.select("event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("millis"))


@query("d2_mixed_timestamps", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) END AS millis FROM events")
def mixed_timestamps(c: Catalog) -> DataFrame:
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, (F.unix_millis(ts)).cast("string")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never")
    return c.events.select("event_id", S.millis(text).alias("millis"))


@query("d3_retention_deadlines", "SELECT id, created_at + CASE WHEN id % 4 = 0 THEN 48 ELSE greatest(1, least(720, id * 13 - 500)) END * 3600000 AS deadline FROM downloads")
def retention_deadlines(c: Catalog) -> DataFrame:
    return c.downloads.select("id", S.retention_deadline(F.col("created_at"), F.when(F.col("id") % 4 != 0, F.col("id") * 13 - 500)).alias("deadline"))


@query("d4_history_bounds", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) WHEN 1 THEN 0 WHEN 2 THEN CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) END AS bound FROM events")
def history_bounds(c: Catalog) -> DataFrame:
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, "").when(k == 2, F.unix_millis(ts).cast("string")).otherwise("soon")
    return c.events.select("event_id", S.history_bound(text).alias("bound"))


@query("f12_cron_matches", "SELECT event_id, (minute(ts) % 15 = 0) AND (hour(ts) BETWEEN 2 AND 20) AND (day(ts) IN (1, 3) OR dayofweek(ts) = 2) AS due FROM events")
def cron_due(c: Catalog, expression: str = "*/15 2-20 1,3 * 2") -> DataFrame:
    return c.events.select("event_id", S.cron_matches(expression, F.col("ts").cast("timestamp")).alias("due"))


_WORD_SQL = "CAST(bit_count(xor(CAST('0x' || substring(a.file_hash, {0}, 8) AS BIGINT), CAST('0x' || substring(b.file_hash, {0}, 8) AS BIGINT))) AS BIGINT)"


@query("m1_hamming", f"SELECT a.id, {' + '.join(_WORD_SQL.format(k) for k in range(1, 64, 8))} AS distance FROM downloads a JOIN downloads b ON b.id = a.id + 1 WHERE a.file_hash IS NOT NULL AND b.file_hash IS NOT NULL")
def hamming_neighbours(c: Catalog) -> DataFrame:
    d = c.downloads.filter("file_hash IS NOT NULL").select("id", F.col("file_hash").alias("h"))
    return d.join(d.select((F.col("id") - 1).alias("id"), F.col("h").alias("g")), "id").select("id", S.hamming_hex(F.col("h"), F.col("g")).cast("long").alias("distance"))


@query("m2_duration_buckets", "SELECT download_id, CAST(floor(duration_sec / 120) AS BIGINT) AS bucket, abs(duration_sec - 300) / greatest(duration_sec, 300) <= 0.1 AS near FROM seekbar_sprites")
def duration_buckets(c: Catalog) -> DataFrame:
    return c.seekbar_sprites.select("download_id", S.duration_bucket(F.col("duration_sec")).alias("bucket"), S.durations_within(F.col("duration_sec"), F.lit(300.0), 0.1).alias("near"))


@query("m3_iou", "SELECT id, round(CASE WHEN w * h + 2500 - i > 0 THEN i / (w * h + 2500 - i) ELSE 0 END, 9) AS overlap FROM (SELECT id, w, h, greatest(least(x + w, 50.5) - greatest(x, 0.5), 0) * greatest(least(y + h, 50.2) - greatest(y, 0.2), 0) AS i FROM faces)")
def overlaps(c: Catalog) -> DataFrame:
    box = [F.lit(v) for v in (0.5, 0.2, 50.0, 50.0)]
    return c.faces.select("id", F.round(S.iou(F.col("x"), F.col("y"), F.col("w"), F.col("h"), *box), 9).alias("overlap"))


@query("m4_l2_normalise", "SELECT id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 6) AS squared FROM faces")
def normalised(c: Catalog) -> DataFrame:
    unit = S.l2_normalised(F.col("embedding"))
    return c.faces.select("id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, v: s + v * v), 6).alias("squared"))


@query("m5_face_quality", "SELECT id, round(0.30 * least(1, w / 100) + 0.20 * least(1, h / 100) + 0.20 * least(1, x) + 0.15 * 0.5 + 0.15 * coalesce(quality_score, 0.5), 4) AS quality FROM faces")
def face_quality(c: Catalog) -> DataFrame:
    return c.faces.select("id", S.face_quality(F.col("w") / 100, F.col("h") / 100, F.col("x"), F.lit(None).cast("double"), F.col("quality_score")).alias("quality"))


@query("m6_nsfw_labels", "SELECT id, CASE WHEN nsfw_score >= 0.5 THEN 'nsfw' ELSE 'sfw' END AS label, round(nsfw_score, 6) AS score FROM downloads WHERE nsfw_score IS NOT NULL")
def nsfw_labels(c: Catalog) -> DataFrame:
    return c.downloads.filter("nsfw_score IS NOT NULL").select("id", S.nsfw_label(F.col("nsfw_score")).alias("label"), F.round("nsfw_score", 6).alias("score"))


_TIERS_SQL = " ".join(f"WHEN d <= {t} THEN least(greatest(ceil(d / {s}), 8), {m})" for t, s, m in S.SPRITE_TIERS[:-1])


@query("m7_sprite_plans", f"SELECT download_id, CAST(f AS BIGINT) AS frames, round(d / f, 6) AS interval_sec, CAST(greatest(1, ceil(f / 10)) AS BIGINT) AS row_count FROM (SELECT download_id, d, CASE {_TIERS_SQL} ELSE least(greatest(ceil(d / 18e0), 8), 720) END AS f FROM (SELECT download_id, duration_sec * 7 AS d FROM seekbar_sprites))")
def sprite_plans(c: Catalog) -> DataFrame:
    return c.seekbar_sprites.select("download_id", S.sprite_plan(F.col("duration_sec") * 7).alias("p")).select("download_id", "p.frames", F.round("p.interval", 6).alias("interval_sec"), "p.row_count")


@query("m8_even_samples", "SELECT download_id, CAST(floor(0 * frames / 5) AS BIGINT) AS a, CAST(floor(2 * frames / 5) AS BIGINT) AS b, CAST(floor(4 * frames / 5) AS BIGINT) AS c FROM seekbar_sprites")
def even_samples(c: Catalog) -> DataFrame:
    k = S.evenly_spaced(F.col("frames"), 5)
    return c.seekbar_sprites.select("download_id", k[0].alias("a"), k[2].alias("b"), k[4].alias("c"))


@query("m9_coalesce_case", "SELECT id, coalesce(nullif(group_name, 'Unknown'), group_id) AS name, CASE WHEN file_path IS NULL THEN 'missing' WHEN pinned = 1 THEN 'pinned' ELSE 'plain' END AS state, CAST(file_size AS VARCHAR) AS size_text FROM downloads")
def coalesce_case(c: Catalog) -> DataFrame:
    return c.downloads.select("id", F.coalesce(F.nullif(F.col("group_name"), F.lit("Unknown")), F.col("group_id")).alias("name"), F.when(F.col("file_path").isNull(), "missing").when(F.col("pinned") == 1, "pinned").otherwise("plain").alias("state"), F.col("file_size").cast("string").alias("size_text"))


@query("a9_top_mean", "SELECT group_id, round(list_avg(list_slice(list_reverse_sort(list(nsfw_score)), 1, 3)), 9) AS top_mean FROM downloads WHERE nsfw_score IS NOT NULL GROUP BY group_id")
def top_means(c: Catalog) -> DataFrame:
    """The mean of each group's three greatest scores; only three rows of a group are gathered."""
    from pyspark.sql.window import Window

    best = c.downloads.filter("nsfw_score IS NOT NULL").select("group_id", "nsfw_score", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("nsfw_score"))).alias("k")).filter("k <= 3")
    return best.groupBy("group_id").agg(F.round(S.top_mean(F.collect_list("nsfw_score")), 9).alias("top_mean"))


@query("m10_tile_hashes")
def tile_hashes(c: Catalog) -> DataFrame:
    """Perceptual hashes of tiles: here all of a text's bytes as 16 x 16 pixels a tile (what the last one lacks is black)."""
    return tiles_hashed(c.documents.select("doc_id", F.col("text").cast("binary").alias("data")), 16)


@query("a11_weighted_means", "SELECT label, round(sum(CAST(embedding[1] AS DOUBLE) * w) / sum(w), 4) + 0 AS c0 FROM (SELECT label, embedding, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE vec_id % 3 END AS w FROM embeddings) GROUP BY label")
def weighted_means(c: Catalog) -> DataFrame:
    from .vectors import centroids

    rows = c.embeddings.select("label", F.col("vec_id").alias("idx"), F.col("embedding").alias("emb"), (F.col("vec_id") % 3).cast("double").alias("w"))
    return centroids(rows).select("label", (F.round(F.col("centroid")[0].cast("double"), 4) + 0.0).alias("c0"))


@query("m11_page_limits", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 OR event_id % 700 = 50 THEN 50 ELSE greatest(1, least(event_id % 700 - 50, 500)) END AS BIGINT) AS page_limit FROM events")
def page_limits(c: Catalog) -> DataFrame:
    """Limits that requests ask for (some ask for none), clamped."""
    i = F.col("event_id")
    return c.events.select("event_id", params.page_limits(F.when(i % 7 != 0, i % 700 - 50), 50, 500).cast("long").alias("page_limit"))
