"""The catalogue's entities, as views over the tables at hand.

Each view is one SELECT in SQL that Spark and DuckDB read alike; {name} stands for a table or another view, and
{sha}(x) for the SHA-256 of a string in hex. with_views() puts the same texts in front of an oracle query.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Milliseconds at which the catalogue's clock starts.
EPOCH = 1_700_000_000_000

_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'document' ELSE 'stories' END"
_NAME = "CASE doc_id % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Group ' || CAST(doc_id % 100 AS STRING) WHEN 2 THEN '-1001' WHEN 3 THEN NULL ELSE 'Channel ' || source END"

VIEWS: dict[str, str] = {
    "downloads": f"""
        SELECT doc_id AS id, source AS group_id, {_NAME} AS group_name, doc_id AS message_id, {_TYPE} AS file_type,
               lang || '_' || CAST(doc_id AS STRING) || '.txt' AS file_name, n_chars AS file_size,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source || '/' || lang || '/' || CAST(doc_id % 400 AS STRING) END AS file_path,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {{sha}}(text) END AS file_hash,
               {EPOCH} + (doc_id * 7919) % 1000003 AS created_at,
               CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS pinned,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1e3 END AS nsfw_score,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {EPOCH} + doc_id * 10 END AS nsfw_checked_at,
               CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS nsfw_whitelist,
               CASE WHEN doc_id % 6 = 0 THEN {EPOCH} + doc_id * 100 END AS pending_until,
               CASE WHEN doc_id % 12 = 0 THEN {EPOCH} + doc_id * 50 END AS rescued_at,
               CASE WHEN doc_id % 5 < 3 AND doc_id % 8 = 0 THEN {EPOCH} + doc_id END AS ai_indexed_at,
               CASE WHEN doc_id % 9 = 0 THEN 'photo' WHEN doc_id % 9 = 1 THEN 'document' END AS telegram_media_kind,
               CASE WHEN doc_id % 9 < 2 THEN CAST(doc_id % 50 AS STRING) END AS telegram_media_id,
               CASE WHEN doc_id % 9 < 2 AND doc_id % 2 = 0 THEN n_chars END AS telegram_media_size,
               'completed' AS status
        FROM {{documents}}""",
    "seekbar_sprites": f"""
        SELECT doc_id AS download_id, 'sprites/' || CAST(doc_id AS STRING) || '.webp' AS sprite_path, CAST(n_chars AS DOUBLE) / 1e1 AS duration_sec,
               doc_id % 60 + 10 AS frames, 10 AS cols, doc_id % 6 + 1 AS row_count, n_chars * 3 AS bytes, 'webp' AS format, {EPOCH} + doc_id AS generated_at
        FROM {{documents}} WHERE doc_id % 5 = 1 AND doc_id % 2 = 0""",
    "peers": f"SELECT CAST(n_nationkey AS STRING) AS peer_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'online' ELSE 'offline' END AS status, {EPOCH} + n_nationkey AS last_seen_at FROM {{nation}}",
    "peer_downloads": f"""
        SELECT CAST(doc_id % 5 AS STRING) AS peer_id, doc_id AS remote_id, {{sha}}(text) AS file_hash, n_chars AS file_size, {_TYPE} AS file_type, source AS group_id, {_NAME} AS group_name,
               lang || '_' || CAST(doc_id AS STRING) || '.txt' AS file_name, source || '/' || CAST(doc_id AS STRING) AS file_path, doc_id AS message_id, {EPOCH} + doc_id * 5 AS created_at, 'completed' AS status
        FROM {{documents}} WHERE doc_id % 4 = 1""",
    "peer_groups": "SELECT CAST(c_nationkey % 5 AS STRING) AS peer_id, '{\"id\": \"src' || CAST(c_custkey % 30 AS STRING) || '\", \"name\": \"' || c_name || '\"}' AS payload FROM {customer} WHERE c_custkey % 7 = 0".replace("{\"", "{{\"").replace("\"}", "\"}}"),
    "faces": """
        SELECT vec_id AS id, vec_id % 150 AS download_id, CAST(vec_id % 7 AS DOUBLE) / 1e1 AS x, CAST(vec_id % 5 AS DOUBLE) / 1e1 AS y, CAST(20 + vec_id % 90 AS DOUBLE) AS w, CAST(20 + vec_id * 3 % 90 AS DOUBLE) AS h,
               CASE WHEN vec_id % 9 = 0 THEN NULL ELSE label END AS person_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE CAST(vec_id % 100 AS DOUBLE) / 1e2 END AS quality_score, embedding
        FROM {embeddings}""",
    "people": f"SELECT label AS id, CASE WHEN label % 4 = 0 THEN NULL WHEN label % 2 = 0 THEN 'person ' || CAST(label AS STRING) ELSE 'Person ' || CAST(label AS STRING) END AS label, count(*) AS face_count, {EPOCH} + min(vec_id) AS created_at, {EPOCH} + max(vec_id) AS updated_at FROM {{embeddings}} GROUP BY label",
    "image_embeddings": f"SELECT DISTINCT vec_id % 180 AS download_id, 'clip' AS model, {EPOCH} AS indexed_at FROM {{embeddings}}",
    "image_tags": "SELECT doc_id AS download_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS tag, CAST(doc_id % 100 AS DOUBLE) / 1e2 AS score FROM {labels}",
    "share_links": f"""
        SELECT o_orderkey AS id, o_orderkey % 200 AS download_id, {EPOCH} + o_orderkey * 1000 AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN {EPOCH} + o_orderkey * 2000 END AS expires_at,
               CASE WHEN o_orderstatus = 'F' THEN {EPOCH} + o_orderkey * 1500 END AS revoked_at, o_orderpriority AS label, o_orderkey % 5 AS access_count
        FROM {{orders}}""",
    "update_history": f"""
        SELECT s_suppkey AS id, '2.' || CAST(s_suppkey % 9 AS STRING) || '.0' AS from_version, '2.' || CAST(s_suppkey % 9 + 1 AS STRING) || '.0' AS to_version, {EPOCH} + s_suppkey AS started_at,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {EPOCH} + s_suppkey + 60 END AS finished_at, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status
        FROM {{supplier}}""",
    "backup_destinations": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 's3' ELSE 'sftp' END AS provider FROM {region}",
    "backup_jobs": f"""
        SELECT o_orderkey AS id, o_custkey % 5 AS destination_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 800 END AS download_id,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, {EPOCH} + o_orderkey AS started_at,
               CASE WHEN o_orderstatus <> 'O' THEN {EPOCH} + o_orderkey * 10 END AS finished_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes_uploaded
        FROM {{orders}}""",
    "work": f"""
        SELECT event_id AS id, CAST(user_id AS STRING) AS group_id, event_id % 50 AS message_id, CAST(event_id % 3 AS STRING) AS account_id, event_type AS media_type, 'file_' || CAST(event_id AS STRING) AS file_name,
               event_id * 11 % 5000 AS file_size, CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'skipped' ELSE 'pending' END AS status,
               CASE WHEN event_id % 14 = 0 THEN 1 ELSE 0 END AS paused, CASE event_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'explicit' ELSE 'history' END AS origin, CASE WHEN event_id % 25 = 0 THEN 30 ELSE 0 END AS ttl_seconds,
               CASE WHEN event_id % 8 = 0 THEN {EPOCH} + event_id * 100 ELSE 0 END AS retry_at, event_id % 4 AS generation, event_id % 8 % 5 AS claim_generation,
               {EPOCH} + event_id AS created_at, {EPOCH} + event_id * 37 % 100003 AS updated_at
        FROM {{events}}""",
    "audit": f"SELECT event_id AS id, {EPOCH} + event_id * 13 % 10007 AS ts, event_type AS kind, user_id AS actor, props FROM {{events}}",
    "tombstones": "SELECT source AS group_id, doc_id + 100000 AS message_id FROM {documents} WHERE doc_id % 19 = 0",
    "chat_access": f"SELECT c_custkey AS chat_id, c_name AS title, c_mktsegment AS kind, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS can_read, {EPOCH} + c_custkey AS checked_at FROM {{customer}}",
    "hash_blocklist": "SELECT DISTINCT upper({sha}(text)) AS file_hash FROM {documents} WHERE doc_id % 23 = 0",
    "ingest_files": "SELECT source || '/' || lang || '/' || CAST(doc_id % 400 AS STRING) AS path FROM {documents} WHERE doc_id % 29 = 0",
    "channel_state": "SELECT CAST(user_id AS STRING) AS channel_id, max(event_id) AS pts FROM {events} WHERE user_id % 3 <> 0 GROUP BY user_id",
    "pending_recovery": "SELECT DISTINCT CAST(user_id AS STRING) AS channel_id, user_id % 10 AS wanted_pts FROM {events}",
    "fingerprints": f"SELECT doc_id AS download_id, CAST(n_chars AS DOUBLE) / 1e2 AS duration_sec, {{sha}}(text) AS aggregate_hash, doc_id % 20 + 4 AS frame_count, CASE WHEN doc_id % 8 = 0 THEN 'old' ELSE 'pdq1' END AS algo, {EPOCH} + doc_id AS indexed_at, {{sha}}(text) AS file_hash FROM {{documents}} WHERE doc_id % 5 = 1 AND doc_id % 3 <> 0",
    "similar_groups": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'duplicate' END AS kind, CAST(o_orderkey % 100 AS DOUBLE) / 1e2 AS confidence FROM {orders} WHERE o_orderkey % 10 = 1",
    "similar_members": "SELECT l_orderkey AS group_id, l_partkey % 400 AS download_id, CASE WHEN min(l_linenumber) = 1 THEN 'keep' ELSE 'remove' END AS role FROM {lineitem} WHERE l_orderkey % 10 = 1 GROUP BY l_orderkey, l_partkey % 400",
}


def body(name: str, sha: str) -> str:
    text = re.sub(r"\{(\w+)\}", lambda m: sha if m[1] == "sha" else "\0" + m[1] + "\1", VIEWS[name])
    return text.replace("{{", "{").replace("}}", "}")


def with_views(sql: str) -> str:
    """An oracle query with the views it names (and those that they name) in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                need.append(name)

    add(sql)
    parts = ", ".join(f"{n} AS ({body(n, 'sha256').replace(chr(0), '').replace(chr(1), '')})" for n in need)
    sql = sql.strip()
    if not parts:
        return sql
    return re.sub(r"^WITH RECURSIVE\b", f"WITH RECURSIVE {parts},", sql) if sql.startswith("WITH RECURSIVE") else re.sub(r"^WITH\b", f"WITH {parts},", sql) if sql.startswith("WITH") else f"WITH {parts} {sql}"


class Catalog:
    """Tables and views of one data directory; each is an immutable scan, so count and page of a query agree."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return (*TABLES, *VIEWS)

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            else:
                text = body(name, "sha2_hex")
                used = re.findall("\0(\\w+)\1", text)
                text = re.sub(r"sha2_hex\((\w+)\)", r"sha2(\1, 256)", text).replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
                self._made[name] = self.spark.sql(text, **{u: self.table(u) for u in used})
        return self._made[name]
