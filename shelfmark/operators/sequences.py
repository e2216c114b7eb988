"""Similarity of frame-hash sequences: local alignment, near duplicates, sub-clips.

Candidates come from a blocked screen of the frames themselves (frames.py), so that alignments grow with the pairs that
have enough matching frames, not with the square of a duration bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..plans.define import query
from ..sources.catalog import Catalog
from ..sources.scratch import written
from .frames import align_batch, screened
from .relational import numbered

#: Videos of a line, until there are LINES of them; videos of a line at most.
LINE, LINES, MOST = 2048, 64, 1 << 18


@dataclass(frozen=True)
class SimilarConfig:
    """Thresholds in bits and shares; durations in seconds."""

    threshold: float = 50.0
    bucket: int = 120
    tolerance: float = 0.1
    coverage: float = 0.7
    gate: float = 64.0
    frame_threshold: float = 50.0
    clip_ratio: float = 0.7
    short_clip: float = 60.0
    short_ratio: float = 0.8
    review_ratio: float = 0.5
    review_frames: int = 3
    clip_frames: int = 4

    @classmethod
    def load(cls, environment: dict[str, str], stored: dict[str, object], prefix: str = "SIMILAR_") -> SimilarConfig:
        """Each value from the environment (PREFIX and its name in capitals), else as stored, else the default; what doesn't read as a number is passed over."""
        got = {}
        for f in fields(cls):
            for value in (environment.get(prefix + f.name.upper()), stored.get(f.name)):
                try:
                    got.setdefault(f.name, type(f.default)(value))
                except (TypeError, ValueError):
                    continue
        return cls(**got)

    def key(self) -> str:
        """Names a configuration: work done under another one counts as not done."""
        return "|".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))


def align(a: list[tuple[float, str]], b: list[tuple[float, str]], threshold: float) -> dict[str, float | int | None]:
    """align_batch() of one pair."""
    return align_batch([(a, b)], threshold)[0]


_ALIGNED = "score double, matched int, aligned int, mean_hamming double, coverage_a double, coverage_b double, coverage_short double, start_a int, start_b int, offset_a double, offset_b double"
_TYPES = [pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.float64()]


def sequences(frames: DataFrame) -> DataFrame:
    """(id, frames): each video's frames in the order of their times. frames has id, t_sec, phash."""
    return frames.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t_sec", "phash"))).alias("frames"))


def aligned(pairs: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, ...) with the alignment of both videos' frames; a video without frames aligns to nothing."""
    seq = sequences(frames)
    both = pairs.join(seq.select(F.col("id").alias("a"), F.col("frames").alias("fa")), "a", "left").join(seq.select(F.col("id").alias("b"), F.col("frames").alias("fb")), "b", "left")
    plain = [c for c in both.columns if c not in ("fa", "fb")]
    spec = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in plain) + ", " + _ALIGNED
    names = [*plain, *[x.split()[0] for x in _ALIGNED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda x: [(f["t_sec"], f["phash"]) for f in x or []]
        for batch in batches:
            got = align_batch([(told(x), told(y)) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)], threshold)
            cols = [pa.array([g[k] for g in got], t) for k, t in zip(names[len(plain) :], _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *cols], names=names)

    return both.mapInArrow(run, spec)


def near_duration_pairs(videos: DataFrame, cfg: SimilarConfig, ignored: DataFrame | None = None) -> DataFrame:
    """(a, b) with b < a whose durations differ by the tolerance at most, by an equi-join on neighbouring buckets.

    videos has id, duration_sec, file_hash, file_size, aggregate_hash, frame_count. Equal files are left out, and pairs
    that are ignored (a_id < b_id).
    """
    v = videos.withColumn("bucket", S.duration_bucket(F.col("duration_sec"), cfg.bucket))
    left = v.select(*[F.col(c).alias(f"a_{c}") for c in videos.columns], F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket"))
    both = left.join(v.select(*[F.col(c).alias(f"b_{c}") for c in videos.columns], "bucket"), "bucket").drop("bucket")
    return _near_in_duration(both, cfg, ignored)


def _paired(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids with both videos' columns, as a_ and b_."""
    side = lambda s: videos.select(*[F.col(c).alias(f"{s}_{c}") for c in videos.columns])
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).join(side("a"), "a_id").join(side("b"), "b_id")


def _near_in_duration(both: DataFrame, cfg: SimilarConfig, ignored: DataFrame | None) -> DataFrame:
    both = both.filter("b_id < a_id")
    both = both.filter(~((F.col("a_file_hash") != "") & (F.col("a_file_hash") == F.col("b_file_hash"))) | F.col("a_file_hash").isNull() | F.col("b_file_hash").isNull())
    both = both.filter(S.durations_within(F.col("a_duration_sec"), F.col("b_duration_sec"), cfg.tolerance))
    if ignored is not None:
        both = both.join(ignored.select(F.greatest("a_id", "b_id").alias("a_id"), F.least("a_id", "b_id").alias("b_id")), ["a_id", "b_id"], "left_anti")
    return both


def similar_videos(videos: DataFrame, frames: DataFrame, cfg: SimilarConfig = SimilarConfig(), ignored: DataFrame | None = None) -> DataFrame:
    """keep, remove, confidence, mean_hamming of near-duplicate pairs: both covered well, the larger file stays (ties: the lower id)."""
    found = screened(videos, frames, cfg.bucket, cfg.threshold, cfg.coverage, cfg.coverage, tolerance=cfg.tolerance).filter("b < a")
    pairs = _near_in_duration(_paired(written(found, "screened"), videos), cfg, ignored)
    gate = max(cfg.gate, 4 * cfg.threshold)
    told = (F.coalesce("a_aggregate_hash", F.lit("")) != "") & (F.coalesce("b_aggregate_hash", F.lit("")) != "")
    distance = S.hamming_hex(F.col("a_aggregate_hash"), F.col("b_aggregate_hash"))
    pairs = pairs.filter(~(F.coalesce((F.col("a_frame_count") > 0) & (F.col("a_frame_count") == F.col("b_frame_count")) & told & (distance > gate), F.lit(False))))
    got = aligned(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_file_size", "b_file_size"), frames, cfg.threshold)
    got = got.filter((F.col("coverage_a") >= cfg.coverage) & (F.col("coverage_b") >= cfg.coverage) & (F.col("mean_hamming") <= cfg.threshold))
    bits = frames.groupBy(F.col("id").alias("a")).agg(F.when(F.length(F.min_by("phash", "t_sec")) >= 64, 256.0).otherwise(64.0).alias("bits"))
    got = got.join(bits, "a")
    keep_b = (F.col("b_file_size") > F.col("a_file_size")) | ((F.col("b_file_size") == F.col("a_file_size")) & (F.col("b") < F.col("a")))
    return got.select(F.when(keep_b, F.col("b")).otherwise(F.col("a")).alias("keep"), F.when(keep_b, F.col("a")).otherwise(F.col("b")).alias("remove"), F.round(F.greatest(F.lit(0.0), 1 - F.col("mean_hamming") / F.col("bits")), 6).alias("confidence"), F.round("mean_hamming", 6).alias("mean_hamming"), "matched")


def clip_parent_pairs(videos: DataFrame, cfg: SimilarConfig, ignored: DataFrame | None = None) -> DataFrame:
    """(a = clip, b = parent): the parent is at least as long, outside of the tolerance, and has as many frames at least.

    Most pairs of a short and a long video are such, so the result itself grows with the square of the videos. Sorted by
    duration they are cut into lines of equal size, and a task has the pairs of two lines: a video moves once for each
    line, a task holds one line's clips while the other's videos pass by, and lines that leave no pair never meet.
    """
    told = videos.filter(F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec")).withColumn("place", F.struct("duration_sec", "id"))
    v = written(numbered(told, "place", "no").drop("place"), "ranked")
    n = v.count()
    lines = max(min(-(-n // LINE), LINES), -(-n // MOST), 1)
    v = v.withColumn("line", F.floor((F.col("no") - 1) * lines / max(n, 1)).cast("int")).withColumn("hash", F.xxhash64("file_hash")).drop("no")
    ends = v.groupBy("line").agg(F.min("duration_sec").alias("lo"), F.max("duration_sec").alias("hi"))
    dealt = ends.toDF("a_line", "a_lo", "a_hi").join(ends.toDF("b_line", "b_lo", "b_hi"), F.col("b_hi") + 1e-9 >= F.col("a_lo"))
    alike = (F.least("a_lo", "b_lo") >= 0) & S.durations_within(F.least("a_lo", "b_lo"), F.greatest("a_hi", "b_hi"), cfg.tolerance * (1 - 1e-9))
    apart = F.lit(cfg.tolerance < 1) & (F.col("b_lo") > 0) & (F.col("b_lo") < math.inf) & ((F.col("b_lo") - F.col("a_hi")) / F.col("b_lo") > max(cfg.tolerance, 0.0) + 1e-9)
    dealt = written(dealt.filter(~alike).select("a_line", "b_line", (F.col("a_line") * lines + F.col("b_line")).alias("task"), apart.alias("apart")), "met")  # at most the square of the lines

    def side(s: str, rows: DataFrame, *more: str) -> DataFrame:
        named = rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns])
        return named.join(F.broadcast(dealt.select(f"{s}_line", "task", *more)), f"{s}_line").drop(f"{s}_line").repartitionById(lines * lines, "task")

    both = side("a", v.filter(F.col("frame_count") >= cfg.clip_frames)).hint("shuffle_hash").join(side("b", v, "apart"), "task")
    return _clip_and_parent(both, cfg, ignored, "apart", "a_hash <> b_hash").drop("task", "apart", "a_hash", "b_hash")


def _clip_and_parent(both: DataFrame, cfg: SimilarConfig, ignored: DataFrame | None, apart: str = "false", unlike: str = "false") -> DataFrame:
    """Of the pairs those of clip and parent. apart, unlike: what tells without a closer look that durations differ enough, and files."""
    both = both.filter("a_duration_sec IS NOT NULL AND b_duration_sec IS NOT NULL AND NOT isnan(a_duration_sec) AND NOT isnan(b_duration_sec)").filter(F.col("a_frame_count") >= cfg.clip_frames)
    both = both.filter("a_frame_count <= b_frame_count AND a_id <> b_id").filter(F.expr(apart) | (F.expr("b_duration_sec + 1e-9 >= a_duration_sec") & ~S.durations_within(F.col("a_duration_sec"), F.col("b_duration_sec"), cfg.tolerance)))
    both = both.filter(F.expr(unlike) | F.expr("NOT coalesce(a_file_hash <> '' AND a_file_hash = b_file_hash, false)"))
    if ignored is not None:
        both = both.join(ignored.select("a_id", "b_id").union(ignored.select("b_id", "a_id")), ["a_id", "b_id"], "left_anti")
    return both


def partial_clips(videos: DataFrame, frames: DataFrame, cfg: SimilarConfig = SimilarConfig(), ignored: DataFrame | None = None) -> DataFrame:
    """keep, remove, role, kind, ratio, offset_sec: every parent that a clip lies in; else its best possible one, for review."""
    least = min(cfg.review_ratio, cfg.clip_ratio, cfg.short_ratio)
    found = screened(videos, frames, cfg.bucket, cfg.frame_threshold, least, 0.0, max(1, cfg.review_frames))
    pairs = _clip_and_parent(_paired(written(found, "screened"), videos), cfg, ignored).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_duration_sec"), F.col("b_duration_sec"))
    got = aligned(pairs, frames, cfg.frame_threshold).filter(F.col("matched") >= cfg.review_frames)
    need = F.when(F.col("a_duration_sec") <= cfg.short_clip, cfg.short_ratio).otherwise(cfg.clip_ratio)
    got = got.withColumn("whole", F.col("coverage_a") >= need).filter(F.col("whole") | (F.col("coverage_a") >= cfg.review_ratio))
    w = Window.partitionBy("a")
    order = w.orderBy(F.desc("coverage_a"), "b_duration_sec", "b")
    got = got.withColumn("any", F.max("whole").over(w)).withColumn("rn", F.row_number().over(order)).filter("whole OR (NOT any AND rn = 1)")
    kind = F.when(F.col("whole"), "partial").otherwise("partial_review")
    return got.select(F.col("b").alias("keep"), F.col("a").alias("remove"), F.when(F.col("whole"), "remove").otherwise("review").alias("role"), kind.alias("kind"), F.round("coverage_a", 6).alias("ratio"), F.coalesce("offset_b", F.lit(0.0)).alias("offset_sec"), "matched", F.round("coverage_a", 9).alias("confidence")).withColumn("reason", reason())


def reason() -> Column:
    """Why a clip is to go or to be looked at."""
    return F.when(F.col("kind") == "partial", F.format_string("partial clip of %s; match ratio %.0f%% at offset %.1fs", F.col("keep").cast("string"), F.col("ratio") * 100, "offset_sec")).otherwise(F.format_string("possible clip of %s; match ratio %.0f%% at offset %.1fs — manual review", F.col("keep").cast("string"), F.col("ratio") * 100, "offset_sec"))


def pending_analysis(videos: DataFrame, cursor: DataFrame, config_key: str) -> DataFrame:
    """Videos that a cursor table (id, config_key, file_hash) doesn't show as analysed under this configuration."""
    return videos.join(cursor.filter(F.col("config_key") == config_key).select("id", "file_hash"), ["id", "file_hash"], "left_anti")


def live_groups(groups: DataFrame, members: DataFrame, downloads: DataFrame) -> DataFrame:
    """Groups with two members or more that still exist. groups has id; members group_id, download_id."""
    live = members.join(downloads.select(F.col("id").alias("download_id")), "download_id", "left_semi").groupBy("group_id").count().filter("count >= 2")
    return groups.join(live.select(F.col("group_id").alias("id")), "id", "left_semi")


# ---- videos at hand: eight vectors are a video's frames, hashed by their signs ----


def demo_videos(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Videos and frames: originals, re-encodings with a few bits changed, and clips of four frames."""
    sign = lambda lo, flip: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s * 2 + F.when((F.get("embedding", F.lit(lo) + i) > 0) != (flip & ((i * 7 + F.col("vec_id")) % 13 == 0)), 1).otherwise(0))
    word = lambda flip: F.concat(*[F.lower(F.lpad(F.hex(sign(lo, flip)), 8, "0")) for lo in (0, 32)])
    v, t = F.floor(F.col("vec_id") / 8).cast("long"), (F.col("vec_id") % 8).cast("double")
    whole = c.embeddings.select((v * 4).alias("id"), (t * 10).alias("t_sec"), word(F.lit(False)).alias("phash"))
    copy = c.embeddings.select((v * 4 + 1).alias("id"), (t * 10).alias("t_sec"), word(F.lit(True)).alias("phash"))
    clip = c.embeddings.filter("vec_id % 8 BETWEEN 2 AND 5").select((v * 4 + 2).alias("id"), ((t - 2) * 10).alias("t_sec"), word(F.lit(False)).alias("phash"))
    frames = whole.union(copy).union(clip)
    k = F.col("id") % 4
    videos = frames.groupBy("id").agg(F.count("*").alias("frame_count"), F.min_by("phash", "t_sec").alias("aggregate_hash"))
    seconds = F.when(k == 2, 40.0).otherwise(80.0) + F.floor(F.col("id") / 4) * 13.0 + F.when(k == 1, 1.0).otherwise(0.0)
    return videos.select("id", seconds.alias("duration_sec"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("file_hash"), (1000 + F.col("id") % 7 * 10 + k).alias("file_size"), "aggregate_hash", "frame_count"), frames


_CFG = SimilarConfig(threshold=12.0, frame_threshold=6.0, gate=64.0)


_FRAMES_SQL = """f AS (SELECT vec_id // 8 * 4 + k AS id, CAST((vec_id % 8 - CASE WHEN k = 2 THEN 2 ELSE 0 END) * 10 AS DOUBLE) AS t,
  list_sum([CASE WHEN (embedding[i + 1] > 0) <> (k = 1 AND (i % 32 * 7 + vec_id) % 13 = 0) THEN CAST(1 AS HUGEINT) << (63 - i) ELSE 0 END FOR i IN range(64)]) AS w
  FROM embeddings, (SELECT unnest([0, 1, 2]) AS k) WHERE k <> 2 OR vec_id % 8 BETWEEN 2 AND 5),
videos AS (SELECT id, (CASE WHEN id % 4 = 2 THEN 40 ELSE 80 END) + id // 4 * 13 + (CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END) AS d, 1000 + id % 7 * 10 + id % 4 AS file_size, count(*) AS n, list({'t': t, 'w': CAST(w AS HUGEINT)} ORDER BY t) AS frames FROM f GROUP BY id)"""


def _aligned_sql(pairs: str, threshold: float) -> str:
    """Alignments of pairs (a, b) in SQL: a cell is 4 * score + step, row by row in one list, then the way back from the best."""
    near = lambda up, back: f"CASE WHEN {up} AND {back} THEN {{}} ELSE 0 END"
    row, col = "x[1] >= m", "x[1] % m > 0"
    diagonal = "(" + near(row, col).format("acc[x[1] - m] // 4") + " + gains[x[1] + 1])"
    above, left = "(" + near(row, "true").format("acc[x[1] - m + 1] // 4") + " - 1)", "(" + near("true", col).format("acc[x[1]] // 4") + " - 1)"
    cell = f"CASE WHEN greatest({diagonal}, {above}, {left}) <= 0 THEN 0 WHEN {diagonal} >= greatest({above}, {left}) THEN {diagonal} * 4 + 1 WHEN {above} >= {left} THEN {above} * 4 + 2 ELSE {left} * 4 + 3 END"
    step, here = "(CASE WHEN acc[1] > 0 AND acc[2] > 0 THEN cells[(acc[1] - 1) * m + acc[2]] % 4 ELSE 0 END)", "far[(acc[1] - 1) * m + acc[2]]"
    back = f"CASE {step} WHEN 1 THEN [acc[1] - 1, acc[2] - 1, acc[3] + 1, acc[4] + CASE WHEN {here} <= {threshold} THEN 1 ELSE 0 END, acc[5] + {here}, acc[1] - 1, acc[2] - 1] WHEN 2 THEN list_concat([acc[1] - 1], acc[2:]) WHEN 3 THEN list_concat([acc[1], acc[2] - 1], acc[3:]) ELSE acc END"
    return f"""{_FRAMES_SQL}, pairs AS ({pairs}),
met AS (SELECT p.a, p.b, x.n, y.n AS m, x.frames AS fa, y.frames AS fb, [CAST(bit_count(xor(x.frames[k // y.n + 1].w, y.frames[k % y.n + 1].w)) AS BIGINT) FOR k IN range(x.n * y.n)] AS far FROM pairs p JOIN videos x ON x.id = p.a JOIN videos y ON y.id = p.b),
gained AS (SELECT *, [CAST(CASE WHEN d <= {threshold} THEN 2 ELSE -1 END AS BIGINT) FOR d IN far] AS gains FROM met),
filled AS (SELECT *, list_reduce([[k] FOR k IN range(n * m)], lambda acc, x: list_append(acc, {cell}), CAST([] AS BIGINT[])) AS cells FROM gained),
best AS (SELECT *, list_max([c // 4 FOR c IN cells]) AS score FROM filled),
ends AS (SELECT *, list_max([(k // m + k % m) * 1000 - k // m FOR k IN range(n * m) IF cells[k + 1] // 4 = score]) AS place FROM best),
ended AS (SELECT *, (-place % 1000 + 1000) % 1000 AS i, (place + (-place % 1000 + 1000) % 1000) // 1000 AS ij FROM ends),
walked AS (SELECT *, list_reduce([[k] FOR k IN range(n + m)], lambda acc, x: {back}, [i + 1, ij - i + 1, 0, 0, 0, -1, -1]) AS w FROM ended),
aligned AS (SELECT a, b, CAST(score AS DOUBLE) AS score, CASE WHEN score = 0 THEN 0 ELSE CAST(w[4] AS INTEGER) END AS matched, CASE WHEN score = 0 THEN 0 ELSE CAST(w[3] AS INTEGER) END AS aligned, CASE WHEN score = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(w[5] AS DOUBLE) / w[3] END AS mean_hamming,
  CASE WHEN score = 0 THEN 0 ELSE CAST(w[4] AS DOUBLE) / n END AS coverage_a, CASE WHEN score = 0 THEN 0 ELSE CAST(w[4] AS DOUBLE) / m END AS coverage_b, CASE WHEN score = 0 THEN 0 ELSE CAST(w[4] AS DOUBLE) / least(n, m) END AS coverage_short,
  CAST(w[6] AS INTEGER) AS start_a, CAST(w[7] AS INTEGER) AS start_b, fa[w[6] + 1].t AS offset_a, fb[w[7] + 1].t AS offset_b FROM walked)"""


_Q1 = f"WITH {_aligned_sql('SELECT x.id AS a, y.id AS b FROM videos x JOIN videos y ON x.id // 4 = y.id // 4 AND x.id < y.id', 12.0)} SELECT * FROM aligned"
_Q2 = f"""WITH {_aligned_sql('SELECT a.id AS a, b.id AS b FROM videos a JOIN videos b ON b.id < a.id AND abs(floor(a.d / 120) - floor(b.d / 120)) <= 1 AND abs(a.d - b.d) / greatest(a.d, b.d) <= 0.1', 12.0)}
SELECT CASE WHEN y.file_size >= x.file_size THEN y.id ELSE x.id END AS keep, CASE WHEN y.file_size >= x.file_size THEN x.id ELSE y.id END AS remove, round(greatest(0, 1 - mean_hamming / 64), 6) AS confidence, round(mean_hamming, 6) AS mean_hamming, matched
FROM aligned JOIN videos x ON x.id = a JOIN videos y ON y.id = b WHERE coverage_a >= 0.7 AND coverage_b >= 0.7 AND mean_hamming <= 12"""
_Q3 = f"""WITH {_aligned_sql('SELECT a.id AS a, b.id AS b FROM videos a JOIN videos b ON a.id <> b.id AND b.d >= a.d AND a.n >= 4 AND a.n <= b.n AND abs(a.d - b.d) / greatest(a.d, b.d) > 0.1', 6.0)},
told AS (SELECT g.*, y.d AS b_d, coverage_a >= CASE WHEN x.d <= 60 THEN 0.8 ELSE 0.7 END AS whole FROM aligned g JOIN videos x ON x.id = a JOIN videos y ON y.id = b WHERE matched >= 3),
ranked AS (SELECT *, round(coverage_a, 6) AS ratio, bool_or(whole) OVER (PARTITION BY a) AS any_whole, row_number() OVER (PARTITION BY a ORDER BY coverage_a DESC, b_d, b) AS place FROM told WHERE whole OR coverage_a >= 0.5)
SELECT b AS keep, a AS remove, CASE WHEN whole THEN 'remove' ELSE 'review' END AS role, CASE WHEN whole THEN 'partial' ELSE 'partial_review' END AS kind, ratio, coalesce(offset_b, 0) AS offset_sec, matched, round(coverage_a, 9) AS confidence,
  CASE WHEN whole THEN 'partial' ELSE 'possible' END || ' clip of ' || b || '; match ratio ' || CAST(floor(ratio * 100 + 0.5) AS INTEGER) || '% at offset ' || printf('%.1f', coalesce(offset_b, 0)) || 's' || CASE WHEN whole THEN '' ELSE ' — manual review' END AS reason
FROM ranked WHERE whole OR (NOT any_whole AND place = 1)"""


@query("q1_alignments", _Q1)
def alignments(c: Catalog) -> DataFrame:
    _, frames = demo_videos(c)
    ids = frames.select("id", F.floor(F.col("id") / 4).alias("v")).distinct()  # at most three videos are of the same frames
    pairs = ids.withColumnRenamed("id", "a").join(ids.withColumnRenamed("id", "b"), "v").filter("a < b").select("a", "b")
    return aligned(pairs, frames, 12.0)


@query("q2_similar_videos", _Q2)
def similar(c: Catalog) -> DataFrame:
    return similar_videos(*demo_videos(c), _CFG)


@query("q3_partial_clips", _Q3)
def clips(c: Catalog) -> DataFrame:
    return partial_clips(*demo_videos(c), _CFG)


_V = "SELECT n * 4 + k AS id, (CASE WHEN k = 2 THEN 40 ELSE 80 END) + n * 13 + (CASE WHEN k = 1 THEN 1 ELSE 0 END) AS d, CASE WHEN k = 2 THEN f.c ELSE f.n8 END AS frames FROM (SELECT vec_id // 8 AS n, count(*) AS n8, count(*) FILTER (WHERE vec_id % 8 BETWEEN 2 AND 5) AS c FROM embeddings GROUP BY 1) f, (SELECT unnest([0, 1, 2]) AS k)"


@query("j9_banded_self_join", f"WITH v AS ({_V}) SELECT a.id AS a_id, b.id AS b_id FROM v a JOIN v b ON b.id < a.id AND abs(floor(a.d / 120) - floor(b.d / 120)) <= 1 AND abs(a.d - b.d) / greatest(a.d, b.d) <= 0.1 WHERE a.frames > 0 AND b.frames > 0")
def banded(c: Catalog) -> DataFrame:
    return near_duration_pairs(demo_videos(c)[0], _CFG).select("a_id", "b_id")


@query("j10_range_join", f"WITH v AS ({_V}) SELECT a.id AS a_id, b.id AS b_id FROM v a JOIN v b ON a.id <> b.id AND b.d >= a.d AND a.frames >= 4 AND a.frames <= b.frames AND abs(a.d - b.d) / greatest(a.d, b.d) > 0.1 WHERE b.frames > 0")
def ranged(c: Catalog) -> DataFrame:
    return clip_parent_pairs(demo_videos(c)[0].drop("aggregate_hash", "file_size"), _CFG).select("a_id", "b_id")


_SIZE = "1000 + {0}.id % 7 * 10 + {0}.id % 4"


@query("q4_keep_remove", f"WITH v AS ({_V}) SELECT a.id AS a_id, b.id AS b_id, CASE WHEN {_SIZE.format('b')} > {_SIZE.format('a')} OR ({_SIZE.format('b')} = {_SIZE.format('a')} AND b.id < a.id) THEN b.id ELSE a.id END AS keep FROM v a JOIN v b ON b.id < a.id AND abs(floor(a.d / 120) - floor(b.d / 120)) <= 1 AND abs(a.d - b.d) / greatest(a.d, b.d) <= 0.1 WHERE a.frames > 0 AND b.frames > 0")
def keep_remove(c: Catalog) -> DataFrame:
    better = (F.col("b_file_size") > F.col("a_file_size")) | ((F.col("b_file_size") == F.col("a_file_size")) & (F.col("b_id") < F.col("a_id")))
    return near_duration_pairs(demo_videos(c)[0], _CFG).select("a_id", "b_id", F.when(better, F.col("b_id")).otherwise(F.col("a_id")).alias("keep"))


@query("q5_pending_analysis", "SELECT download_id AS id FROM fingerprints WHERE NOT (algo = 'pdq1' AND download_id % 2 = 0)")
def pending(c: Catalog) -> DataFrame:
    videos = c.fingerprints.select(F.col("download_id").alias("id"), "file_hash", "algo")
    return pending_analysis(videos, videos.withColumn("config_key", F.when((F.col("id") % 2 == 0) & (F.col("algo") == "pdq1"), "k1").otherwise("k0")), "k1").select("id")


def effective(environment: Column, stored: Column, default: float) -> Column:
    """One setting of many instances: SimilarConfig.load()'s precedence, what doesn't read as a number is passed over."""
    return F.coalesce(environment.try_cast("double"), stored.try_cast("double"), F.lit(default))


@query("q9_effective_settings", "SELECT c_custkey AS instance, coalesce(TRY_CAST(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN CAST(c_nationkey AS VARCHAR) END AS DOUBLE), TRY_CAST(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) ELSE c_name END AS DOUBLE), 50) AS threshold FROM customer")
def effective_settings(c: Catalog) -> DataFrame:
    """The threshold in force for each instance (here: customer): from its environment, else as stored, else the default."""
    k = F.col("c_custkey")
    environment = F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, F.col("c_nationkey").cast("string"))
    stored = F.when(k % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(F.col("c_name"))
    return c.customer.select(k.alias("instance"), effective(environment, stored, SimilarConfig.threshold).alias("threshold"))


@query("q6_ignored_pairs", "SELECT least(download_id, group_id) AS a_id, greatest(download_id, group_id) AS b_id FROM similar_members WHERE download_id <> group_id AND NOT EXISTS (SELECT 1 FROM share_links s WHERE s.id = greatest(similar_members.download_id, similar_members.group_id) AND s.revoked_at IS NOT NULL)")
def unignored(c: Catalog) -> DataFrame:
    pairs = c.similar_members.filter("download_id <> group_id").select(F.least("download_id", "group_id").alias("a_id"), F.greatest("download_id", "group_id").alias("b_id"))
    return pairs.join(c.share_links.filter("revoked_at IS NOT NULL").select(F.col("id").alias("b_id")), "b_id", "left_anti").select("a_id", "b_id")


@query("q7_live_groups", "SELECT g.id FROM similar_groups g WHERE (SELECT count(*) FROM similar_members m JOIN downloads d ON d.id = m.download_id WHERE m.group_id = g.id AND d.file_type = 'video') >= 2")
def live(c: Catalog) -> DataFrame:
    return live_groups(c.similar_groups, c.similar_members, c.downloads.filter("file_type = 'video'")).select("id")
