"""Vector analytics: neighbourhoods, density clustering, centroids, label carry-over.

Neighbours come from the blocked join in neighbours.py; clustering reduces each pair of blocks where it is measured.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.define import query
from ..sources.catalog import Catalog
from ..sources.scratch import written
from .graph import FEW, components
from .neighbours import BLOCK, Blocks, Linked, Nearest, nearest_within, within
from .relational import numbered


@dataclass(frozen=True)
class ClusterConfig:
    """Defaults of clustering faces: distance, least points of a cluster (the point itself included), least score and side of a face's box in pixels."""

    eps: float = 1.05
    min_points: int = 2
    min_score: float = 0.5
    min_box: float = 60.0

    def faces(self, faces: DataFrame) -> DataFrame:
        """The faces that are clustered: score and box are known and large enough, and the box isn't too narrow (F9)."""
        return faces.filter((F.col("quality_score") >= self.min_score) & (F.least("w", "h") >= self.min_box) & (F.col("w") / F.col("h")).between(0.5, 2))


EPS, MIN_POINTS = ClusterConfig.eps, ClusterConfig.min_points


def valid(vectors: DataFrame) -> DataFrame:
    """(idx, emb): vectors of the dimension that the lowest id's non-empty vector has."""
    rows = vectors.select("idx", F.col("emb").cast("array<float>").alias("emb")).filter("emb IS NOT NULL AND size(emb) > 0")
    dim = rows.agg(F.min_by(F.size("emb"), "idx").alias("dim"))
    return rows.crossJoin(F.broadcast(dim)).filter("size(emb) = dim").drop("dim")  # one row


def dbscan(vectors: DataFrame, eps: float = EPS, min_points: float = MIN_POINTS, block: int = BLOCK) -> DataFrame:
    """(idx, label): clusters are numbered in the order of their first core point; noise is -1.

    A point with min_points neighbours (itself included; 2 at least) is core. Clusters are components of core points;
    its seed is the first of them. Any other point joins the cluster with the smallest seed s that it has a core
    neighbour c in, if it comes after s or c is s itself; else it is noise.

    The neighbour graph is never written: a task gives the components among its rows as stars (fewer edges than it has
    rows), its rows' numbers of neighbours, and the core neighbours of points that aren't core (fewer than min_points
    each).
    """
    need = max(2.0, min_points) if np.isfinite(min_points) else 2.0
    rows = valid(vectors)
    blocks = Blocks(rows, None, eps, block)
    spec = "kind int, a long, b long"
    if need <= 2:  # whoever has a neighbour is core
        edges = blocks.measured(lambda: Linked(eps, True), spec)
        named = written(components(edges, "a", "b", few=FEW).select(F.col("node").alias("idx"), F.col("component").alias("seed")), "seeds")
    else:
        counts = blocks.measured(lambda: Nearest(eps, True, False), "idx long, n long, other long, distance double").groupBy("idx").agg(F.sum("n").alias("n"))
        core = written(counts.filter(F.col("n") + 1 >= need).select("idx"), "core")
        edges = written(blocks.measured(lambda: Linked(eps, False), spec, core), "core-edges")
        found = components(edges.filter("kind = 0"), "a", "b", few=FEW).withColumnRenamed("node", "idx")
        cores = written(core.join(found, "idx", "left").select("idx", F.coalesce("component", "idx").alias("seed")), "seeds")
        border = edges.filter("kind = 1").select(F.col("a").alias("idx"), F.col("b").alias("c")).join(cores.select(F.col("idx").alias("c"), "seed"), "c")
        named = cores.unionByName(border.filter("idx > seed OR c = seed").groupBy("idx").agg(F.min("seed").alias("seed")))
    seeds = numbered(named.select("seed").distinct(), "seed", "label").withColumn("label", F.col("label") - 1)  # a row for each cluster
    return rows.select("idx").join(named, "idx", "left").join(seeds, "seed", "left").select("idx", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def clusters(labels: DataFrame) -> DataFrame:
    """label, size, first_idx, place: clusters by size, equals by their first point. labels has idx, label."""
    groups = labels.filter("label >= 0").groupBy("label").agg(F.count("*").alias("size"), F.min("idx").alias("first_idx"))
    return numbered(groups.withColumn("by", F.struct(-F.col("size"), "first_idx")), "by", "place").drop("by")


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, centroid): weighted means, in the order of idx, rounded to single precision at every step.

    A weight that is null, NaN, infinite or not positive counts as 1. The rounding makes this a fold over one
    cluster's rows in order, which partial sums can't give: a cluster's sorted rows pass by in one task, which holds
    their sum only.
    """
    w = F.col("w").cast("double")
    rows = vectors.select("label", "idx", F.col("emb").cast("array<float>").alias("emb"), F.when(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf")), 1.0).otherwise(w).alias("w"))
    spec = T.StructType([rows.schema["label"], T.StructField("centroid", T.ArrayType(T.FloatType()))])

    def run(batches):
        label, sums, known, total = None, None, None, 0.0  # known: no null so far, for each dimension; None: a vector was null

        def done(at: pa.Array):
            mean = None if known is None else [v if k else None for v, k in zip((sums / total).astype(np.float32).tolist(), known.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([at, pa.array([mean], pa.list_(pa.float32()))], names=["label", "centroid"])

        for batch in batches:
            for i, (mine, emb, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "emb", "w")), strict=True)):
                if label is None or mine != label[0].as_py():
                    if label is not None:
                        yield done(label)
                    label, total = batch.column("label").take(pa.array([i])), 0.0
                    sums, known = (np.zeros(len(emb)), np.ones(len(emb), bool)) if emb is not None else (None, None)
                total += w
                if emb is None or known is None:
                    known = None
                    continue
                n, size = len(emb), max(len(emb), len(sums))
                if len(sums) < size:
                    sums, known = np.append(sums, np.zeros(size - len(sums))), np.append(known, np.zeros(size - len(known), bool))
                known[n:] = False
                if None in emb:
                    known[:n] &= [v is not None for v in emb]
                sums[:n] = (sums[:n] + np.array(emb, np.float32).astype(np.float64) * w).astype(np.float32)
        if label is not None:
            yield done(label)

    return rows.repartition("label").sortWithinPartitions("label", "idx", "emb", "w").mapInArrow(run, spec)


def _carried(found: DataFrame, known: DataFrame, eps: float) -> DataFrame:
    return nearest_within(valid(found), valid(known), min(0.6, max(0.2, 0.9 * eps)))


def carried_labels(found: DataFrame, known: DataFrame, eps: float = EPS) -> DataFrame:
    """(idx, known_idx): for each new centroid the nearest known one within 0.9 eps (held between 0.2 and 0.6); the first of equals."""
    return _carried(found, known, eps).select("idx", F.col("other").alias("known_idx"))


def replaced_people(faces: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new generation: faces with their cluster as person (noise: null), and people with their face counts."""
    told = faces.drop("person_id").join(labels.filter("label >= 0").select(F.col("idx").alias("id"), F.col("label").alias("person_id")), "id", "left")
    return told, told.filter("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("face_count"))


def merge_people(faces: DataFrame, source: int, target: int) -> DataFrame:
    return faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id")))


def reassign_faces(faces: DataFrame, ids: list[int], person: int | None) -> DataFrame:
    """Faces given to another person, to a new one (a split), or to nobody."""
    return faces.withColumn("person_id", F.when(F.col("id").isin(*ids), F.lit(person).cast(faces.schema["person_id"].dataType)).otherwise(F.col("person_id")))


def delete_person(faces: DataFrame, person: int) -> DataFrame:
    return faces.withColumn("person_id", F.when(~F.col("person_id").eqNullSafe(person), F.col("person_id")))


def recounted(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People with their faces counted anew; those without a face go."""
    counts = faces.filter("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("face_count"))
    return people.drop("face_count").join(counts, "id").select(*people.columns)


def greedy_faces(faces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One best face for each person of a video: faces in the order of time meet the ones kept so far, and the first within
    the threshold is the same person; the better score stays. Sequential by its definition, so a video's sorted rows pass
    by in one task, which holds the faces kept so far. faces has video, frame_time, idx, score, emb."""
    spec = "video long, idx long, score double"

    def merge(batches):
        video, found, kept, n = None, [], np.zeros((0, 0), np.float32), 0

        def done():
            columns = zip(*[(video, i, s) for i, s in found], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["video", "idx", "score"])

        for batch in batches:
            vectors = batch.column("emb").to_pylist()
            for mine, i, s, emb in zip(*(batch.column(c).to_pylist() for c in ("video", "idx", "score")), vectors, strict=True):
                x = np.array(emb, np.float32)
                if mine != video or not n:
                    if n:
                        yield done()
                    video, found, kept, n = mine, [], np.zeros((16, len(x)), np.float32), 0
                same = np.flatnonzero(kept[:n] @ x >= threshold)
                if len(same):
                    best = found[same[0]][1]
                    if s is not None and best is not None and s > best:
                        found[same[0]], kept[same[0]] = (i, s), x
                    continue
                if n == len(kept):
                    kept = np.concatenate((kept, np.zeros_like(kept)))
                found.append((i, s))
                kept[n] = x
                n += 1
        if n:
            yield done()

    rows = faces.select(F.col("video").cast("long").alias("video"), "frame_time", F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"), F.col("emb").cast("array<float>").alias("emb"))
    return rows.repartition("video").sortWithinPartitions("video", F.asc_nulls_last("frame_time"), "idx").mapInArrow(merge, spec)


def _vectors(c: Catalog) -> DataFrame:
    return c.embeddings.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("emb"))


_EDGE_SQL = "SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) <= 1.15"


@query("j11_eps_self_join", _EDGE_SQL)
def eps_join(c: Catalog, eps: float = 1.15) -> DataFrame:
    rows = _vectors(c)
    return within(rows, rows, eps, same=True).select("a", "b")


@query("v1_neighbour_counts", f"SELECT a AS idx, count(*) AS neighbours FROM (SELECT a, b FROM ({_EDGE_SQL}) UNION ALL SELECT b, a FROM ({_EDGE_SQL})) GROUP BY a")
def neighbour_counts(c: Catalog, eps: float = 1.15) -> DataFrame:
    return nearest_within(_vectors(c), None, eps, best=False).withColumnRenamed("n", "neighbours")


_DBSCAN = f"""WITH RECURSIVE e AS ({_EDGE_SQL}), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT vec_id AS idx, vec_id AS seed FROM embeddings UNION SELECT w.b, r.seed FROM reach r JOIN both_ways w ON w.a = r.idx WHERE r.seed < w.b),
seeded AS (SELECT r.idx, min(r.seed) AS seed FROM reach r WHERE r.idx IN (SELECT a FROM both_ways) GROUP BY r.idx),
named AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS label FROM (SELECT DISTINCT seed FROM seeded)),
labels AS (SELECT v.vec_id AS idx, coalesce(n.label, -1) AS label FROM embeddings v LEFT JOIN seeded s ON s.idx = v.vec_id LEFT JOIN named n ON n.seed = s.seed)"""


@query("v2_dbscan", f"{_DBSCAN} SELECT idx, label FROM labels")
def dbscan_labels(c: Catalog) -> DataFrame:
    return dbscan(_vectors(c), 1.15, 2)


@query("v2_dbscan_border_points", f"""
WITH RECURSIVE e AS ({_EDGE_SQL}), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
core AS (SELECT a AS idx FROM both_ways GROUP BY a HAVING count(*) + 1 >= 4),
inner_ways AS (SELECT a, b FROM both_ways WHERE a IN (SELECT idx FROM core) AND b IN (SELECT idx FROM core)),
reach AS (SELECT idx, idx AS seed FROM core UNION SELECT w.b, r.seed FROM reach r JOIN inner_ways w ON w.a = r.idx WHERE r.seed < w.b),
cores AS (SELECT idx, min(seed) AS seed FROM reach GROUP BY idx),
border AS (SELECT w.a AS idx, min(c.seed) AS seed FROM both_ways w JOIN cores c ON c.idx = w.b WHERE w.a NOT IN (SELECT idx FROM core) AND (w.a > c.seed OR c.idx = c.seed) GROUP BY w.a),
seeded AS (SELECT * FROM cores UNION ALL SELECT * FROM border),
named AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS label FROM (SELECT DISTINCT seed FROM seeded))
SELECT v.vec_id AS idx, coalesce(n.label, -1) AS label FROM embeddings v LEFT JOIN seeded s ON s.idx = v.vec_id LEFT JOIN named n ON n.seed = s.seed""")
def dbscan_border(c: Catalog) -> DataFrame:
    return dbscan(_vectors(c), 1.15, 4)


@query("v3_cluster_sizes", f"{_DBSCAN} SELECT label, count(*) AS size, min(idx) AS first_idx, row_number() OVER (ORDER BY count(*) DESC, min(idx)) AS place FROM labels WHERE label >= 0 GROUP BY label")
def cluster_sizes(c: Catalog) -> DataFrame:
    return clusters(dbscan_labels(c))


@query("v4_centroids", "SELECT label, " + ", ".join(f"round(sum(CAST(embedding[{k + 1}] AS DOUBLE) * w) / sum(w), 4) + 0 AS c{k}" for k in range(4)) + " FROM (SELECT label, embedding, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE vec_id % 5 END AS w FROM embeddings) GROUP BY label")
def label_centroids(c: Catalog) -> DataFrame:
    rows = c.embeddings.select(F.col("label").alias("label"), F.col("vec_id").alias("idx"), F.col("embedding").alias("emb"), (F.col("vec_id") % 5).cast("double").alias("w"))
    return centroids(rows).select("label", *[(F.round(F.col("centroid")[k].cast("double"), 4) + 0.0).alias(f"c{k}") for k in range(4)])


@query("v5_label_carry_over", """
WITH known AS (SELECT vec_id // 2 AS known_idx, [CAST((CAST(x AS DOUBLE) + CAST(y AS DOUBLE)) * 0.25e0 AS FLOAT) FOR x, y IN zipped] AS embedding FROM (SELECT a.vec_id, list_zip(a.embedding, b.embedding) AS zipped FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)),
met AS (SELECT v.vec_id AS idx, k.known_idx, list_distance([CAST(CAST(e AS DOUBLE) * 0.5e0 AS FLOAT)::DOUBLE FOR e IN v.embedding], CAST(k.embedding AS DOUBLE[])) AS d FROM embeddings v, known k)
SELECT idx, arg_min(known_idx, [d, CAST(known_idx AS DOUBLE)]) AS known_idx, count(*) AS candidates FROM met WHERE d <= 0.6 GROUP BY idx""".replace("FOR x, y IN zipped", "FOR z IN zipped").replace("CAST(x AS DOUBLE) + CAST(y AS DOUBLE)", "CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)"))
def carry_over(c: Catalog) -> DataFrame:
    """All vectors, at half their length, against an older generation: the halved means of two neighbouring ids each. Most have several candidates."""
    rows = _vectors(c).withColumn("emb", F.transform("emb", lambda x: (x.cast("double") * 0.5).cast("float")))
    twos = c.embeddings.select(F.col("vec_id"), F.col("embedding"))
    pairs = twos.filter("vec_id % 2 = 0").join(twos.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    known = pairs.select(F.floor(F.col("vec_id") / 2).alias("idx"), F.zip_with("embedding", "other", lambda x, y: ((x.cast("double") + y.cast("double")) * 0.25).cast("float")).alias("emb"))
    return _carried(rows, known, EPS).select("idx", F.col("other").alias("known_idx"), F.col("n").alias("candidates"))


@query("v10_clustered_faces", "SELECT id FROM faces WHERE quality_score >= 0.5 AND least(w, h) >= 60 AND w / h BETWEEN 0.5 AND 2")
def clustered_faces(c: Catalog) -> DataFrame:
    return ClusterConfig().faces(c.faces).select("id")


@query("j12_nearest_under_threshold", "SELECT idx, arg_min(other, [d, CAST(other AS DOUBLE)]) AS nearest FROM (SELECT x.vec_id AS idx, y.vec_id AS other, list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id) WHERE d <= 1.2 GROUP BY idx")
def nearest(c: Catalog, eps: float = 1.2) -> DataFrame:
    return nearest_within(_vectors(c), None, eps).select("idx", F.col("other").alias("nearest"))


@query("v6_new_generation", f"{_DBSCAN} SELECT label AS id, count(*) AS face_count FROM labels WHERE label >= 0 GROUP BY label")
def new_generation(c: Catalog) -> DataFrame:
    return replaced_people(c.faces, dbscan_labels(c))[1]


@query("v7_valid_vectors", "SELECT vec_id AS idx, length(embedding) AS dim FROM embeddings WHERE vec_id % 3 <> 0")
def valid_vectors(c: Catalog) -> DataFrame:
    ragged = c.embeddings.select(F.col("vec_id").alias("idx"), F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 0)).when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("emb"))
    return valid(ragged.filter("idx > 0 OR size(emb) > 0").withColumn("idx", F.when(F.size("emb") == 5, F.col("idx") + 1_000_000).otherwise(F.col("idx")))).select("idx", F.size("emb").cast("long").alias("dim"))


@query("v8_merge_people", "SELECT CASE WHEN person_id = 4 THEN 2 ELSE person_id END AS person_id, count(*) AS faces FROM faces WHERE person_id IS NOT NULL GROUP BY 1")
def merged_people(c: Catalog) -> DataFrame:
    return merge_people(c.faces, 4, 2).filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("faces"))


@query("j14_greedy_faces", """
WITH RECURSIVE f AS (SELECT vec_id % 20 AS video, vec_id AS idx, CAST(vec_id % 11 AS DOUBLE) AS score, embedding, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id % 7, vec_id) AS n FROM embeddings),
s AS (
  SELECT video, n, [{'idx': idx, 'score': score, 'embedding': embedding}] AS kept FROM f WHERE n = 1
  UNION ALL
  SELECT video, n, CASE WHEN place IS NULL THEN list_append(kept, mine) WHEN mine.score > kept[place].score THEN kept[: place - 1] || [mine] || kept[place + 1 :] ELSE kept END
  FROM (SELECT f.video, f.n, s.kept, {'idx': f.idx, 'score': f.score, 'embedding': f.embedding} AS mine, list_position([list_dot_product(k.embedding, f.embedding) >= 0.2 FOR k IN s.kept], true) AS place
    FROM s JOIN f ON f.video = s.video AND f.n = s.n + 1))
SELECT video, k.idx AS idx, k.score AS score FROM (SELECT video, unnest(kept) AS k FROM (SELECT *, max(n) OVER (PARTITION BY video) AS last FROM s) WHERE n = last)""")
def greedy(c: Catalog) -> DataFrame:
    return greedy_faces(c.embeddings.select((F.col("vec_id") % 20).alias("video"), (F.col("vec_id") % 7).cast("double").alias("frame_time"), F.col("vec_id").alias("idx"), (F.col("vec_id") % 11).cast("double").alias("score"), F.col("embedding").alias("emb")), 0.2)


@query("v8_split_and_recount", """
WITH f AS (SELECT CASE WHEN id IN (3, 12, 21) THEN 9 WHEN person_id = 5 THEN NULL ELSE person_id END AS person_id FROM faces)
SELECT p.id, count(*) AS face_count FROM people p JOIN f ON f.person_id = p.id GROUP BY p.id""")
def split_and_recount(c: Catalog) -> DataFrame:
    faces = reassign_faces(delete_person(c.faces, 5), [3, 12, 21], 9)
    return recounted(c.people, faces).select("id", "face_count")
