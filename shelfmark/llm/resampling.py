"""Importance resampling towards a target: hashed runs of words, bucket gains, and a draw without replacement.

Both corpora are counted by buckets of hashed features. A document's weight is the mean gain of its features; a Gumbel
variable that its id fixes is added, and the highest sums are drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import numbered
from . import byte_automaton, common

#: Buckets of hashed features; longest run of words; percentage drawn; words of a document that takes part; the draw's seed.
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Text bytes of one step: arrays over them stay in a core's cache.
_STEP = 1 << 20


def _features(batch: pa.RecordBatch, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features of each length, how many each text has of them, and the texts' words."""
    raw, off = common.text_bytes(batch)
    low, starts, ends, word_off = byte_automaton.words(raw, off)
    for k, crc in enumerate(byte_automaton.run_crcs(low, starts, ends, word_off, longest), 1):
        yield crc % np.uint32(buckets), byte_automaton.run_counts(word_off, k), np.diff(word_off)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has. Tasks count their own texts, so at most `buckets` rows leave each; as many are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in common.small_batches(batches, limit=_STEP):
            for found, _, _ in _features(batch, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    rows = common.bounded(texts).select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(common.tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which the target's share of a bucket exceeds the corpus', each count plus one; floored."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row. A null text has no words; a null id is written as nothing in the draw's hash."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in common.small_batches(batches, limit=_STEP):
            total, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, counts, n_words in _features(batch, longest, len(own)):
                sums = np.concatenate(([0], np.cumsum(own[found])))
                ends = np.cumsum(counts)
                total += sums[ends] - sums[ends - counts]
                n += counts
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = common.pair(docs, id_col, text_col).mapInArrow(common.tidy(weigh), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + gumbel.cast("long"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs: rank 1, 2, ... of those drawn, null for the others.

    Of the rows with least_words words or more, percent in a hundred (rounded down) with the highest scores are drawn;
    equal scores by the smaller id (nulls first), rows of one id in any order. Null and empty texts have no features,
    weight 0, and aren't drawn. An empty table gives an empty result, an empty target gains from smoothing alone.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    rows = common.keep(scored(docs, gain, id_col, text_col, longest, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    fine = rows.filter(F.col("n_words") >= least_words)
    drawn = fine.count() * percent // 100
    ranked = numbered(fine.withColumn("by", F.struct(-F.col("score"), "doc_id", "row")), "by", "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that resampled() draws, by id (rows that share a drawn id stay together), with all their columns."""
    ids = resampled(docs, target, id_col, text_col, **settings).filter("rank IS NOT NULL").select("doc_id").distinct()
    (name,) = common.fresh(docs.columns, "drawn")
    return docs.join(ids.withColumnRenamed("doc_id", name), F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
tab AS (SELECT [list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS crc),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bytes AS (SELECT word, [16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) + instr('0123456789ABCDEF', h[2 * k + 2]) - 1 FOR k IN range(length(h) // 2)] AS b FROM vocabulary),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(b, lambda c, x: xor(crc[xor(c, x) % 256 + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS MATERIALIZED (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n, list_reduce([instr('0123456789abcdef', sha256('2024:' || doc_id)[k + 1]) - 1 FOR k IN range(8)], lambda c, x: c * 16 + x, 0) AS h FROM d),
scored AS (SELECT doc_id, n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n >= 20) THEN place END AS rank FROM ranked
"""
