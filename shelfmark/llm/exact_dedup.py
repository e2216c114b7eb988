"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are dealt by hash,
sorted within their partition, and named by that order: an integer for each distinct block. Adjacent names are then
paired, the distinct pairs sorted and named in the same way, until each document has one integer. Two documents get
the same integer on the same level if and only if their texts are equal: no digest decides.

A 64-bit digest only routes: a block travels once, to where it is named, and its occurrences find the name by the
digest where exactly one block has it, else by the block itself.

Everything is a DataFrame operation. Groups of copies are combined before each shuffle (partial aggregation), and
joins back to occurrences are sort-merge joins that adaptive execution splits where a name is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: Shared digests that are told to the scan one by one, at most.
FEW = 1000


def normalised(text: Column) -> Column:
    """Each run of space characters as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Integer names of distinct rows by their sorted order within hash partitions."""
    return distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def _digest(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): (level, name) is the same for equal texts only.

    row numbers the input's rows, so that repeated or null ids are no trouble. A null text is the empty text, of one
    empty block. An empty table has an empty result. digest_bits is for tests, to bring about collisions.
    """
    source = common.pair(docs, id_col, text_col).withColumn("norm", normalised(F.col("text")).cast("binary"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("norm") - 1) / block).cast("int"))), lambda i: F.substring("norm", i * block + 1, F.lit(block)))
    distinct = source.select(F.explode(cut).alias("block")).groupBy("block").agg(F.lit(0).alias("_"))
    names = common.keep(_named(distinct.select("block"), ["block"], "name").withColumn("digest", _digest(F.col("block"), digest_bits)), "names")
    by_digest = names.groupBy("digest").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    shared = [r["digest"] for r in by_digest.filter("n > 1").select("digest").limit(FEW + 1).collect()]  # of n blocks about n * n / 2 ** 65
    # blocks whose digest is another block's too stay with their place; all do where those are many
    blocks = [F.filter(F.transform(cut, lambda b, i: F.struct(i.alias("pos"), b.alias("x"))), lambda s: _digest(s["x"], digest_bits).isin(shared) if len(shared) <= FEW else F.lit(True)).alias("blocks")] if shared else []
    first = source.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(cut, lambda b: _digest(b, digest_bits)).alias("digests"), *blocks)
    first = common.keep(first.withColumn("row", F.monotonically_increasing_id()), "blocks")
    places = first.select("row", F.size("digests").alias("width"), F.posexplode("digests").alias("pos", "digest"))
    sole = places.join(by_digest.filter("n = 1").select("digest", "name"), "digest").select("row", "width", "pos", "name")
    if shared:
        again = first.select("row", F.size("digests").alias("width"), F.explode("blocks").alias("b")).select("row", "width", "b.pos", F.col("b.x").alias("block"))
        again = again.withColumn("digest", _digest(F.col("block"), digest_bits)).join(by_digest.filter("n > 1").select("digest"), "digest", "left_semi")
        sole = sole.unionByName(again.join(names.select("block", "name"), "block").select("row", "width", "pos", "name"))
    # occurrences of texts of more than one block go on; a level halves them
    level, ended, current = 0, [], common.keep(sole, "level")
    while True:
        ended.append(current.filter("width = 1").select("row", F.lit(level).alias("level"), "name"))
        current = current.filter("width > 1")
        if current.isEmpty():
            break
        pairs = current.groupBy("row", "width", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = common.keep(pairs, "pairs")
        named = common.keep(_named(pairs.groupBy("left", "right").agg(F.lit(0).alias("_")).select("left", "right"), ["left", "right"], "name"), "names")
        current = common.keep(pairs.join(named, ["left", "right"]).select("row", F.ceil(F.col("width") / 2).cast("int").alias("width"), F.col("at").alias("pos"), "name"), "level")
        level += 1
    whole = ended[0]
    for x in ended[1:]:
        whole = whole.unionByName(x)
    return first.select("row", "doc_id", "text_sha256").join(whole, "row")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Of equal texts, the smallest id stays (nulls last); rows that repeat that id are kept with it. Null texts equal empty ones.
    """
    named = common.keep(identities(docs, id_col, text_col, block, digest_bits), "identities")
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that dedup() drops; of rows that repeat a kept id with an equal text, one stays."""
    gone_id, gone_sha, own = common.fresh(docs.columns, "id", "sha", "own")
    named = common.keep(dedup(docs, id_col, text_col).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), F.col("kept").alias("kept")), "named")
    keyed = docs.withColumn(own, F.sha2(normalised(F.col(text_col).cast("string")).cast("binary"), 256))
    gone = named.filter("NOT kept").select(gone_id, gone_sha).distinct()
    left = keyed.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha)), "left_anti")
    if not named.filter("kept").groupBy(gone_id, gone_sha).count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, own])
    return left.drop(own)


def op4_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
