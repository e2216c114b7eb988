"""Pairs of blocks on a grid of tasks: blocks of rows are numbered, consecutive numbers form lines, and a task has the pairs of two lines.

A block moves once for each line that it meets, not once for each block: with a fixed number of lines what moves grows
with the rows. A task holds one line's blocks (at most about HELD bytes) and the other's pass by, one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .relational import numbered

#: Lines at least (fewer blocks: a line each); bytes of a line.
LINES, HELD = 8, 32 << 20


def on_grid(sides: list[DataFrame], meets: DataFrame, keys: list[str], sizes: list[int], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], spec: str) -> DataFrame:
    """What run gives for the pairs of blocks in meets (a_ and b_ with each key); sizes: bytes of each side.

    sides are one or two tables of blocks. With one, a pair's first block doesn't come after its second in the order
    of keys. A task's rows: the first line's blocks (side 0), then the second's (side 1), each with the numbers of the
    blocks that it meets (met); the blocks' other columns as they are, and their number (no).
    """
    named = [numbered(s.select(F.struct(*keys).alias("key")), "key", "no").select("key.*", (F.col("no") - 1).cast("int").alias("no")) for s in sides]
    spread = math.ceil(math.sqrt(4 * meets.sparkSession.sparkContext.defaultParallelism))
    counts = [s.count() for s in sides]
    lines = [max(1, min(n, max(LINES, spread, -(-size // HELD)))) for n, size in zip(counts, sizes, strict=True)]
    met = meets
    for s, k in (("a", 0), ("b", -1)):
        met = met.join(named[k].select(*[F.col(x).alias(f"{s}_{x}") for x in keys], F.col("no").alias(f"{s}_no")), [f"{s}_{x}" for x in keys])
        met = met.withColumn(f"{s}_line", F.floor(F.col(f"{s}_no").cast("long") * lines[k] / max(counts[k], 1)).cast("int"))
    met = written(met.select("a_no", "b_no", (F.col("a_line") * lines[-1] + F.col("b_line")).alias("task")), "met")
    needs = [met.select("task", F.col("a_no").alias("no"), F.lit(0).alias("side"), F.lit(None).cast("array<int>").alias("met")).distinct(), met.groupBy("task", F.col("b_no").alias("no")).agg(F.lit(1).alias("side"), F.sort_array(F.collect_list("a_no")).alias("met"))]  # at most the blocks of a line
    dealt = [need.join(named[k], "no").join(sides[k], keys).drop(*keys) for need, k in zip(needs, (0, -1), strict=True)]
    rows = dealt[0].unionByName(dealt[1]).repartitionById(lines[0] * lines[-1], "task")
    return rows.sortWithinPartitions("side", "no").mapInArrow(run, spec)
