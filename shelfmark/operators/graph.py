"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Edges that one task may label by itself (two longs each), for callers who ask for it.
FEW = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their least reachable node) of an edge list: roots hook on to lesser ones, and paths are halved, until nothing moves."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    p, q, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(p):
        a, b = label[p], label[q]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return nodes, nodes[label]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if parts:
            nodes, least = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100, few: int = 0) -> DataFrame:
    """(node, component): the smallest node that each endpoint of an edge can reach.

    Edges go either way; nulls and loops name no edge (a node with a loop only has no row). Each round links every
    node's larger neighbours to its least one, then its smaller ones: the number of rounds grows with the logarithm of
    the longest chain. A node's neighbours are never gathered: least neighbours are partial aggregates, joined back.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    told = Observation()
    current = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().observe(told, F.count("*").alias("n")), "edges")
    if told.get["n"] <= few:
        return _at_once(current)
    before = None
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        seen = Observation()
        rows = small.union(down.select("u", F.col("m").alias("v"))).distinct()
        current = written(rows.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "stars")
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    stars = current.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
