"""Pairs of vectors within a distance, by a blocked join that is pruned before any row moves.

Centres come from the data: pivots of a bounded sample, farthest first, then the means of the sample's rows nearest to
each. A row belongs to its nearest centre's cell; a cell is cut into rings by the distance to its centre and these into
blocks of bounded size. What is kept of a cell is its least and greatest distance to every centre, and how far it stays
on its own side of the plane between its centre and each other one. Two blocks meet only if neither the triangle
inequality nor the planes tell them apart. Pairs of blocks are dealt to tasks on a grid (grid.py), so that what moves
grows with the rows, and what a task finds is reduced there where pairs themselves aren't asked for. A pair of blocks is
a few matrix products in single precision; what that leaves open is measured again in doubles, in the order of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import roots
from .grid import on_grid

#: Rows of a block, at most so many bytes of them; rows of the sample; centres.
BLOCK, BLOCK_BYTES, SAMPLE, CENTRES = 2048, 8 << 20, 4096, 256
#: Rows whose products are made at once (their sums fit a byte); edges that a task holds before it reduces them (some 100 bytes each meanwhile).
STRIP, EDGES = 255, 1 << 18
#: Distances to centres (or values of rows, if these are more) that a task holds at once when it deals rows to cells.
MEASURED = 1 << 18


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A column of float lists of one length as an n x dimension array."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float32).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def finite(rows: DataFrame) -> DataFrame:
    """(idx, emb) whose every value is a finite number: no other vector has a neighbour."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.select("idx", F.col("emb").cast("array<float>").alias("emb")).filter("emb IS NOT NULL AND idx IS NOT NULL").filter(~F.exists("emb", bad))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y, in doubles."""
    return np.maximum(0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T))


def centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots, each the farthest from those before (the first: from the mean); then the means of what is nearest to each."""
    if not len(sample):
        return sample
    far = squares(sample, sample.mean(axis=0, keepdims=True))[:, 0]
    chosen, far = [int(np.argmax(far))], None
    while len(chosen) < most:
        own = squares(sample, sample[chosen[-1:]])[:, 0]
        far = own if far is None else np.minimum(far, own)
        if far.max() <= 0:
            break
        chosen.append(int(np.argmax(far)))
    near = np.argmin(squares(sample, sample[chosen]), axis=1)
    return np.stack([sample[near == k].mean(axis=0) if (near == k).any() else sample[c] for k, c in enumerate(chosen)])


class Cells:
    """What a task has seen of the cells of centres c: least and greatest distance to every centre, and how far a cell stays behind each plane."""

    def __init__(self, c: np.ndarray):
        k = len(c)
        self.c, self.gap = c, np.sqrt(squares(c, c))
        self.low, self.high, self.plane = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full((k, k), np.inf)

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and the distance to its centre; some rows at a time, whatever the number of centres."""
        cell, own, most = np.zeros(len(x), np.int32), np.zeros(len(x)), max(1, MEASURED // max(self.c.shape))
        for i in range(0, len(x), most):
            cell[i : i + most], own[i : i + most] = self._deal(x[i : i + most].astype(np.float64))
        return cell, own

    def _deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high, plane, gap = self.low, self.high, self.plane, self.gap
        d2 = squares(x, self.c)
        cell = np.argmin(d2, axis=1)
        mine = d2[np.arange(len(x)), cell]
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) > 0)))
        present = cell[order][first]
        d = np.sqrt(d2[order])
        low[present] = np.minimum(low[present], np.minimum.reduceat(d, first))
        high[present] = np.maximum(high[present], np.maximum.reduceat(d, first))
        with np.errstate(divide="ignore", invalid="ignore"):
            side = (d2[order] - mine[order][:, None]) / (2 * gap[cell[order]])
        plane[present] = np.minimum(plane[present], np.minimum.reduceat(np.where(gap[cell[order]] > 0, side, 0.0), first))
        return cell, np.sqrt(mine)


def _dealt(rows: DataFrame, held) -> DataFrame:
    """Rows (kind 0) with their cell and the distance to its centre; bounds of the cells (kind 1), one for each task, cell and centre."""
    names = ["kind", "idx", "emb", "cell", "own", "other", "low", "high", "plane"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(held.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cell, own = cells.deal(matrix(batch.column("emb"), n))
            none = pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("idx"), batch.column("emb"), pa.array(cell), pa.array(own), pa.nulls(n, pa.int32()), none, none, none], names=names)
        at, other = np.nonzero(np.isfinite(cells.low))
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.float32())), pa.array(at.astype(np.int32)), pa.nulls(n, pa.float64()), pa.array(other.astype(np.int32)), *[pa.array(x[at, other]) for x in (cells.low, cells.high, cells.plane)]], names=names)

    return rows.select(F.col("idx").cast("long").alias("idx"), "emb").mapInArrow(run, "kind int, idx long, emb array<float>, cell int, own double, other int, low double, high double, plane double")


def _bounds(dealt: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest distance of each cell to each centre, and how far it stays behind the plane; at most CENTRES ** 2 rows are collected."""
    low, high, plane = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full((k, k), np.inf)
    for r in dealt.filter("kind = 1").groupBy("cell", "other").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("plane").alias("plane")).collect():
        low[r["cell"], r["other"]], high[r["cell"], r["other"]], plane[r["cell"], r["other"]] = r["low"], r["high"], r["plane"]
    return low, high, plane


@dataclass
class Side:
    """A block's rows in the order of idx: ids, vectors, marks; and what a task has found for them."""

    ids: np.ndarray
    emb: np.ndarray
    marks: np.ndarray
    found: dict = field(default_factory=dict)

    def only(self, keep: np.ndarray) -> Side:
        return self if keep.all() else Side(self.ids[keep], self.emb[keep], self.marks[keep])

    @cached_property
    def norms(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.emb, self.emb, dtype=np.float64)

    @cached_property
    def big(self) -> bool:
        return bool(np.abs(self.emb).max(initial=0) > 1e15)

    def factor(self, first: bool, kind: type) -> np.ndarray:
        """first @ second.T are the squared distances: (-2x, x^2, 1) and (y, 1, y^2)."""
        at = ("factor", first, kind)
        if at not in self.found:
            one, norms = np.ones((len(self.ids), 1), kind), self.norms.astype(kind)[:, None]
            self.found[at] = np.hstack((-2 * self.emb.astype(kind), norms, one) if first else (self.emb.astype(kind), one, norms))
        return self.found[at]


class Fold:
    """What a task does with pairs of blocks: meet() gets each, leave() a block that is done in this task, end() comes last; each may give columns."""

    def meet(self, a: Side, b: Side, own: bool) -> Iterator[list]:
        return iter(())

    def leave(self, side: Side, first: bool) -> Iterator[list]:
        return iter(())

    def end(self) -> Iterator[list]:
        return iter(())


class Blocks:
    """Two tables of vectors (idx, emb), or one with itself, in blocks, and the pairs of blocks that may hold neighbours within eps."""

    def __init__(self, left: DataFrame, right: DataFrame | None, eps: float, block: int = BLOCK):
        self.eps, self.same = float(eps), right is None
        spark = left.sparkSession
        sides = [finite(left)] + ([] if self.same else [finite(right)])
        rows = sides[0] if self.same else sides[0].unionByName(sides[1])
        seen = rows.agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim")).first()
        self.size = seen["n"] * (4 * (seen["dim"] or 1) + 9)
        self.block = max(64, min(block, BLOCK_BYTES // (4 * max(seen["dim"] or 1, 1)))) if block == BLOCK else block
        names = [f"{s}_{x}" for s in "ab" for x in ("cell", "ring", "part")]
        if seen["n"] <= self.block:  # one block, which meets itself or the other side's
            self.rows = [s.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("ring"), F.lit(0).alias("part"), F.col("idx").cast("long").alias("idx"), "emb") for s in sides]
            self.meets = spark.range(1).select(*[F.lit(0).cast("long" if "ring" in x else "int").alias(x) for x in names])
            self.counts = lambda: (1, 1)
            return
        k = max(1, min(CENTRES, -(-seen["n"] // self.block)))
        sides = [s.filter(F.size("emb") == seen["dim"]) for s in sides]
        rows = rows.filter(F.size("emb") == seen["dim"])
        sample = [r["emb"] for r in rows.orderBy(F.xxhash64("idx"), "idx").limit(SAMPLE).select("emb").collect()]
        self.centres = centres(np.array(sample, np.float64), k)
        held = spark.sparkContext.broadcast(self.centres)
        dealt = [written(_dealt(s, held), "cells") for s in sides]
        bounds = [_bounds(d, len(self.centres)) for d in dealt]
        pairs, wide = self._cell_pairs(bounds[0], bounds[-1])
        cut = [self._cut(d.filter("kind = 0").select("idx", "emb", "cell", "own"), wide) for d in dealt]
        self.rows = [c[0] for c in cut]
        named = [c[1].select(*[F.col(x).alias(f"{s}_{x}") for x in ("cell", "ring", "part")]) for c, s in zip((cut[0], cut[-1]), "ab", strict=True)]
        meets = named[0].join(F.broadcast(spark.createDataFrame(pairs)), "a_cell").join(named[1], "b_cell")  # at most CENTRES ** 2 rows
        near = lambda ring, low, high: (F.col(low) - (F.col(ring) + 1) * wide <= wide) & (F.col(ring) * wide - F.col(high) <= wide)
        meets = meets.filter(F.when(F.col("a_cell") == F.col("b_cell"), F.abs(F.col("a_ring") - F.col("b_ring")) <= 1).otherwise(near("a_ring", "b_low", "b_high") & near("b_ring", "a_low", "a_high")))
        if self.same:  # each pair of blocks once
            meets = meets.filter("struct(a_cell, a_ring, a_part) <= struct(b_cell, b_ring, b_part)")
        self.meets = meets.select(*names)
        self.counts = lambda: tuple(c[1].count() for c in (cut[0], cut[-1]))

    def _cell_pairs(self, one: tuple, two: tuple) -> tuple[pa.Table, float]:
        """Pairs of cells that may meet, with the bounds of each to the other's centre; and the width of a ring."""
        (low_a, high_a, plane_a), (low_b, high_b, plane_b) = one, two
        top = max([float(x[np.isfinite(x)].max(initial=0)) for x in (high_a, high_b)])
        wide = max(self.eps * (1 + 1e-6) + 1e-6 * top, 1e-300)  # distances to centres are right to about 1e-7 of their size
        some_a, some_b = np.isfinite(low_a).any(axis=1), np.isfinite(low_b).any(axis=1)
        kept = []
        for a in np.flatnonzero(some_a):
            apart = np.maximum((low_a[a][None, :] - high_b).max(axis=1), (low_b - high_a[a][None, :]).max(axis=1))
            with np.errstate(invalid="ignore"):
                apart = np.where(np.arange(len(apart)) == a, apart, np.maximum(apart, plane_a[a] + plane_b[:, a]))
            for b in np.flatnonzero(some_b & (apart <= wide)):
                kept.append((a, b, low_b[b, a], high_b[b, a], low_a[a, b], high_a[a, b]))
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
        columns = list(zip(*kept, strict=True)) if kept else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a_cell", "b_cell", "b_low", "b_high", "a_low", "a_high"]), wide

    def _cut(self, rows: DataFrame, wide: float) -> tuple[DataFrame, DataFrame]:
        """The rows with their blocks (cell, ring, part), and the blocks."""
        ringed = rows.withColumn("ring", F.floor(F.col("own") / wide))
        sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / self.block).cast("int").alias("parts"))
        dealt = ringed.join(sizes, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int"))
        return dealt.select("cell", "ring", "part", "idx", "emb"), sizes.select("cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def measured(self, make: Callable[[], Fold], spec: str, marks: DataFrame | None = None) -> DataFrame:
        """What a Fold of each task gives for the pairs of blocks that meet. marks (idx): rows that are marked."""
        names = [x.split()[0] for x in spec.split(", ")]
        same = self.same

        def pack(table: pa.Table) -> pa.Table:
            idx = np.asarray(table["idx"], dtype=np.int64)
            order = np.argsort(idx, kind="stable")
            emb, mark = matrix(table["emb"], len(idx))[order], np.asarray(table["mark"])[order]
            return pa.table([*[table[x].slice(0, 1) for x in ("cell", "ring", "part")], *[pa.array([x.tobytes()], pa.binary()) for x in (idx[order], emb, mark.astype(bool))]], names=["cell", "ring", "part", "ids", "emb", "marks"])

        def packed(rows: DataFrame) -> DataFrame:
            told = rows.withColumn("mark", F.lit(False)) if marks is None else rows.join(marks.select("idx", F.lit(True).alias("m")), "idx", "left").withColumn("mark", F.coalesce("m", F.lit(False)))
            blocks = told.select("cell", "ring", "part", "idx", "emb", "mark").groupBy("cell", "ring", "part").applyInArrow(pack, "cell int, ring long, part int, ids binary, emb binary, marks binary")
            return written(blocks, "blocks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, held = make(), {}
            told = lambda columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, emb, mark = (batch.column(x)[i].as_buffer() for x in ("ids", "emb", "marks"))
                    ids, no = np.frombuffer(ids, np.int64), batch.column("no")[i].as_py()
                    side = Side(ids, np.frombuffer(emb, np.float32).reshape(len(ids), -1), np.frombuffer(mark, bool))
                    if batch.column("side")[i].as_py() == 0:
                        held[no] = side
                        continue
                    for k in batch.column("met")[i].as_py():
                        yield from map(told, fold.meet(held[k], side, same and k == no))
                    yield from map(told, fold.leave(side, False))
            for side in held.values():
                yield from map(told, fold.leave(side, True))
            yield from map(told, fold.end())

        ready = [packed(r) for r in self.rows]
        return on_grid(ready, self.meets, ["cell", "ring", "part"], [self.size] * len(ready), run, spec)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows: squares are added in doubles, in the order of dimensions."""
    out, most = np.zeros(len(x)), max(1, (1 << 22) // max(x.shape[1], 1))
    for k in range(0, len(x), most):
        out[k : k + most] = np.sqrt(np.add.accumulate((x[k : k + most].astype(np.float64) - y[k : k + most]) ** 2, axis=1)[:, -1]) if x.shape[1] else 0.0
    return out


def near(a: Side, b: Side, eps: float) -> Iterator[tuple[int, np.ndarray, float]]:
    """For some rows of a at a time: the first of them, squared distances of all b's rows, and how far any of these may be off."""
    kind = np.float64 if a.big or b.big else np.float32
    x, y = a.factor(True, kind), b.factor(False, kind)
    top, unit = b.norms.max(initial=0), rounding(a, b)
    for i in range(0, len(x), STRIP):
        yield i, x[i : i + STRIP] @ y.T, unit * (a.norms[i : i + STRIP].max(initial=0) + top) + 1e-36 * x.shape[1]


def rounding(a: Side, b: Side) -> float:
    """A squared distance by product is off by so much of both squared lengths at most."""
    return (a.emb.shape[1] + 8) * (3e-16 if a.big or b.big else 1.3e-7)


def sorted_out(a: Side, b: Side, eps: float, i: int, far: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of far are surely within eps, and the places (p, q) of the others that measuring again shows to be."""
    sure = far < eps * eps - slack
    p, q = np.divmod(np.flatnonzero((far <= eps * eps + slack) & ~sure), far.shape[1])
    if len(p):  # lengths differ: a pair's own may tell
        own = rounding(a, b) * (a.norms[i + p] + b.norms[q]) + 1e-36 * (a.emb.shape[1] + 2)
        over = far[p, q].astype(np.float64) - eps * eps
        fine, open_ = over < -own, np.flatnonzero(np.abs(over) <= own)
        fine[open_] = exact(a.emb[i + p[open_]], b.emb[q[open_]]) <= eps
        p, q = p[fine], q[fine]
    return sure, p, q


def adjacency(a: Side, b: Side, eps: float) -> np.ndarray:
    out = np.zeros((len(a.ids), len(b.ids)), bool)
    for i, far, slack in near(a, b, eps):
        sure, p, q = sorted_out(a, b, eps, i, far, slack)
        sure[p, q] = True
        out[i : i + len(sure)] = sure
    return out


class Pairs(Fold):
    """(a, b, distance) of all pairs; of one table with itself with a < b."""

    def __init__(self, eps: float, same: bool):
        self.eps, self.same = eps, same

    def meet(self, a: Side, b: Side, own: bool) -> Iterator[list]:
        for i, far, slack in near(a, b, self.eps):
            p, q = np.divmod(np.flatnonzero(far <= self.eps * self.eps + slack), far.shape[1])
            if own:
                p, q = p[q > p + i], q[q > p + i]
            d = exact(a.emb[i + p], b.emb[q])
            m, n = a.ids[i + p], b.ids[q]
            fine = (d <= self.eps) & (m != n if self.same else True)
            m, n, d = m[fine], n[fine], d[fine]
            yield [np.minimum(m, n) if self.same else m, np.maximum(m, n) if self.same else n, d]


class Nearest(Fold):
    """(idx, n, other, distance) for rows of a, and of one table with itself of b too: how many neighbours a task has found, and the nearest, the first of equals.

    Only rows that may be nearer than what is known are measured in doubles. Without `best` neighbours are only counted.
    """

    def __init__(self, eps: float, same: bool, best: bool = True):
        self.eps, self.same, self.best = eps, same, best

    def state(self, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "nearest" not in side.found:
            n = len(side.ids)
            side.found["nearest"] = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
        return side.found["nearest"]

    def meet(self, a: Side, b: Side, own: bool) -> Iterator[list]:
        (count_a, _, _), (count_b, _, _) = self.state(a), self.state(b)
        alike = own or self.same and len(np.intersect1d(a.ids, b.ids))
        both = self.same and not own
        for i, far, slack in near(a, b, self.eps):
            rows = slice(i, i + len(far))
            if alike:
                far[a.ids[rows, None] == b.ids[None, :]] = np.inf
            sure, p, q = sorted_out(a, b, self.eps, i, far, slack)
            count_a[rows] += np.count_nonzero(sure, axis=1) + np.bincount(p, minlength=len(far))
            if both:
                count_b += np.add.reduce(sure.view(np.uint8), axis=0, dtype=np.uint8)
                count_b += np.bincount(q, minlength=len(b.ids))
            if self.best:
                self.nearer(a, b, far, i, slack, 1)
                if both:
                    self.nearer(a, b, far, i, slack, 0)
        return iter(())

    def nearer(self, a: Side, b: Side, far: np.ndarray, i: int, slack: float, axis: int) -> None:
        """Betters what is known of a's rows (axis 1) or b's (axis 0)."""
        _, distance, other = self.state(a if axis else b)
        base = i if axis else 0
        least = far.min(axis=axis)
        known = distance[base : base + len(least)]
        at = np.flatnonzero((least <= self.eps * self.eps + slack) & (least - 2 * slack <= known * known * (1 + 1e-6)))
        if not len(at):
            return
        p, q = np.nonzero((far[at] if axis else far[:, at].T) <= (least[at] + 2 * slack)[:, None])
        p = at[p]
        d = exact(a.emb[i + p], b.emb[q]) if axis else exact(b.emb[p], a.emb[i + q])
        ids = b.ids[q] if axis else a.ids[i + q]
        order = np.lexsort((ids, d, p))
        order = order[np.concatenate(([True], np.diff(p[order]) > 0))]
        p, d, ids = base + p[order], d[order], ids[order]
        fine = (d <= self.eps) & ((d < distance[p]) | ((d == distance[p]) & (ids < other[p])))
        distance[p[fine]], other[p[fine]] = d[fine], ids[fine]

    def leave(self, side: Side, first: bool) -> Iterator[list]:
        if "nearest" in side.found and (first or self.same):
            n, distance, other = side.found["nearest"]
            some = n > 0
            yield [side.ids[some], n[some], other[some], distance[some]]


class Linked(Fold):
    """(kind, a, b): as kind 0 the components of marked rows that a task sees, as stars; as kind 1 (row that isn't marked, its marked neighbour).

    With every row taken as marked there is kind 0 only.
    """

    def __init__(self, eps: float, every: bool):
        self.eps, self.every, self.edges, self.many = eps, every, [], 0

    def meet(self, a: Side, b: Side, own: bool) -> Iterator[list]:
        core_a, core_b = (a, b) if self.every else (self.marked(a, True), self.marked(b, True))
        met = adjacency(core_a, core_b, self.eps)
        if own:
            np.fill_diagonal(met, False)
        self.edges.append(stars(met, core_a.ids, core_b.ids, own))
        self.many += len(self.edges[-1][0])
        if self.many > EDGES:
            self.reduce()
        if not self.every:
            for outer, inner in ((self.marked(a, False), core_b), *([] if own else [(self.marked(b, False), core_a)])):
                p, q = np.nonzero(adjacency(outer, inner, self.eps))
                yield [np.ones(len(p), np.int32), outer.ids[p], inner.ids[q]]

    def marked(self, side: Side, core: bool) -> Side:
        if core not in side.found:
            side.found[core] = side.only(side.marks == core)
        return side.found[core]

    def reduce(self) -> None:
        nodes, least = roots(*(np.concatenate([e[k] for e in self.edges]) for k in (0, 1)))
        some = nodes != least
        self.edges = [(least[some], nodes[some])]
        self.many = 0  # edges since

    def end(self) -> Iterator[list]:
        if self.edges:
            self.reduce()
            u, v = self.edges[0]
            yield [np.zeros(len(u), np.int32), u, v]


def within(left: DataFrame, right: DataFrame, eps: float, same: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of pairs at most eps apart; of one table with itself (same) with a < b.

    Distances add squares in doubles, in the order of dimensions; vectors with a null, NaN or infinite value, or of
    fewer dimensions than the longest, have no neighbours.
    """
    return Blocks(left, None if same else right, eps, block).measured(lambda: Pairs(eps, same), "a long, b long, distance double")


def nearest_within(left: DataFrame, right: DataFrame | None, eps: float, best: bool = True, block: int = BLOCK) -> DataFrame:
    """(idx, n, other, distance): for each row of left that has neighbours in right (None: others of left) how many within eps, and the nearest one, the first of equals.

    The pairs themselves are never written: a task gives one row for each of its rows. Without best there are idx and n only.
    """
    blocks, same = Blocks(left, right, eps, block), right is None
    found = blocks.measured(lambda: Nearest(eps, same, best), "idx long, n long, other long, distance double")
    n = F.sum("n").alias("n")
    if not best:
        return found.groupBy("idx").agg(n)
    return found.groupBy("idx").agg(n, F.min(F.struct("distance", "other")).alias("m")).select("idx", "n", F.col("m.other").alias("other"), F.col("m.distance").alias("distance"))


def stars(near_: np.ndarray, a: np.ndarray, b: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The components of a block pair's adjacency as edges (least id, other id): fewer than it has rows."""
    left_x = near_.any(axis=1)
    left_y = np.zeros(len(b), bool) if own else near_.any(axis=0)
    roots, nodes = [], []
    while left_x.any():
        front = np.zeros(len(a), bool)
        front[np.argmax(left_x)] = True
        seen_x, seen_y = front.copy(), np.zeros(len(b), bool)
        while front.any():
            reach = near_[front].any(axis=0)
            if own:
                front = reach & ~seen_x
            else:
                reach &= ~seen_y
                seen_y |= reach
                front = near_[:, reach].any(axis=1) & ~seen_x
            seen_x |= front
        left_x &= ~seen_x
        left_y &= ~seen_y
        ids = np.unique(a[seen_x] if own else np.concatenate((a[seen_x], b[seen_y])))
        roots.append(np.full(len(ids) - 1, ids[0]))
        nodes.append(ids[1:])
    return (np.concatenate(roots), np.concatenate(nodes)) if roots else (np.zeros(0, np.int64), np.zeros(0, np.int64))
