"""Neighbours are counted, compared and linked where a task measures them; pairs are never written, and blocks move once for each line."""

import numpy as np
import pytest

from shelfmark.operators import vectors as V
from shelfmark.operators.grid import LINES
from shelfmark.operators.neighbours import Blocks, Linked, Nearest, nearest_within


def frame(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in p]) for i, p in enumerate(points)], "idx long, emb array<float>")


def points(n, seed=3):
    """Some rows are copies, and one is far longer than the rest."""
    x = np.random.default_rng(seed).normal(size=(n, 5)).astype(np.float32)
    x[n // 2 : n // 2 + 12], x[7] = x[0], x[7] * 1e4
    return x


def expected(x, y, eps, same):
    far = np.sqrt(((x[:, None].astype(float) - y[None]) ** 2).sum(axis=2))
    if same:
        np.fill_diagonal(far, np.inf)
    return {i: ((far[i] <= eps).sum(), far[i].argmin()) for i in range(len(x)) if (far[i] <= eps).any()}


@pytest.mark.parametrize("eps", [1.2, 100.0])
def test_nearest_and_counts(spark, eps):
    x, y = points(230), points(150, 4)
    left, right = frame(spark, x), frame(spark, y)
    told = lambda df: {r["idx"]: (r["n"], r["other"]) for r in df.collect()}
    assert told(nearest_within(left, right, eps, block=16)) == expected(x, y, eps, False)
    assert told(nearest_within(left, None, eps, block=16)) == expected(x, x, eps, True)
    assert {r["idx"]: r["n"] for r in nearest_within(left, None, eps, best=False).collect()} == {i: n for i, (n, _) in expected(x, x, eps, True).items()}


def test_rows_that_leave_tasks_grow_with_the_input(spark):
    """Everything is within reach of everything: n * n pairs, but a row for each row and line, and a star for each task's components."""
    spread = max(LINES, int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism))))
    for n in (150, 600):
        x = np.random.default_rng(1).normal(size=(n, 3)).astype(np.float32)
        blocks = Blocks(frame(spark, x), None, 50.0, 16)
        assert blocks.measured(lambda: Nearest(50.0, True), "idx long, n long, other long, distance double").count() <= n * (spread + 1)
        assert blocks.measured(lambda: Linked(50.0, True), "kind int, a long, b long").count() < n * (spread + 1)


def test_edges_are_reduced_within_a_task(spark):
    """A task's edges are reduced whenever they pass a limit, with the same clusters."""
    x = points(200)
    rows = frame(spark, x)
    whole = {r["idx"]: r["label"] for r in V.dbscan(rows, 1.0, 2).collect()}
    fold = Linked(1.0, True)
    fold.edges, fold.many = [(np.array([1, 1, 2]), np.array([2, 3, 3])), (np.array([3, 9]), np.array([4, 8]))], 5
    fold.reduce()
    assert sorted(zip(*(e.tolist() for e in fold.edges[0]), strict=True)) == [(1, 2), (1, 3), (1, 4), (8, 9)]
    assert whole == {r["idx"]: r["label"] for r in V.dbscan(rows, 1.0, 2, block=9).collect()}
