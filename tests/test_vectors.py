import numpy as np
import pytest

from shelfmark.operators import graph
from shelfmark.operators import vectors as V


def sequential(points, eps, need):
    """Density clustering as it is usually written: visit in order, expand from each core point."""
    need = max(2, need)
    n = len(points)
    near = [[j for j in range(n) if j != i and np.sqrt(((points[i] - points[j]) ** 2).sum()) <= eps] for i in range(n)]
    label, seen, k = [-1] * n, [False] * n, 0
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        if len(near[i]) + 1 < need:
            continue
        label[i] = k
        queue = []
        for j in near[i]:
            if label[j] < 0:
                label[j] = k
            if not seen[j]:
                seen[j] = True
                queue.append(j)
        while queue:
            j = queue.pop(0)
            if len(near[j]) + 1 >= need:
                for m in near[j]:
                    if not seen[m]:
                        seen[m] = True
                        label[m] = k
                        queue.append(m)
        k += 1
    return label


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "idx long, emb array<float>")


@pytest.mark.parametrize("need", [2, 3, 4])
def test_against_sequential_clustering(spark, need):
    rng = np.random.default_rng(need)
    points = (rng.integers(0, 30, (60, 2)) / 2).astype(np.float32)
    got = {r["idx"]: r["label"] for r in V.dbscan(frame(spark, points), 1.2, need).collect()}
    assert [got[i] for i in range(len(points))] == sequential(points.astype(float), 1.2, need)
    assert got == {r["idx"]: r["label"] for r in V.dbscan(frame(spark, points), 1.2, need, block=7).collect()}  # many cells and blocks


def test_border_point_before_the_seed(spark):
    points = [[0.0], [1.0], [2.0], [2.5], [3.5]]
    got = {r["idx"]: r["label"] for r in V.dbscan(frame(spark, points), 1.0, 3).collect()}
    assert [got[i] for i in range(5)] == sequential(np.array(points), 1.0, 3)


def test_invalid_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.1, 0.0]), (4, []), (5, None), (6, [1.0])], "idx long, emb array<float>")
    got = {r["idx"]: r["label"] for r in V.dbscan(rows, 1.0, float("nan")).collect()}
    assert got == {1: 0, 2: -1, 3: 0}
    assert V.dbscan(rows.limit(0)).count() == 0


def test_pairs_are_complete(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 6)).astype(np.float32)
    rows = frame(spark, points)
    exact = {(i, j) for i in range(300) for j in range(i + 1, 300) if np.sqrt(((points[i].astype(float) - points[j].astype(float)) ** 2).sum()) <= 1.5}
    assert {(r["a"], r["b"]) for r in V.within(rows, rows, 1.5, same=True).collect()} == exact
    assert {(r["a"], r["b"]) for r in V.within(rows, rows, 1.5, same=True, block=16).collect()} == exact
    some = rows.filter("idx < 120")
    ways = {(a, b) for a, b in exact} | {(b, a) for a, b in exact} | {(a, a) for a in range(300)}
    assert {(r["a"], r["b"]) for r in V.within(some, rows, 1.5, block=16).collect()} == {(a, b) for a, b in ways if a < 120}


def congruential(seed, n):
    """n values in [0, 1) of the 32-bit generator x -> 1664525 x + 1013904223."""
    a = np.full(n, 1664525, np.uint32)
    powers = np.multiply.accumulate(a, dtype=np.uint32)
    sums = np.concatenate((np.ones(1, np.uint32), powers[:-1]))
    return (powers * np.uint32(seed) + np.uint32(1013904223) * np.add.accumulate(sums, dtype=np.uint32)) / 4294967296.0


def identities(n, seed, dim, k, noise, strangers):
    """Unit vectors around k centres, and strangers, as the published clustering figure's data are described."""
    draw, at = congruential(seed, 2 * dim * (k + 2 * n) + 4 * n), 0

    def uniform():
        nonlocal at
        at += 1
        return draw[at - 1]

    def gauss():
        nonlocal at
        u, v = draw[at : at + 2 * dim : 2], draw[at + 1 : at + 2 * dim : 2]
        at += 2 * dim
        return np.sqrt(-2 * np.log(np.where(u == 0, 1e-9, u))) * np.cos(2 * np.pi * v)

    def unit(x):
        x = x.astype(np.float32).astype(np.float64)
        return (x / np.sqrt((x * x).sum())).astype(np.float32)

    heads, out = [unit(gauss()) for _ in range(k)], []
    for i in range(n):
        base = unit(gauss()) if uniform() < strangers else heads[int(uniform() * k)]
        out.append(unit(base + gauss() * noise))
        if i % 5:
            uniform()  # a weight
    return np.stack(out)


def table(spark, points):
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(points))), "emb": pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float32()))}))


def test_published_clustering(spark):
    """5,000 faces of 512 dimensions: 60 clusters, 989 of noise, 82 in the largest."""
    points = identities(5000, 20260929, 512, 60, 0.045, 0.2)
    labels = V.dbscan(table(spark, points), 1.05, 2).groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in labels}
    assert (len(sizes) - 1, sizes[-1], max(n for k, n in sizes.items() if k >= 0)) == (60, 989, 82)


def test_blocks_that_are_apart_do_not_meet(spark):
    """The same shape with less noise: most pairs of blocks are dropped before a row moves, and none that holds a pair."""
    from shelfmark.operators.neighbours import Blocks

    points = identities(2000, 7, 64, 20, 0.03, 0.0)
    rows = table(spark, points)
    blocks = Blocks(rows, None, 0.6, 50)
    n, _ = blocks.counts()
    met = blocks.meets.count()
    assert met < 0.2 * n * (n + 1) / 2, (met, n)
    far = np.sqrt(np.maximum(0, 2 - 2 * points.astype(float) @ points.T.astype(float)))
    assert V.within(rows, rows, 0.6, same=True, block=50).count() == np.triu(far <= 0.6, 1).sum()


def test_centroids_round_each_step(spark):
    rows = spark.createDataFrame([("a", 0, [0.1, 1.0], 1.0), ("a", 1, [0.2, 3.0], float("nan")), ("a", 2, [0.4, 5.0], 2.0), ("b", 3, [7.0, 7.0], -1.0)], "label string, idx long, emb array<float>, w double")
    got = {r["label"]: r["centroid"] for r in V.centroids(rows).collect()}
    f = np.float32
    s = f(0.0)
    for x, w in ((0.1, 1.0), (0.2, 1.0), (0.4, 2.0)):
        s = f(float(s) + float(f(x)) * w)
    assert got["a"][0] == float(f(float(s) / 4.0)) and got["a"][1] == 3.5 and got["b"] == [7.0, 7.0]


def test_labels_carry_over(spark):
    new, old = frame(spark, [[0.0], [5.0]]), frame(spark, [[0.3], [0.3], [9.0]])
    assert [tuple(r) for r in V.carried_labels(new, old).collect()] == [(0, 0)]


def test_greedy_faces(spark):
    rows = spark.createDataFrame([(1, 0.0, 1, 0.5, [1.0, 0.0]), (1, 1.0, 2, 0.9, [0.9, 0.4]), (1, 2.0, 3, 0.1, [0.0, 1.0])], "video long, frame_time double, idx long, score double, emb array<float>")
    assert sorted(r["idx"] for r in V.greedy_faces(rows).collect()) == [2, 3]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in graph.components(df, few=graph.FEW).collect()} == got
    assert graph.components(df.limit(0)).count() == 0 == graph.components(df.limit(0), few=-1).count()
