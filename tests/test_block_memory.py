"""What a task holds of its pairs of blocks, and while it deals rows to cells, doesn't grow with the table."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from shelfmark.operators import neighbours as N


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Caught:
    """A table that gives the function which would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, spec):
        return run


def test_dealing_rows_holds_as_much_for_many_centres(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10_000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel()))], names=["idx", "emb"])
    for k in (16, 256):
        c = rng.normal(size=(k, 8))
        (rows, bounds), mb = peak(lambda c=c: list(N._dealt(Caught(), SimpleNamespace(value=c))(iter([batch]))))
        assert mb < 40, (k, mb)
        far = np.sqrt(((x[:, None].astype(float) - c[None]) ** 2).sum(axis=2))
        cell = far.argmin(axis=1)
        assert (rows.column("cell").to_numpy() == cell).all() and np.allclose(rows.column("own").to_numpy(), far.min(axis=1))
        at, other = (bounds.column(n).to_numpy() for n in ("cell", "other"))
        assert sorted(set(at)) == sorted(set(cell)) and len(at) == len(set(cell)) * k
        low, high = (np.array([f(far[cell == a, b]) for a, b in zip(at, other, strict=True)]) for f in (np.min, np.max))
        assert np.allclose(bounds.column("low").to_numpy(), low) and np.allclose(bounds.column("high").to_numpy(), high)


def test_edges_of_many_pairs_of_blocks_are_few(monkeypatch):
    """24 x 24 blocks of 2,048 rows: 2.4 million edges pass by, 98,303 are left."""
    monkeypatch.setattr(N, "adjacency", lambda a, b, eps: np.zeros((1, 1), bool))
    monkeypatch.setattr(N, "stars", lambda met, a, b, own: (np.full(len(a) + len(b) - 1, a[0]), np.concatenate((a[1:], b))))
    emb, fold = np.zeros((2048, 1), np.float32), N.Linked(1.0, True)
    block = lambda k: N.Side(np.arange(2048) + 2048 * k, emb, np.ones(2048, bool))

    def run():
        for a in range(24):
            for b in range(24, 48):
                list(fold.meet(block(a), block(b), False))
        return list(fold.end())

    ((kind, least, nodes),), mb = peak(run)
    assert len(kind) == 48 * 2048 - 1 and not least.any() and (np.sort(nodes) == np.arange(1, 48 * 2048)).all()
    assert mb < 80, mb
