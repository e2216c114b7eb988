"""Perceptual hashes of image tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, KEPT = 64, 16


def _basis() -> np.ndarray:
    k, i = np.arange(SIZE)[:, None], np.arange(SIZE)[None, :]
    return np.cos(np.pi / (2 * SIZE) * (2 * i + 1) * k) * np.where(k == 0, np.sqrt(0.5), 1.0)


_DCT = _basis()


def perceptual_hash(rgb: bytes, side: int) -> str:
    """256 bits of a packed RGB tile as hex: the cosine transform's frequencies 1..16 each way, against their median.

    Missing bytes are black; tiles of another size are sampled by nearest neighbour.
    """
    side = side if side >= 1 else SIZE
    data = np.zeros(side * side * 3)
    got = np.frombuffer(rgb[: len(data) - len(rgb) % 3 if len(rgb) < len(data) else len(data)], np.uint8)
    data[: len(got)] = got
    grey = data.reshape(side, side, 3) @ np.array([0.299, 0.587, 0.114])
    if side != SIZE:
        at = np.minimum(((np.arange(SIZE) + 0.5) * side / SIZE).astype(int), side - 1)
        grey = grey[np.ix_(at, at)]
    block = (2 / SIZE * (_DCT @ grey @ _DCT.T))[1 : KEPT + 1, 1 : KEPT + 1].ravel()
    bits = block > np.median(block)
    return np.packbits(bits).tobytes().hex()


def tile_hash(tile: Column, side: Column) -> Column:
    """perceptual_hash of a binary column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(tiles, sides):
        return tiles.combine(sides, lambda t, s: None if t is None else perceptual_hash(bytes(t), int(s)))

    return run(tile, side)


def tiles_hashed(rows: DataFrame, side: int, at_once: int = 4096) -> DataFrame:
    """(id, tile, phash) for each tile of side x side pixels that a binary column holds. rows has an id and the bytes; none is tile 0, and null has no hash."""
    size = side * side * 3
    key = rows.schema.fields[0]
    spec = T.StructType([key, T.StructField("tile", T.LongType()), T.StructField("phash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, tile, hashes = [], [], []

            def send() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(tile, pa.int64()), pa.array(hashes, pa.string())], names=spec.names)  # noqa: B023

            for i, data in enumerate(batch.column(1)):
                data = data.as_py()
                for start in range(0, max(len(data or b""), 1), size):
                    owner.append(i)
                    tile.append(start // size)
                    hashes.append(None if data is None else perceptual_hash(bytes(data[start : start + size]), side))
                    if len(owner) >= at_once:
                        yield send()
                        owner, tile, hashes = [], [], []
            if owner:
                yield send()

    return rows.mapInArrow(run, spec)
