"""A count-min prefilter for strings of a fixed number of symbols.

Every window of `width` symbols has one anchor: the leftmost of its `gram`-symbol strings with the least hash. Equal
windows have equal anchors at equal distances, so a window occurs at most as often as its anchor's string is picked as
an anchor anywhere: the sketch counts picks, about one for each (width - gram) / 2 symbols, and its estimate for the
anchor overestimates the window's count. Windows estimated once are certainly unique; none that repeats is lost.

Each partition makes a sketch of its own (sparse, in chunks); chunks are merged in two steps by adding saturating
counts. What is sent to executors is one bit for each counter (count of two or more): DEPTH << BITS bits, whatever the
input's size. A fuller sketch lets more unique windows through to the exact pass; it never drops any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

DEPTH, BITS, CHUNK = 2, 27, 16
#: Picks that a task gathers before it sends a sketch.
FLUSH = 2_000_000
ARROW = pa.schema([("depth", pa.int32()), ("chunk", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of keys[i : i + span], by doubling."""
    if len(keys) < span:
        return keys[:0]
    out, have = keys, 1
    while 2 * have <= span:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - span + 1], out[span - have : span - have + len(keys) - span + 1])


def anchors(grams: np.ndarray, starts: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For windows at starts: where their anchor is. grams: the hash of the gram at each symbol."""
    low = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = grams >> low << low | np.arange(len(grams), dtype=np.uint64)
    return (sliding_least(keys, width - gram + 1)[starts] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and the text of each. first: the n + 1 symbol offsets of texts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return common.ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def places(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each gram hash, in each of the sketch's rows."""
    return [(common.mix(grams + np.uint64(_SALTS[d])) >> np.uint64(64 - bits)).astype(np.int64) for d in range(DEPTH)]


def _merge(counts: np.ndarray, once: bytes | None, twice: bytes | None, packed: bool) -> None:
    if packed:
        a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in (once, twice))
        counts += a + 2 * b
    else:
        counts[np.frombuffer(once, np.uint16)] += 1
        counts[np.frombuffer(twice, np.uint16)] = 2
    np.minimum(counts, 2, out=counts)


def repeated(docs: DataFrame, picks: Callable[[pa.RecordBatch], tuple[np.ndarray, int]], bits: int = BITS, limit: int = 2 << 20) -> tuple[np.ndarray, int]:
    """The merged sketch as packed bits (DEPTH rows: is the count two or more?), and how many symbols there were.

    picks gives the gram hashes of the distinct anchors of a batch of docs, and its number of symbols.
    """
    spec = common.schema("depth int, chunk int, salt int, once binary, twice binary")
    chunk_bits = min(CHUNK, bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() // 64
        held: list[np.ndarray] = []
        total = symbols = 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(held)
            for d, at in enumerate(places(grams, bits)):
                at.sort()
                new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                values, counts = at[new], np.diff(np.append(new, len(at)))
                chunks = values >> chunk_bits
                low = (values & (1 << chunk_bits) - 1).astype(np.uint16)
                edges = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))
                ends = np.append(edges[1:], len(chunks))
                one = counts == 1
                rows = [(int(chunks[i]), low[i:j][one[i:j]].tobytes(), low[i:j][~one[i:j]].tobytes()) for i, j in zip(edges.tolist(), ends.tolist(), strict=True)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=ARROW)

        for batch in common.small_batches(batches, limit=limit):
            grams, n = picks(batch)
            symbols += n
            if len(grams):
                held.append(grams)
                total += len(grams)
            if total >= FLUSH:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((-1, 0, salt, symbols.to_bytes(8, "little"), b""), [f.type for f in ARROW], strict=True)], schema=ARROW)

    def add(packed: bool) -> Callable:
        def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            depth, chunk = key[0].as_py(), key[1].as_py()
            n, counts = 0, np.zeros(1 << chunk_bits, np.uint8)
            for batch in batches:  # one at a time: a group of any size takes the room of its counters
                for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                    if depth < 0:
                        n += int.from_bytes(a, "little")
                    else:
                        _merge(counts, a, b, packed)
            once, twice = np.packbits(counts == 1).tobytes(), np.packbits(counts == 2).tobytes()
            if depth < 0:
                once, twice = n.to_bytes(8, "little"), b""
            if not packed or depth < 0 or counts.max() > 1:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((depth, chunk, 0, None if packed and depth >= 0 else once, twice), ARROW, strict=True)], schema=ARROW)

        return merge

    parts = docs.mapInArrow(sketch, spec).groupBy("depth", "chunk", "salt").applyInArrow(add(False), spec)
    merged = parts.groupBy("depth", "chunk").applyInArrow(add(True), spec)
    out, n = np.zeros((DEPTH, max(1, (1 << bits) // 8)), np.uint8), 0
    size = (1 << chunk_bits) // 8
    for r in merged.toLocalIterator():  # at most DEPTH << (BITS - CHUNK) chunks of 2 ** CHUNK bits
        if r["depth"] < 0:
            n = int.from_bytes(r["once"], "little")
        else:
            out[r["depth"], r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    return out, n


def estimated_repeated(sketch: np.ndarray, grams: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each gram's estimate is two or more."""
    out = np.ones(len(grams), bool)
    for row, at in zip(sketch, places(grams, bits), strict=True):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
