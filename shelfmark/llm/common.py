"""Helpers that the operators share: shared-folder tables, text batches, rolling arithmetic."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path
from ..sources.scratch import written as keep  # noqa: F401  (the operators' way to cut lineage)

#: The bytes that separate words, in every operator that speaks of words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text bytes that one Python batch holds at most (a longer text is a batch of its own).
BATCH_BYTES = 8 << 20


def keep_by(df: DataFrame, name: str, column: str) -> str:
    """Write df to the shared folder, one directory for each of the few values of a column; the folder's path."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return path


def bounded(df: DataFrame) -> DataFrame:
    """Smaller Arrow batches than by default, as a row may hold a long text or set (unless the session says otherwise)."""
    conf = df.sparkSession.conf
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")):
        if conf.get(key, usual) == usual:
            conf.set(key, ours)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pair(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id as a long, the text as a string, and further columns: whatever else the table has can't clash."""
    return bounded(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about limit bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                ends.append(i)
                total = 0
            total += n
        for end in [*ends, batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step, giving free memory back at the end of its task: workers go on to other stages, and allocators keep what is freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def rows_like(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str, limit: int = 1 << 19) -> DataFrame:
    """docs with each batch (of at most about limit bytes of text) changed, all columns and their order kept."""
    fields = bounded(docs).schema
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col, limit):
            out = change(batch)
            yield pa.RecordBatch.from_arrays([out.column(out.schema.get_field_index(n)) for n in names], names=names)

    return docs.mapInArrow(tidy(run), fields)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the n + 1 offsets (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (no space inside, none across texts), and the n + 1 word offsets of the texts."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    is_word = ~space[raw]
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64; short tables are kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1), base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 21:
            _POWERS[base] = held
    return held[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Spans:
    """Hashes of any [start, end) of a symbol array, from prefix sums modulo 2 ** 64.

    Symbols are first mapped to 64-bit values that behave as random; the base is 5 modulo 8, so that
    differences of its powers keep few factors of two.
    """

    def __init__(self, values: np.ndarray, base: int):
        self.inv = inverse(base)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.back = powers(self.inv, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


#: Two bases, 5 modulo 8, and random tables of byte values (fixed seed: the same on every executor).
BASES = (0x9E3779B97F4A7C15 // 8 * 8 + 5, 0xD1342543DE82EF95 // 8 * 8 + 5)
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, (2, 256), dtype=np.uint64)


_GOLD = 0x9E3779B97F4A7C15
_WORD_SALTS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit value.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit value of each word's bytes and length.

    Eight bytes at a time go through a non-linear mixer together with their place in the word, so that no pattern of
    bytes (as in the difference of two sums of powers) makes two words collide.
    """
    sizes = (ends - starts).astype(np.int64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    salt = _WORD_SALTS[which]
    h = mix((eight[starts] & _FIRST[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(_GOLD) + np.uint64(salt))
    longer = np.flatnonzero(sizes > 8)
    if len(longer):
        parts = (sizes[longer] - 1) // 8
        nth = ranges(np.ones(len(parts), np.int64), parts)
        at = np.repeat(starts[longer], parts) + 8 * nth
        v = (eight[at] & _FIRST[np.minimum(np.repeat(ends[longer], parts) - at, 8)]) + np.uint64(salt)
        v ^= mix(nth.astype(np.uint64) * np.uint64(_GOLD))
        first = np.concatenate(([0], np.cumsum(parts)[:-1]))
        h[longer] = mix(h[longer] + np.add.reduceat(mix(v), first))
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b + np.uint64(_GOLD))


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value of each run of `size` values, by doubling; as many as there are runs."""
    n, out, have, power, span = len(values), None, 0, values, 1
    if n < size:
        return values[:0]
    while size:
        if size & 1:
            if out is None:
                out, have = power, span
            else:
                m = n - have - span + 1
                out, have = _joined(out[:m], power[have : have + m]), have + span
        size >>= 1
        if size:
            power, span = _joined(power[:-span], power[span:]), span * 2
    return out


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    lengths, starts = lengths[lengths > 0], starts[lengths > 0]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) of any start."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 64 else edge.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    np.subtract.at(edge, np.minimum(starts + width, n), 1) if len(starts) < 64 else edge.__isub__(np.bincount(np.minimum(starts + width, n), minlength=n + 1).astype(np.int32))
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def partitions(spark: SparkSession, rows: float, per: int) -> int:
    """Partitions for so many rows, by the session's own figure at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per), 1)
