"""Substring deduplication over words: what lies in a repeated window of words is removed.

First pass: a count-min sketch (see sketch.py) over the whole input. Second pass: windows that the sketch estimates to
be repeated are grouped exactly, by 128 bits of a cryptographic digest of their words; all others are certainly unique. A task first
groups its own windows, so that a window sends one entry from each task however often it occurs there; entries travel
packed, dealt by their anchor's hash. Buckets that a common anchor makes too large are dealt again, by the windows' hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sketch

WINDOW, GRAM = 35, 8
#: Candidate windows that a task groups at a time; entries for each bucket of the exact pass, about.
FLUSH, PER_BUCKET = 1_000_000, 400_000
#: Entries of a bucket that are grouped in one task at most; a larger bucket is cut into parts of about PER_BUCKET entries.
MOST = 4 * PER_BUCKET
#: What a packet holds of each entry: two hashes, the row, the place in it, and whether its task had it more than once.
_FIELDS = (np.uint64, np.uint64, np.int64, np.uint32, np.bool_)


def _pack(*fields: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype(t).tobytes() for x, t in zip(fields, _FIELDS, strict=True)))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    sizes = [np.dtype(t).itemsize for t in _FIELDS]
    n = len(plain) // sum(sizes)
    return [np.frombuffer(plain, t, n, n * sum(sizes[:k])) for k, t in enumerate(_FIELDS)]


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic digest of each window's words, joined by one space."""
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(begin[-1] + sizes[-1]), 32, np.uint8)
    joined[common.ranges(begin, sizes)] = raw[common.ranges(starts, sizes)]
    data, digest = memoryview(joined.tobytes()), hashlib.blake2b
    last = at + window - 1
    named = b"".join([digest(data[i:j], digest_size=16).digest() for i, j in zip(begin[at].tolist(), (begin[last] + sizes[last]).tolist(), strict=True)])
    both = np.frombuffer(named, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def dealt(entries: DataFrame, most: int, per_part: int) -> DataFrame:
    """(bucket, part, packed) of (bucket, n, packed): buckets of more than `most` entries are cut by the hash of the windows, so that equal ones stay together."""
    large = entries.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    parts = {r["bucket"]: -(-r["n"] // per_part) for r in large.collect()}  # at most one for each `most` entries
    fine = entries.select("bucket", F.lit(0).alias("part"), "packed")
    if not parts:
        return fine
    told = entries.sparkSession.sparkContext.broadcast(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed")), strict=True):
                fields = _unpack(data)
                part = (fields[0] % np.uint64(told.value[bucket])).astype(np.int32)
                order = np.argsort(part, kind="stable")
                mine = [p for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(mine), pa.int32()), pa.array([int(part[p[0]]) for p in mine], pa.int32()), pa.array([_pack(*(x[p] for x in fields)) for p in mine], pa.binary())], names=["bucket", "part", "packed"])

    hot = F.col("bucket").isin(*parts)
    return fine.filter(~hot).unionByName(entries.filter(hot).select("bucket", "packed").mapInArrow(cut, common.schema("bucket int, part int, packed binary")))


def _grams(batch: pa.RecordBatch, window: int, gram: int) -> tuple:
    """Word hashes, word offsets of texts, starts of windows, their anchors and the gram hash at each word."""
    raw, off = common.text_bytes(batch)
    starts, ends, first = common.words(raw, off)
    values = common.word_hashes(raw, starts, ends, 0)
    n = len(values)
    at, text = sketch.window_starts(first, window)
    if not len(at):
        return raw, starts, ends, first, values, at, text, at, values[:0]
    grams = np.zeros(n, np.uint64)
    grams[: n - gram + 1] = common.grams(values, gram)
    return raw, starts, ends, first, values, at, text, sketch.anchors(grams, at, window, gram), grams


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = sketch.BITS, kept_text: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; with the kept words joined by one space, if asked for.

    A null or empty text has no words. Repeated rows repeat each other's windows. An empty table gives an empty result.
    """
    spark, gram = docs.sparkSession, min(gram, window)
    source = common.pair(docs, id_col, text_col)

    def picks(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        *_, values, at, _, where, grams = _grams(batch, window, gram)
        return (grams[where[np.append(True, where[1:] != where[:-1])]] if len(at) else grams), len(values)  # anchors never go back

    held, n_words = sketch.repeated(source, picks, bits)
    told = spark.sparkContext.broadcast(held)  # sketch.DEPTH << bits bits
    buckets = max(64, common.partitions(spark, n_words / 4, PER_BUCKET))
    spec = common.schema("kind int, row long, doc_id long, n_words long, kept_sha256 string, text binary, bucket int, n int, packed binary")
    kinds = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("bucket", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        gathered: list[tuple[np.ndarray, ...]] = []
        total = 0

        def send(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, rows, at, hashed = (np.concatenate(x) for x in zip(*gathered, strict=True))
            order = np.lexsort((b, a))
            a, b, rows, at, hashed = a[order], b[order], rows[order], at[order], hashed[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            edges = np.flatnonzero(new)
            counts = np.diff(np.append(edges, len(a)))
            again = np.repeat(counts > 1, counts)
            if again.any():
                yield send([(1, r, None, None, None, None, None, None, p) for r, p in _by_row(rows[again], at[again])])
            a, b, rows, at, hashed, many = a[edges], b[edges], rows[edges], at[edges], hashed[edges], counts > 1
            # dealt by anchor: neighbouring windows go to the same bucket, and their places pack well
            bucket = (hashed % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((at, rows, bucket))
            ends = np.flatnonzero(np.diff(bucket[order])) + 1
            out = []
            for part in np.split(order, ends):
                if len(part):
                    out.append((2, None, None, None, None, None, int(bucket[part[0]]), len(part), _pack(a[part], b[part], rows[part], at[part], many[part])))
            yield send(out)

        for batch in common.small_batches(batches, limit=2 << 20):
            raw, starts, ends, first, values, at, text, where, grams = _grams(batch, window, gram)
            hot = sketch.estimated_repeated(told.value, grams[where], bits) if len(at) else np.zeros(0, bool)
            at, text = at[hot], text[hot]
            has = np.zeros(batch.num_rows, bool)
            has[text] = True
            if len(at):
                a, b = _names(raw, starts, ends, at, window)
                gathered.append((a, b, row + text, at - first[text], grams[where[hot]]))
                total += len(at)
            out = []
            for i, (doc, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data, n = (t or "").encode(), int(first[i + 1] - first[i])
                if has[i]:
                    out.append((3, row + i, doc, n, None, data, None, None, None))
                else:
                    kept = b" ".join(data.split())
                    out.append((0, None, doc, n, hashlib.sha256(kept).hexdigest(), kept if kept_text else None, None, None, None))
            yield send(out)
            row += batch.num_rows
            if total >= FLUSH:
                yield from flush()
                gathered, total = [], 0
        if total:
            yield from flush()

    path = common.keep_by(source.mapInArrow(candidates, spec), "candidates", "kind")
    kind = lambda k: spark.read.schema(spec).parquet(path).filter(F.col("kind") == k)

    def group(table):
        a, b, rows, at, many = (np.concatenate(p) for p in zip(*map(_unpack, table["packed"].to_pylist()), strict=True))
        order = np.lexsort((b, a))
        edges = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))))
        counts = np.diff(np.append(edges, len(a)))
        shared = (counts > 1) | np.logical_or.reduceat(many[order], edges)
        mine = order[np.repeat(shared, counts)]
        mine = mine[~many[mine]]  # a task told its own repeats already
        got = list(_by_row(rows[mine], at[mine]))
        return pa.table({"row": pa.array([r for r, _ in got], pa.int64()), "packed": pa.array([p for _, p in got], pa.binary())})

    found = dealt(kind(2).select("bucket", "n", "packed"), most, max(1, most // 4)).groupBy("bucket", "part").applyInArrow(group, "row long, packed binary")
    flags = found.unionByName(kind(1).select("row", "packed")).groupBy("row").agg(F.collect_list("packed").alias("packs"))  # a text's own windows
    final = common.schema("doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if kept_text else ""))
    names = final.names

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data, packs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "text", "packs")), strict=True):
                words = data.split()
                gone = common.covered(np.concatenate([np.frombuffer(p, np.uint32) for p in packs]).astype(np.int64), window, n) if packs else np.zeros(n, bool)
                kept = b" ".join(compress(words, (~gone).tolist()))
                rows.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False)], names=names)

    cut = kind(3).select("row", "doc_id", "n_words", "text").join(flags, "row", "left").select("doc_id", "n_words", "text", "packs").mapInArrow(take, final)
    whole = kind(0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.col("text").cast("string").alias("kept")] if kept_text else []))
    return cut.unionByName(whole)


def _by_row(rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(row, its positions packed) of parallel arrays."""
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order].astype(np.uint32)
    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True) if len(edges) else ():
        yield int(rows[i]), at[i:j].tobytes()


def op2_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(common.documents(spark, sf_dir))
