"""Frame-hash sequences in bulk: local alignment of many pairs at once, and a blocked screen for pairs worth aligning.

Alignments fill anti-diagonals, each of whose cells depends on the two diagonals before only, for a whole batch of
pairs. The screen packs whole videos into blocks of frames by duration bucket; two blocks are compared word by word,
and a pair of videos passes that has enough frames with a match in the other. Only passing pairs are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import written
from .grid import on_grid

MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the step tables of the pairs that are aligned together; frames of a block; comparisons held at once.
CELLS, FRAMES, HELD = 1 << 23, 2048, 1 << 21
#: Frames of a block where durations have no tolerance; bits that a piece of a hash has at least, so that equal pieces are worth looking up.
SPAN, PIECE = 8192, 8
NONE = {"score": 0.0, "matched": 0, "aligned": 0, "mean_hamming": float("inf"), "coverage_a": 0.0, "coverage_b": 0.0, "coverage_short": 0.0, "start_a": -1, "start_b": -1, "offset_a": None, "offset_b": None}


def hex_bytes(text: str | None) -> bytes | None:
    try:
        return bytes.fromhex(text) if text else None
    except ValueError:
        return None


def words(hashes: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes as rows of `width` 64-bit words, and which of their bits count (None: all of all; no hash: none of its)."""
    sizes = {0 if h is None else len(h) for h in hashes}
    data = np.frombuffer(b"".join((h or b"").ljust(8 * width, b"\0") for h in hashes), np.uint64).reshape(len(hashes), width)
    if sizes <= {8 * width}:
        return data, None
    return data, np.frombuffer(b"".join((b"\xff" * len(h or b"")).ljust(8 * width, b"\0") for h in hashes), np.uint64).reshape(len(hashes), width)


def width_of(hashes: list[bytes | None]) -> int:
    return max(1, max((-(-len(h) // 8) for h in hashes if h is not None), default=1))


def differing(x: np.ndarray, y: np.ndarray, mx: np.ndarray | None, my: np.ndarray | None) -> np.ndarray:
    """Bits that differ, over the shorter of both; a huge number where one has no hash. The last axis holds the words."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int64)
    for k in range(x.shape[-1]):
        d = x[..., k] ^ y[..., k]
        for m in (mx, my):
            if m is not None:
                d &= m[..., k]
        out += np.bitwise_count(d)
    for m in (mx, my):
        if m is not None:
            out = np.where((m[..., 0] == 0) & np.ones_like(out, bool), 1 << 40, out)
    return out


def align_batch(pairs: list[tuple[list[tuple[float, str]], list[tuple[float, str]]]], threshold: float) -> list[dict]:
    """The best local alignment of each pair of frame sequences (t_sec, phash).

    A pair of frames within the threshold scores 2, any other -1, a gap -1. Of equal predecessors the diagonal wins,
    then the one above; of equally good ends the one with the greater sum of indexes, then the lower first index.
    """
    out: list[dict] = [NONE] * len(pairs)
    live = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(live):  # pairs of like sizes together
        end, n, m = at, 0, 0
        while end < len(live):
            n2, m2 = max(n, len(pairs[live[end]][0])), max(m, len(pairs[live[end]][1]))
            if end > at and (n2 + m2) * (n2 + 1) * (end + 1 - at) > CELLS:
                break
            n, m, end = n2, m2, end + 1
        _align(pairs, live[at:end], n, m, threshold, out)
        at = end
    return out


def _align(pairs: list, which: list[int], n: int, m: int, threshold: float, out: list[dict]) -> None:
    count = len(which)
    size_a, size_b = (np.array([len(pairs[k][s]) for k in which]) for s in (0, 1))
    told = [[hex_bytes(h) for k in which for h in [*[f[1] for f in pairs[k][s]], *[None] * (most - len(pairs[k][s]))]] for s, most in ((0, n), (1, m))]
    width = max(map(width_of, told))
    (x, mx), (y, my) = (words(t, width) for t in told)
    x, y = x.reshape(count, n, width), y.reshape(count, m, width)
    mx, my = (None if k is None else k.reshape(count, -1, width) for k in (mx, my))
    steps = np.zeros((n + m + 1, count, n + 1), np.uint8)
    before, last = np.zeros((count, n + 1), np.int32), np.zeros((count, n + 1), np.int32)  # scores of the two diagonals before
    best, best_i, best_d = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        back = slice(d - hi - 1, d - lo)  # the other side's frames, from the last to the first
        flip = lambda z: None if z is None else z[:, back][:, ::-1]
        near = differing(x[:, lo - 1 : hi], flip(y), None if mx is None else mx[:, lo - 1 : hi], flip(my)) <= threshold
        top = before[:, lo - 1 : hi] + np.where(near, MATCH, MISMATCH)
        above, left = last[:, lo - 1 : hi] + GAP, last[:, lo : hi + 1] + GAP
        step = np.where(above > top, 2, 1)
        top = np.maximum(top, above)
        step[left > top] = 3
        top = np.maximum(top, left)
        step[top <= 0] = 0
        top = np.maximum(top, 0)
        steps[d, :, lo : hi + 1] = step
        row = np.zeros((count, n + 1), np.int32)
        row[:, lo : hi + 1] = top
        before, last = last, row
        inside = np.where((i <= size_a[:, None]) & (d - i <= size_b[:, None]), top, 0)
        first = np.argmax(inside, axis=1)
        most = inside[np.arange(count), first]
        better = (most >= best) & (most > 0)  # a later diagonal wins a tie
        best, best_i, best_d = np.where(better, most, best), np.where(better, first + lo, best_i), np.where(better, d, best_d)
    i, j, rows = best_i.copy(), best_d - best_i, np.arange(count)
    matched, aligned, total, start_a, start_b = (np.zeros(count, np.int64) for _ in range(5))
    while True:
        on = (best > 0) & (i > 0) & (j > 0)
        step = np.where(on, steps[np.where(on, i + j, 0), rows, np.where(on, i, 0)], 0)
        if not step.any():
            break
        k = np.flatnonzero(step == 1)
        far = differing(x[k, i[k] - 1], y[k, j[k] - 1], None if mx is None else mx[k, i[k] - 1], None if my is None else my[k, j[k] - 1])
        aligned[k] += 1
        total[k] += far
        matched[k] += far <= threshold
        start_a[k], start_b[k] = i[k] - 1, j[k] - 1
        i, j = i - ((step == 1) | (step == 2)), j - ((step == 1) | (step == 3))
        i = np.where(step == 0, 0, i)  # done
    for k, p in enumerate(which):
        if aligned[k]:
            a, b = pairs[p]
            sa, sb, hit = int(start_a[k]), int(start_b[k]), int(matched[k])
            mean = float("inf") if total[k] >= 1 << 40 else float(total[k]) / int(aligned[k])
            out[p] = {"score": float(best[k]), "matched": hit, "aligned": int(aligned[k]), "mean_hamming": mean, "coverage_a": hit / len(a), "coverage_b": hit / len(b), "coverage_short": hit / min(len(a), len(b)), "start_a": sa, "start_b": sb, "offset_a": a[sa][0], "offset_b": b[sb][0]}


def packed(videos: DataFrame, frames: DataFrame, bucket: int, size: int = FRAMES, merged: bool = False) -> DataFrame:
    """Whole videos in blocks of about `size` frames of one duration bucket (a longer video is a block of its own or makes its block longer).

    bucket, part, and of the block's videos ids, durations, the number of frames of each, and all their hashes. With
    merged, as many neighbouring buckets count as one as hold `size` frames on average.
    """
    told = frames.select("id", "phash").join(videos.select("id", "duration_sec", S.duration_bucket(F.col("duration_sec"), bucket).alias("bucket")), "id")
    if merged:
        told = written(told, "frames")
        seen = told.agg(F.count("*").alias("n"), (F.max("bucket").cast("double") - F.min("bucket") + 1).alias("buckets")).first()
        told = told.withColumn("bucket", F.floor(F.col("bucket") / max(1, int(seen["buckets"] or 1) * size // max(seen["n"], 1))))
    sizes = told.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = told.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "duration_sec", "phash")

    def pack(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"], np.int64)
        order = np.argsort(ids, kind="stable")
        hashes = table["phash"].to_pylist()
        hashes = [hex_bytes(hashes[k]) for k in order.tolist()]
        width = width_of(hashes)
        data, mask = words(hashes, width)
        first = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        seconds = table["duration_sec"].to_numpy(zero_copy_only=False).astype(np.float64)[order][first]
        parts = [ids[order][first], seconds, np.diff([*first, len(ids)]).astype(np.int64), data, np.zeros(0, np.uint64) if mask is None else mask]
        return pa.table([table["bucket"].slice(0, 1), table["part"].slice(0, 1), pa.array([width]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["bucket", "part", "width", "ids", "seconds", "sizes", "words", "masks"])

    return written(dealt.groupBy("bucket", "part").applyInArrow(pack, "bucket long, part int, width long, ids binary, seconds binary, sizes binary, words binary, masks binary"), "frame-blocks")


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of the 64-bit hashes within the threshold: cut into one piece more than bits may differ, these have an equal piece."""
    pieces = int(threshold) + 1
    edges = [64 * k // pieces for k in range(pieces + 1)]
    found = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        u, v = ((z >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1) for z in (x, y))
        order = np.argsort(v, kind="stable")
        v = v[order]
        first, last = np.searchsorted(v, u, "left"), np.searchsorted(v, u, "right")
        ends = np.cumsum(last - first)
        start = 0
        while start < len(x):  # about HELD pairs at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")))
            n = (last - first)[start:stop]
            p = np.repeat(np.arange(start, stop), n)
            q = order[np.arange(n.sum()) + np.repeat(first[start:stop] - (np.cumsum(n) - n), n)]
            near = np.flatnonzero(np.bitwise_count(x[p] ^ y[q]) <= threshold)
            found.append(np.unique(p[near] * len(y) + q[near]))
            start = stop
    return np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), max(len(y), 1))


def _counts(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each video of a and each of b: how many of a's frames have a match in b, and of b's in a."""
    width = max(a["words"].shape[1], b["words"].shape[1])

    def wide(z: dict) -> tuple[np.ndarray, np.ndarray | None]:
        pad = [(0, 0), (0, width - z["words"].shape[1])]
        if not pad[1][1]:
            return z["words"], z["masks"]
        return np.pad(z["words"], pad), np.pad(np.full_like(z["words"], 2**64 - 1) if z["masks"] is None else z["masks"], pad)

    (x, mx), (y, my) = wide(a), wide(b)
    ours, theirs = np.zeros((len(a["ids"]), len(b["ids"])), np.int64), np.zeros((len(a["ids"]), len(y)), bool)
    first = np.cumsum(b["sizes"]) - b["sizes"]
    own = np.repeat(np.arange(len(a["ids"])), a["sizes"])
    if width == 1 and mx is None and my is None and 0 <= threshold and 64 // (int(threshold) + 1) >= PIECE:
        p, q = alike(x[:, 0], y[:, 0], threshold)
        n, his = len(b["ids"]), np.repeat(np.arange(len(b["ids"])), b["sizes"])
        mine, other = np.unique(p * n + his[q]), np.unique(own[p] * len(y) + q)
        count = lambda at: np.bincount(at, minlength=len(a["ids"]) * n).reshape(len(a["ids"]), n)
        return count(own[mine // n] * n + mine % n), count(other // len(y) * n + his[other % len(y)])
    chunk = max(1, HELD // max(len(y), 1))
    for k in range(0, len(x), chunk):
        near = differing(x[k : k + chunk, None], y[None], None if mx is None else mx[k : k + chunk, None], None if my is None else my[None]) <= threshold
        mine = own[k : k + chunk]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(mine) != 0)))
        ours[mine[edge]] += np.add.reduceat(np.logical_or.reduceat(near, first, axis=1).astype(np.int64), edge, axis=0)
        theirs[mine[edge]] |= np.logical_or.reduceat(near, edge, axis=0)
    return ours, np.add.reduceat(theirs.astype(np.int64), first, axis=1)


def screened(videos: DataFrame, frames: DataFrame, bucket: int, threshold: float, share_a: float, share_b: float, least: int = 1, tolerance: float | None = None) -> DataFrame:
    """(a, b) of different videos that may align so that share_a of a's frames and share_b of b's, and `least` at least, match.

    With a tolerance, durations differ by that share at most and each pair is given both ways; without one, b is at
    least as long as a. A frame that an alignment matches has a match among the other's frames, so none is lost.
    Blocks of buckets that can't hold such a pair never meet; pairs of blocks are dealt to tasks on a grid (grid.py).
    """
    blocks = packed(videos, frames, bucket) if tolerance is not None else packed(videos, frames, bucket, SPAN, merged=True)
    keys = blocks.select("bucket", "part")
    if tolerance is None:
        used = keys.select("bucket").distinct().agg(F.array_sort(F.collect_set("bucket")).alias("used"))  # one row, a number for each bucket of durations
        ways = keys.crossJoin(F.broadcast(used)).select(F.col("bucket").alias("a_bucket"), F.col("part").alias("a_part"), F.explode(F.filter("used", lambda x: x >= F.col("bucket"))).alias("b_bucket"))
    else:
        ways = keys.select(F.col("bucket").alias("a_bucket"), F.col("part").alias("a_part"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("b_bucket"))
    meets = ways.join(keys.select(F.col("bucket").alias("b_bucket"), F.col("part").alias("b_part")), "b_bucket").filter("a_bucket < b_bucket OR a_part <= b_part")
    slack = 1e-9

    def met(a: dict, b: dict) -> pa.RecordBatch:
        ours, theirs = _counts(a, b, threshold)
        most = np.minimum(ours, theirs)
        da, db = a["seconds"][:, None], b["seconds"][None, :]
        found = []
        for forth in (True, False):
            na, nb = (a["sizes"][:, None], b["sizes"][None, :]) if forth else (b["sizes"][None, :], a["sizes"][:, None])
            fine = (most >= least) & (most >= share_a * na - slack) & (most >= share_b * nb - slack) & (a["ids"][:, None] != b["ids"][None, :])
            if tolerance is None:
                short, long = (da, db) if forth else (db, da)
                fine &= ~(long + 1e-6 < short)
            else:
                fine &= ~(np.abs(da - db) > tolerance * np.maximum(da, db) * (1 + slack) + slack)
            p, q = np.nonzero(fine)
            found.append((a["ids"][p], b["ids"][q]) if forth else (b["ids"][q], a["ids"][p]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for row in range(batch.num_rows):
                width, no = batch.column("width")[row].as_py(), batch.column("no")[row].as_py()
                got = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                masks = got("masks", np.uint64)
                side = {"ids": got("ids", np.int64), "seconds": got("seconds", np.float64), "sizes": got("sizes", np.int64), "words": got("words", np.uint64).reshape(-1, width), "masks": masks.reshape(-1, width) if len(masks) else None}
                if batch.column("side")[row].as_py() == 0:
                    held[no] = side
                    continue
                for k in batch.column("met")[row].as_py():
                    yield met(held[k], side)

    size = blocks.agg(F.sum(F.length("words") + F.length("masks") + F.length("ids") * 3)).first()[0] or 0
    return on_grid([blocks], meets.select(*[f"{s}_{x}" for s in "ab" for x in ("bucket", "part")]), ["bucket", "part"], [size], run, "a long, b long").distinct()
