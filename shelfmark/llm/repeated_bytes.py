"""Substring deduplication over bytes: what a document with a smaller id holds as well is removed.

A window is a string of WIDTH bytes that starts at any byte of a text. Its anchor (see sketch.py) lies at the same
distance in every place where the window occurs. So:

1. A count-min sketch over the whole input counts anchors; a window whose anchor is estimated once is unique.
2. Each other anchor sends a snippet, the bytes that the windows with that anchor span, to where its hash is dealt.
   A task sends equal snippets once if a smaller document among them settles the others. An anchor that a sample of
   the documents shows in very many different snippets sends its windows one by one, each dealt by its own bytes.
3. Snippets of one anchor that are equal throughout, byte for byte, settle each other: all but those of the smallest
   document go (each of their windows is a group of its own, there is no order to find).
   Where an anchor has several different snippets, their suffixes are sorted (suffix_groups.py) and each run of
   suffixes with equal windows finds its smallest document. Symbols before the anchor are bytes; the anchor's own
   string, which all share, is one symbol, and what follows it is taken four bytes a symbol, first byte highest: that
   keeps the order of bytes and halves the length. Runs are confirmed on the windows' bytes.
   Very many snippets of one anchor are first split by the bytes on the longer side that their windows must share.
4. Covered bytes go, text by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sketch
from .suffix_groups import suffix_arrays

WIDTH, GRAM = 50, 20
#: Bytes of text in a batch; anchors that a task gathers at a time; input bytes for each bucket of step 3, about.
BATCH, FLUSH, PER_BUCKET = 1 << 20, 300_000, 4_000_000
#: Different snippets of an anchor that are sorted together; more are split.
MOST = 64
#: Different snippets of an anchor that may go to one bucket, about, and how many of so many the sample sees.
MOST_DEALT, SEEN = 100_000, 64
NO_ID = 2**63 - 1


def _anchored(batch: pa.RecordBatch, width: int, gram: int) -> tuple:
    """Text bytes and offsets; for each anchor of a text: the text, the gram hash, where it is, and its first and last window."""
    raw, off = common.text_bytes(batch)
    at, text = sketch.window_starts(off, width)
    if not len(at):
        none = np.zeros(0, np.int64)
        return raw, off, none, none.astype(np.uint64), none, none, none
    n = len(raw)
    i = np.arange(n - gram + 1)
    grams = np.zeros(n, np.uint64)
    grams[: n - gram + 1] = _gram_hashes(raw, i, gram)
    where = sketch.anchors(grams, at, width, gram)
    new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (text[1:] != text[:-1]))))
    last = at[np.append(new[1:] - 1, len(at) - 1)]
    return raw, off, text[new], grams[where[new]], where[new], at[new], last


def _snippets(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[common.ranges(start, size)]


#: What a packet holds of each anchor besides its snippet.
_FIELDS = (np.int64, np.int64, np.uint32, np.uint8, np.uint8)


def _pack(doc: np.ndarray, key: np.ndarray, start: np.ndarray, reach: np.ndarray, span: np.ndarray, snippets: np.ndarray) -> bytes:
    import zstandard

    fixed = b"".join(x.astype(t).tobytes() for x, t in zip((doc, key, start, reach, span), _FIELDS, strict=True))
    return np.array([len(doc)], np.int64).tobytes() + zstandard.ZstdCompressor(level=3).compress(fixed + snippets.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    n = int(np.frombuffer(data, np.int64, 1)[0])
    plain = zstandard.ZstdDecompressor().decompress(data[8:])
    out, at = [], 0
    for dtype in _FIELDS:
        out.append(np.frombuffer(plain, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    return (*out, np.frombuffer(plain, np.uint8, offset=at))


def _gram_hashes(raw: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    return common.mix(common.Spans(common.BYTE_VALUES[0][raw], common.BASES[0]).of(at, at + gram))


def _gram_hashes_of_few(raw: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """The same values, where the grams are a small part of the bytes."""
    out, factor = np.zeros(len(at), np.uint64), 1
    for k in range(gram):
        out += common.BYTE_VALUES[0][raw[at + k]] * np.uint64(factor)
        factor = factor * common.BASES[0] & 2**64 - 1
    return common.mix(out)


def _digests(raw: np.ndarray, at: np.ndarray, size: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """A 64-bit value of a snippet's bytes and of where its anchor is: with the anchor's hash it names the snippet."""
    return common.mix(common.Spans(common.BYTE_VALUES[1][raw], common.BASES[1]).of(at, at + size) + (size * 256 + reach).astype(np.uint64))


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and at b differ, for each size: eight bytes at a time."""
    if len(a) and size.min() < 8:
        return np.array([bytes(raw[i : i + n]) != bytes(raw[j : j + n]) for i, j, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)])
    eight = np.ndarray((max(len(raw) - 7, 0),), dtype="<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 16):
        n = size[i : i + (1 << 16)].astype(np.int64)
        k = -(-n // 8)
        at = np.minimum(8 * common.ranges(np.zeros(len(k), np.int64), k), np.repeat(n, k) - 8)
        unlike = eight[np.repeat(a[i : i + (1 << 16)], k) + at] != eight[np.repeat(b[i : i + (1 << 16)], k) + at]
        out[i : i + (1 << 16)] = np.logical_or.reduceat(unlike, np.cumsum(k) - k)
    return out


def variants_of(ids: np.ndarray, grams: np.ndarray, digest: np.ndarray, snippets: np.ndarray, at: np.ndarray, size: np.ndarray, reach: np.ndarray, gram: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edges, anchors): snippets by anchor (and `first` before that), then equal ones together, those by id; edges start equal ones.

    Hashes sort; what they hold equal is compared byte for byte. Where two strings share a hash, names by content replace it.
    """
    whole = np.zeros(len(ids), np.int64) if first is None else first
    tie = np.zeros(len(ids), np.int64)
    for exact in (False, True):
        order = np.lexsort((ids, tie, digest, grams, whole))
        edges = _groups(whole[order], grams[order], digest[order], tie[order])
        head = np.repeat(order[edges], np.diff(np.append(edges, len(order))))
        anchor_edges = _groups(grams[order])
        anchor = np.repeat(order[anchor_edges], np.diff(np.append(anchor_edges, len(order))))
        unlike = (size[order] != size[head]) | (reach[order] != reach[head])
        more = order != head
        more &= ~unlike
        if exact or not (unlike.any() or _differ(snippets, at[order[more]], at[head[more]], size[head[more]]).any() or _differ(snippets, (at + reach)[order], (at + reach)[anchor], np.full(len(order), gram)).any()):
            break
        names: dict[tuple, int] = {}
        grams = np.array([names.setdefault((bytes(snippets[i : i + gram]),), len(names)) for i in (at + reach).tolist()], np.uint64)
        tie = np.array([names.setdefault((bytes(snippets[i : i + n]), r), len(names)) for i, n, r in zip(at.tolist(), size.tolist(), reach.tolist(), strict=True)])
    return order, edges, grams


def common_anchors(source: DataFrame, width: int, gram: int, most: int) -> np.ndarray:
    """Gram hashes, sorted, of anchors with more than about `most` different snippets, by a sample of documents: it decides where windows meet, not whether."""
    every = max(1, most // SEEN)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, limit=BATCH):
            raw, _, _, grams, where, lo, hi = _anchored(batch, width, gram)
            digest = _digests(raw, lo, hi - lo + width, where - lo) if len(grams) else grams
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(digest.view(np.int64))], names=["gram", "digest"])

    sample = source.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).mapInArrow(variants, "gram long, digest long")
    found = sample.distinct().groupBy("gram").count().filter(F.col("count") > most / every).select("gram").collect()  # one for each SEEN sampled snippets at most
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(few):
        return np.zeros(len(values), bool)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination starts, in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def smallest_documents(snippets: np.ndarray, offset: np.ndarray, reach: np.ndarray, span: np.ndarray, doc: np.ndarray, group: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For different snippets (in the order of their groups), the smallest document of each window: (n + 1 window offsets, documents).

    A snippet's anchor is `reach` bytes from its start, and it has span + 1 windows, one from each of its first bytes.
    """
    windows = span.astype(np.int64) + 1
    first = np.concatenate(([0], np.cumsum(windows)))
    best = np.repeat(doc, windows)
    problems = _problems(snippets, offset, reach, span, group, width, gram)
    for i in range(0, len(problems), 4096):  # sorted by length: those of about the same length go in step
        part = problems[i : i + 4096]
        _settle(part, snippets, offset, reach, doc, first, best, width, gram)
    return first, best


def _problems(snippets: np.ndarray, offset: np.ndarray, reach: np.ndarray, span: np.ndarray, group: np.ndarray, width: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(snippets, least and greatest distance from the anchor at which windows start) of what is sorted together."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = _groups(group)
    near, far = reach.astype(np.int64) - span, reach.astype(np.int64)
    after = width - gram

    def split(items: np.ndarray, lo: int, hi: int) -> None:
        if len(items) < 2:
            return
        if len(items) <= MOST or lo == hi:
            out.append((items, np.maximum(near[items], lo), np.minimum(far[items], hi)))
            return
        mid = (lo + hi + 1) // 2
        for left, a, b in ((False, lo, mid - 1), (True, mid, hi)):
            keys: dict[bytes, list[int]] = {}
            for i in items[(far[items] >= a) & (near[items] <= b)].tolist():
                at = int(offset[i] + reach[i])
                key = snippets[at - a : at] if left else snippets[at + gram : at + gram + after - b]
                keys.setdefault(key.tobytes(), []).append(i)
            for same in keys.values():
                split(np.array(same), a, b)

    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(group)], strict=True):
        split(np.arange(i, j), 0, after)
    out.sort(key=lambda p: len(p[0]))
    return out


def _settle(problems: list[tuple[np.ndarray, np.ndarray, np.ndarray]], snippets: np.ndarray, offset: np.ndarray, reach: np.ndarray, doc: np.ndarray, first: np.ndarray, best: np.ndarray, width: int, gram: int) -> None:
    items = np.concatenate([p[0] for p in problems])
    near, far = np.concatenate([p[1] for p in problems]), np.concatenate([p[2] for p in problems])
    counts = np.array([len(p[0]) for p in problems])
    anchor = offset[items] + reach[items]
    # symbols of a snippet: `far` bytes, the anchor, what follows in fours, an end
    right = width - gram - near
    words = -(-right // 4)
    size = far + 1 + words + 1
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    symbols = np.zeros(int(size.sum()), np.int64)
    symbols[common.ranges(begin, far)] = snippets[common.ranges(anchor - far, far)].astype(np.int64) + 1
    symbols[begin + far] = 258
    part = common.ranges(np.zeros(len(items), np.int64), words) * 4
    source, limit = np.repeat(anchor + gram, words) + part, np.repeat(right, words) - part
    value = np.zeros(len(part), np.int64)
    for k in range(4):
        inside = k < limit
        value = value * 256 + np.where(inside, snippets[np.where(inside, source + k, 0)], 0)
    symbols[common.ranges(begin + far + 1, words)] = value + 259
    ends = np.cumsum(counts)
    problem_start = begin[ends - counts]
    problem_size = np.add.reduceat(size, ends - counts)
    order = suffix_arrays(symbols, problem_start, problem_size)
    place = order + np.repeat(problem_start, problem_size)
    which = np.searchsorted(begin, place, side="right") - 1
    r = far[which] - (place - begin[which])  # distance from the anchor
    fine = (r >= near[which]) & (r >= 0)
    place, which, r = place[fine], which[fine], r[fine]
    problem = np.repeat(np.arange(len(counts)), counts)[which]
    start = anchor[which] - r
    bytes_ = snippets[start[:, None] + np.arange(width)[None, :]] if len(start) else np.zeros((0, width), np.uint8)
    new = np.ones(len(start), bool)
    new[1:] = (problem[1:] != problem[:-1]) | (bytes_[1:] != bytes_[:-1]).any(axis=1)
    edges = np.flatnonzero(new)
    if len(edges):
        item = items[which]
        least = np.minimum.reduceat(doc[item], edges)
        np.minimum.at(best, first[item] + (reach[item] - r), np.repeat(least, np.diff(np.append(edges, len(start)))))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, bits: int = sketch.BITS, kept_text: bool = False, most: int = MOST_DEALT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with the remaining bytes, if asked for.

    A null text is empty. A null id is greater than any other; rows of the same id leave each other alone, and of such
    rows each is told by 60 bits of its text's SHA-256. An empty table gives an empty result.
    """
    spark, gram = docs.sparkSession, min(gram, width)
    if width - gram > 200:
        raise ValueError("a window may be at most 200 bytes longer than its anchor")
    source = common.pair(docs, id_col, text_col)

    def picks(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        raw, _, _, grams, *_ = _anchored(batch, width, gram)
        return grams, len(raw)

    held, n_bytes = sketch.repeated(source, picks, bits, BATCH)
    told_sketch = spark.sparkContext.broadcast(held)  # sketch.DEPTH << bits bits
    told_common = spark.sparkContext.broadcast(common_anchors(source, width, gram, most))
    buckets = max(128, common.partitions(spark, n_bytes, PER_BUCKET))
    # a row goes by its id and 60 bits of its text's SHA-256: rows that share both have equal texts, so what is cut from one is cut from all
    keyed = source.withColumn("key", F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long"))
    kinds = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("packed", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        total = 0

        def send(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        def flush() -> Iterator[pa.RecordBatch]:
            grams, digest, ids, key, start, reach, span = (np.concatenate(x) for x in zip(*[g[:7] for g in gathered], strict=True))
            snippets = np.concatenate([g[7] for g in gathered])
            size = span + width
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            dealt = np.where(_among(grams, told_common.value), common.mix(grams + digest), grams)
            bucket = (dealt % np.uint64(buckets)).astype(np.int32)
            order, edges, _ = variants_of(ids, grams, digest, snippets, at, size, reach, gram, bucket)
            least = np.repeat(ids[order][edges], np.diff(np.append(edges, len(order))))
            later = order[ids[order] > least]
            if len(later):  # settled here; they pass through a bucket of their own hash
                told = list(by_row(ids[later], key[later], start[later], span[later] + 1))
                yield send([((d * 31 + k) % buckets, d, k, p) for d, k, p in told])
            order = order[ids[order] == least]
            out = []
            for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(p):
                    out.append((int(bucket[p[0]]), None, None, _pack(ids[p], key[p], start[p], reach[p], span[p], _snippets(snippets, at[p], size[p]))))
            yield send(out)

        for batch in common.small_batches(batches, limit=BATCH):
            raw, off, text, grams, where, lo, hi = _anchored(batch, width, gram)
            hot = sketch.estimated_repeated(told_sketch.value, grams, bits) if len(grams) else np.zeros(0, bool)
            text, grams, where, lo, hi = text[hot], grams[hot], where[hot], lo[hot], hi[hot]
            single = _among(grams, told_common.value)
            if single.any():  # a snippet for each window
                n = np.where(single, hi - lo + 1, 1)
                text, grams, where, single, last = (np.repeat(x, n) for x in (text, grams, where, single, hi))
                lo = common.ranges(lo, n)
                hi = np.where(single, lo, last)
            if len(text):
                ids = np.asarray(batch.column("doc_id").fill_null(int(NO_ID)), dtype=np.int64)[text]
                keys = np.asarray(batch.column("key"), dtype=np.int64)[text]
                size = hi - lo + width
                gathered.append((grams, _digests(raw, lo, size, where - lo), ids, keys, lo - off[text], where - lo, hi - lo, _snippets(raw, lo, size)))
                total += len(text)
            if total >= FLUSH:
                yield from flush()
                gathered, total = [], 0
        if total:
            yield from flush()

    replies = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("packed", pa.binary())])

    def settle(table):
        passed = table.filter(table["doc"].is_valid()).select(["doc", "key", "packed"])
        parts = [_unpack(data) for data in table.filter(table["doc"].is_null())["packed"].to_pylist()]
        if not parts:
            return passed
        ids, keys, start, reach, span = (np.concatenate(x) for x in zip(*[p[:5] for p in parts], strict=True))
        snippets = np.concatenate([p[5] for p in parts])
        reach, span = reach.astype(np.int64), span.astype(np.int64)
        at = np.concatenate(([0], np.cumsum(span + width)[:-1]))
        grams, digest = _gram_hashes_of_few(snippets, at + reach, gram), _digests(snippets, at, span + width, reach)
        hashed = grams
        order, variant_edges, grams = variants_of(ids, grams, digest, snippets, at, span + width, reach, gram)
        g = grams[order]
        counts = np.diff(np.append(variant_edges, len(order)))
        heads = order[variant_edges]  # of equal snippets, one of the smallest document
        group = np.cumsum(np.isin(variant_edges, _groups(g)))
        several = (np.bincount(group)[group] > 1) & ~_among(hashed[heads], told_common.value)  # single windows meet whole
        # each occurrence's windows that a smaller document holds, as runs: mostly all or none of them
        variant = np.repeat(np.arange(len(heads)), counts)
        doc, key, at_, n = ids[order], keys[order].astype(np.int64), start[order].astype(np.int64), span[order] + 1
        whole = ~several[variant] & (doc > ids[heads][variant])
        runs = [(doc[whole], key[whole], at_[whole], n[whole])]
        if several.any():
            h = heads[several]
            first, best = smallest_documents(snippets, at[h], reach[h], span[h], ids[h], group[several], width, gram)
            place = np.cumsum(several) - 1
            mine = np.flatnonzero(several[variant])
            doc, key, at_, n, v = doc[mine], key[mine], at_[mine], n[mine], place[variant[mine]]
            gone = best[common.ranges(first[:-1][v], n)] < np.repeat(doc, n)
            edges = np.concatenate(([0], np.cumsum(n)[:-1]))
            many = np.add.reduceat(gone, edges, dtype=np.int64)
            full = many == n
            runs.append((doc[full], key[full], at_[full], n[full]))
            part = (many > 0) & ~full
            where = np.flatnonzero(gone & np.repeat(part, n))
            owner = np.repeat(np.arange(len(n)), n)[where]
            runs.append((doc[owner], key[owner], at_[owner] + where - edges[owner], np.ones(len(where), np.int64)))
        got = list(by_row(*(np.concatenate(x) for x in zip(*runs, strict=True))))
        made = pa.Table.from_arrays([pa.array([x[i] for x in got], f.type) for i, f in enumerate(replies)], schema=replies)
        return pa.concat_tables([passed.cast(replies), made])

    # straight into the shuffle: snippets are written once
    packets = keyed.mapInArrow(candidates, "bucket int, doc long, key long, packed binary")
    found = packets.groupBy("bucket").applyInArrow(settle, "doc long, key long, packed binary")
    flags = found.groupBy("doc", "key").agg(F.collect_list("packed").alias("packs"))  # a text's own windows
    final = common.schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_text else ""))
    names = final.names

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, packs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "packs")), strict=True):
                data = (text or "").encode()
                cut = spans = 0
                if packs:
                    edge = np.zeros(len(data) + 1, np.int64)
                    for p in packs:
                        runs = np.frombuffer(p, np.uint32).reshape(-1, 2).astype(np.int64)
                        np.add.at(edge, runs[:, 0], 1)
                        np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + width, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    cut, spans = int(gone.sum()), len(common.runs(gone)[0])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    kept = data
                rows.append((doc, len(data), cut, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=False)], names=names)

    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (keyed["key"] == flags["key"])
    return keyed.join(flags, same, "left").select("doc_id", "text", "packs").mapInArrow(take, final)


def by_row(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(id, key, the row's runs of window starts, packed as start and count): runs that touch are one."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start, count = ids[order], keys[order], start[order].astype(np.int64), count[order].astype(np.int64)
    if not len(ids):
        return
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] != start[:-1] + count[:-1]))))
    total = np.add.reduceat(count, new)
    ids, keys, start = ids[new], keys[new], start[new]
    edges = _groups(ids, keys)
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True):
        yield int(ids[i]), int(keys[i]), np.stack([start[i:j], total[i:j]], axis=1).astype(np.uint32).tobytes()


def op10_linear_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(common.documents(spark, sf_dir))
