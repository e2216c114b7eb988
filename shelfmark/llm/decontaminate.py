"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a batch of texts. Words that no benchmark item has end every match, so its suffix array orders the suffixes
that begin with another word only. All suffixes of the benchmark are looked up at once: a query's range of the array is
narrowed word by word, by binary search in that column of the sorted suffixes, until it is empty. The range at the
window's width gives the places of the window, the last one that isn't empty the longest verbatim match.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_automaton, common

WINDOW = 10
#: Benchmark words that one pass over the texts looks up, and words of one piece of an item (a longer item is cut into overlapping pieces).
BLOCK_WORDS, PIECE_WORDS = 1 << 20, 1 << 15


@dataclass
class Block:
    """Pieces of benchmark items, as word numbers from 1 in the order of their hashes; 0 stands after each piece."""

    hashes: np.ndarray  # of the vocabulary, sorted, and a second hash of each word
    checks: np.ndarray
    maybe: np.ndarray  # which leading bits any hash has
    seq: np.ndarray
    width: np.ndarray  # of the window that begins at each word; 0: none does
    piece: np.ndarray  # of each word
    items: list[str | None]  # of each piece
    starts: np.ndarray  # the word of its item that each word is
    longest: int


def _block(rows: list) -> Block:
    """rows: (item, start, n_words of the item, first hashes, second hashes) of each piece."""
    parts = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["c"], np.uint64)) for r in rows]
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    hashes, first, number = np.unique(h, return_index=True, return_inverse=True)
    checks = (np.concatenate([p[1] for p in parts]) if parts else h)[first]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1)
    seq, width, piece, starts = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64), None, np.repeat(np.arange(len(rows)), sizes + 1), None
    within = common.ranges(np.zeros(len(rows), np.int64), sizes + 1)
    seq[within < sizes[piece]] = number + 1
    wide = np.array([r["width"] for r in rows], np.int64)[piece] if rows else piece
    width = np.where(within + wide <= sizes[piece], wide, 0)
    starts = within + (np.array([r["start"] for r in rows], np.int64)[piece] if rows else 0)
    maybe = np.zeros(1 << 20, bool)
    maybe[hashes >> np.uint64(44)] = True
    return Block(hashes, checks, maybe, seq, width, piece, [r["item"] for r in rows], starts, int(sizes.max(initial=0)))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_WORDS words: what is collected and broadcast at once is bounded, whatever the table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            raw, off = common.text_bytes(batch)
            low, starts, ends, word_off = byte_automaton.words(raw, off)
            h, c = (common.word_hashes(low, starts, ends, k) for k in (0, 1))
            out = []
            for i, item in enumerate(batch.column("item").to_pylist()):
                n = int(word_off[i + 1] - word_off[i])
                for at in range(0, max(n - window + 1, min(n, 1)), PIECE_WORDS):
                    a, b = word_off[i] + at, word_off[i] + min(n, at + PIECE_WORDS + window - 1)
                    out.append((item, at, min(window, n), int(b - a), h[a:b].tobytes(), c[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["item", "start", "width", "size", "h", "c"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    rows = common.bounded(benchmark).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    pieces = common.keep(rows.mapInArrow(cut, "item string, start long, width long, size long, h binary, c binary"), "benchmark-pieces")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    n = math.ceil(total / BLOCK_WORDS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "start", "h"), F.lit(max(n, 1))))
    for k in range(n):
        yield _block(dealt.filter(F.col("block") == k).collect())


def suffixes(seq: np.ndarray, most: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a word sequence that begin with a word (not 0), sorted; a 0 ends a suffix. most: the greatest word number.

    Words are packed into one key as far as they fit; groups that still tie are ordered by the ranks of what follows,
    twice as far each time, until they differ, end, or are alike for `depth` words. Also returns the sequence with zeros after it.
    """
    bits = max(int(most).bit_length(), 1)
    per = max(1, 63 // bits)
    at = np.flatnonzero(seq)
    padded = np.concatenate((seq, np.zeros(max(per, depth) + 1, np.int64)))
    key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(per):
        word = padded[at + j]
        alive &= word > 0
        key = (key << bits) | np.where(alive, word, 0)
    order = np.argsort(key, kind="stable")
    at, key, alive = at[order], key[order], alive[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(at) else np.zeros(0, bool)
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at  # the place of its group's first member
    rank, ended = np.zeros(len(padded), np.int64), np.zeros(len(padded), bool)
    rank[at], ended[at] = group + 1, ~alive
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    todo = np.flatnonzero(np.repeat(size > 1, size) & alive) if len(at) else at
    far = per
    while len(todo) and far < depth:
        p = at[todo]
        nxt = np.minimum(p + far, len(padded) - 1)
        follows, over = rank[nxt], ended[nxt] | (rank[nxt] == 0)
        order = np.lexsort((follows, group[todo]))
        p, follows, over, own = p[order], follows[order], over[order], group[todo]  # groups are runs, so the places stay
        at[todo] = p
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (follows[1:] != follows[:-1])))
        first = np.flatnonzero(new)
        group[todo] = todo[first][np.cumsum(new) - 1]
        size = np.diff(np.concatenate((first, [len(todo)])))
        later_rank, later_ended = group[todo] + 1, over
        todo = todo[np.repeat(size > 1, size) & ~over]
        rank[p], ended[p] = later_rank, later_ended
        far *= 2
    return at, padded


def look_up(block: Block, at: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the block: the range of suffixes that begin with its window, the length of its longest match, and the range of that."""
    n = len(block.seq)
    lo_w, hi_w, length, lo_all, hi_all = (np.zeros(n, np.int64) for _ in range(5))
    heads = padded[at]
    live = np.flatnonzero(block.seq)
    lo, hi = np.searchsorted(heads, block.seq[live], "left"), np.searchsorted(heads, block.seq[live], "right")
    depth = 1
    while True:
        fine = lo < hi
        live, lo, hi = live[fine], lo[fine], hi[fine]
        if not len(live):
            return lo_w, hi_w, length, lo_all, hi_all
        length[live], lo_all[live], hi_all[live] = depth, lo, hi
        met = block.width[live] == depth
        lo_w[live[met]], hi_w[live[met]] = lo[met], hi[met]
        word = block.seq[live + depth]
        fine = word > 0  # else the piece ends here
        live, lo, hi, word = live[fine], lo[fine], hi[fine], word[fine]
        bounds = []
        for above in (False, True):  # the first suffix whose next word isn't less, and the first where it is greater
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                value = padded[at[mid] + depth]
                less = value <= word[open_] if above else value < word[open_]
                a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            bounds.append(a)
        lo, hi = bounds
        depth += 1


def _shard(batch: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's word offsets, the text of each place of its word sequence, and its suffix array over the block's words, padded sequence last.

    The sequence has a 0 after each text, and one for each word that the block doesn't know.
    """
    raw, off = common.text_bytes(batch)
    low, starts, ends, word_off = byte_automaton.words(raw, off)
    h = common.word_hashes(low, starts, ends, 0)
    some = np.flatnonzero(block.maybe[h >> np.uint64(44)])
    number = np.searchsorted(block.hashes, h[some])
    known = number < len(block.hashes)
    known[known] = block.hashes[number[known]] == h[some[known]]
    some, number = some[known], number[known]
    same = common.word_hashes(low, starts[some], ends[some], 1) == block.checks[number]
    some, number = some[same], number[same]
    text = np.repeat(np.arange(batch.num_rows), np.diff(word_off) + 1)
    seq = np.zeros(len(text), np.int64)
    seq[some + np.searchsorted(word_off[1:], some, "right")] = number + 1  # each text before it adds one place
    at, padded = suffixes(seq, len(block.hashes), block.longest)
    return word_off, text, at, padded


def _found(batch: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Word offsets, which words any window covers, and (text, item) of the items with a window there."""
    word_off, text, at, padded = _shard(batch, block)
    lo, hi, _, _, _ = look_up(block, at, padded)
    query = np.flatnonzero(hi > lo)
    if not len(query):
        return word_off, np.zeros(int(word_off[-1]), bool), []
    # equal windows share their range: each range is walked once
    ranges, which = np.unique(np.stack((lo[query], hi[query], block.width[query])), axis=1, return_inverse=True)
    sizes = ranges[1] - ranges[0]
    places = at[common.ranges(ranges[0], sizes)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.subtract.at(edge, np.minimum(places + np.repeat(ranges[2], sizes), len(text)), 1)
    hit = np.delete(np.cumsum(edge[:-1]) > 0, word_off[1:] + np.arange(batch.num_rows))  # without the places after texts
    pairs = np.unique(np.stack((np.repeat(np.arange(len(sizes)), sizes), text[places])), axis=1)  # (range, text)
    order = np.argsort(which.ravel(), kind="stable")
    count = np.bincount(which.ravel(), minlength=len(sizes))
    first = np.cumsum(count) - count
    pieces = block.piece[query[order]]
    rows = np.repeat(pairs[1], count[pairs[0]])
    pieces = pieces[common.ranges(first[pairs[0]], count[pairs[0]])]
    both = np.unique(np.stack((rows, pieces)), axis=1)
    return word_off, hit, [(int(r), block.items[p]) for r, p in both.T.tolist()]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_run, items for each row of docs.

    A window is `window` words in a row of an item; an item of fewer words is one window. A word of a document that an
    occurrence of any window covers is hit; longest_run is the longest run of hit words, items are the sorted ids of the
    items with occurring windows (items that share an id count once, those without an id hit words but aren't listed).
    Null and empty texts have no words; empty tables give no rows, or no hits. Repeated rows are each judged by themselves.
    """
    rows = common.pair(docs, id_col, text_col).withColumns({"hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    held = list(_broadcasts(docs.sparkSession, _blocks(benchmark, item_col, item_text_col, window))) or [docs.sparkSession.sparkContext.broadcast(_block([]))]

    def step(block, last: bool):
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_run", "items"] if last else ["doc_id", "text", "hits", "items"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in common.small_batches(batches):
                word_off, hit, pairs = _found(batch, own)
                items: list[set[str]] = [set(x or ()) for x in batch.column("items").to_pylist()]
                for r, item in pairs:
                    if item is not None:
                        items[r].add(item)
                for i, held in enumerate(batch.column("hits").to_pylist()):
                    if held:
                        at = np.frombuffer(held, np.uint32).reshape(-1, 2)
                        hit[word_off[i] + common.ranges(at[:, 0].astype(np.int64), (at[:, 1] - at[:, 0]).astype(np.int64))] = True
                a, b = common.runs(np.insert(hit, word_off[1:-1], False))  # runs end with their texts
                row = np.searchsorted(word_off[1:-1] + np.arange(1, batch.num_rows), a, "right")
                listed = [sorted(x) for x in items]
                if not last:
                    packed = np.stack((a - row - word_off[row], b - row - word_off[row]), axis=1).astype(np.uint32)
                    cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([packed[i:j].tobytes() or None for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(listed, pa.list_(pa.string()))], names=names)
                    continue
                longest, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.maximum.at(longest, row, b - a)
                np.add.at(n_hit, row, b - a)
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NONE for x in listed]
                columns = [batch.column("doc_id"), pa.array(np.diff(word_off)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(digests), pa.array(n_hit > 0), pa.array(longest), pa.array(listed, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return common.tidy(run)

    for k, block in enumerate(held):
        last = k == len(held) - 1
        spec = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_run long, items array<string>" if last else "doc_id long, text string, hits binary, items array<string>"
        rows = rows.mapInArrow(step(block, last), spec)
        if not last:
            rows = common.keep(rows, "overlaps")
    return rows


_NONE = hashlib.sha256(b"").hexdigest()


def _broadcasts(spark: SparkSession, blocks: Iterator[Block]) -> Iterator:
    for block in blocks:
        yield spark.sparkContext.broadcast(block)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without a word that a window of the benchmark covers, with all their columns."""
    fields = common.bounded(docs).schema
    (name,) = common.fresh(docs.columns, "text")

    def without(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in common.small_batches(batches, name):
                word_off, hit, _ = _found(batch.select([name]).rename_columns(["text"]), own)
                sums = np.concatenate(([0], np.cumsum(hit)))
                yield batch.filter(pa.array(sums[word_off[1:]] == sums[word_off[:-1]])).drop_columns([name])

        return common.tidy(run)

    for block in _broadcasts(docs.sparkSession, _blocks(benchmark, item_col, item_text_col, window)):
        docs = common.keep(docs.withColumn(name, F.col(text_col).cast("string")).mapInArrow(without(block), fields), "decontaminated")
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW) -> DataFrame:
    """item_id, item_word, words, doc_id, doc_word: for each suffix of an item (from its item_word on) that `least` words in a row of a document begin with,
    the longest verbatim match in all documents and one place of it, of those in the smallest doc_id the first. Words count from 0.

    A task keeps the best of its own texts; so many rows as the benchmark has words leave it at most. Items are cut into
    pieces of PIECE_WORDS words, beyond which a match doesn't reach.
    """
    found = None
    for block in _broadcasts(docs.sparkSession, _blocks(benchmark, item_col, item_text_col, least)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = block.value
            best: dict[int, tuple[int, int | None, int]] = {}
            for batch in common.small_batches(batches):
                word_off, text, at, padded = _shard(batch, own)
                _, _, length, lo, hi = look_up(own, at, padded)
                ids = np.array([-(1 << 63) if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
                for q in np.flatnonzero(length >= least).tolist():
                    places = at[lo[q] : hi[q]]
                    rows = text[places]
                    k = np.lexsort((places, ids[rows]))[0]
                    place = (-int(length[q]), int(ids[rows[k]]), int(places[k] - word_off[rows[k]] - rows[k]))
                    best[q] = min(best.get(q, place), place)
            rows = [(own.items[own.piece[q]], int(own.starts[q]), -n, d if d > -(1 << 63) else None, w) for q, (n, d, w) in best.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "item_word", "words", "doc_id", "doc_word"])

        got = common.keep(common.pair(docs, id_col, text_col).mapInArrow(common.tidy(run), "item_id string, item_word long, words long, doc_id long, doc_word long"), "matches")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id string, item_word long, words long, doc_id long, doc_word long")
    return found.groupBy("item_id", "item_word").agg(F.min(F.struct(-F.col("words"), "doc_id", "doc_word")).alias("m")).select("item_id", "item_word", (-F.col("m.col1")).alias("words"), "m.doc_id", "m.doc_word")


def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, widths WHERE len(w) >= width),
hits AS MATERIALIZED (SELECT p.doc_id, p.k, p.width, x.item FROM (SELECT doc_id, k, width, array_to_string(w[k:k + width - 1], ' ') AS t FROM places) p JOIN windows x ON x.width = p.width AND x.t = p.t),
words AS (SELECT DISTINCT doc_id, k + unnest(range(width)) AS place FROM hits),
runs AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM words) GROUP BY doc_id, run),
found AS (SELECT doc_id, sum(n) AS n_hit, max(n) AS longest FROM runs GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest, 0)::BIGINT AS longest_run
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN items USING (doc_id)
"""
