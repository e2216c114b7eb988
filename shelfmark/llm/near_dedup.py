"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct word shingles. Each register of its sketch keeps the least of the exponentially
distributed points that the elements draw for it, on an exponentially spaced scale that is truncated at both ends:
sketches of parts merge by the register-wise extreme, and registers agree about as often as sets overlap.

1. One pass makes each document's set size, a 128-bit digest of its set, and its registers. Documents with equal sets
   form a class, a node of the graph of links.
2. Bands of registers are bucket keys. Buckets with the same members are one bucket. Members of a small bucket are
   paired; in a larger one each is paired with a pivot, found by partial aggregates, so a bucket of any size gives rows
   in proportion to its members.
3. Pairs are held against the joint likelihood of their registers, given both set sizes; those that may be similar are
   verified on the shingles themselves, and give links.
4. Buckets may still hold several components. A count-min sketch of these buckets' shingles tells which of them are
   certainly in one text only; a text that has too many of those is similar to none, and leaves the buckets. Texts of
   one template, each with more than a fifth of its own, go here, however many they are.
5. What is left outside of a bucket's largest component meets members of other components, in blocks of bounded size,
   where two texts have one of their rarest shingles in common: sets that are similar share one of the first
   n - threshold * n + 1 of any order of the shingles. Such pairs are held against each other by their registers (the
   same likelihood), then by their shingles, as long as no link found in the block joins their components already. A
   block gives fewer links than it has rows, and a pair is looked at in the first band that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common
from . import sketch as count_min

SHINGLE, SIMILARITY = 5, 0.8
#: Registers (a power of two), base of their scale, offset of the scale's zero; bands and registers in a band.
REGISTERS, BASE, SHIFT, BANDS, ROWS = 256, 1.1, 25, 42, 6
#: Members of a bucket that are paired with each other.
SMALL = 4
#: Members and shingles of a block of the last step, about.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Elements that are sketched at a time; a larger set is sketched in parts, and the parts' registers are merged.
PART = 1 << 21
#: Bits (as a power of two) of the filter that lets the texts of needed classes through: 8 MB, whatever the input.
FILTER_BITS = 26
#: Counters (as powers of two, least and most) in each row of the sketch of open buckets' shingles: 64 MB at most, as bits.
OPEN_BITS = (20, 28)
#: How far below its greatest value the log-likelihood at the threshold may lie for a pair to be verified.
MARGIN = 12.5
#: Similarities at which the likelihood is taken; a coarse grid finds less of a maximum, so it lets more pairs through.
_GRID, _COARSE = np.linspace(0.0, 1.0, 201), np.linspace(0.0, 1.0, 13)

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def shingles(raw: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of `size` words, or of all its words if they are fewer."""
    raw = _UPPER[raw]
    starts, ends, first = common.words(raw, off)
    values = common.word_hashes(raw, starts, ends, 0)
    runs = common.grams(values, size)
    out = []
    for lo, count in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
        if count >= size:
            s = np.sort(runs[lo : lo + count - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif count:
            out.append(common.mix(common.grams(values[lo : lo + count], count) + np.uint64(count)))
        else:
            out.append(values[:0])
    return out


def exact_shingles(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves. bytes.lower() and bytes.split() are those of ASCII: A-Z, and the six space characters."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


class Verifier:
    """Whether texts are similar: by hashes first; what those accept is confirmed on the shingles themselves."""

    def __init__(self, texts: list[bytes], hashed: list[np.ndarray], size: int, threshold: float):
        self.texts, self.hashed, self.size, self.hundredths = texts, hashed, size, round(threshold * 100)
        self.seen: dict[int, set] = {}

    def _of(self, i: int) -> set:
        if i not in self.seen:
            if len(self.seen) >= 64:
                self.seen.pop(next(iter(self.seen)))
            self.seen[i] = exact_shingles(self.texts[i], self.size)
        return self.seen[i]

    def __call__(self, i: int, j: int) -> bool:
        s, t = self.hashed[i], self.hashed[j]
        return self.enough(_shared(s, t), len(s), len(t)) and self.confirmed(i, j)

    def enough(self, shared, n, m):
        return 100 * shared >= self.hundredths * (n + m - shared)

    def confirmed(self, i: int, j: int) -> bool:
        x, y = self._of(i), self._of(j)
        return self.enough(len(x & y), len(x), len(y))


#: Random round functions of the permutation of registers (fixed seed: the same on every executor).
_ROUNDS = np.random.Generator(np.random.PCG64(11)).integers(0, 16, (4, 256, 16)).astype(np.uint8)


def _register(key: np.ndarray, j: int) -> np.ndarray:
    """The j-th of an element's 256 registers: a Feistel network of four rounds over two halves of four bits."""
    left, right = np.full(len(key), j >> 4, np.uint8), np.full(len(key), j & 15, np.uint8)
    for k in range(4):
        left, right = right, left ^ _ROUNDS[k, key[:, k], right]
    return left.astype(np.int64) << 4 | right


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS registers (bytes) for each set; an empty set has zeros.

    An element draws the points of a Poisson-like sequence in ascending order, each for another register in an order of
    its own, and stops at the first that no register of its set can use any more.
    """
    if any(len(s) > PART for s in sets):
        return np.stack([np.max([_sketched([s[i : i + PART]])[0] for i in range(0, max(len(s), 1), PART)], axis=0) for s in sets])
    return _sketched(sets)


def _sketched(sets: list[np.ndarray]) -> np.ndarray:
    m = REGISTERS
    out = np.full((len(sets), m), np.inf, np.float32)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    x = np.zeros(len(h), np.float32)
    state = h.copy()
    key = np.ascontiguousarray(common.mix(h + np.uint64(0xA0761D6478BD642F))).view(np.uint8).reshape(-1, 8)[:, :4]
    for j in range(m):
        if not len(state):
            break
        state = common.mix(state + np.uint64(0x9E3779B97F4A7C15))
        u = ((state >> np.uint64(40)).astype(np.float32) + 0.5) * np.float32(2.0**-24)
        x = x - np.log(u) / np.float32(m - j)
        np.minimum.at(flat, row * m + _register(key, j), x)
        most = out.max(axis=1)
        live = x < most[row]
        row, x, key, state = row[live], x[live], key[live], state[live]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(out) / np.log(BASE)) + SHIFT
    return np.where(np.isinf(out), 0, np.clip(level, 1, 255)).astype(np.uint8)


def _p(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)


def _count(flags: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(flags).view(np.uint64)).sum(axis=1, dtype=np.int64)[:, None]


def likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, base: float = BASE, points: np.ndarray = _GRID) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, log-likelihood lost at the threshold) of pairs of sketches, given both set sizes.

    Registers of a are greater, smaller or equal with probabilities that depend on the sizes and the similarity alone.
    """
    more, less = _count(a > b), _count(a < b)
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    most = np.minimum(na / nb, nb / na)[:, None]

    def at(j: np.ndarray) -> np.ndarray:
        pa_, pb = np.clip(_p(u - v * j, base), 1e-12, 1), np.clip(_p(v - u * j, base), 1e-12, 1)
        return more * np.log(pa_) + less * np.log(pb) + same * np.log(np.clip(1 - pa_ - pb, 1e-12, 1))

    grid = points[None, :] * most
    ll = at(grid)
    best = ll.argmax(axis=1)
    estimate = grid[np.arange(len(best)), best]
    top = ll[np.arange(len(best)), best]
    lost = np.where(estimate >= threshold, 0.0, top - at(np.minimum(threshold, most))[:, 0])
    return estimate, lost


def _sketch(source: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest and sketch (null without words) of each row."""
    spec = common.schema("doc_id long, mark binary, n_shingles long, digest binary, sketch binary")
    names = spec.names

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, limit=2 << 20):
            sets = shingles(*common.text_bytes(batch), size)
            regs = registers(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sketches = [r.tobytes() if d else None for r, d in zip(regs, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=names)

    return source.mapInArrow(common.tidy(make), spec)


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: all of small buckets, members with the pivot of others. members has bucket, n, node."""
    few = members.filter(F.col("n") <= SMALL).select("bucket", "node")
    small = few.alias("x").join(few.alias("y"), "bucket").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = members.filter(F.col("n") > SMALL).select("bucket", "node")
    pivots = many.groupBy("bucket").agg(F.min("node").alias("p"))
    large = many.join(pivots, "bucket").filter("node <> p")
    return small.unionByName(large.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those pairs whose registers allow the threshold, by joint likelihood."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                na, nb = (np.asarray(batch.column(c), dtype=np.float64) for c in ("na", "nb"))
                keep = np.concatenate([likelihood(sa[i : i + 512], sb[i : i + 512], na[i : i + 512], nb[i : i + 512], threshold)[1] <= MARGIN for i in range(0, len(sa), 512)])
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(common.tidy(test), common.schema("a long, b long"))


def _texts(source: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """node, n_shingles, sketch and text (A-Z lowered) of needed classes: a text of each, from a row with its smallest id.

    A bitmap of hashed ids, of a fixed size, is sent to the scan of the texts, so that other texts aren't shuffled;
    what passes by chance goes when ids and digests are joined.
    """
    bits = 1 << FILTER_BITS
    at = needed.select((F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()  # 4 KB for each 32768 bits
    held = np.zeros(bits // 8, np.uint8)
    for r in maps:
        held[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
    told = source.sparkSession.sparkContext.broadcast(held)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.asarray(batch.column("at"), dtype=np.int64)
            batch = batch.filter(pa.array((told.value[where >> 3] >> (where & 7).astype(np.uint8) & 1).astype(bool)))
            for part in common.small_batches([batch], limit=2 << 20):
                raw, off = common.text_bytes(part)
                sets = shingles(raw, off, size)
                lowered = _UPPER[raw].tobytes()
                texts = [lowered[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "digest", "text"])

    rows = source.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"))
    found = rows.mapInArrow(common.tidy(make), common.schema("doc_id long, digest binary, text binary"))
    once = found.join(needed.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return once.join(needed, ["doc_id", "digest"]).select("node", "n_shingles", "sketch", "text")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose sets have at least the threshold's similarity, in hundredths and exact."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts, hashed = batch.num_rows, [], []
            for c in ("ta", "tb"):
                texts += batch.column(c).to_pylist()
                hashed += shingles(*common.text_bytes(batch, c), size) if n else []
            similar = Verifier(texts, hashed, size, threshold)
            keep = pa.array([similar(i, n + i) for i in range(n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(common.tidy(test), common.schema("a long, b long"))


def _shared(s: np.ndarray, t: np.ndarray) -> int:
    both = np.concatenate((s, t))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Overlaps:
    """How many elements one of many sets (none of them empty) shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        distinct, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum([0, *(len(s) for s in sets)])
        self.table = np.zeros(len(distinct), np.uint8)

    def shared(self, i: int) -> np.ndarray:
        mine = self.ids[self.starts[i] : self.starts[i + 1]]
        self.table[mine] = 1
        out = np.add.reduceat(self.table[self.ids], self.starts[:-1], dtype=np.int64)
        self.table[mine] = 0
        return out


def prefixes(overlaps: Overlaps, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, shingle) of the rarest shingles of each set: as many as it takes that similar sets have one in common.

    A set of n shares at least its ceil(threshold * n) with a similar one, so of the n - ceil(threshold * n) + 1 first
    in an order of all shingles one is shared, and it is among the first of the other set as well.
    """
    sizes = np.diff(overlaps.starts)
    order = np.argsort(np.bincount(overlaps.ids), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of = np.repeat(np.arange(len(sizes)), sizes)
    ranks = rank[overlaps.ids]
    ranks = ranks[np.lexsort((ranks, of))]
    first = np.arange(len(of)) - overlaps.starts[of] < (sizes - -(-hundredths * sizes // 100) + 1)[of]
    return of[first], ranks[first]


def candidates(overlaps: Overlaps, left: np.ndarray, right: np.ndarray, hundredths: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set of left, places in right) of the sets that have one of their rarest shingles in common; sets of left without any are left out."""
    of, rank = prefixes(overlaps, hundredths)
    place = np.full(len(overlaps.starts) - 1, -1, np.int64)
    place[right] = np.arange(len(right))
    theirs = place[of] >= 0
    at, held = place[of[theirs]], rank[theirs]
    order = np.argsort(held, kind="stable")
    at, held = at[order], held[order]
    lo, hi = np.searchsorted(held, rank, "left"), np.searchsorted(held, rank, "right")
    begin = np.searchsorted(of, np.arange(len(place) + 1))
    for i in left.tolist():
        starts, counts = lo[begin[i] : begin[i + 1]], (hi - lo)[begin[i] : begin[i + 1]]
        total = int(counts.sum())
        if total > 4 * len(right):
            yield i, np.arange(len(right))
        elif total:
            yield i, np.unique(at[common.ranges(starts, counts)])


def _able(texts: DataFrame, shingles_: int, size: int, threshold: float) -> DataFrame:
    """The nodes of texts that may be similar to another: those with enough shingles that the sketch estimates in two or more of them."""
    bits = min(max(int(shingles_).bit_length(), OPEN_BITS[0]), OPEN_BITS[1])
    texts = texts.select("node", "text")

    def picks(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        sets = shingles(*common.text_bytes(batch), size)
        return np.concatenate(sets), sum(map(len, sets))

    held, _ = count_min.repeated(texts, picks, bits)
    told = texts.sparkSession.sparkContext.broadcast(held)  # count_min.DEPTH << bits bits, of a bounded number

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, limit=2 << 20):
            sets = shingles(*common.text_bytes(batch), size)
            shared = [int(np.count_nonzero(count_min.estimated_repeated(told.value, s, bits))) for s in sets]
            able = pa.array([100 * k >= round(threshold * 100) * len(s) for k, s in zip(shared, sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(able)], names=["node"])

    return texts.mapInArrow(common.tidy(test), common.schema("node long"))


def _further(members: DataFrame, labels: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame | None:
    """Links across components within a bucket that pivots have missed: enough of them to join what belongs together; None if no bucket is open.

    Outsiders of a bucket (members that aren't in its largest component) meet its members block by block: a bucket of n
    members with o outsiders makes about n * o / BLOCK + o * n / BLOCK rows, n + o where it is no larger than a block.
    Members that can't be similar to any other are no part of this.
    """
    known = members.filter(F.col("n") > SMALL).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def opened(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"))
        return sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("count", -F.col("component"), "shingles")).alias("main"), F.sum("count").alias("rows"), F.sum("shingles").alias("shingles")).filter("parts > 1")

    first = common.keep(known.join(opened(known).select("bucket"), "bucket"), "open")
    nodes = first.select("node", "n_shingles").distinct()
    total = nodes.agg(F.sum("n_shingles")).first()[0]
    if total is None:
        return None
    able = common.keep(_able(texts.join(nodes, "node", "left_semi"), total, size, threshold), "able")
    left = first.join(able, "node", "left_semi")
    cut = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    grid = opened(left).select("bucket", (-F.col("main.col2")).alias("main"), cut(F.col("rows"), F.col("shingles")).alias("k"), cut(F.col("rows") - F.col("main.count"), F.col("shingles") - F.col("main.shingles")).alias("o"))
    open_ = left.join(grid, "bucket")
    # each block of outsiders meets each block of its bucket once
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outer = F.transform(all_("k"), lambda j: F.struct(F.lit(0).alias("side"), part("o", 1).alias("i"), j.alias("j")))
    inner = F.transform(all_("o"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), part("k", 2).alias("j")))
    places = open_.select("bucket", "band", "node", "component", F.when(F.col("component") == F.col("main"), inner).otherwise(F.concat(outer, inner)).alias("places"))
    rows = places.join(texts, "node").select("bucket", "band", "node", "component", "n_shingles", "sketch", "text", F.inline("places"))

    def meet(table):
        band = table["band"][0].as_py()
        side = np.asarray(table["side"])
        node, comp, n = (np.asarray(table[c], dtype=np.int64) for c in ("node", "component", "n_shingles"))
        regs = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        bands = regs[:, : band * ROWS].reshape(len(node), band, ROWS)
        held = [x for c in table["text"].chunks for x in shingles(*common.text_bytes(pa.RecordBatch.from_arrays([c], names=["text"])), size) if len(c)]
        similar = Verifier(table["text"].to_pylist(), held, size, threshold)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        right = np.flatnonzero(side == 1)
        overlaps = Overlaps(held)
        a, b = [], []
        for i, at in candidates(overlaps, np.flatnonzero(side == 0), right, similar.hundredths):
            at = at[(comp[right[at]] != comp[i]) & (np.minimum(n[right[at]], n[i]) >= threshold * np.maximum(n[right[at]], n[i]) - 1e-9)]
            if band and len(at):
                at = at[~(bands[right[at]] == bands[i]).all(axis=2).any(axis=1)]
            lost = [likelihood(regs[i : i + 1], regs[mine], np.full(len(mine), float(n[i])), n[mine].astype(float), threshold, points=_COARSE)[1] for mine in np.split(right[at], range(512, len(at), 512))] if len(at) else []
            at = at[np.concatenate(lost) <= MARGIN] if lost else at
            if len(at):
                mine = right[at]
                few = 8 * int(n[mine].sum() + n[i] * len(mine)) < len(overlaps.ids)
                shared = np.array([_shared(held[i], held[r]) for r in mine.tolist()]) if few else overlaps.shared(i)[mine]
                at = at[similar.enough(shared, n[i], n[mine])]
            for r in right[at].tolist():
                x, y = root(int(comp[i])), root(int(comp[r]))
                if x != y and similar.confirmed(i, r):
                    parent[max(x, y)] = min(x, y)
                    a.append(min(int(node[i]), int(node[r])))
                    b.append(max(int(node[i]), int(node[r])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _labelled(source: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, mark, n_shingles, node, component, component_id of each row; the last three are null where a set is empty or has no id at all.

    source has doc_id, text and mark. component is a node, component_id the smallest id in it.
    """
    made = common.keep(_sketch(source, shingle), "sketches")
    least = made.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("m"))
    classes = common.keep(least.select("digest", "m.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    every = classes.select("node", F.posexplode(bands).alias("band", "bucket"))
    # buckets of the same members are one, that of the first band: they agree in count, sum and exclusive-or of hashes
    shape = every.groupBy("bucket").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).filter("n > 1")
    chosen = shape.groupBy("n", "s", "x").agg(F.min(F.struct("band", "bucket")).alias("c")).select("c.bucket", "n")
    members = common.keep(every.join(chosen, "bucket"), "members")
    likely = common.keep(_likely(_pairs(members), classes, threshold), "likely")
    needed = likely.select(F.explode(F.array("a", "b")).alias("node")).union(members.filter(F.col("n") > SMALL).select("node")).distinct()
    texts = common.keep(_texts(source, classes.join(needed, "node", "left_semi"), shingle), "texts")
    links = common.keep(_verified(likely, texts, shingle, threshold), "links")
    found = common.keep(components(links, "a", "b"), "components")
    labels = classes.select("node", "n_shingles").join(found, "node", "left")
    further = _further(members, labels, texts, shingle, threshold)
    if further is not None:
        more = common.keep(further, "further")
        if not more.isEmpty():
            found = common.keep(components(links.unionByName(more), "a", "b"), "components")
    ids = found.join(classes.select("node", "doc_id"), "node")
    named = ids.select("node", "component").join(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    every_class = classes.select("digest", "node", "doc_id").join(named, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return made.select("doc_id", "mark", "n_shingles", "digest").join(every_class, "digest", "left").drop("digest")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Texts are linked whose sets of `shingle` words (A-Z lowered) have a similarity of at least the threshold. A text
    without words has an empty set and is linked with nothing: its component is itself. Rows that share an id are
    linked by their own sets only; a row without an id joins the component of its set, or null where that has no id.
    An empty table gives an empty result.
    """
    out = _labelled(common.pair(docs, id_col, text_col, F.lit(None).cast("binary").alias("mark")), shingle, threshold)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component: that of the smallest id (of several texts with that id, one).

    Rows are told apart by id and text, so a text that is linked with nothing stays whatever ids it shares; rows with
    the same id and text stay or go together. Rows without an id stay.
    """
    mark = lambda text: F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    rows = common.keep(_labelled(common.pair(docs, id_col, text_col, mark(text_col).alias("mark")), shingle, threshold).filter("component IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "mark", "component"), "labelled")
    stays = rows.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("s"), F.count("*").alias("n")).filter("n > 1")
    gone_id, gone_mark, own = common.fresh(docs.columns, "id", "mark", "own")
    gone = common.keep(rows.join(stays, "component").filter("doc_id <> s.doc_id OR mark <> s.mark").select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct(), "gone")
    marked = docs.withColumn(own, mark(text_col))
    return marked.join(gone, (F.col(id_col).cast("long") == F.col(gone_id)) & (F.col(own) == F.col(gone_mark)), "left_anti").drop(own)


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.documents(spark, sf_dir), shingle=2)
