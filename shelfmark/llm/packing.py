"""Packing token ids into sequences by minimum bin slack.

A document's ids and an end id are cut into pieces of the capacity and one shorter rest. How many rests there are of
each length is a table of at most `capacity` rows, whatever the corpus: from it the driver plans. For each sequence
a bitset subset-sum (one integer, bit s set where s can be reached) finds the multiset of remaining lengths that
comes closest to the capacity beside the longest length left; the counts are traced back through the kept bitsets,
and the multiset is used as often as the counts allow, so each entry of the plan exhausts a length.

Pieces are then ranked within their length and looked up in the plan. Ranks come from row numbers within
(length, bucket) and running counts over buckets, so a length that many pieces share is dealt over many tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks, common

CAPACITY, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes, by a tokenizers file; one chunk table for each worker."""

    path: str
    longest: int = chunks.LONGEST
    most: int = chunks.MOST

    def open(self) -> Callable[[list[str]], list[bytes]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        key = (self.path, self.longest, self.most)
        if key not in _OPEN:
            tokenizer = Tokenizer.from_file(self.path)
            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            ranks = _ranks(self.path)

            def whole_text(text: str) -> bytes:
                return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

            if ranks:
                import tiktoken

                merge = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

                def encode(text: str) -> bytes:
                    return array("I", merge(text)).tobytes()
            else:
                encode = whole_text

            table = chunks.Table(encode, self.longest, self.most)

            def look(texts: list[str]) -> list[bytes]:
                table.renew()
                out = []
                for text in texts:
                    if any(s in text for s in special):  # a special token's string is left to the library
                        out.append(whole_text(text))
                        continue
                    keys = iter(chunks.cut(text))
                    out.append(b"".join(chain((encode(next(keys)),), map(table.__getitem__, keys))))
                return out

            look.forget = table.forget
            _OPEN[key] = look
        return _OPEN[key]


_OPEN: dict = {}
#: How byte-level pre-tokenizing splits text (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int] | None:
    """The byte strings of a byte-level BPE file by id, if merging by least id is the same as merging by the file's order."""
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = held["model"], held.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or held.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("ignore_merges"):
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]  # these bytes stand for themselves, the others for 256 + k
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab, first = model["vocab"], len(byte)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(pairs)) or len(vocab) != first + len(pairs):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


def pieces(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; with the ids as bytes, if asked for. Null text: the end id alone."""
    spec = common.schema(PIECES + (", ids binary" if ids else ""))
    fields = spec.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder.open(), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in common.small_batches(batches, limit=2 << 20):
            rows: list[tuple] = []
            for doc, got in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data = got + end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    part = data[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, part)[: 6 if ids else 5])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=fields)
        encode.forget()

    return common.pair(docs, id_col, text_col).mapInArrow(common.tidy(cut), spec)


def fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths in counts whose sum comes closest to the capacity from below, and that sum."""
    goal, reach, kept = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left:  # binary splitting: 1, 2, 4, ... copies at once
            n = min(step, left)
            kept.append((length, n, reach))
            reach |= reach << (length * n) & goal
            left, step = left - n, step * 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, n, before in reversed(kept):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return taken, best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths with their numbers, how many sequences are so filled), until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        taken, _ = fill({k: v for k, v in rest.items() if v and k <= capacity - first}, capacity - first) if first < capacity else ({}, 0)
        taken[first] = taken.get(first, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        out.append((taken, times))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table, as it is read three times)."""
    spark = cut.sparkSession
    counted = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    lookup: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counted}
    used, sequence = dict.fromkeys(counted, 0), 0
    for taken, times in plan(counted, capacity):
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            lookup[length].append((used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    table = {k: np.array(v, dtype=np.int64).T for k, v in lookup.items()}
    buckets = common.partitions(spark, sum(counted.values()), 100_000)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("rank", rank).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    names = [f.name for f in cut.schema]
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            ids, offsets = np.empty_like(lengths), np.empty_like(lengths)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                first, base, n, offset = table[length]
                k = np.searchsorted(first, ranks[mine], side="right") - 1
                over = ranks[mine] - first[k]
                ids[mine], offsets[mine] = base[k] + over // n[k], offset[k] + over % n[k] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ids), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(common.tidy(look), common.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"))


def pack(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each; an empty table packs to nothing.
    """
    return place(common.keep(pieces(docs, encoder, capacity, end_id, id_col, text_col, ids), "pieces"), capacity)


def op5_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), Encoder(public_tokenizers.path("byte_bpe_50k.json")))
