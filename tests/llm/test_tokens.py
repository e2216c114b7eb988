import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import chunks, packing, piece_codec

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "▁", "</s>", "<s>", "中", "😀", "\xa0", "\x1c", "\x85", "12", ".", "'s", " t", "\r", "\x00", "<|endoftext|>", "Ertion", "<0x0A>"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_byte_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(BYTES).open()(texts)] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_pieces_are_the_librarys(texts):
    coder = piece_codec.Codec(PIECES).open()
    assert coder.cuttable
    for text, (ids, decoded) in zip(texts, coder.code(texts), strict=True):
        want = [*coder.model.encode(text), coder.model.eos_id()]
        assert ids == " ".join(map(str, want)) and decoded == coder.model.decode(want)


def test_uncuttable_models_encode_whole_texts():
    coder = piece_codec.Codec(PIECES, most=3).open()
    coder.cuttable = False
    want = [*coder.model.encode("a  b\nc"), coder.model.eos_id()]
    assert list(coder.code(["a  b\nc"])) == [(" ".join(map(str, want)), "a  b\nc")]


def test_chunk_table_is_bounded():
    table = chunks.Table(lambda c: c.upper(), longest=5, most=10)
    for k in range(30):
        table.renew()
        assert [table[x] for x in ("same", f"k{k}", "toolong")] == [" SAME", f" K{k}", " TOOLONG"]
    assert len(table) <= 12 and "toolong" not in table


@pytest.mark.parametrize("text", ["", "a", " a", "a  b", "a\nb c", "\n\n", "a ", "a \n b"])
def test_chunks_join_to_the_text(text):
    parts = chunks.cut(text)
    assert parts[0] + "".join(map(chunks.chunk, parts[1:])) == text


def test_piece_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    coder = piece_codec.Codec(PIECES).open()
    import hashlib

    want = {}
    for r in rows:
        ids = [*coder.model.encode(r["text"]), 2]
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.model.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in piece_codec.op7_distinct_chunk_pieces(spark, sf).collect()} == want


def test_pieces_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = sorted(map(repr, (tuple(r)[:2] for r in piece_codec.encode(df, piece_codec.Codec(PIECES)).collect())))
    assert got == sorted(map(repr, [(1, 1), (1, 1), (None, 3)]))
    assert piece_codec.encode(df.limit(0), piece_codec.Codec(PIECES)).count() == 0


def test_plan_fills_what_brute_force_fills():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        reach = {0}
        for k, n in counts.items():
            reach = {s + k * i for s in reach for i in range(n + 1) if s + k * i <= 40}
        taken, best = packing.fill(counts, 40)
        assert best == max(reach) == sum(k * n for k, n in taken.items()) and all(n <= counts[k] for k, n in taken.items())


def test_plan_uses_every_piece():
    counts = {2048: 3, 2000: 10, 48: 25, 1024: 7, 1: 4}
    plan = packing.plan(counts)
    used = {}
    for taken, times in plan:
        assert sum(k * n for k, n in taken.items()) <= 2048
        for k, n in taken.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts and sum(t for _, t in plan) == 3 + 10 + 3 + 1


def check_packing(rows, texts, capacity):
    encode = packing.Encoder(BYTES).open()
    ids = {d: np.frombuffer(b, "<u4").tolist() + [1] for (d, _), b in zip(texts, encode([t or "" for _, t in texts]), strict=True)}
    seen, places = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(seen) == set(ids)
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, sf, capacity):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(docs, packing.Encoder(BYTES), capacity).collect()
    n = check_packing(rows, texts, capacity)
    least = -(-sum(r["length"] for r in rows) // capacity)  # no packing has fewer sequences
    assert n <= least * 1.01 + 1


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 5000, 9)], "doc_id long, text string, length int")
    rows = packing.pack(df, packing.Encoder(BYTES)).collect()
    check_packing(rows, [(1, None), (2, ""), (3, "word " * 5000)], 2048)
    assert packing.pack(df.limit(0), packing.Encoder(BYTES)).collect() == []
    both = packing.pack(df.limit(1).union(df.limit(1)), packing.Encoder(BYTES)).collect()
    assert sorted((r["sequence_id"], r["offset"]) for r in both) == [(0, 0), (0, 1)]
