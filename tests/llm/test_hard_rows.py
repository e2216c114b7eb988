"""Rows that are hard on hashes, parsers and names."""

import hashlib
import struct

import numpy as np
import pytest
from test_near_dedup import edited, expected
from test_repeated import bytes_expected, passages, words_expected

from shelfmark.llm import common, exact_dedup, near_dedup, personal_data, repeated_bytes, repeated_words, tiff


def twins(n=1024):
    """A word of two letters in the order of Thue and Morse, and the same with the letters exchanged: sums of powers modulo 2 ** 64 are equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_have_no_structure():
    a, b = twins()
    words = [a, b, a[:512] + b[:512], "x", "x" * 8, "x" * 9, "x\0", "\0x", *(c * n for c in "pq" for n in range(1, 40))]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]))
    for which in (0, 1):
        h = common.word_hashes(raw, starts, ends, which)
        assert len(set(h.tolist())) == len(set(words))
    again = np.frombuffer(b"zz zzz " + raw.tobytes(), np.uint8)
    s2, e2, _ = common.words(again, np.array([0, len(again)]))
    assert (common.word_hashes(again, s2, e2, 1)[2:] == h).all()


def test_grams_are_of_their_own_values_only():
    v = np.random.default_rng(2).integers(0, 2**64, 60, dtype=np.uint64)
    for n in (1, 2, 3, 5, 8, 35, 60, 61):
        g = common.grams(v, n)
        assert len(g) == max(0, 61 - n) and all(common.grams(v[i : i + n], n)[0] == g[i] for i in range(len(g)))


def test_colliding_words_in_windows_and_shingles(spark):
    a, b = twins()
    fill = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*fill, a])), (2, " ".join([*fill, b])), (3, " ".join([*fill[:17], a, *fill[17:]])), (4, " ".join([*fill[:17], a, *fill[17:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in repeated_words.removed(df, bits=12).collect()) == words_expected(rows, 35)
    rows = [(1, f"{a} {a}"), (2, f"{b} {b}"), (3, f"{a} {b}"), (4, a), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.link(df, shingle=2).collect()) == expected(rows, 2)


def test_texts_with_one_digest(spark, monkeypatch):
    """Hashes that say nothing: content decides."""
    monkeypatch.setattr(repeated_bytes, "_digests", lambda raw, at, size, reach: np.zeros(len(at), np.uint64))
    rng = np.random.default_rng(0)
    snippets = rng.integers(97, 99, 4000).astype(np.uint8)
    at, size, reach = rng.integers(0, 3000, 300), rng.integers(50, 60, 300), rng.integers(0, 9, 300)
    snippets[2000:3000] = snippets[:1000]
    at[150:] = at[:150] % 1000 + 2000
    at[:150] %= 1000
    size[150:], reach[150:] = size[:150], reach[:150]
    ids = rng.permutation(300).astype(np.int64)
    order, edges, anchors = repeated_bytes.variants_of(ids, np.zeros(300, np.uint64), np.zeros(300, np.uint64), snippets, at, size, reach, 20)
    key = lambda i: (bytes(snippets[at[i] : at[i] + size[i]]), int(reach[i]))
    groups = np.split(order, edges[1:])
    assert len(groups) == len({key(i) for i in range(300)}) and all(len({key(i) for i in g}) == 1 and (np.diff(ids[g]) > 0).all() for g in groups)
    gram = lambda i: bytes(snippets[at[i] + reach[i] : at[i] + reach[i] + 20])
    assert all((anchors[i] == anchors[j]) == (gram(i) == gram(j)) for i in range(0, 300, 7) for j in range(300))


def test_repeated_ids_lose_no_text(spark):
    t = [f"a{i}" for i in range(60)]
    rows = [(3, " ".join(t)), (5, " ".join([*t, "more"])), (5, "something else altogether here"), (5, None), (7, ""), (7, "  "), (None, " ".join(t))]
    df = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc_id long, text string, __id int, __key int")
    got = near_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(repr, [rows[0], *rows[2:]]))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and {r["__key"] for r in kept.collect()} == {2}
    near = edited(__import__("random").Random(1), t, 1)
    two = spark.createDataFrame([(5, " ".join(t)), (5, near), (8, near)], "doc_id long, text string")
    assert near_dedup.drop_copies(two, shingle=2).count() == 1


def test_long_addresses():
    look = personal_data.Finder().spans
    zeros = "0" * 5000
    assert [k for k, *_ in look(f"{zeros}.0.1.{zeros}255 {zeros}1.{zeros}2.3.256 1.2.3.4")] == ["ip", "ip"]


@pytest.mark.parametrize("tag,value", [(tiff.TILE_WIDTH, 0), (tiff.TILE_LENGTH, 0), (tiff.WIDTH, 2**32 - 1), (tiff.LENGTH, 2**32 - 1), (tiff.WIDTH, 0), (tiff.SAMPLES, 0), (tiff.TILE_WIDTH, 2**31), (tiff.COMPRESSION, 7), (tiff.BITS, 12)])
def test_malformed_pages_are_rows(spark, tag, value):
    page = np.arange(48 * 40, dtype=np.uint8).reshape(48, 40)
    good = tiff.write([page], tiff.DEFLATE, tile=16)
    bad = bytearray(good)
    (at,) = struct.unpack_from("<I", bad, 4)
    for i in range(struct.unpack_from("<H", bad, at)[0]):
        if struct.unpack_from("<H", bad, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<HI" if tag != tiff.BITS else "<HI", bad, at + 4 + 12 * i, 4, 1)
            struct.pack_into("<I", bad, at + 10 + 12 * i, value)
    rows = spark.createDataFrame([("bad", bytes(bad)), ("good", good), ("cut", good[:60]), ("none", None), ("text", b"II*")], "id string, content binary")
    got = {r["id"]: r for r in tiff.pages(rows).collect()}
    assert len(got) == 5 and all(got[k]["error"] for k in ("bad", "cut", "none", "text")) and got["good"]["data"] == page.tobytes()


def test_coded_bytes_of_the_format_description():
    """Byte sequences made by hand: a run-length example, and LZW codes 256 7 258 8 8 258 6 6 257 of nine bits."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.unpackbits(packed, len(plain)) == plain
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    coded = bytes(int(bits.ljust(-len(bits) % 8 + len(bits), "0")[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert tiff.unlzw(coded, 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))


def test_large_sets_are_sketched_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 3, 700)]
    whole = near_dedup.registers(sets)
    monkeypatch.setattr(near_dedup, "PART", 100)
    assert (near_dedup.registers(sets) == whole).all()


def test_passages_with_few_bits_of_hash(spark):
    rows = passages(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in repeated_bytes.removed(df, bits=12).collect()) == bytes_expected(rows, 50)
    assert hashlib.sha256(b"").hexdigest() in {r["kept_sha256"] for r in repeated_bytes.removed(spark.createDataFrame([(1, None)], "doc_id long, text string"), bits=12).collect()}
