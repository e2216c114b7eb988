import collections
import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import repeated_bytes, repeated_words, sketch
from shelfmark.llm.suffix_groups import suffix_array, suffix_arrays

WORDS = [(1, None), (2, ""), (3, "a " * 100), (4, "a b " * 60), (None, "x y z " * 30), (4, "q"), (5, "p\x1cq r\x0bs " * 40), (6, "one two three"), (7, "p\x1cq r\x0bs " * 40)]


def words_expected(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("width,bits", [(35, 20), (4, 20), (35, 9)])
def test_words_against_counting(spark, sf, width, bits):
    """A full sketch loses nothing: it only lets more windows through to the exact pass."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()] + WORDS
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, row int").repartition(5)
    got = repeated_words.removed(df, "doc_id", "text", window=width, bits=bits)
    assert sorted(repr(tuple(r)) for r in got.collect()) == words_expected(rows, width)


def test_words_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in repeated_words.op2_count_min_windows(spark, sf).collect()) == words_expected(rows, 35)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words.removed(df, bits=12).collect() == [] and repeated_bytes.removed(df, bits=12).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "u v " + "a b c " * 3), (2, "w " + "a b c " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in repeated_words.removed(df, window=5, bits=12, kept_text=True).collect()}
    assert got == {1: "u v", 2: "w"}


def bytes_expected(rows, width):
    least, most = {}, 2**63 - 1
    texts = [(most if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - width + 1):
            least[b[i : i + width]] = min(d, least.get(b[i : i + width], most))
    out = []
    for (d0, _), (d, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d0, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def passages(n):
    rng = random.Random(n)
    base = "".join(rng.choices("abcdefgh ", k=300))
    out = []
    for i in range(n):
        t = list(base[rng.randrange(200) :])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        out.append((1000 + i, "".join(rng.choices("mnop", k=rng.randrange(30))) + "".join(t)))
    return out


def test_bytes_against_counting(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "a" * 300), (903, "ab" * 200), (None, "xyz " * 30), (903, "q"), (904, rows[3][1]), (905, "a" * 70), (906, "xyz " * 40), (907, "é" * 60), (908, "é" * 60), *passages(150)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kind string").repartition(5)
    assert sorted(repr(tuple(r)) for r in repeated_bytes.removed(df, bits=20).collect()) == bytes_expected(rows, 50)


def test_bytes_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in repeated_bytes.op10_linear_suffix_groups(spark, sf).collect()) == bytes_expected(rows, 50)


@pytest.mark.parametrize("most", [64, 3])
def test_many_snippets_of_one_anchor_are_split(most, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "MOST", most)
    rng = np.random.default_rng(most)
    width, gram = 50, 20
    snippets, reach, span = [], [], []
    for _ in range(40):
        r, s = int(rng.integers(0, 31)), 0
        s = int(rng.integers(0, r + 1))
        text = np.concatenate([rng.integers(97, 99, r), np.full(gram, 103), rng.integers(97, 99, width + s - r - gram)]).astype(np.uint8)
        if rng.random() < 0.7 and snippets:  # share most of another one's bytes around the anchor
            other, o = snippets[-1], reach[-1]
            for k in range(-min(r, o), min(len(text) - r, len(other) - o)):
                text[r + k] = other[o + k]
        snippets.append(text)
        reach.append(r)
        span.append(s)
    doc = rng.permutation(40).astype(np.int64)
    offset = np.concatenate(([0], np.cumsum([len(s) for s in snippets])[:-1]))
    first, best = repeated_bytes.smallest_documents(np.concatenate(snippets), offset, np.array(reach), np.array(span), doc, np.zeros(40, np.int64), width, gram)
    least = {}
    for t, s, d in zip(snippets, span, doc.tolist(), strict=True):
        for k in range(s + 1):
            w = t[k : k + width].tobytes()
            least[w] = min(d, least.get(w, d))
    assert best.tolist() == [least[t[k : k + width].tobytes()] for t, s in zip(snippets, span, strict=True) for k in range(s + 1)]
    assert first[-1] == len(best)


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        strings = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)) for _ in range(rng.integers(1, 20))]
        lengths = np.array([len(s) for s in strings])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        want = [sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist()) for s in strings]
        assert suffix_arrays(np.concatenate(strings), starts, lengths).tolist() == [i for w in want for i in w]
    assert suffix_array(np.frombuffer(b"abracadabra" * 9, np.uint8)).tolist() == sorted(range(99), key=lambda i: (b"abracadabra" * 9)[i:])


def test_anchors_are_at_equal_distances():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 3, 3000).astype(np.uint64)
    grams = np.zeros(3000, np.uint64)
    grams[:-4] = sum(symbols[k : k - 4 or None][: 2996] * np.uint64(3**k) for k in range(4))
    grams = grams * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(3000 - 12 + 1 - 4)
    where = sketch.anchors(grams, at, 12, 4)
    seen = {}
    for i, w in zip(at.tolist(), where.tolist(), strict=True):
        assert seen.setdefault(symbols[i : i + 12].tobytes(), w - i) == w - i


def with_checksum(base: bytes, target: int) -> bytes:
    """base with some of its letters a turned to b, so that its CRC-32 is the target's (elimination over bits)."""
    import zlib

    plain, rows = zlib.crc32(base), []
    for i in range(len(base)):
        change, mask = zlib.crc32(base[:i] + b"b" + base[i + 1 :]) ^ plain, 1 << i
        for value, m in rows:
            if change ^ value < change:
                change, mask = change ^ value, mask ^ m
        if change:
            rows.append((change, mask))
            rows.sort(reverse=True)
    want, mask = plain ^ target, 0
    for value, m in rows:
        if want ^ value < want:
            want, mask = want ^ value, mask ^ m
    assert not want
    return bytes(98 if mask >> i & 1 else 97 for i in range(len(base)))


def test_rows_of_one_id_and_checksum(spark):
    """Two different texts that share an id and a CRC-32 are told apart, whatever their lengths."""
    import zlib

    passage = "".join(random.Random(6).choices("cdefgh ", k=300))
    for size in (60, 400):
        other = with_checksum(b"a" * size, zlib.crc32((passage + " and more").encode())).decode()
        rows = [(1, passage), (2, passage + " and more"), (2, other), (2, other)]
        assert zlib.crc32(rows[1][1].encode()) == zlib.crc32(other.encode())
        got = repeated_bytes.removed(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got.collect()) == sorted([(1, 300, 0), (2, 309, 300), (2, size, 0), (2, size, 0)])
