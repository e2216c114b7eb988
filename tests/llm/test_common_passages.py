"""Passages that are shorter than a window, in many surroundings, make no task large and change no result."""

import random

import numpy as np
from test_repeated import bytes_expected, words_expected

from shelfmark.llm import repeated_bytes, repeated_words


def surrounded(n, passage, size, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(i, " ".join([*(word() for _ in range(size)), *passage, *(word() for _ in range(size))])) for i in range(n)]
    return rows + [(n + i, t) for i, (_, t) in enumerate(rows[: n // 5])]


def test_large_buckets_are_cut_by_windows(spark):
    entries = []
    for k in range(20):
        a = np.arange(100, dtype=np.uint64) * np.uint64(7919)
        entries.append((3, 100, repeated_words._pack(a, a, np.full(100, k), np.arange(100), np.zeros(100))))
    entries.append((4, 1, repeated_words._pack(*[np.ones(1)] * 5)))
    df = spark.createDataFrame(entries, "bucket int, n int, packed binary")
    got = {}
    for r in repeated_words.dealt(df, 500, 100).collect():
        for a in repeated_words._unpack(r["packed"])[0].tolist():
            got.setdefault((r["bucket"], a), []).append(r["part"])
    assert len({p for (b, _), parts in got.items() if b == 3 for p in parts}) == 20
    assert all(len(set(parts)) == 1 for parts in got.values())
    sizes = np.bincount([p for (b, _), parts in got.items() if b == 3 for p in parts])
    assert sizes.sum() == 2000 and sizes.max() <= 500
    assert [parts for (b, _), parts in got.items() if b == 4] == [[0]]


def test_common_passage_against_counting(spark):
    rows = surrounded(60, [f"w{i}" for i in range(9)], 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = repeated_words.removed(df, window=12, bits=16, most=40)
    assert sorted(repr(tuple(r)) for r in got.collect()) == words_expected(rows, 12)


def test_common_anchors_are_found(spark):
    df = spark.createDataFrame(surrounded(60, ["a phrase of some thirty bytes!"], 12), "doc_id long, text string")
    assert 1 <= len(repeated_bytes.common_anchors(df, 50, 20, 40)) <= 12
    assert len(repeated_bytes.common_anchors(df, 50, 20, 400)) == 0


def test_common_phrase_is_dealt_by_windows(spark):
    rows = surrounded(60, ["a phrase of some thirty bytes!"], 12)
    rows += [(100 + i, f"{t[:90]} y {t[60:]}") for i, t in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for most in (40, 2, 100_000):
        got = repeated_bytes.removed(df, bits=16, most=most)
        assert sorted(repr(tuple(r)) for r in got.collect()) == bytes_expected(rows, 50)
