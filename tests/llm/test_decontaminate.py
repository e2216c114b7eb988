import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import decontaminate


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def expected(docs, items, window):
    told = [(i, plain_words(t)) for i, t in items]
    out = []
    for d, text in docs:
        w = plain_words(text)
        hit, found = [False] * len(w), set()
        for item, words in told:
            n = min(window, len(words))
            for a in range(len(words) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == words[a : a + n]:
                        hit[k : k + n] = [True] * n
                        found |= {item} - {None}
        listed = sorted(map(str, found))
        runs = "".join("x" if h else " " for h in hit).split()
        out.append(repr((d, len(w), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), any(hit), max(map(len, runs), default=0))))
    return sorted(out)


def rows(rng, n, words, length):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(length)))) for i in range(n)]


CASES = [("ab", 4, 60), ("abcdefgh", 3, 200), (["Ä", "b-c", "dd", "E", "f1"], 5, 120)]


@pytest.mark.parametrize("words,window,length", CASES)
def test_against_brute_force(spark, monkeypatch, words, window, length):
    """Small vocabularies make long repeats; blocks and pieces of few words make several passes."""
    rng = random.Random(window)
    docs = [*rows(rng, 40, words, length), (100, None), (101, ""), (102, "?!"), (None, " ".join(words) * 3), (3, "b " * 50), (3, "b " * 50)]
    items = [*rows(rng, 8, words, 30), (50, None), (51, ""), (52, "b"), (None, " ".join(words[:2])), (53, "unseen words only here"), (1, "a b"), (54, "b " * 12)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, items int, hits string").repartition(3)
    test = spark.createDataFrame(items, "item_id long, text string")
    want = expected(docs, items, window)
    got = decontaminate.overlaps(df, test, window=window)
    assert sorted(repr(tuple(r)[:7]) for r in got.collect()) == want
    left = decontaminate.decontaminated(df, test, window=window)
    assert left.columns == df.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(repr(x) for x in docs if "True" not in expected([x], items, window)[0])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    assert sorted(repr(tuple(r)[:7]) for r in decontaminate.overlaps(df, test, window=window).collect()) == want


def test_longest_matches(spark):
    rng = random.Random(9)
    docs, items = rows(rng, 30, "abc", 80), rows(rng, 4, "abc", 40)
    want = []
    for item, text in items:
        w = plain_words(text)
        for a in range(len(w)):
            best = None
            for d, other in docs:
                o = plain_words(other)
                for k in range(len(o)):
                    n = 0
                    while a + n < len(w) and k + n < len(o) and w[a + n] == o[k + n]:
                        n += 1
                    if n >= 5 and (best is None or (-n, d, k) < best):
                        best = (-n, d, k)
            if best:
                want.append((str(item), a, -best[0], best[1], best[2]))
    got = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), least=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("most", [1, 2, 3, 5000])
def test_suffixes_are_sorted(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 2, 50, 400):
        seq = rng.integers(0, most + 1, n)
        if n == 400:
            seq = np.tile(seq[:40], 10)
        at, padded = decontaminate.suffixes(seq, most, 1000)
        told = [padded[p : p + np.flatnonzero(padded[p:] == 0)[0]].tolist() for p in at]
        assert sorted(at.tolist()) == np.flatnonzero(seq).tolist() and told == sorted(told)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, item_id long, text string"), spark.createDataFrame([(1, 1, "some words")], "doc_id long, item_id long, text string")
    assert decontaminate.overlaps(none, some).collect() == [] and decontaminate.longest_matches(some, none).collect() == []
    assert [r["contaminated"] for r in decontaminate.overlaps(some, none).collect()] == [False]
    assert decontaminate.decontaminated(some, none).count() == 1 and decontaminate.decontaminated(some, some).count() == 0


def test_query(spark, sf, agree):
    agree(decontaminate.op12_suffix_decontamination(spark, sf), decontaminate.OP12_SQL)
