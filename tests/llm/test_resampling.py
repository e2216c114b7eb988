import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from shelfmark.llm import byte_automaton, resampling

ALPHABET = "aAbZ 9.é\x00ß-z日\n"


def plain_words(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(6)] + ["a" * rng.choice([63, 64, 65, 200])]
        parts = [t.encode() for t in texts]
        off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        low, starts, ends, word_off = byte_automaton.words(np.frombuffer(b"".join(parts), np.uint8), off)
        want = [plain_words(t) for t in texts]
        assert [[low[starts[i] : ends[i]].tobytes() for i in range(word_off[k], word_off[k + 1])] for k in range(len(texts))] == want
        for k, crc in enumerate(byte_automaton.run_crcs(low, starts, ends, word_off, 3), 1):
            assert crc.tolist() == [zlib.crc32(b" ".join(w[i : i + k])) for w in want for i in range(len(w) - k + 1)]


def expected(docs, target, buckets, longest, percent, least, seed):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in docs:
        np.add.at(s, features(text), 1)
    for text in target:
        np.add.at(t, features(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    fine = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {id(r): k for k, r in enumerate(fine[: len(fine) * percent // 100], 1)}
    return sorted(repr((*r[:4], ranks.get(id(r)))) for r in rows)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 17)])
def test_against_brute_force(spark, longest, buckets):
    rng = random.Random(longest)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "gamma-delta", "日本"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " .\n"), (203, "w" * 100_000 + " tail " * 25), (None, "null id " * 30), (3, "a repeated id " * 20)]
    target = ["alpha beta été", None, "beta beta 日本"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, aim, buckets=buckets, longest=longest, percent=30)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(docs, target, buckets, longest, 30, resampling.LEAST_WORDS, "2024")
    ids = {r["doc_id"] for r in got.collect() if r["rank"] is not None}
    left = resampling.drawn(df, aim, buckets=buckets, longest=longest, percent=30)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == ids


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "word " * 20)] * 10, "doc_id long, text string")
    assert resampling.resampled(none, some).collect() == []
    got = resampling.resampled(some, none)  # ten rows of one id: one of them is drawn
    assert [r["rank"] for r in got.collect()].count(1) == 1 and got.count() == 10


def test_query(spark, sf, agree):
    agree(resampling.op13_target_resampling(spark, sf), resampling.OP13_SQL)
