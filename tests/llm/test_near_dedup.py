import random
import re

import numpy as np
import pytest

from shelfmark.llm import near_dedup as N


def expected(rows, size, least=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= least * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return sorted((d, len(sets[i]), rows[root(i)][0], rows[root(i)][0] == d) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size):
    """A chain of edits, a large group of independent edits, copies, short, empty and null texts."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = [None, "", "one", "One", "one two", "\t\n"]
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 6).split()
        texts.append(" ".join(chain))
    texts += [edited(rng, base, rng.randrange(1, 12)) for _ in range(60)]
    texts += [" ".join(base)] * 5
    texts += [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(2, 90))) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, rep long, bucket string").repartition(4)
    assert sorted(tuple(r) for r in N.link(df, shingle=size).collect()) == expected(rows, size)


def test_query_against_all_pairs(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in N.op6_setsketch_near_dedup(spark, sf).collect()) == expected(rows, 2)


def test_blocks_find_what_pivots_miss(spark):
    """In one bucket: links of members that aren't like the pivot are found in blocks."""
    rng = random.Random(9)
    a = [f"a{i}" for i in range(120)]
    far = a[:84] + [f"b{i}" for i in range(36)]
    rows = list(enumerate([" ".join(a)] + [edited(rng, far, 2) for _ in range(20)] + [edited(rng, a, 3) for _ in range(20)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in N.link(df, shingle=2).collect()) == expected(rows, 2)


def template(rng, n, common=100, own=20, near=0):
    """n texts of one template, each with words of its own among the common ones; `near` of them twice, with a word changed."""
    base, out = [f"t{i}" for i in range(common)], []
    for k in range(n):
        words = list(base)
        for _ in range(own):
            words.insert(rng.randrange(len(words) + 1), f"o{rng.randrange(10**9)}")
        out.append(" ".join(words))
        if k < near:
            out.append(edited(rng, words, 1))
    return out


def test_template_texts(spark):
    """Texts just under the threshold share buckets; the near copies among them are found, the others are left alone."""
    rng = random.Random(4)
    texts = template(rng, 150, own=12, near=12) + template(rng, 60, common=90, own=9)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in N.link(df, shingle=2).collect())
    assert got == expected(rows, 2) and sum(not kept for *_, kept in got) >= 12


def compared(texts):
    sets = [s for t in texts for s in N.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 2)]
    every = np.arange(len(sets))
    return sum(len(at) - 1 for _, at in N.candidates(N.Overlaps(sets), every, every, 80))


def test_comparisons_of_template_texts_are_linear():
    """Doubling the texts of a template doubles the comparisons at most (all pairs: four times), and near copies are compared."""
    for own in (20, 28):
        counts = [compared(template(random.Random(5), n, own=own, near=n // 10)) for n in (500, 1000, 2000)]
        assert all(c <= 4 * n for c, n in zip(counts, (500, 1000, 2000), strict=True)) and counts[0] >= 2 * 50
        assert all(y <= 2.2 * x for x, y in zip(counts, counts[1:], strict=False))


def test_candidates_lose_no_similar_pair():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.1], s[:1])) for s in sets]
    every = np.arange(len(sets))
    found = {(i, int(r)) for i, at in N.candidates(N.Overlaps(sets), every, every, 80) for r in at}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            shared = len(np.intersect1d(s, t))
            assert 100 * shared < 80 * (len(s) + len(t) - shared) or (i, j) in found


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "q r s"), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in N.link(df, shingle=2).collect())))
    assert got == sorted(map(repr, [(None, 2, 4, False), (4, 2, 4, True), (None, 2, None, True), (None, 0, None, True)]))
    assert N.link(df.limit(0)).collect() == []
    assert N.drop_copies(df).count() == 4


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for n, j in ((30, 0.5), (800, 0.8), (5000, 0.95)):
        k = round(2 * n * j / (1 + j))
        u = rng.integers(0, 2**64, 2 * n - k, dtype=np.uint64)
        a, b = u[:n], u[n - k :]
        both = N.registers([a, b, u])
        assert (np.maximum(both[0], both[1]) == both[2]).all()
        estimate, lost = N.likelihood(both[:1], both[1:2], np.array([float(n)]), np.array([float(n)]), 0.8)
        assert abs(estimate[0] - k / (2 * n - k)) < 0.12
        assert (lost[0] > N.MARGIN) == (j < 0.6)
