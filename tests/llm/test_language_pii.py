import hashlib
import random
import re
import zlib

import numpy as np

from shelfmark.llm import language as L
from shelfmark.llm import personal_data as P


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.op1_crf_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95


def model():
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(60))
    return L.train([(make(["the", "ing", "wh"]), "en") if i % 2 else (make(["qué", "ción", "ado"]), "es") for i in range(60)], size=1 << 12)


def test_code_switched_words():
    got = L.label_words(model(), "thewh ingthe whing wh the quéado ciónado ado queción qué thewh ingwh")
    assert [lab for _, lab, _ in got[:4]] == ["en"] * 4 and [lab for _, lab, _ in got[6:9]] == ["es"] * 3
    assert all(0 <= p <= 1.0001 for *_, p in got)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    want, total = np.zeros((5, 3)), 0.0
    for k in range(3**5):
        path = [k // 3**i % 3 for i in range(5)]
        p = np.exp(sum(scores[i, a] for i, a in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for i, a in enumerate(path):
            want[i, a] += p
    at, p, _, _ = L.forward_backward(scores, moves, np.array([0]), np.array([5]))
    assert np.allclose(p[np.argsort(at)], want / total, atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 | 45", "es"), (4, "the whing " * 3000, None), (4, "x", "en"), (None, "qué", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.predict(df, model()).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got if r["doc_id"] in (1, 2, 3)) == [("1", "und"), ("2", "und"), ("3", "und")]
    assert len(got) == 6 and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in L.predict(df, None).collect()} == {"und"}
    assert L.fit(df.limit(0)) is None and L.predict(df.limit(0), model()).collect() == []
    kept = L.keep_known(df, model())
    assert kept.columns == df.columns and kept.count() == 3


def test_many_labels_take_fixed_room(spark):
    """Of 3,000 labels the most frequent are taught; the model has no more weights than it may have, and others' rows teach nothing."""
    rows = [(3 * i + k, f"word{i % 40} thing{i} text", f"l{i % 40:02}" if i < 400 else f"rare{i}") for i in range(3400) for k in range(1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.fit(df, most_labels=40)
    assert got.labels == [f"l{i:02}" for i in range(40)] and got.weights.size <= L.CELLS and got.moves.shape == (40, 40)
    assert len(L.fit(df, sample=7).labels) == 7
    assert L.fit(df.drop("lang")) is None


def test_parts_of_a_batch_agree_with_the_whole(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["the", "whing", "qué", "ciónado", "12", "ing"], k=rng.randrange(0, 700))) for _ in range(12)] + ["the", None, "|| the"]
    whole = L.label_texts(model(), texts)
    monkeypatch.setattr(L, "AT_ONCE", 1)
    parts = L.label_texts(model(), texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=2e-6)


def test_label_column_of_another_type(spark):
    df = spark.createDataFrame([(1, "the whing the", 5), (2, "12", 6)], "doc_id long, text string, lang int")
    assert [tuple(r) for r in L.keep_known(df, model()).collect()] == [(1, "the whing the", 5)]


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return [(P.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_spans_against_expressions():
    rng = random.Random(5)
    parts = ["@", "a.b", "x", "1", "12", "255", "256", ".", "-", "+", "+4", " ", "(", ")", "é", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "a@b.c", "@@", "1.2.3.4", "0001", "http://", "account ", " ", "\n", "٣"]
    find = P.finder().spans
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert [s for s in find(text) if s[0] in P.BASE] == brute(text), text


def test_added_kinds():
    found = P.finder().spans("see https://a.example/x?y=1. IBAN: DE89 3704 0044 0532 0130 00, Account no. 12345678; account of note")
    assert [k for k, _, _ in found] == ["url", "account", "account"]


def test_query_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.op9_anchor_expansion(spark, sf).collect():
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(b[0] == k for b in base) for k in P.BASE]
    df = spark.createDataFrame([(1, None, 3, "s"), (1, "", 0, "s"), (None, "mail a@b.co now", 15, "s"), (2, "1" * 200_000, 200_000, "s")], "doc_id long, text string, n_chars long, spans string")
    got = P.find(df).collect()
    assert sorted((str(r["doc_id"]), r["n_email"]) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("None", 1)]
    clean = P.redact(df)
    assert clean.columns == df.columns
    assert sorted(map(str, ((r["text"], r["n_chars"]) for r in clean.filter("doc_id IS NULL OR doc_id = 1").collect()))) == ["('', 0)", "('mail [EMAIL] now', 16)", "(None, 3)"]
    assert P.redact(df.limit(0)).collect() == []


def test_overlapping_spans_are_masked_once():
    assert P.masked("ab 1.2.3.4 cd", [("ip", 3, 10), ("card", 5, 12)]) == "ab [IP]d"
