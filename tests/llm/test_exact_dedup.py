import hashlib
import re

import pytest

from shelfmark.llm import exact_dedup

ROWS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "x" * 10000), (6, "x" * 10000), (7, "x" * 9999 + "y"), (8, " "), (None, "a\tb"), (9, "é" * 5000), (9, "é" * 5000), (10, "x" * 4096), (11, "x" * 8192), (12, "\n\x0b ")]


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), t in zip(rows, norm, strict=True):
        ids = [e for (e, _), u in zip(rows, norm, strict=True) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block,bits", [(4096, 64), (3, 64), (64, 2)])
def test_against_comparison(spark, block, bits):
    """Blocks of any size, and digests so short that nearly all of them collide, give the same."""
    rows = ROWS if block > 3 else [(d, t if t is None else t[:60]) for d, t in ROWS]
    df = spark.createDataFrame([(d, t, "en", 1, "z") for d, t in rows], "doc_id long, text string, lang string, name int, block string").repartition(3)
    assert sorted(repr(tuple(r)) for r in exact_dedup.dedup(df, block=block, digest_bits=bits).collect()) == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup(df).collect() == []
    assert exact_dedup.drop_copies(df).collect() == []


def test_stage_keeps_one_of_each(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, name int")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5, 7, 8, 9, 10, 11]


def test_query(spark, sf, agree):
    agree(exact_dedup.op4_block_naming_dedup(spark, sf), exact_dedup.OP4_SQL)


def test_no_python_in_the_plan(spark, sf):
    plan = exact_dedup.op4_block_naming_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map)|MapIn", plan)
