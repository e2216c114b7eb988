from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import params
from shelfmark.functions import scalars as S
from shelfmark.functions.media import perceptual_hash, tile_hash


def values(spark, fn, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("v")).collect()]


def test_limits():
    assert [params.page_limit(n, 50, 500) for n in (None, 0, -3, 7, 9999)] == [50, 50, 1, 7, 500]
    assert [params.candidate_limit(n, 64, 2000) for n in (None, 0, -3, 7, 9999)] == [64, 64, 64, 7, 2000]
    assert [params.bins(n) for n in (None, 1, 20, 99)] == [20, 4, 20, 50]
    assert params.total_pages(0, 50) == 1 and params.total_pages(0, 50, 0) == 0 and params.total_pages(101, 50) == 3
    assert params.has_more(0, 50, 51) and not params.has_more(1, 50, 51)


def test_human_bytes(spark):
    assert values(spark, S.human_bytes, [0, 1023, 1024, 1536, 1048576, 1024**3 * 5 // 2, 1024**5 * 3], "long") == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "2.5 GB", "3072 TB"]


def test_human_bytes_rounds_halves_to_even(spark, duck):
    """Exact halves of a hundredth, what is just beside them, and what rounds up to a whole unit, against printf of the other engine."""
    sizes = [k * 1024**p + d * 1024**p // 1024 + e for p in (1, 2, 3) for k in (1, 2, 77, 1023) for d in (128, 384, 640, 896, 1023) for e in (-1, 0, 1)]
    want = [duck.execute(f"SELECT rtrim(rtrim(printf('%.2f', {n} / {1024**p}e0), '0'), '.')").fetchone()[0] + unit for n in sizes for p, unit in [next((p, u) for p, u in ((1, " KB"), (2, " MB"), (3, " GB")) if n < 1024 ** (p + 1))]]
    assert values(spark, S.human_bytes, sizes, "long") == want
    assert values(spark, S.human_bytes, [1152, None], "long") == ["1.12 KB", None]


def test_parse_size(spark):
    assert values(spark, S.parse_size, ["10", "1.5 KB", "2g", "1 TB", "3b", "", "x", "-1", "1.2.3 MB", None]) == [10, 1536, 2 * 1024**3, 1024**4, 3, 0, 0, 0, 0, 0]


def test_versions(spark):
    rows = spark.createDataFrame([("2.10.0", "2.9.9"), ("v1.0", "1.0.0"), ("1.2.3-rc1", "1.2.3"), ("x", "0.0.1")], "a string, b string")
    assert [r[0] for r in rows.select(S.version_newer(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_message_links(spark):
    links = {
        "https://t.me/some_channel/12": ("@some_channel", 12, None),
        "t.me/c/123/5/9": ("-1000000000123", 9, 5),
        "https://T.ME/s/name_x/7?thread=3": ("@name_x", 7, 3),
        "tg://resolve?domain=abcd&post=4": ("@abcd", 4, None),
        "tg://privatepost?channel=77&post=4&thread=2": ("-1000000000077", 4, 2),
        "https://t.me/name_x": None,
        "https://t.me/name_x/0": None,
        "https://example.com/name/5": None,
        "https://t.me/name_x/3/9?thread=4": None,
        "https://t.me/name_x/9?comment=4": None,
        "tg://resolve?domain=abcd&domain=efgh&post=4": None,
        "": None,
    }
    got = values(spark, S.message_link, list(links))
    assert [None if g is None else tuple(g) for g in got] == list(links.values())


def test_chat_queries(spark):
    texts = {"@a": "username", "-100123": "id", "News": "name", "t.me/news": "username", "https://www.t.me/joinchat/x": "invite", "t.me/+abc": "invite", "t.me/+123": "unsupported", "t.me/c/1/2": "message", "t.me/c/x/2": "unsupported", "t.me/news/4": "message", "t.me/addstickers/x": "unsupported", "t.me/": "unsupported"}
    assert values(spark, S.chat_query_kind, list(texts)) == list(texts.values())


def test_paths(spark):
    assert values(spark, S.path_safe, ["a/b:c", "", None, "x\x01y"]) == ["a_b_c", "unknown", "unknown", "x_y"]
    assert values(spark, S.extension, ["a/b.TXT", "a.b/c", "c."]) == [".txt", "", "."]
    assert values(spark, S.file_type, ["g/stickers/x.bin", "g/gifs/x", "g/o/x.WEBM", "g/o/x.mp3", "g/o/x.zip", "x"]) == ["photo", "video", "video", "audio", "document", "photo"]


def test_prefix_search(spark):
    assert S.prefix_terms("it's  \"Big\" a_b") == ["its", "big", "a", "b"]
    rows = spark.createDataFrame([("Hello_World.txt", None), ("other", "hello there"), (None, None)], "a string, b string")
    found = rows.select(S.matches_prefixes(["hel", "wo"], F.col("a"), F.col("b")), S.matches_prefixes(["hel"], F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == [(True, True), (False, True), (False, False)]


def test_escaped_substring(spark):
    rows = ["100%_a\\b", "100xya", "É100%", None]
    assert values(spark, lambda c: S.contains_folded(c, "0%_A\\"), rows) == [True, False, False, None]


def test_time(spark):
    assert values(spark, S.millis, ["1700000000123", "2024-01-01T00:00:00Z", "2024-01-01 00:00:01", "junk", None, ""]) == [1700000000123, 1704067200000, 1704067201000, 0, 0, 0]
    assert values(spark, S.history_bound, ["", "12", "1704067200000", "2024-01-01", "-5", "9999999999", "soon"]) == [0, 12, 1704067200, 1704067200, None, None, None]
    hours = spark.createDataFrame([(None,), (0,), (5,), (9999,)], "h int")
    assert [r[0] // 3_600_000 for r in hours.select(S.retention_deadline(F.lit(0), F.col("h"))).collect()] == [48, 1, 5, 720]


@pytest.mark.parametrize("expression,due", [("* * * * *", True), ("30 12 15 6 *", True), ("*/7 * * * *", False), ("0-40/10 * * * *", True), ("30 12 1 * 6", True), ("30 12 1 * 0", False), ("30 12 * * 6", True)])
def test_cron(spark, expression, due):
    at = spark.createDataFrame([(datetime(2024, 6, 15, 12, 30),)], "t timestamp")  # a Saturday
    assert at.select(S.cron_matches(expression, F.col("t"))).first()[0] is due


@pytest.mark.parametrize("bad", ["* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *"])
def test_cron_refuses(spark, bad):
    with pytest.raises(ValueError):
        S.cron_matches(bad, F.lit(None).cast("timestamp"))


def test_hamming(spark):
    rows = spark.createDataFrame([("ff00", "0f00"), ("f" * 64, "0" * 64), ("abc", "abd"), ("ff", "ffff"), ("zz", "00"), (None, "00")], "a string, b string")
    assert [r[0] for r in rows.select(S.hamming_hex(F.col("a"), F.col("b"))).collect()] == [4, 256, -1, -1, -1, -1]


def test_durations(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (100.0, 91.0), (100.0, 80.0)], "a double, b double")
    assert [r[0] for r in rows.select(S.durations_within(F.col("a"), F.col("b"), 0.1)).collect()] == [True, True, False]


def test_sprites(spark):
    got = values(spark, lambda c: S.sprite_plan(c), [4.0, 60.0, 7200.0, 99999.0], "double")
    assert [(p["frames"], p["row_count"]) for p in got] == [(8, 1), (60, 6), (600, 60), (720, 72)]


def test_vectors_and_means(spark):
    assert values(spark, S.l2_normalised, [[3.0, 4.0], [0.0, 0.0]], "array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, S.top_mean, [[1.0, 5.0, 3.0, 4.0], [2.0], []], "array<double>") == [4.0, 2.0, None]


def test_json_set(spark):
    assert values(spark, lambda c: S.json_set(c, "a", F.lit("9")), ['{"a":"1","b":"2"}', "{}"]) == ['{"b":"2","a":"9"}', '{"a":"9"}']


def test_perceptual_hash(spark):
    tile = bytes((x * y * 7 + x) % 256 for y in range(64) for x in range(64) for _ in range(3))
    h = perceptual_hash(tile, 64)
    assert len(h) == 64 and 100 <= bin(int(h, 16)).count("1") <= 128
    brighter = bytes(min(255, b // 2 + 60) for b in tile)
    assert bin(int(h, 16) ^ int(perceptual_hash(brighter, 64), 16)).count("1") <= 16
    assert len(perceptual_hash(tile[:300], 10)) == 64 and len(perceptual_hash(b"", 64)) == 64
    rows = spark.createDataFrame([(tile, 64), (None, 64)], "t binary, s int")
    assert [r[0] for r in rows.select(tile_hash(F.col("t"), F.col("s"))).collect()] == [h, None]
