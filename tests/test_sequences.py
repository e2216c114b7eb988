import random
import time

import numpy as np

from shelfmark.operators import frames as R
from shelfmark.operators import sequences as Q
from shelfmark.sources.scratch import written


def frames(hashes, step=10.0):
    return [(i * step, h) for i, h in enumerate(hashes)]


def test_identical_sequences():
    a = frames(["0000", "00ff", "ff00", "ffff"])
    got = Q.align(a, a, 2)
    assert (got["score"], got["matched"], got["coverage_a"], got["mean_hamming"]) == (8.0, 4, 1.0, 0.0)


def test_clip_in_parent():
    parent = frames(["1111", "2222", "0000", "00ff", "ff00", "ffff", "3333", "4444"])
    clip = frames(["0000", "00ff", "ff00", "ffff"])
    got = Q.align(clip, parent, 1)
    assert (got["coverage_a"], got["coverage_b"], got["offset_b"], got["start_a"]) == (1.0, 0.5, 20.0, 0)


def test_gap_and_mismatch():
    got = Q.align(frames(["00", "0f", "ff", "f0"]), frames(["00", "0f", "55", "ff", "f0"]), 0)
    assert got["matched"] == 4 and got["score"] == 7.0 and got["aligned"] == 4


def test_unequal_hashes():
    got = Q.align(frames(["zz", "00"]), frames(["zz", "00"]), 5)
    assert got["matched"] == 1
    assert Q.align([], frames(["00"]), 5)["score"] == 0.0 and Q.align(frames(["ff"]), frames(["00"]), 1)["score"] == 0.0


def test_equal_ends_take_the_later():
    got = Q.align(frames(["00"]), frames(["00", "ff", "00"]), 0)
    assert got["start_b"] == 2


def test_near_duplicates_and_clips(spark):
    cfg = Q.SimilarConfig(threshold=2, frame_threshold=2, tolerance=0.1, gate=64)
    base = ["0000", "00ff", "ff00", "ffff", "0f0f", "f0f0", "3333", "cccc"]
    sets = {1: base, 2: ["0001", *base[1:]], 3: base[2:6], 4: ["aaaa"] * 8}
    f = spark.createDataFrame([(v, t, h) for v, hs in sets.items() for t, h in frames(hs)], "id long, t_sec double, phash string")
    v = spark.createDataFrame([(1, 80.0, "a", 100, None, 8), (2, 81.0, "b", 200, None, 8), (3, 40.0, "c", 50, None, 4), (4, 80.0, "d", 10, None, 8)], "id long, duration_sec double, file_hash string, file_size long, aggregate_hash string, frame_count long")
    similar = Q.similar_videos(v, f, cfg).collect()
    assert [(r["keep"], r["remove"]) for r in similar] == [(2, 1)]
    clips = Q.partial_clips(v, f, cfg).collect()
    assert sorted((r["keep"], r["remove"], r["kind"], r["offset_sec"]) for r in clips) == [(1, 3, "partial", 20.0), (2, 3, "partial", 20.0)]
    ignored = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert Q.similar_videos(v, f, cfg, ignored).count() == 0
    assert Q.similar_videos(v.limit(0), f, cfg).count() == 0


def test_review_takes_one(spark):
    cfg = Q.SimilarConfig(frame_threshold=0, short_ratio=0.9, clip_ratio=0.9, review_ratio=0.5, review_frames=3)
    base = ["00", "01", "02", "03", "04", "05", "06", "07"]
    sets = {1: base, 2: base, 3: ["00", "01", "02", "f1", "f2"]}
    f = spark.createDataFrame([(v, t, h) for v, hs in sets.items() for t, h in frames(hs)], "id long, t_sec double, phash string")
    v = spark.createDataFrame([(1, 80.0, "a", 100, None, 8), (2, 300.0, "b", 200, None, 8), (3, 50.0, "c", 50, None, 5)], "id long, duration_sec double, file_hash string, file_size long, aggregate_hash string, frame_count long")
    got = Q.partial_clips(v, f, cfg).filter("remove = 3").collect()
    assert [(r["keep"], r["role"], r["kind"]) for r in got] == [(1, "review", "partial_review")]


def test_configuration_precedence():
    cfg = Q.SimilarConfig.load({"SIMILAR_THRESHOLD": "31", "SIMILAR_BUCKET": "x"}, {"threshold": 5, "bucket": 60, "coverage": "0.9"})
    assert (cfg.threshold, cfg.bucket, cfg.coverage, cfg.tolerance) == (31.0, 60, 0.9, 0.1)
    assert cfg.key() != Q.SimilarConfig().key() and isinstance(cfg.bucket, int)


def cell_by_cell(a, b, threshold):
    """The alignment as it is usually written: one cell after another."""
    far = [[bits(p, q) for _, q in b] for _, p in a]
    n, m = len(a), len(b)
    score, came = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (score[i - 1][j - 1] + (2 if far[i - 1][j - 1] <= threshold else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            top = max(options)
            if top > 0:
                score[i][j], came[i][j] = top, 1 + options.index(top)
                if top > best or (top == best and i + j > sum(at)):
                    best, at = top, (i, j)
    pairs, (i, j) = [], at
    while i and j and came[i][j]:
        step = came[i][j]
        if step == 1:
            pairs.insert(0, (i - 1, j - 1))
        i, j = i - (step != 3), j - (step != 2)
    if not pairs:
        return R.NONE
    gaps = [far[i][j] for i, j in pairs]
    hit, (sa, sb) = sum(d <= threshold for d in gaps), pairs[0]
    return {"score": float(best), "matched": hit, "aligned": len(pairs), "mean_hamming": sum(gaps) / len(gaps), "coverage_a": hit / n, "coverage_b": hit / m, "coverage_short": hit / min(n, m), "start_a": sa, "start_b": sb, "offset_a": a[sa][0], "offset_b": b[sb][0]}


def bits(p, q):
    try:
        x, y = bytes.fromhex(p or "x"), bytes.fromhex(q or "x")
    except ValueError:
        return float("inf")
    return sum(bin(u ^ v).count("1") for u, v in zip(x, y, strict=False))


def some_frames(rng, n, pool):
    return [(10.0 * i, rng.choice(pool)) for i in range(n)]


def test_wavefront_against_cells(monkeypatch):
    rng = random.Random(4)
    pools = [["00", "01", "ff", "f0"], ["00ff", "00fe", "1234", "ff"], ["0" * 64, "f" * 64, "0" * 63 + "1"], ["zz", "00", None, "0f", "00000000000000000f"]]
    pairs = [(some_frames(rng, rng.randrange(12), pool), some_frames(rng, rng.randrange(15), pool)) for pool in pools for _ in range(60)]
    for most in (1 << 23, 300):
        monkeypatch.setattr(R, "CELLS", most)
        for threshold in (0, 1, 3):
            assert R.align_batch(pairs, threshold) == [cell_by_cell(a, b, threshold) for a, b in pairs]


def test_many_alignments_take_no_loop_for_each_cell():
    rng = random.Random(1)
    pool = ["%064x" % rng.getrandbits(256) for _ in range(300)]
    pairs = [(some_frames(rng, 200, pool), some_frames(rng, 200, pool)) for _ in range(20)]
    began = time.process_time()
    fast = R.align_batch(pairs, 50)
    took = time.process_time() - began
    began = time.process_time()
    assert fast[:1] == [cell_by_cell(*pairs[0], 50)]
    assert took / len(pairs) < (time.process_time() - began) / 10


def catalogue(spark, rng, n):
    """Videos of one length: unrelated ones, and now and then a changed copy or a clip of another."""
    sets, seconds = {}, {}
    for v in range(n):
        if v % 10 == 3:
            sets[v], seconds[v] = [h if rng.random() < 0.8 else "%016x" % rng.getrandbits(64) for h in sets[v - 2]], 80.0
        elif v % 10 == 7:
            sets[v], seconds[v] = sets[v - 1][2:7], 40.0
        else:
            sets[v], seconds[v] = ["%016x" % rng.getrandbits(64) for _ in range(8)], 80.0 + v % 3
    f = spark.createDataFrame([(v, t, h) for v, hs in sets.items() for t, h in frames(hs)], "id long, t_sec double, phash string")
    rows = [(v, seconds[v], f"h{v}", 100 + v, None, len(hs)) for v, hs in sets.items()]
    return spark.createDataFrame(rows, "id long, duration_sec double, file_hash string, file_size long, aggregate_hash string, frame_count long"), f


def test_screen_loses_no_pair(spark, monkeypatch):
    """Near duplicates and clips are the same as when every pair in duration is aligned, and few pairs pass the screen."""
    monkeypatch.setattr(R, "FRAMES", 50)  # several blocks
    v, f = catalogue(spark, random.Random(8), 60)
    cfg = Q.SimilarConfig(threshold=6, frame_threshold=4)
    every = Q.aligned(Q.near_duration_pairs(v, cfg).select(Q.F.col("a_id").alias("a"), Q.F.col("b_id").alias("b")), f, 6)
    want = {(r["a"], r["b"]) for r in every.filter("coverage_a >= 0.7 AND coverage_b >= 0.7 AND mean_hamming <= 6").collect()}
    got = {tuple(sorted((r["keep"], r["remove"]), reverse=True)) for r in Q.similar_videos(v, f, cfg).collect()}
    assert got == want and want
    clips = Q.aligned(Q.clip_parent_pairs(v, cfg).select(Q.F.col("a_id").alias("a"), Q.F.col("b_id").alias("b")), f, 4)
    want = {(r["a"], r["b"]) for r in clips.filter("matched >= 3 AND coverage_a >= 0.8").collect()}
    assert {(r["remove"], r["keep"]) for r in Q.partial_clips(v, f, cfg).filter("kind = 'partial'").collect()} == want and want


def test_candidates_grow_with_near_pairs(spark):
    counts = []
    for n in (60, 120):
        v, f = catalogue(spark, random.Random(n), n)
        counts.append((R.screened(v, f, 120, 6, 0.7, 0.7, tolerance=0.1).count(), Q.near_duration_pairs(v, Q.SimilarConfig()).count()))
    assert counts[1][0] <= 3 * counts[0][0] and counts[1][1] > 3.5 * counts[0][1], counts


def test_equal_pieces_find_all_matches():
    """Hashes looked up by pieces are those that comparing all with all finds, copies and near copies among them."""
    import numpy as np

    from shelfmark.operators import frames as R

    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = np.concatenate((x[:120], x[:120] ^ np.uint64(0x4100000000000421), x[100:180] ^ np.uint64(0x8100000000010C21), np.repeat(x[:1], 40)))
    for threshold in (0.0, 4.5, 6.0):
        p, q = R.alike(x, y, threshold)
        want = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= threshold)
        assert (p.tolist(), q.tolist()) == (want[0].tolist(), want[1].tolist())
    sides = [{"ids": np.arange(n), "sizes": np.full(n, len(z) // n), "words": z[:, None], "masks": None} for n, z in ((100, x), (36, y))]
    fast = R._counts(*sides, 6.0)
    usual, R.PIECE = R.PIECE, 65
    try:
        slow = R._counts(*sides, 6.0)
    finally:
        R.PIECE = usual
    assert all((f == s).all() for f, s in zip(fast, slow, strict=True)) and fast[0].sum() > 0


def test_short_buckets_share_a_block(spark, sf):
    """Blocks are as many as frames fill, not as many as there are buckets of durations."""
    from shelfmark.operators.frames import packed
    from shelfmark.operators.sequences import demo_videos
    from shelfmark.sources.catalog import Catalog

    videos, frames = demo_videos(Catalog(spark, sf))
    many, few = packed(videos, frames, 1), packed(videos, frames, 1, 200, merged=True)
    n = frames.count()
    assert few.count() <= 2 * n / 200 + 2 < many.count()


VIDEO = "id long, duration_sec double, file_hash string, file_size long, aggregate_hash string, frame_count long"


def test_no_task_has_most_clips_and_parents(spark, monkeypatch):
    """Lines of 20 videos: a task has the pairs of two lines, and a video moves once for each line."""
    monkeypatch.setattr(Q, "LINE", 20, raising=False)
    v = spark.createDataFrame([(i, 100.0 + 130 * i, f"h{i}", 1, None, 8) for i in range(120)], VIDEO)
    got = Q.clip_parent_pairs(v, Q.SimilarConfig()).select("a_id", "b_id", Q.F.spark_partition_id().alias("task")).collect()
    want = {(a, b) for a in range(120) for b in range(a, 120) if 130 * (b - a) / (100 + 130 * b) > 0.1}
    assert sorted((r["a_id"], r["b_id"]) for r in got) == sorted(want)
    tasks = [r["task"] for r in got]
    assert max(map(tasks.count, set(tasks))) <= 20 * 20


def test_clips_and_parents_against_all_pairs(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    rng = random.Random(5)
    seconds = [None, nan, -inf, -3.0, -0.5, 0.0, 0.0, 1e-10, 5e-10, 0.5, 80.0, 80.0, 88.0, 88.888888888888886, 88.9, 119.9999999999, 120.0, inf, inf, *[rng.choice([1.0, 40.0, 44.4, 300.0, 5000.0]) * rng.choice([1, 0.9, 1.1, 1.2]) for _ in range(40)]]
    rows = [(i, d, rng.choice(["", None, "x", "y", f"h{i}", f"h{i}"]), 1, None, rng.choice([None, 3, 4, 8, 8])) for i, d in enumerate(seconds)]
    told = [r for r in rows if r[1] is not None and r[1] == r[1] and r[5] is not None]
    v = spark.createDataFrame(rows, VIDEO)
    for tolerance, line in ((0.1, 1000), (0.1, 8), (0.0, 8), (1.5, 8)):
        monkeypatch.setattr(Q, "LINE", line, raising=False)
        cfg, within = Q.SimilarConfig(tolerance=tolerance), lambda a, b: max(a, b) <= 0 or abs(a - b) / max(a, b) <= tolerance  # noqa: B023
        want = sorted((a[0], b[0]) for a in told for b in told if a[0] != b[0] and b[1] + 1e-9 >= a[1] and 4 <= a[5] <= b[5] and not within(a[1], b[1]) and not (a[2] and a[2] == b[2]))
        assert sorted((r["a_id"], r["b_id"]) for r in Q.clip_parent_pairs(v, cfg).collect()) == want and want
    ignored = {(min(p), max(p)) for p in want[::7]}
    got = Q.clip_parent_pairs(v, cfg, spark.createDataFrame([*ignored], "a_id long, b_id long")).collect()
    assert sorted((r["a_id"], r["b_id"]) for r in got) == [p for p in want if (min(p), max(p)) not in ignored]
    assert Q.clip_parent_pairs(v.limit(0), cfg).count() == 0


def test_lines_of_like_durations_do_not_meet(spark, monkeypatch):
    """Videos of about one length have no clips among them, and no two lines are dealt."""
    made = {}
    monkeypatch.setattr(Q, "LINE", 10, raising=False)
    monkeypatch.setattr(Q, "written", lambda df, name: made.setdefault(name, written(df, name)))
    v = spark.createDataFrame([(i, 100.0 + i % 5, f"h{i}", 1, None, 8) for i in range(60)], VIDEO)
    assert Q.clip_parent_pairs(v, Q.SimilarConfig()).count() == 0
    assert made["met"].count() == 0
