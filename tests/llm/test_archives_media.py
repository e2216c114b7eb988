import hashlib
import struct
import zlib

import numpy as np
import pytest

from shelfmark.llm import tiff, warc


def test_archive_round_trip():
    records = [warc.record(i, f"http://x/{i}", (f"<html>page {i}</html>" * 30).encode(), "d", None) for i in range(200)]
    data = warc.archive(records)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    got = list(warc.read(data))
    assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:page:{i}>" for i in range(200)]
    assert got[7][1].endswith(b"page 7</html>") and len(data) < sum(map(len, records)) / 5
    assert len(list(warc.frames(data, 0))) == 200


def test_plain_dictionary_and_foreign_frames():
    import zstandard

    r = warc.record(1, "http://x/\n1", b"payload", "d", None)
    assert b"x/%0A1" in r
    plain = zstandard.ZstdCompressor(level=1).compress(r)
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    assert [h["WARC-Type"] for h, _ in warc.read(plain + skip + plain)] == ["response", "response"]
    raw = b"HTTP/1.1 200 OK WARC-Type response " * 4
    coded = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(r)
    assert len(list(warc.read(struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw + coded))) == 1


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r[:-1], lambda r: r.replace(b"Content-Length: 4", b"Content-Length: 9"), lambda r: r.replace(b"WARC-Type:", b"WARC Type:")])
def test_invalid_records(change):
    record = warc.record(1, "u", b"x" * 400, "d", None)
    warc.parse(record)
    with pytest.raises(warc.Malformed):
        warc.parse(change(record))


@pytest.mark.parametrize("cut", [1, 9, 40, 300])
def test_cut_archives(cut):
    data = warc.archive([warc.record(i, "u", bytes(np.random.default_rng(i).integers(0, 255, 300, dtype=np.uint8)), "d", None) for i in range(5)])
    with pytest.raises(warc.Malformed):
        list(warc.read(data[:-cut]))


def test_query(spark, sf, agree):
    agree(warc.op3_zstd_warc(spark, sf), warc.OP3_SQL)


def test_odd_pages(spark):
    long = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "u", long, 1), (0, None, long, 1), (None, "u", long, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", "short", 1), (5, "u", "short", 1), (0, "u", long, 1)], "page_id long, url string, html string, digest int")
    got = sorted(map(repr, (tuple(r) for r in warc.records(warc.write_archives(warc.decided(pages))).collect())))
    d = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 203, d(long), "revisit", 0), (0, 203, d(long), "response", None), (0, 203, d(long), "response", None), (None, 203, d(long), "revisit", 0), (2, 0, d(""), "response", None), (3, 0, d(""), "response", None), (4, 5, d("short"), "response", None), (5, 5, d("short"), "response", None)]
    assert got == sorted(map(repr, want))
    assert warc.records(warc.write_archives(warc.decided(pages.limit(0)))).collect() == []


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(scheme):
    for i in range(40):
        rng = np.random.default_rng(i)
        pages = [rng.integers(0, [256, 3, 1][i % 3] + 1 - (i % 3 == 0), (int(rng.integers(1, 80)), int(rng.integers(1, 80)), [1, 3][i % 2]), dtype=np.uint8) for _ in range(1 + i % 3)]
        for tile in (0, 16):
            data = tiff.write(pages, scheme, 1 + i % 2, rows=int(rng.integers(1, 60)), tile=tile, order="<>"[i % 2])
            assert [p.data for p in tiff.read(data)] == [p.tobytes() for p in pages]


def test_long_lzw():
    x = np.random.default_rng(1).integers(0, 256, (3000, 64), dtype=np.uint8)
    assert next(tiff.read(tiff.write([x], tiff.LZW))).data == x.tobytes()


def test_sixteen_bits_with_predictor():
    rows = np.array([[1, 300, 65535], [7, 7, 7]], dtype="<u2")
    diff = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1)
    body = zlib.compress(diff.tobytes())
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 8), (273, 4, 8), (279, 4, len(body)), (317, 3, 2)]
    at = 8 + len(body)
    data = b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    assert next(tiff.read(data)).data == rows.tobytes()


def test_malformed_files(spark):
    good = tiff.write([np.zeros((4, 4), np.uint8)])
    at = struct.unpack_from("<I", good, 4)[0]
    circle = good[:-4] + struct.pack("<I", at)
    df = spark.createDataFrame([("a", good, 1), ("b", good[:-20], 1), ("c", b"nothing", 1), ("d", None, 1), ("e", circle, 1)], "id string, content binary, page int")
    rows = tiff.pages(df).collect()
    assert sorted((r["id"], r["page"], r["error"] is None) for r in rows) == [("a", 0, True), ("b", 0, False), ("c", 0, False), ("d", 0, False), ("e", 0, True), ("e", 1, False)]
    assert tiff.pages(df.limit(0)).collect() == []


def test_texts_as_tiff(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "x" * 64), (9004, "é" * 3_000_000)], docs.schema)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.union(extra).collect()}
    for r in tiff.texts_as_tiff(docs.union(extra), media=True).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
        assert b"".join(p.data for p in tiff.read(bytes(r["media"]))) == payload


def foreign(kind, block, *more, version="WARC/1.0"):
    lines = [version, f"warc-type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "warc-date: 2024-01-01T00:00:00Z", *more, f"CONTENT-LENGTH: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    """Records without this library's own headers: other types, other digests, none at all, names in any case."""
    import base64

    http, body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    held = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("response", http + body, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"),
        foreign("response", http, "Content-Type: application/http"),
        foreign("resource", body, "Content-Type: text/html", "WARC-Payload-Digest: sha256:" + hashlib.sha256(body).hexdigest()),
        foreign("revisit", http, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha1}"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http", "WARC-Payload-Digest: md5:00"),
    ]
    got = warc.records(spark.createDataFrame([(warc.archive(held),)], "archive binary"), payloads=True).collect()
    assert [(r["record_type"], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for r in got] == [("warcinfo", 13, b"software: x\r\n"), ("response", 12, body), ("response", 0, b""), ("resource", 12, body), ("revisit", None, b""), ("request", 0, b"")]
    assert got[1]["payload_digest"] == hashlib.sha256(body).hexdigest() and {r["page_id"] for r in got} == {None}
    for bad in (foreign("response", http + body, "WARC-Payload-Digest: sha1:" + "A" * 32), foreign("revisit", http + body), foreign("response", b"no header end")):
        with pytest.raises(Exception, match="payload|HTTP header"):
            warc.records(spark.createDataFrame([(warc.archive([bad]),)], "archive binary")).collect()


def test_files_without_directories_and_shared_tiles(spark):
    none = b"II*\0" + struct.pack("<I", 0)
    # 4,096 tiles of 256 x 256 that all are one compressed strip
    body = zlib.compress(b"\0" * 65536)
    n = 4096
    tags = [(256, 4, 1, 256 * 64), (257, 4, 1, 256 * 64), (258, 3, 1, 8), (259, 3, 1, 8), (322, 4, 1, 256), (323, 4, 1, 256), (324, 4, n, 8 + len(body)), (325, 4, n, 8 + len(body) + 4 * n)]
    at = 8 + len(body) + 8 * n
    data = b"II*\0" + struct.pack("<I", at) + body + struct.pack(f"<{n}I", *[8] * n) + struct.pack(f"<{n}I", *[len(body)] * n) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    small = data[:8] + b"\0" * 16
    rows = tiff.pages(spark.createDataFrame([("none", none), ("shared", data), ("short", small)], "id string, content binary")).collect()
    told = {r["id"]: (r["page"], r["error"]) for r in rows}
    assert told["none"] == (0, "no directory") and told["short"][1] is not None and told["shared"][1] is not None, told
