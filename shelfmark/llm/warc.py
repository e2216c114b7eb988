"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

Archives are byte strings of bounded size, in a binary column: any store that Spark can write holds them, and files
read with Spark's binaryFile source have the same column. The reader loads the dictionary from the leading skippable
frame, walks frames by their block headers, decodes one record from each and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values of the formats
SKIPPABLE, FRAME, DICTIONARY_FRAME = range(0x184D2A50, 0x184D2A60), 0xFD2FB528, 0x184D2A5D
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
#: Payload bytes of one archive, about; bytes of its dictionary, at most; smallest payload that a revisit may stand for.
ARCHIVE_BYTES, DICTIONARY_BYTES, LEAST = 8 << 20, 16 << 10, 100
#: Records carry a fixed date, so that archives depend on their input alone.
DATE = "2000-01-01T00:00:00Z"


class Malformed(ValueError):
    """An archive or record that isn't valid."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with its HTTP block, or a revisit record if it refers to another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else "urn:none"
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names as written; a folded line continues the one before) and block of one record; Malformed if they don't hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise Malformed("no WARC version line")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or re.search(r"[\x00-\x20]", name):
            raise Malformed(f"header line {line[:60]!r}")
        last = name
        headers[name] = value.strip()
    known = {k.lower() for k in headers}
    if missing := [m for m in MANDATORY if m.lower() not in known]:
        raise Malformed(f"without {', '.join(missing)}")
    length = next(v for k, v in headers.items() if k.lower() == "content-length")
    if not re.fullmatch(r"[0-9]{1,18}", length) or int(length) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise Malformed(f"a block of {len(rest) - 4} bytes, not {length}")
    return headers, rest[:-4]


def archive(records: list[bytes], level: int = 3, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary made from the records in the leading skippable frame, then one frame for each record."""
    import zstandard

    sample = [r[:4096] for r in records[:: max(1, len(records) // 400)]]
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, sample, k=64, d=8).as_bytes() if len(sample) >= 16 else b""
    except zstandard.ZstdError:  # too little to learn from: what the records share, as it stands
        trained = b""
    raw = trained or b"".join(r[:512] for r in sample[:8])[:dictionary_bytes].ljust(8, b"\0")
    held = zstandard.ZstdCompressor(level=level).compress(raw)
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(held)), held, *(coder.compress(r) for r in records)])


def frames(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Start and end of each frame from `at` on, by block headers; skippable frames are passed over."""
    n = len(data)
    while at < n:
        if at + 8 > n:
            raise Malformed("a frame ends early")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        if magic != FRAME:
            raise Malformed(f"no frame at byte {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            if end + 3 > n:
                raise Malformed("a block ends early")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
        if end > n:
            raise Malformed("a frame ends early")
        yield at, end
        at = end


def read(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive. The dictionary may itself be a Zstandard frame; without one, frames stand alone."""
    import zstandard

    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        held, at = data[8 : 8 + size], 8 + size
        try:
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == struct.pack("<I", FRAME) else held)
        except zstandard.ZstdError as e:
            raise Malformed(f"dictionary: {e}") from e
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    for start, end in frames(data, at):
        try:
            plain = decoder.decompressobj().decompress(data[start:end])
        except zstandard.ZstdError as e:
            raise Malformed(f"frame at byte {start}: {e}") from e
        yield parse(plain)


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least `least` bytes, the smallest id is the response.

    A null payload is empty; a null id is never the smallest, and repeats of the smallest id are responses as well.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= least)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    later = long.select("page_id", "digest").join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    later = common.keep(later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")), "revisits")
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """(archive binary) of decided() rows, each of about so many payload bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total = 0
        for batch in common.small_batches(batches, "payload", archive_bytes):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(*row))
                total += len(held[-1])
                if total >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held, level)], pa.binary())], names=["archive"])
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held, level)], pa.binary())], names=["archive"])

    return rows.mapInArrow(put, common.schema("archive binary"))


#: Record types whose block is an HTTP message.
HTTP_TYPES = ("response", "request", "revisit")


def digest_holds(told: str, payload: bytes) -> bool:
    """Whether `algorithm:value` is the payload's digest; of algorithms other than SHA-1 and SHA-256 nothing is known, so they hold."""
    name, _, value = told.partition(":")
    if name.lower() not in ("sha1", "sha256"):
        return True
    own = hashlib.new(name.lower(), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _number(text: str) -> int | None:
    m = re.fullmatch(r"<?urn:page:(-?\d+)>?", text)
    return int(m[1]) if m else None


def records(archives: DataFrame, content_col: str = "archive", payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; with the payload, if asked for.

    Header names are read in any case. The payload is what follows the HTTP header of a response, request or revisit, and
    the whole block of any other type; page ids are null where the record's id isn't a page's. A digest is checked where
    there is one (SHA-256 or SHA-1, in hex or base 32), and what is returned is the SHA-256; a revisit has no payload, so
    its length and digest are those that it names, or null. A record whose headers, lengths or digest don't hold ends the
    job with an error: an archive is whole or it is refused.
    """
    spec = common.schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else ""))
    names = spec.names

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for data in batch.column("archive"):
                rows = []
                for headers, block in read(data.as_buffer().to_pybytes()):
                    named = {k.lower(): v for k, v in headers.items()}
                    kind, told, stated = named["warc-type"], named.get("warc-payload-digest"), named.get("x-payload-length", "")
                    payload = block
                    if kind in HTTP_TYPES and named.get("content-type", "application/http").lower().startswith("application/http"):
                        _, mark, payload = block.partition(b"\r\n\r\n")
                        if not mark and block:
                            raise Malformed(f"no HTTP header in {named['warc-record-id']}")
                    if kind == "revisit":
                        if payload:
                            raise Malformed(f"a revisit with a payload: {named['warc-record-id']}")
                        length = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
                        digest = told.partition(":")[2].lower() if told and told.lower().startswith("sha256:") else None
                    else:
                        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if stated and stated != str(length) or told and not digest_holds(told, payload):
                            raise Malformed(f"payload of {named['warc-record-id']}")
                    rows.append((_number(named["warc-record-id"]), length, digest, kind, _number(named.get("warc-refers-to", "")), payload)[: 6 if payloads else 5])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return archives.select(F.col(content_col).alias("archive")).mapInArrow(get, spec)


def op3_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(common.keep(write_archives(decided(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "archives"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
