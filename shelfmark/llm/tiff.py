"""TIFF pages: a writer, and a reader that walks image directories.

The reader takes both byte orders, strips and tiles, no compression, LZW, deflate and PackBits, the horizontal
predictor for 8- and 16-bit samples, and emits one row per page. Planes of their own, other sample sizes, predictor 3
and 64-bit offsets (BigTIFF) are refused: such a file gives an error row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values of the format: tags, compression schemes, field types
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 3: "H", 4: "I"}
#: A page has at most so many payload bytes; a longer payload has more pages.
PAGE_BYTES = 4 << 20
#: No scheme makes more bytes of one byte: a strip or tile of more is malformed, and no memory is taken for it.
MOST_EXPANSION = 4096


class Malformed(ValueError):
    """The bytes are no TIFF that this reader takes."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    data: bytes


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widened one code early."""
    out, acc, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256)
    table, free, prefix = {bytes((i,)): i for i in range(256)}, 258, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer], free, prefix = free, free + 1, data[i : i + 1]
        if free == 4095:
            put(256)
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free >= 1 << width:
            width += 1
    if prefix:
        put(table[prefix])
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, acc, bits, width, at = [], 0, 0, 9, 0
    table: list[bytes] = []
    prefix, total = b"", 0
    while total < size:
        while bits < width:
            if at >= len(data):
                raise Malformed("LZW data end early")
            acc, bits, at = (acc << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prefix = [*(bytes((i,)) for i in range(256)), b"", b""], 9, b""
            continue
        if not table or code > len(table) or code == len(table) and not prefix:
            raise Malformed("LZW code out of range")
        entry = table[code] if code < len(table) else prefix + prefix[:1]
        if prefix:
            table.append(prefix + entry[:1])
        out.append(entry)
        total, prefix = total + len(entry), entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def squeeze(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits}[scheme](data)


def expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = bytes(data[:size])
    elif scheme in (DEFLATE, DEFLATE_OLD):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Malformed(str(e)) from e
    elif scheme in (LZW, PACKBITS):
        out = (unlzw if scheme == LZW else unpackbits)(bytes(data), size)
    else:
        raise Malformed(f"compression {scheme}")
    if len(out) < size:
        raise Malformed("a strip or tile has too few bytes")
    return out[:size]


def write(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, rows: int = 4096, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages (height, width[, samples]); in strips of so many rows, or square tiles."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    body, link, at = [], [], 8
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        if tile:
            blocks = [np.pad(page[y : y + tile, x : x + tile], ((0, max(0, y + tile - height)), (0, max(0, x + tile - width)), (0, 0))) for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        coded = []
        for b in blocks:
            b = b if predictor == 1 else np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            coded.append(squeeze(np.ascontiguousarray(b).tobytes(), scheme))
        offsets = []
        for c in coded:
            offsets.append(at)
            c += b"\0" * (len(c) & 1)
            body.append(c)
            at += len(c)
        tags = {WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [scheme]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        sizes = [len(c) for c in coded]
        tags |= {TILE_WIDTH: (3, [tile]), TILE_LENGTH: (3, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, sizes)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows]), STRIP_COUNTS: (4, sizes)}
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                body.append(raw + b"\0" * (len(raw) & 1))
                raw, at = struct.pack(order + "I", at), at + len(body[-1])
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        link.append((len(body), at))
        body.append([struct.pack(order + "H", len(entries)) + b"".join(entries)])
        at += len(body[-1][0]) + 4
    for i, (k, _) in enumerate(link):
        body[k] = body[k][0] + struct.pack(order + "I", link[i + 1][1] if i + 1 < len(link) else 0)
    return head + struct.pack(order + "I", link[0][1] if link else 0) + b"".join(body)


def read(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, one directory after another; Malformed if it isn't one, or directories run in a circle."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        raise Malformed("no TIFF header")
    view, seen = memoryview(data), set()
    (at,) = struct.unpack_from(order + "I", data, 4)
    if not at:
        raise Malformed("no directory")
    decoded = 0
    try:
        while at:
            if at in seen:
                raise Malformed("directories in a circle")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in TYPES:
                    size = struct.calcsize(TYPES[kind]) * count
                    where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                    if where + size > len(data):
                        raise Malformed(f"tag {tag} ends after the file")
                    tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where)
            page = _page(tags, view, order)
            decoded += len(page.data)
            if decoded > len(data) * MOST_EXPANSION:  # directories that share strips
                raise Malformed(f"{decoded} bytes of pages in a file of {len(data)}")
            yield page
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except Malformed:
        raise
    except (struct.error, LookupError, ValueError, TypeError, ArithmeticError) as e:
        raise Malformed(f"{type(e).__name__}: {e}") from e


def _page(tags: dict[int, tuple[int, ...]], data: memoryview, order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, scheme, predictor = tags[WIDTH][0], tags[LENGTH][0], one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    bits = one(BITS, 1)
    if bits not in (8, 16) or len(set(tags[BITS])) > 1 or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise Malformed(f"{bits} bits, planes {one(PLANAR, 1)}, predictor {predictor}")
    if min(width, height, samples) < 1:
        raise Malformed(f"a page of {width} x {height} x {samples}")
    kind = np.dtype("u1" if bits == 8 else order + "u2")

    def block(offset: int, count: int, h: int, w: int) -> np.ndarray:
        if offset + count > len(data) or h * w * samples * kind.itemsize > count * (1 if scheme == NONE else MOST_EXPANSION):
            raise Malformed(f"a strip or tile of {h} x {w} in {count} bytes at {offset}")
        got = np.frombuffer(expand(data[offset : offset + count], scheme, h * w * samples * kind.itemsize), kind).reshape(h, w, samples)
        return got if predictor == 1 else np.cumsum(got, axis=1, dtype=kind.newbyteorder("="))

    if TILE_OFFSETS in tags:
        w, h = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        if min(w, h) < 1:
            raise Malformed(f"tiles of {w} x {h}")
        across, places = -(-width // w), list(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True))
        if len(places) != across * -(-height // h):
            raise Malformed(f"{len(places)} tiles of {w} x {h} for {width} x {height}")
        if len(places) * w * h * samples * kind.itemsize > len(data) * MOST_EXPANSION:  # tiles that share their bytes
            raise Malformed(f"{len(places)} tiles of {w} x {h} in a file of {len(data)}")
        tiles = [block(offset, count, h, w) for offset, count in places]
        out = np.zeros((height, width, samples), kind.newbyteorder("="))
        for i, tile in enumerate(tiles):
            y, x = i // across * h, i % across * w
            out[y : y + h, x : x + w] = tile[: height - y, : width - x]
    else:
        rows = min(one(ROWS_PER_STRIP, height), height) or 1
        if len(tags[STRIP_OFFSETS]) != -(-height // rows):
            raise Malformed(f"{len(tags[STRIP_OFFSETS])} strips of {rows} rows for {height}")
        if height * width * samples * kind.itemsize > len(data) * MOST_EXPANSION:
            raise Malformed(f"{width} x {height} x {samples} in a file of {len(data)}")
        parts = [block(offset, count, min(rows, height - i * rows), width) for i, (offset, count) in enumerate(zip(tags[STRIP_OFFSETS], tags[STRIP_COUNTS], strict=True))]
        out = np.concatenate(parts) if len(parts) > 1 else parts[0]
        if len(out) != height:
            raise Malformed("rows are missing")
    return Page(width, height, samples, bits, scheme, out.tobytes())


def pages(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """One row per page: id, page (from 0), width, height, samples, bits, compression, data, error.

    A null or malformed file (one without a directory, too) gives its good pages, then one row with the error and nulls; repeated rows give repeated rows.
    """
    spec = common.schema("id string, page int, width int, height int, samples int, bits int, compression int, data binary, error string")
    names = spec.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, k = [], 0
                try:
                    if content is None:
                        raise Malformed("no content")
                    for p in read(content):
                        rows.append((name, k, p.width, p.height, p.samples, p.bits, p.compression, p.data, None))
                        k += 1
                except Malformed as e:
                    rows.append((name, k, *[None] * 6, str(e)))
                kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(walk, spec)


def stored(payload: bytes, width: int = 64, scheme: int = DEFLATE) -> bytes:
    """A payload (a positive multiple of the width) as a TIFF of that width, in as many pages as needed."""
    return write([np.frombuffer(payload[i : i + PAGE_BYTES], np.uint8).reshape(-1, width) for i in range(0, len(payload), PAGE_BYTES)], scheme)


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: int = DEFLATE, media: bool = False) -> DataFrame:
    """Stores each text (null: empty) as TIFF, reads the stored bytes back and describes them; with the stored form, if asked for.

    feature: pages, rows, smallest and largest sample, their mean to four places, and how many differ from the one before.
    """
    spec = common.schema("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if media else ""))
    names = spec.names

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                form = stored(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), scheme=scheme)
                got = list(read(form))
                back = b"".join(p.data for p in got)
                v = np.frombuffer(back, np.uint8)
                feature = f"pages={len(got)};rows={sum(p.height for p in got)};min={v.min()};max={v.max()};mean={int(v.sum(dtype=np.int64)) / len(v):.4f};changes={int(np.count_nonzero(v[1:] != v[:-1]))}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature, form)[: 8 if media else 7])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]], names=names)

    return common.pair(docs, id_col, text_col).mapInArrow(code, spec)


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_as_tiff(common.documents(spark, sf_dir))
