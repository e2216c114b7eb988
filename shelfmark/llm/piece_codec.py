"""SentencePiece encoding and decoding through a distinct-chunk table.

The model's own file says whether its pieces can cross a white-space marker or a line feed. Where they cannot, a text
is cut there and each distinct marked word is segmented once for each worker; ids and decoded strings are joined back
by position. Where they can, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chunks, common

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            n, at = number(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def plain_normaliser(path: str) -> bool:
    """Whether the model leaves texts as they are, but for a marker in front and for each space."""
    spec = {k: v for f, v in _fields(open(path, "rb").read()) if f == 3 for k, v in _fields(v)}
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


@dataclass
class Codec:
    """Encodes and decodes with a SentencePiece model file; an end id follows each text's ids."""

    path: str
    longest: int = chunks.LONGEST
    most: int = chunks.MOST

    def open(self) -> _Open:
        key = (self.path, self.longest, self.most)
        if key not in _OPEN:
            _OPEN[key] = _Open(self)
        return _OPEN[key]


class _Open:
    def __init__(self, codec: Codec):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=codec.path)
        normal = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        crossing = any(MARK in p.lstrip(MARK) for p in normal)
        feed = any("\n" in p and len(p) > 1 for p in normal)
        self.marker_id = self.model.piece_to_id(MARK)
        self.cuttable = plain_normaliser(codec.path) and not crossing and not feed and not self.model.is_unknown(self.marker_id)
        self.table = chunks.Table(self._segment, codec.longest, codec.most)
        self.end = self.model.eos_id()

    def _segment(self, part: str) -> tuple[str, str]:
        """Ids of a chunk, as text, and what they decode to.

        A space in front is the marker that the model adds, and that decoding takes away; before a line feed there is none.
        """
        if part == " ":  # alone it encodes to nothing, as the marker in front belongs to a text
            return str(self.marker_id), " "
        spaced = part[0] == " "
        ids = self.model.encode(part[1:] if spaced else part)
        ids = ids if spaced else ids[1:]
        return " ".join(map(str, ids)), " " * spaced + self.model.decode(ids)

    def code(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids and end id as text, decoded text) of each text."""
        if not self.cuttable:
            for t in texts:
                ids = self.model.encode(t)
                yield " ".join(map(str, [*ids, self.end])), self.model.decode([*ids, self.end])
            return
        # with the marker in front as a space, every chunk starts with a space or a line feed
        self.table.renew()
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, " ")
            found = list(map(self.table.__getitem__, chunks.cut(" " + t if t[0] in " \n" else t))) if t else []
            yield " ".join([*[x for x, _ in found], str(self.end)]), "".join([x for _, x in found])[1:]


_OPEN: dict = {}


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with the ids (space-joined) and the decoded text, if asked for.

    Null and empty texts have the end id alone and decode to the empty text; repeated rows give repeated rows.
    """
    spec = common.schema(CODED + (", ids string, decoded string" if texts else ""))

    names = spec.names

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec.open()
        for batch in common.small_batches(batches, limit=2 << 20):
            got = list(coder.code([t or "" for t in batch.column("text").to_pylist()]))
            cols = [batch.column("doc_id"), pa.array([x.count(" ") + 1 for x, _ in got], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in got], pa.string()), pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in got], pa.string())]
            if texts:
                cols += [pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        coder.table.forget()

    return common.pair(docs, id_col, text_col).mapInArrow(code, spec)


def op7_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.documents(spark, sf_dir), Codec(public_tokenizers.path("piece_bpe_32k.model")))
