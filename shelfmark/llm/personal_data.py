"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, plus signs, digits, schemes and the
cues that stand before identifiers. At each anchor a deterministic parser of that kind looks left and right of it,
validates what it has expanded and remembers where its last match ended, so each kind's matches are the leftmost
non-overlapping ones. Work is linear in the text: no parser looks behind its own last match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Base kinds first, in their contract's order; then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "customer id", "user id", "passport", "member no")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_ACCOUNT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?))?\s{0,2}[:#=]?\s{0,2}([A-Za-z0-9](?:[A-Za-z0-9]|[\x20-](?=[A-Za-z]{0,2}[0-9])){5,40})")
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLE[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _email(text: str, at: int, last: int) -> tuple[int, int] | None:
    start = at
    while start > last and text[start - 1] in _LOCAL:
        start -= 1
    found = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, found.end()) if found else None


class Finder:
    """Spans of one text; built once for each worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word("@", ("@", 1))
        self.automaton.add_word("+", ("+", 1))
        for d in "0123456789":
            self.automaton.add_word(d, ("0", 1))
        for name, cues in (("url", SCHEMES), ("account", CUES)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                    self.automaton.add_word(form, (name, len(form)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in KINDS' order."""
        out: list[tuple[int, int, int]] = []
        email = ip = card = phone = url = account = 0
        before = -2
        for end, (anchor, n) in self.automaton.iter(text):
            at = end - n + 1
            if anchor == "0":
                if at >= ip and (before != at - 1 or at == ip) and (m := _IP.match(text, at)):
                    ip = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                        out.append((at, 1, ip))
                if at >= card and (m := _CARD.match(text, at)):
                    card = m.end()
                    if card - at <= 40 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                        out.append((at, 2, card))
                before = at
            elif anchor == "@":
                if got := _email(text, at, email):
                    email = got[1]
                    out.append((got[0], 0, email))
            elif anchor == "+":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                        out.append((at, 3, phone))
            elif anchor == "url":
                if at >= url and (m := _URL.match(text, end + 1)):
                    stop = end + 1 + len(m.group().rstrip(".,;:!?)]}"))
                    url = m.end()
                    if stop > end + 1 and ("." in (host := text[end + 1 : stop].split("/")[0]) or host.startswith("localhost")):
                        out.append((at, 4, stop))
            elif at >= account and (m := _ACCOUNT.match(text, end + 1)):
                stop = m.start(1) + len(m.group(1).rstrip(" -"))
                if sum("0" <= c <= "9" for c in m.group(1)) >= 6 and not text[stop : stop + 1].isalnum():
                    account = stop
                    out.append((m.start(1), 5, stop))
        return [(KINDS[k], s, e) for s, k, e in sorted(out)]


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans. A null or empty text has none; repeated rows give repeated rows."""
    spec = common.schema("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    names = spec.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = finder().spans
        for batch in common.small_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = look(text) if text else []
                base = [x for x in spans if x[0] in BASE]
                rows.append((*(sum(k == b for k, _, _ in base) for b in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=names)

    return common.pair(docs, id_col, text_col).mapInArrow(common.tidy(scan), spec)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in the text and, if there is such a column, its length renewed; null stays null."""

    has = length_col in docs.columns and dict(docs.dtypes)[length_col] in ("bigint", "int")

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        look = finder().spans
        texts = [t if not t or not (found := look(t)) else masked(t, found) for t in batch.column(text_col).to_pylist()]
        batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
        if has:
            at = batch.schema.get_field_index(length_col)
            batch = batch.set_column(at, length_col, pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(at).to_pylist(), strict=True)], batch.schema.field(at).type))
        return batch

    return common.rows_like(docs, mask, text_col, 2 << 20)


def op9_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.documents(spark, sf_dir))
