"""Conversation structure repair: the cheapest edits that give a conversation the shape (system? (user assistant)+)?.

A shape's prefix is one of four states, and a turn is a 4 x 4 matrix: at (i, j) the cheapest way from state i to j that
edits this turn and inserts any turns before and after, as (cost, audit), where an audit is the edits' initials. Matrices
are multiplied by (min, +): costs add, audits are joined, and of equal costs the ASCII-least audit wins. As the cost of
an audit is fixed by its letters, no audit of equal cost begins another one, so the product is associative. It is
reduced as a tree: within a slice of the sorted turns, then over slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Costs of edits; what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant (0 and 3 are whole shapes); the state that each role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Turns and text of one conversation that a task holds; a longer one is repaired by slices. Slices that meet in one step of the tree; turns of a slice.
HELD_TURNS, HELD_BYTES, FAN, SLICE = 20_000, 4 << 20, 16, 50_000
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

Matrix = dict[tuple[int, int], tuple[int, str]]


def times(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in x.items():
        for j in range(4):
            more = y.get((k, j))
            if more is not None:
                both = (cost + more[0], audit + more[1])
                if (i, j) not in out or both < out[i, j]:
                    out[i, j] = both
    return out


def _closure() -> Matrix:
    """Any number of inserted turns: cheapest paths by inserted users and assistants."""
    once: Matrix = {(i, i): (0, "") for i in range(4)}
    for role in "ua":
        once |= {(i, j): (INSERT, "I") for i, j in _NEXT[role].items()}
    return times(times(once, once), times(once, once))


INSERTS = _closure()


@lru_cache(maxsize=64)
def turn(initial: str, fault: str) -> Matrix:
    """The matrix of a turn: initial of its role ('s', 'u', 'a', else ''), fault 'blank', 'duplicate', 'truncated' or ''."""
    edits: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in ("blank", "duplicate"):
        add = TRUNCATED if fault else 0
        ways = [((i, j), (REROLE + add, "R")) for role in "ua" for i, j in _NEXT[role].items()] + [((i, j), (add, "K")) for i, j in _NEXT.get(initial, {}).items()]
        for at, way in ways:
            edits[at] = min(edits.get(at, way), way)
    return times(times(INSERTS, edits), INSERTS)


@lru_cache(maxsize=1 << 14)
def _short(turns: tuple[tuple[str, str], ...]) -> Matrix:
    return reduce(times, (turn(*t) for t in turns), INSERTS)


def product(parts: list[Matrix]) -> Matrix:
    """The product in order, by a balanced tree."""
    while len(parts) > 1:
        parts = [times(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else INSERTS


def matrix(turns: list[tuple[str, str]]) -> Matrix:
    return product([_short(tuple(turns[k : k + 4])) for k in range(0, len(turns), 4)])


def best(m: Matrix) -> tuple[int, str]:
    return min(m[START, j] for j in (START, ASSISTANT) if (START, j) in m)


def fault_of(text: str, seen: bool) -> str:
    last = text.rstrip(_SPACES)[-1:]
    return "blank" if not last else "duplicate" if seen else "" if last in ".!?" else "truncated"


class Repaired:
    """Hashes the repaired turns of one conversation, given its audit's letters and its turns in order."""

    def __init__(self, audit: str):
        self.letters, self.state, self.first, self.sha = iter(audit), START, True, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode(errors="surrogatepass"))
        self.first = False
        self.state = _NEXT[role[:1]][self.state]

    def _new_role(self) -> str:
        return "assistant" if self.state == USER else "user"

    def add(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._put(self._new_role(), "")
                continue
            if letter != "D":
                self._put(role if letter == "K" else self._new_role(), text)
            return

    def done(self) -> str:
        for _ in self.letters:  # inserted at the end
            self._put(self._new_role(), "")
        return self.sha.hexdigest()


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with faults put in by crc32(`conv_id:turn`) % 20 (0 drops: gone; 1 empties;
    2 takes the ends of sentences; 3 repeats; 4 makes it a user's). Null roles and texts, and nulls in the hashed string, are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(some(conv_col), F.lit(":"), some(turn_col)).cast("binary")), F.lit(20))
    out = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), some(role_col).alias("role"), some(text_col).alias("text"), code.cast("int").alias("code"))
    text = F.when(F.col("code") < 2, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_MATRIX = "struct<" + ", ".join(f"{'abcd'[i]}{'abcd'[j]}: struct<cost: bigint, audit: string>" for i, j in sorted(INSERTS)) + ">"


class _Slice:
    """What turns in a row add up to: faults, turn numbers, the ends' initials, and the matrix."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.distinct = self.rows = 0
        self.first = self.last = None
        self.parts: list[Matrix] = []
        self.block: list[tuple[str, str]] = []

    def add(self, number: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.rows:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        if number is not None:
            self.distinct += number != self.high  # turns come in order
            self.low, self.high = number if self.low is None else self.low, number
        self.block.append((initial if initial in ("s", "u", "a") else "", fault))
        if len(self.block) == 1024:
            self.close()

    def close(self) -> None:
        if self.block:
            self.parts.append(matrix(self.block))
            self.block = []

    def matrix(self) -> Matrix:
        self.close()
        self.parts = [product(self.parts)]
        return self.parts[0]

    def join(self, row: dict) -> None:
        """The slice that follows this one, as a row."""
        if row["rows"]:
            if self.rows:
                self.counts["illegal"] += self.last + row["first"] not in ("su", "ua", "au")
            for c in _COUNTS:
                self.counts[c] += row[c]
            self.first, self.last = self.first if self.rows else row["first"], row["last"]
            if row["low"] is not None:
                self.distinct += row["distinct"] - (self.high == row["low"])
                self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
            self.rows += row["rows"]
            self.parts.append({at: (row["matrix"][k]["cost"], row["matrix"][k]["audit"]) for at, k in _NAMES.items() if row["matrix"][k] is not None})

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


_NAMES = {(i, j): "abcd"[i] + "abcd"[j] for i, j in sorted(INSERTS)}


def _slice_row(s: _Slice) -> dict:
    m = s.matrix()
    return s.counts | {"rows": s.rows, "low": s.low, "high": s.high, "distinct": s.distinct, "first": s.first, "last": s.last, "matrix": {k: {"cost": m[at][0], "audit": m[at][1]} if at in m else None for at, k in _NAMES.items()}}


_SLICE_SPEC = f"blank long, duplicate long, truncated long, illegal long, rows long, low long, high long, distinct long, first string, last string, matrix {_MATRIX}"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(spec: str) -> Callable[[list[dict]], pa.RecordBatch]:
    """Rows as a batch of a schema, which is read here, on the driver."""
    fields = to_arrow_schema(common.schema(spec))
    return lambda rows: pa.RecordBatch.from_pylist(rows, schema=fields)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation.

    Turns go by number (nulls first), then by role and text. Null roles and texts are one space. A turn's first fault
    counts: blank, a duplicate (role and text seen earlier), truncated (its last character but white space ends no
    sentence). gone_col marks rows that only tell of their conversation. A conversation without turns has zeros, an empty
    audit and the hash of an empty text; a null conv_id is a conversation; an empty table gives no rows.

    Turns are dealt by ranges of (conversation, turn, ...), so that a conversation of any length spreads over as many
    tasks as it takes. Those within one slice are done there. For the others, first occurrences are found by an
    aggregate, slices are reduced to one matrix each, FAN slices at a time to one, and the repaired turns stream by in
    order: their hash is a chain, so that last step is one task for each conversation, which holds its audit only.
    """
    spark = rows.sparkSession
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), some(role_col).alias("role"), some(text_col).alias("text"), (F.col(gone_col) if gone_col else F.lit(False)).alias("gone"))
    kind = plain.schema["conv_id"].dataType.simpleString()
    n = common.partitions(spark, rows.count(), SLICE)
    ranged = common.bounded(plain).repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = common.keep(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")  # a partition's number leads its places

    report = f"conv_id {kind}, open boolean, {_REPORT}, repaired_sha256 string"
    as_report = _arrow(report)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations that begin and end between others of this slice; of the rest, that they are open."""
        conv, part, held, size, edge, out = None, None, [], 0, True, []

        def done(is_open: bool) -> dict:
            if is_open or held is None:
                return {"conv_id": conv[0], "open": True}
            s, seen = _Slice(), set()
            for number, role, text, gone in held:
                if not gone:
                    s.add(number, role, fault_of(text, (role, text) in seen))
                    seen.add((role, text))
            cost, audit = best(s.matrix())
            told = Repaired(audit)
            for _, role, text, gone in held:
                if not gone:
                    told.add(role, text)
            return {"conv_id": conv[0], "open": False, "gaps": s.gaps, **s.counts, "cost": cost, "audit": audit, "repaired_sha256": told.done()}

        for batch in batches:
            for mine, number, role, text, gone, pos in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "pos")), strict=True):
                cut = part != pos >> 33  # another slice, of the same task: what ends at its edge may go on elsewhere
                if conv is None or conv[0] != mine or cut:
                    if conv is not None:
                        out.append(done(edge or cut))
                    edge, conv, part, held, size = conv is None or cut, (mine,), pos >> 33, [], 0
                if held is not None:
                    held.append((number, role, text, gone))
                    size += len(text)
                    if len(held) > HELD_TURNS or size > HELD_BYTES:
                        held = None
            if len(out) >= 1000:
                yield as_report(out)
                out = []
        if conv is not None:
            out.append(done(True))
            yield as_report(out)

    told = common.keep(turns.mapInArrow(whole, report), "conversations")
    wide = told.filter("open").select("conv_id").distinct()  # at most two for each slice, and long ones
    closed = told.filter("NOT open")
    columns = ["conv_id", *[x.split()[0] for x in _REPORT.split(", ")], "repaired_sha256"]
    return closed.select(*columns).unionByName(_wide(turns, wide, kind).select(*columns))


def _wide(turns: DataFrame, convs: DataFrame, kind: str) -> DataFrame:
    """The report of conversations that more than one slice may hold. turns has pos, by which they are sorted."""
    spark = turns.sparkSession
    ids = convs.select(F.col("conv_id").alias("id"))
    mine = common.keep(turns.join(ids, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi").withColumn("digest", F.unhex(F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256))), "wide-turns")
    first = mine.filter("NOT gone").groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    marked = mine.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").select("conv_id", "turn", "role", F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1).alias("last"), "gone", "pos", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("seen"))
    n = common.partitions(spark, mine.count(), SLICE)
    slices_spec = f"conv_id {kind}, slice long, {_SLICE_SPEC}"
    as_slices = _arrow(slices_spec)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, s, number = None, _Slice(), TaskContext.get().partitionId()
        for batch in batches:
            for c, turn_, role, last, gone, seen in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "last", "gone", "seen")), strict=True):
                if conv is None or conv[0] != c:
                    if conv is not None:
                        yield as_slices([{"conv_id": conv[0], "slice": number, **_slice_row(s)}])
                    conv, s = (c,), _Slice()
                if not gone:
                    s.add(turn_, role, fault_of(last, seen))
        if conv is not None:
            yield as_slices([{"conv_id": conv[0], "slice": number, **_slice_row(s)}])

    level = common.keep(marked.repartitionByRange(n, "pos").sortWithinPartitions("pos").mapInArrow(slices, slices_spec), "slices")
    most = level.agg(F.max("slice")).first()[0] or 0

    def join(table: pa.Table) -> pa.Table:
        s = _Slice()
        for row in sorted(table.to_pylist(), key=lambda r: r["slice"]):
            s.join(row)
        return pa.Table.from_batches([as_slices([{"conv_id": table["conv_id"][0].as_py(), "slice": table["slice"][0].as_py() // FAN, **_slice_row(s)}])])

    while True:
        level = common.keep(level.withColumn("group", F.floor(F.col("slice") / FAN)).groupBy("conv_id", "group").applyInArrow(lambda t: join(t.drop_columns(["group"])), slices_spec), "slices")
        most //= FAN
        if not most:
            break

    one = f"conv_id {kind}, {_REPORT}"
    as_one = _arrow(one)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                s = _Slice()
                s.join(row)
                cost, audit = best(s.matrix())
                out.append({"conv_id": row["conv_id"], "gaps": s.gaps, **s.counts, "cost": cost, "audit": audit})
            if out:
                yield as_one(out)

    reports = common.keep(level.mapInArrow(end, one), "reports")
    # the audit of a conversation leads its turns
    stream = reports.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")).unionByName(mine.filter("NOT gone").select("conv_id", "pos", "role", "text"))

    as_hash = _arrow(f"conv {kind}, repaired_sha256 string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, told = None, None
        for batch in batches:
            for c, pos, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "role", "text")), strict=True):
                if pos >= 0:
                    told.add(role, text)
                    continue
                if conv is not None:
                    yield as_hash([{"conv": conv[0], "repaired_sha256": told.done()}])
                conv, told = (c,), Repaired(text)
        if conv is not None:
            yield as_hash([{"conv": conv[0], "repaired_sha256": told.done()}])

    hashes = stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(hashed, f"conv {kind}, repaired_sha256 string")
    return reports.join(common.keep(hashes, "hashes"), F.col("conv_id").eqNullSafe(F.col("conv")))


def op11_min_plus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone_col="gone")
