import hashlib
import heapq
import random
import re
import zlib

import pytest

from shelfmark.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """The cheapest edits by search over (turns done, roles so far), and what they give. turns: (role, text, fault)."""
    heap, settled, best = [(0, "", 0, ())], set(), None
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        roles = "".join(r[:1] or " " for r, _ in out)
        key = (at, roles[-1:] if len(roles) != 1 else roles)
        if (best is not None and cost > best[0]) or key in settled:
            continue
        settled.add(key)
        if at == len(turns) and SHAPE.fullmatch(roles):
            best = (cost, audit, out)
            break
        ways = [(3, "I", at, (r, "")) for r in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            ways.append((4, "D", at + 1, None))
            if fault not in ("blank", "duplicate"):
                add = 3 * (fault == "truncated")
                ways += [(add, "K", at + 1, (role, text)), *[(3 + add, "R", at + 1, (r, text)) for r in ("user", "assistant")]]
        for more, letter, then, put in ways:
            new = out if put is None else (*out, put)
            told = "".join(r[:1] or " " for r, _ in new)
            if re.fullmatch(r"s?(ua)*u?", told):
                heapq.heappush(heap, (cost + more, audit + letter, then, new))
    return best


def expected(rows):
    """rows: conv_id, turn, role, text."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        convs[c] += [(t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told = set(), []
        for _, role, text in turns:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            told.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, final = cheapest(told)
        faults = [f for _, _, f in told]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out.append(repr((c, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)))
    return sorted(out)


def conversations(rng, n, length):
    roles = ["user", "assistant", "system", "tool", None, "", "sudo", "User"]
    texts = ["Hello.", "Well then!", "no end", "  \t", "", None, "Why?\n ", "ends. not", "é日.", "x" * 300 + "."]
    for c in range(n):
        for t in range(rng.randrange(1, length)):
            if rng.random() < 0.9:
                yield (c, None if rng.random() < 0.05 else t, rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.random()}.")


@pytest.mark.parametrize("held", [20_000, 3, 0])
def test_against_search(spark, monkeypatch, held):
    """Long conversations by slices give the same: with few turns held, all go that way, over many slices."""
    rng = random.Random(held)
    rows = [*conversations(rng, 60, 9), (None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", "a."), (901, 4, "assistant", "b."), (901, 4, "assistant", "b.")]
    rows += [(902, t, "user" if t % 2 else "assistant", f"{t % 7}.") for t in range(60)]
    monkeypatch.setattr(repair, "HELD_TURNS", held)
    if held < 100:
        monkeypatch.setattr(repair, "SLICE", 12)
        monkeypatch.setattr(repair, "FAN", 2)
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "conv_id long, turn long, role string, text string, gone boolean, audit string").repartition(3)
    got = repair.repaired(repair.damaged(df), gone_col="gone")
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)


def test_every_conversation_stays(spark):
    """Conversations whose rows are all dropped are told of."""
    rows = [(c, 0, "user", "Hi.") for c in range(200)]
    got = {r["conv_id"]: r for r in repair.repaired(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), gone_col="gone").collect()}
    none = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(got) == 200 and none
    assert all(got[c][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in none)


def test_products_are_associative():
    rng = random.Random(5)
    turns = [(rng.choice(["s", "u", "a", ""]), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(40)]
    whole = repair.matrix(turns)
    for cut in (1, 7, 20, 39):
        assert repair.times(repair.matrix(turns[:cut]), repair.matrix(turns[cut:])) == whole
    assert repair.best(repair.matrix([])) == (0, "")


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(none).collect() == []
    assert repair.repaired(spark.createDataFrame([("a", 1, "user", "Hi"), ("a", 2, "assistant", "Yes.")], none.schema)).first()["audit"] == "KK"


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(repr(tuple(r)) for r in repair.op11_min_plus_repair(spark, sf).collect()) == expected(rows)
