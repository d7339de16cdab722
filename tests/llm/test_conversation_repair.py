"""Repairs against an enumeration of all edits, and rows that stand at the edges."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from parlance.llm import conversation_repair as R

ROLES = {"user": "u", "assistant": "a"}
SCHEMA = "conv_id long, turn long, role string, text string, extra string, present_ int"


def plain(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """The cheapest edits of (role, text, fault), ties by audit: all prefixes in order of cost and audit."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        state = (at, "" if not initials else initials[-1])
        if state in done:
            continue
        done.add(state)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(lines)

        def go(letter, price, step, role=None, text="", cost=cost, audit=audit, at=at, initials=initials, lines=lines):
            now = initials if role is None else initials + role[:1]
            if re.fullmatch("(s?(ua)*u?)?", now):
                heapq.heappush(heap, (cost + price, audit + letter, at + step, now, lines if role is None else (*lines, f"{role}:{text}")))

        for role in ROLES:
            go("I", 3, 0, role)
        if at < len(rows):
            role, text, fault = rows[at]
            go("D", 4, 1)
            if fault not in (R.BLANK, R.REPEAT):
                go("K", 3 * (fault == R.TRUNCATED), 1, role or "-", text)
                for new in ROLES:
                    go("R", 3 + 3 * (fault == R.TRUNCATED), 1, new, text)
    raise AssertionError


def repaired(rows: list[tuple]) -> tuple:
    one = R.Repair()
    for i, (role, text, fault) in enumerate(rows):
        one.add(i, role, text, fault)
    return one.result()


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_the_cheapest_edits_of_least_audit(monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randrange(13))]
        cost, audit, lines = plain(rows)
        got = repaired(rows)
        assert (got[5], got[6], got[7]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_long_conversations_take_linear_time():
    rng = random.Random(3)
    for kind in (["user"], ["assistant", "system"], ["user", "assistant", "system"]):
        rows = [(rng.choice(kind), "t", rng.choice([0, 0, 0, 3])) for _ in range(20_000)]
        began = time.time()
        assert repaired(rows)[5] > 0
        assert time.time() - began < 20


def loop(rows: list[tuple]) -> dict:
    """The query's contract, row by row."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        put = lambda x: " " if x is None else str(x)
        kind, now = zlib.crc32(f"{put(conv)}:{put(turn)}".encode()) % 20, by.setdefault(conv, [])
        role, text = put(role), put(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        now += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            marked.append((role, text, R.BLANK if not bare else R.REPEAT if (role, text) in seen else R.TRUNCATED if bare[-1] not in ".!?" else R.OK))
            seen.add((role, text))
        turns = sorted({r[1] for r in found if r[0]})
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = plain(marked)
        n = [sum(m[2] == k for m in marked) for k in (R.BLANK, R.REPEAT, R.TRUNCATED)]
        out[conv] = (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_is_the_contract(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t", None, "Why?  ", "ä!", "same.", "long " * 4000 + ".", "a.\n\n", "x "]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, -3, *range(6)]), rng.choice(["user", "assistant", "system", None, "", "tool", "assistant", "user"]), rng.choice(texts), "e", 1) for _ in range(400)]
    rows += rows[:30] + [(900 + i, 0, "user", "Alone.", None, None) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = loop(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in R.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(v[6] == "" for v in want.values())


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_conversation_repair(spark, str(tmp_path)).count() == 0
