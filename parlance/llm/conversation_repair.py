"""Repair of a conversation's structure at the least cost, by depth-first branch-and-bound.

A conversation's rows, in order of turn (nulls first; ties by role and text), are edited
until the initials of their roles read ``(s?(ua)+)?``: rows are kept (0), given another
role (3), deleted (4; blank rows and repeats must be) and empty ones inserted (3); a
truncated row that stays adds 3. Of all cheapest lists of edits the one counts whose
initials (K, R, D, I) come first in ASCII order.

Search: a node is (rows done, state of the pattern); a prefix of edits reaches it at a
cost and with an audit (its initials). An explicit stack takes prefixes depth first, the edit
of the least bound next (then in ASCII order). Suffix lower bounds say what finishing from
a node costs at least (the rows one by one from the end; ties set aside). A prefix goes if its cost with that bound is over the incumbent's,
or equal and its audit comes later; a dominance table per node keeps the best (cost,
audit) seen there, and a prefix that isn't better goes. That is safe: two prefixes of one
node at one cost have done the same rows, so neither audit is a beginning of the other
and their order is that of anything they go on to. When the stack is empty the incumbent
is proved to be the best.

Long conversations are searched ``SEGMENT`` rows at a time: a segment starts from the
best prefix of each of the four states and gives the best one for each state at its end,
so memory holds a segment, four prefixes and their running hashes, and the audit (which
is a value of the result). What all four prefixes agree on is put aside.

Work before that (damage, faults) is Spark's: repeats are told by a window over
conversation, role and text hash, so a long conversation is split over tasks. Only the
edited order itself is followed in one task per conversation, as a stream, since the hash
of the repaired text is one chain.

Nulls and edge cases: a null role or text is one space (so blank, or an initial that fits
nothing); a null conversation is one of its own; null turns come first and are no gaps; a role is told by
its first character; equal rows of one turn are repeats; conversations whose rows are all dropped have
zeros, an empty audit and the hash of nothing; an empty table gives no rows. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm._storage import table
from parlance.llm.merkle import CRC32_SQL

RECAST, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows that are searched at once.
SEGMENT = 512
#: States of the pattern: nothing yet, after s, after u, after a. Where a user's or else an assistant's row leads, and by which role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GOALS = (0, 3)
NEVER = 1 << 60
OK, BLANK, REPEAT, TRUNCATED = 0, 1, 2, 3

VISIBLE = r"[^\x20\x09-\x0D]"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: A row as the search sees it: initial of its role, and its fault.
Row = tuple[str, int]


def edits(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """What can be done with a row in a state, in ASCII order: initial, cost, state after it."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (BLANK, REPEAT):
        return
    stays = CUT if fault == TRUNCATED else 0
    after = KEPT.get(initial, {}).get(state)
    if after is not None:
        yield "K", stays, after
    yield "R", RECAST + stays, NEXT[state]


def suffix_bounds(rows: list[Row], goals: tuple[int, ...]) -> list[list[int]]:
    """For each number of rows done and each state: the least cost of coming from there to a goal."""

    def inserted(least: list[int]) -> list[int]:
        for _ in range(2):  # a third insertion in a row comes back to a state that the second passed
            least = [min(c, INSERT + least[NEXT[s]]) for s, c in enumerate(least)]
        return least

    out = [inserted([0 if s in goals else NEVER for s in range(4)])]
    for row in reversed(rows):
        out.append(inserted([min(cost + out[-1][after] for _, cost, after in edits(row, s)) for s in range(4)]))
    return out[::-1]


def search(rows: list[Row], entries: dict[int, tuple[int, str]], goals: tuple[int, ...] = GOALS) -> tuple[int, str, int, str] | None:
    """The best way through rows from entries (state: cost, audit so far) to a goal: cost, audit, entry, own edits."""
    bounds, n = suffix_bounds(rows, goals), len(rows)
    best: tuple[int, str] = (NEVER, "")
    found: tuple[int, str, int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    first = sorted(entries.items(), key=lambda e: (e[1][0] + bounds[0][e[0]], e[1][1]), reverse=True)
    stack = [(0, state, cost, audit, state, "") for state, (cost, audit) in first]
    while stack:
        done, state, cost, audit, entry, own = stack.pop()
        least = cost + bounds[done][state]
        if least >= NEVER or least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        held = seen.get((done, state))
        if held is not None and held <= (cost, audit):
            continue
        seen[done, state] = (cost, audit)
        if done == n and state in goals and (cost, audit) < best:
            best, found = (cost, audit), (cost, audit, entry, own)
        ways = [(e, done + 1, cost + c, after) for e, c, after in edits(rows[done], state)] if done < n else []
        ways.append(("I", done, cost + INSERT, NEXT[state]))
        ways.sort(key=lambda w: (w[2] + bounds[w[1]][w[3]], w[0]), reverse=True)  # the likeliest is taken from the stack first
        stack += [(at, after, c, audit + e, entry, own + e) for e, at, c, after in ways]
    return found


class Repair:
    """One conversation: rows come in order, the result is asked for at the end."""

    def __init__(self):
        self.rows: list[Row] = []
        self.lines: list[tuple[str, str]] = []
        self.prefixes: dict[int, tuple[int, str]] = {0: (0, "")}
        self.hashes = {0: (sha256(), False)}
        self.settled: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.before: str | None = None
        self.turns: tuple[int, int, int] | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            first, last, distinct = self.turns or (turn, turn - 1, 0)
            self.turns = first, turn, distinct + (turn != last)
        self.rows.append((initial, fault))
        self.lines.append((role, text))
        if len(self.rows) == SEGMENT:
            self._close((0,), (1,), (2,), (3,))

    def _close(self, *goals: tuple[int, ...]) -> None:
        """Goes through the rows at hand, once to each of the goals."""
        ends, hashes = {}, {}
        for goal in goals:
            found = search(self.rows, self.prefixes, goal)
            if found:
                cost, audit, entry, own = found
                state, hashed = self._follow(entry, own)
                ends[state], hashes[state] = (cost, audit), hashed
        same = commonprefix([audit for _, audit in ends.values()])
        self.settled.append(same)
        self.prefixes = {s: (cost, audit[len(same) :]) for s, (cost, audit) in ends.items()}
        self.hashes, self.rows, self.lines = hashes, [], []

    def _follow(self, state: int, own: str) -> tuple[int, tuple]:
        """The state after the edits, and the hash with what they leave."""
        value, any_row = self.hashes[state]
        value, at = value.copy(), 0
        for edit in own:
            role, text = ROLE[state], ""
            if edit != "I":
                had, text = self.lines[at]
                role = had if edit == "K" else role
                at += 1
            if edit == "D":
                continue
            value.update(f"{chr(10) * any_row}{role}:{text}".encode())
            any_row = True
            state = KEPT[role[:1]][state] if edit == "K" else NEXT[state]
        return state, (value, any_row)

    def result(self) -> tuple:
        self._close(GOALS)
        ((state, (cost, audit)),) = self.prefixes.items()
        first, last, distinct = self.turns or (0, -1, 0)
        _, blank, repeats, truncated = self.counts
        return (last - first + 1 - distinct, blank, repeats, truncated, self.illegal, cost, "".join([*self.settled, audit]), self.hashes[state][0].hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows with the query's faults put in; a dropped row stays as one that isn't present."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"))
    key = F.concat(plain("conv_id"), F.lit(":"), plain("turn"))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(copies))
    return out.drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault: the first of blank, repeat (role and text seen earlier in the conversation) and truncated that a row has."""
    earlier = F.row_number().over(W.partitionBy("conv_id", "present", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())) > 1
    blank, ended = ~F.col("text").rlike(VISIBLE), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.withColumn("fault", F.when(blank, BLANK).when(earlier, REPEAT).when(~ended, TRUNCATED).otherwise(OK))


def repair(rows: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` for every conversation of rows (conv_id, turn, role, text, present)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, out = None, None, []
        names = [x.split()[0] for x in RESULT.split(", ")]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, columns)], names)

        for b in batches:
            for conv, turn, role, text, fault, present in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "present")]):
                if made is None or conv != now:
                    if made is not None:
                        out.append((now, *made.result()))
                    now, made = conv, Repair()
                if present:
                    made.add(turn, role, text, fault)
            if len(out) > 5000:
                yield batch()
                out = []
        if made is not None:
            out.append((now, *made.result()))
        yield batch()

    ready = with_faults(rows.select("conv_id", "turn", "role", F.when(F.col("present"), F.col("text")).otherwise("").alias("text"), "present"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == REPEAT]
    return ready.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(solve, RESULT)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


def oracle() -> str:
    """The same in DuckDB: the best way to each of the four states, row by row."""

    def way(state: str, cost: str, edit: str, line: str | None = None, when: str = "true") -> str:
        lines = f"{state}.r" if line is None else f"list_append({state}.r, {line})"
        return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {lines}}} end"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    kept = lambda s, initial: way(s, "stays", "K", "role || ':' || text", f"free and left(role, 1) = '{initial}'")
    recast = lambda s, role: way(s, f"stays + {RECAST}", "R", f"'{role}:' || text", "free")
    deleted = lambda s: way(s, str(DELETE), "D")
    put = lambda s, role: way(s, str(INSERT), "I", f"'{role}:'")
    step = f"""(select {deleted("s0")} as t0, {best(deleted("s1"), kept("s0", "s"))} as t1,
      {best(deleted("s2"), *[kept(s, "u") for s in ("s0", "s1", "s3")], *[recast(s, "user") for s in ("s0", "s1", "s3")])} as t2,
      {best(deleted("s3"), kept("s2", "a"), recast("s2", "assistant"))} as t3) t,
    lateral (select {best("t2", put("t0", "user"), put("t1", "user"), put("t3", "user"))} as u2) u"""
    none = "{'c': 0, 'a': '', 'r': []::varchar[]}"
    return f"""
with recursive base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC32_SQL.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind from conversations),
rows_ as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from base),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from rows_),
told as (select *, not regexp_matches(text, '{VISIBLE}') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut from ordered),
x as (select conv_id, i, turn, role, text, blank, not blank and again as again, not blank and not again and cut as cut, not blank and not again as free, case when not blank and not again and cut then {CUT} else 0 end as stays,
  coalesce(left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal from told),
f(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {none}, null::struct(c integer, a varchar, r varchar[]), {{'c': {INSERT}, 'a': 'I', 'r': ['user:']}}, {{'c': {2 * INSERT}, 'a': 'II', 'r': ['user:', 'assistant:']}} from (select distinct conv_id from conversations)
  union all
  select f.conv_id, x.i, t0, t1, u2, {best("t3", put("u2", "assistant"))}
  from f join x on x.conv_id is not distinct from f.conv_id and x.i = f.i + 1, lateral {step}),
ended as (select conv_id, {best("s0", "s3")} as e from f qualify row_number() over (partition by conv_id order by i desc) = 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate, count(*) filter (cut) as truncated, count(*) filter (illegal) as illegal from x group by 1)
select e1.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, e.c::bigint as cost, e.a as audit, sha256(array_to_string(e.r, chr(10))) as repaired_sha256
from ended e1 left join counts c on c.conv_id is not distinct from e1.conv_id"""
