"""Ordered work inside calls and threads: chunking, trimming, lanes, matching in time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.columns import video_service
from parlance.operators.folds import sorted_fold
from parlance.sources.storage import broadcast_few, stored

MAX_CHUNK_CHARS, MAX_CHUNK_MS = 500, 45_000


def turn_chunks(lines: DataFrame, max_chars: int = MAX_CHUNK_CHARS, max_ms: int = MAX_CHUNK_MS) -> DataFrame:
    """Lines (call, seq, ms, speaker, text) to chunks: a new one on another speaker, or when the running one is full.

    The budget starts anew with every chunk, so this is a fold over the call's sorted lines, linear in them: a chunk's texts are kept
    as a list until it closes. Lines without text are passed over; a line or chunk without a time never fills a chunk by its length in time;
    chunks of nothing but spaces take a number but give no row.
    """

    def closed(now: dict) -> list[tuple]:
        text = " ".join(now["texts"]).strip(" ")
        return [(now["no"], now["start"], now["end"], now["speaker"], text)] if text else []

    def step(now: dict | None, x: dict) -> tuple[dict, list[tuple]]:
        late = now is not None and None not in (x["ms"], now["start"]) and x["ms"] - now["start"] >= max_ms
        if now is not None and now["speaker"] == x["speaker"] and now["size"] < max_chars and not late:
            now["texts"].append(x["text"])
            now["size"] += 1 + len(x["text"])
            now["end"] = x["ms"]
            return now, []
        fresh = {"no": 0 if now is None else now["no"] + 1, "start": x["ms"], "end": x["ms"], "speaker": x["speaker"], "texts": [x["text"]], "size": len(x["text"])}
        return fresh, [] if now is None else closed(now)

    rows = lines.where(F.col("text") != "").select("call", "seq", F.col("ms").cast("long").alias("ms"), F.col("speaker").cast("string").alias("speaker"), F.col("text").cast("string").alias("text"))
    made = [("chunk_no", T.IntegerType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("speaker", T.StringType()), ("text", T.StringType())]
    return sorted_fold(rows, ["call"], ["seq", "ms", "speaker", "text"], made, lambda: None, step, closed)


def history_trim(turns: DataFrame, budget: int) -> DataFrame:
    """Turns (id, turn, text): the oldest go until the rest fits; the first and last always stay; threads of two stay whole."""
    w = W.partitionBy("id")
    size = F.length("text")
    rows = turns.withColumns({"_n": F.count(F.lit(1)).over(w), "_rn": F.row_number().over(w.orderBy("turn")), "_after": F.sum(size).over(w.orderBy(F.desc("turn")))})
    first = F.max(F.when(F.col("_rn") == 1, size)).over(w)
    rows = rows.withColumn("_first", first)
    return rows.where((F.col("_n") <= 2) | F.col("_rn").isin(1) | (F.col("_rn") == F.col("_n")) | (F.col("_after") + F.col("_first") <= budget)).drop("_n", "_rn", "_after", "_first")


def close_turns(turns: DataFrame) -> DataFrame:
    """A trailing empty answer goes, a trailing partial one (no final stop) is marked as interrupted."""
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("turn"))) == 1
    rows = turns.withColumn("_last", last & (F.col("role") == "assistant"))
    rows = rows.where(~(F.col("_last") & (F.trim("text") == "")))
    return rows.withColumn("interrupted", F.col("_last") & ~F.rtrim("text").rlike(r"[.!?]$")).drop("_last")


def screen_dedup(screens: DataFrame, below: float = 0.85) -> DataFrame:
    """Captures (call, seq, lines array) that differ from the last kept one; empty and null sets are dropped. A fold per call that holds the last kept set."""

    def step(last: set, x: dict) -> tuple[set, list[tuple]]:
        now = set(x["lines"])
        return (now, [(x["seq"],)]) if len(now & last) / len(now | last) < below else (last, [])

    rows = screens.where(F.size("lines") > 0).select("call", F.col("seq").cast("long").alias("seq"), "lines")
    return sorted_fold(rows, ["call"], ["seq", "lines"], [("seq", T.LongType())], set, step)


def comparison_lines(text: Column) -> Column:
    """Trimmed lines of more than two characters that are not only clocks, counters or badges."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: (F.length(x) > 2) & ~F.regexp_replace(x, r"\s", "").rlike(r"^[\p{N}:.%+/\-]*$")))


def line_pairs(docs: DataFrame, least: float = 0.5, lines: Column | str = "lines") -> DataFrame:
    """a, b, a_copies, b_copies, common, jaccard: pairs of distinct line sets (of docs: doc_id and what ``lines`` is made of) that are alike by ``least`` or more.

    A pair that is must share one of the rarest lines of both (all but so many as the rest could make up for), so
    lines that many documents have are hardly joined on. Sets are told apart by their SHA-256, and lines stand as 64-bit hashes: lines of one hash
    can only make more candidates, never fewer. Candidates are sifted by their hashes, and the lines of those that may be alike are compared.
    """
    lined = lambda df: df.select("doc_id", (F.col(lines) if isinstance(lines, str) else lines).alias("lines"))
    digest = F.unhex(F.sha2(F.to_json(F.array_sort("lines")), 256))
    hashes = F.array_sort(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))))
    sets = lined(docs).select("doc_id", F.size("lines").alias("n"), digest.alias("digest"), hashes.alias("hashes"))
    sets = stored(sets.groupBy("digest", "n", "hashes").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "line-sets")
    rows = sets.select("doc_id", "n", F.size("hashes").alias("m"), F.explode("hashes").alias("line"))
    used = stored(rows.groupBy("line").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "shared-lines")
    shared = rows.join(broadcast_few(used), "line").groupBy("doc_id", "n", "m").agg(F.array_sort(F.collect_list(F.struct("uses", "line"))).alias("rare"))
    # Lines of one set only come first in the order; what is left of the prefix is taken from the shared ones.
    prefix = F.col("n") - F.ceil(F.col("n") * least) + 1 - (F.col("m") - F.size("rare"))
    heads = shared.where(prefix > 0).select("doc_id", "n", F.explode(F.slice("rare", F.lit(1), prefix.cast("int"))).alias("x")).select("doc_id", "n", "x.line")
    of = lambda x: heads.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), "line")
    near = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    pairs = of("a").join(of("b"), "line").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("digest").alias(f"d{x}"), F.col("hashes").alias(f"h{x}"), F.col("copies").alias(f"{x}_copies"))
    # At most so many lines in common: lines of a that share a hash with another of a may all be among them.
    most = F.size(F.array_intersect("ha", "hb")) + F.col("na") - F.size("ha")
    may = pairs.join(side("a"), "a").join(side("b"), "b").where(most >= (F.col("na") + F.col("nb") - most) * least)
    may = stored(may.select("a", "b", "da", "db", "a_copies", "b_copies"), "line-pairs")
    asked = may.select(F.col("a").alias("doc_id")).union(may.select("b")).distinct()
    texts = lined(docs.join(broadcast_few(asked), "doc_id", "left_semi")).select("doc_id", "lines", digest.alias("digest")).dropDuplicates(["doc_id", "digest"])
    whole = lambda x: texts.select(F.col("doc_id").alias(x), F.col("digest").alias(f"d{x}"), F.col("lines").alias(f"l{x}"))
    both = may.join(whole("a"), ["a", "da"]).join(whole("b"), ["b", "db"]).withColumn("common", F.size(F.array_intersect("la", "lb")).cast("long"))
    alike = F.col("common") / (F.size("la") + F.size("lb") - F.col("common"))
    return both.where(alike >= least).select("a", "b", "a_copies", "b_copies", "common", F.round(alike, 9).alias("jaccard"))


def append_entries(notes: DataFrame | None, captures: DataFrame) -> DataFrame:
    """Captures (note, stamp, text, id) in order after the entries (note, entry_no, stamp, text) that their notes have: all entries, with ``created`` for those of new notes."""
    place = F.row_number().over(W.partitionBy("note").orderBy("stamp", "id"))
    rows = captures.select("note", place.cast("long").alias("place"), "stamp", "text")
    if notes is None:
        return rows.select("note", F.col("place").alias("entry_no"), "stamp", "text", F.lit(True).alias("created"))
    last = notes.groupBy("note").agg(F.max("entry_no").alias("last"))
    new = rows.join(last, "note", "left").select("note", (F.col("place") + F.coalesce("last", F.lit(0))).alias("entry_no"), "stamp", "text", F.col("last").isNull().alias("created"))
    return notes.select("note", "entry_no", "stamp", "text", F.lit(False).alias("created")).unionByName(new)


def speaker_slots(lines: DataFrame) -> DataFrame:
    """Speakers (call, seq, speaker) in order of first appearance; one's own labels take no slot."""
    first = lines.where(~F.col("speaker").isin("you", "note")).groupBy("call", "speaker").agg(F.min("seq").alias("first"))
    return first.select("call", "speaker", (F.dense_rank().over(W.partitionBy("call").orderBy("first")) - 1).alias("slot"))


def interleave(segments: DataFrame) -> DataFrame:
    """Both tracks in one order; labels only where both spoke."""
    both = F.size(F.collect_set(F.when(F.col("track") != "note", F.col("track"))).over(W.partitionBy("call"))) > 1
    order = W.partitionBy("call").orderBy("start_ms", "track", "seq")
    return segments.select("call", "seq", "start_ms", F.when(both | (F.col("track") == "note"), F.col("track")).alias("speaker"), F.row_number().over(order).alias("place"))


def pause_splice(marks: DataFrame) -> DataFrame:
    """Marks (call, ts_ms, kind: pause, resume, note; id) to elapsed time without the pauses; an open pause stands still."""
    w = W.partitionBy("call").orderBy("ts_ms", "id")
    state = F.last(F.when(F.col("kind").isin("pause", "resume"), F.struct("kind", "ts_ms")), ignorenulls=True)
    rows = marks.withColumns({"_now": state.over(w.rowsBetween(W.unboundedPreceding, 0)), "_was": state.over(w.rowsBetween(W.unboundedPreceding, -1)), "_start": F.min("ts_ms").over(W.partitionBy("call"))})
    pause = F.when((F.col("kind") == "resume") & (F.col("_was.kind") == "pause"), F.col("ts_ms") - F.col("_open")).otherwise(0)
    opened = F.last(F.when((F.col("kind") == "pause") & (F.coalesce(F.col("_was.kind"), F.lit("resume")) != "pause"), F.col("ts_ms")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_open", opened).withColumn("_paused", F.sum(pause).over(w.rowsBetween(W.unboundedPreceding, 0)))
    standing = F.when(F.col("_now.kind") == "pause", F.col("ts_ms") - F.col("_open")).otherwise(0)
    return rows.select("call", "id", "kind", (F.col("ts_ms") - F.col("_start") - F.col("_paused") - F.coalesce(standing, F.lit(0))).alias("elapsed_ms"))


def peak_normalize(samples: DataFrame, silent: float = 0.02, peak: float = 0.7) -> DataFrame:
    """Tracks whose peak is over the silence, scaled to one peak."""
    top = samples.groupBy("track").agg(F.max(F.abs("x")).alias("top")).where(F.col("top") > silent)
    return samples.join(top, "track").select("event_id", "track", (F.col("x") * (F.lit(peak) / F.col("top"))).alias("x"))


def refresh_status(passes: DataFrame) -> DataFrame:
    """Passes (scope, attempted, outcome) with the last success carried on and the first failure since then."""
    w = W.partitionBy("scope").orderBy("attempted", "event_id").rowsBetween(W.unboundedPreceding, 0)
    failed = F.col("outcome") == "compose_failed"
    rows = passes.withColumn("succeeded", F.last(F.when(~failed, F.col("attempted")), ignorenulls=True).over(w)).withColumn("_run", F.sum((~failed).cast("int")).over(w))
    since = F.min(F.when(failed, F.col("attempted"))).over(W.partitionBy("scope", "_run").orderBy("attempted", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("event_id", "scope", "attempted", "outcome", "succeeded", failed.alias("frozen"), F.when(failed, since).alias("frozen_since"))


def meeting_match(recordings: DataFrame, meetings: DataFrame) -> DataFrame:
    """For each recording (recording, calendar, start_ts, end_ts) the meeting of its calendar (meeting, calendar, start_ts, end_ts, location,
    all_day) that it was made of: one with a video service first, then the longest overlap (in microseconds), then the smaller id. All-day
    events take no part.

    The range join goes by calendar and hour, so it is an equi-join: each side stands in the hours that it touches, and a pair
    counts in the first hour that it shares.
    """
    hour = lambda c: F.date_trunc("hour", F.col(c).cast("timestamp"))
    hours = lambda a, b: F.explode(F.sequence(hour(a), hour(b), F.expr("interval 1 hour"))).alias("hour")
    r = recordings.where("start_ts <= end_ts").select("recording", "calendar", "start_ts", "end_ts", hours("start_ts", "end_ts"))
    m = meetings.where("not all_day and start_ts <= end_ts").select("meeting", "calendar", F.col("start_ts").alias("m_start"), F.col("end_ts").alias("m_end"), video_service(F.col("location")).alias("service"), hours("start_ts", "end_ts"))
    once = F.col("hour") == F.greatest(hour("start_ts"), hour("m_start"))
    overlap = F.unix_micros(F.least("end_ts", "m_end").cast("timestamp")) - F.unix_micros(F.greatest("start_ts", "m_start").cast("timestamp"))
    pairs = r.join(m, ["calendar", "hour"]).where(once).withColumn("overlap_us", overlap).where("overlap_us > 0")
    best = F.min(F.struct(F.col("service").isNull().alias("plain"), (-F.col("overlap_us")).alias("o"), "meeting", "service")).alias("best")
    return pairs.groupBy("recording").agg(best).select("recording", "best.meeting", "best.service", (-F.col("best.o")).alias("overlap_us"))


def calendar_lanes(events: DataFrame, least: int = 15) -> DataFrame:
    """Events (grp, day, id, start_min, duration_min) to lanes: each takes the first lane of its workspace's day that is free at its start.

    A fold with two heaps, of the busy lanes by their ends and of the free ones, so an event costs the logarithm of the lanes. Events without a
    start have no place in a day and are left out; one without a duration takes the least.
    """

    def step(state: list, x: dict) -> tuple[list, list[tuple]]:
        busy, free, n = state
        while busy and busy[0][0] <= x["start_min"]:
            heapq.heappush(free, heapq.heappop(busy)[1])
        lane = heapq.heappop(free) if free else n
        heapq.heappush(busy, (x["end"], lane))
        return [busy, free, max(n, lane + 1)], [(x["id"], lane)]

    end = F.col("start_min") + F.greatest(F.lit(least), "duration_min")
    rows = events.where(F.col("start_min").isNotNull()).select("grp", "day", F.col("id").cast("long").alias("id"), F.col("start_min").cast("long").alias("start_min"), end.cast("long").alias("end"))
    placed = sorted_fold(rows, ["grp", "day"], ["start_min", "id", "end"], [("id", T.LongType()), ("lane", T.IntegerType())], lambda: [[], [], 0], step)
    return placed.select("grp", "day", "id", "lane", (F.max("lane").over(W.partitionBy("grp", "day")) + 1).alias("lanes"))


def scope_moved(polls: DataFrame) -> DataFrame:
    """Listed scopes (event_id, poll from 0, scope, attempted) with whether the scope's last refresh attempt is another than the last one
    known. Listings without an attempt tell nothing, and poll 0 is the baseline; later a scope that is new has moved."""
    earlier = F.last("attempted", ignorenulls=True).over(W.partitionBy("scope").orderBy("poll", "event_id").rowsBetween(W.unboundedPreceding, -1))
    rows = polls.withColumn("_was", earlier)
    moved = (F.col("poll") > 0) & F.col("attempted").isNotNull() & ~F.col("_was").eqNullSafe(F.col("attempted"))
    return rows.select("event_id", "scope", F.col("_was").isNotNull().alias("known"), moved.alias("moved"))


def late_replies(replies: DataFrame) -> DataFrame:
    """Replies of a generation older than one that has already come are dropped."""
    w = W.partitionBy("key").orderBy("arrival", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return replies.withColumn("_max", F.max("generation").over(w)).where(F.col("generation") >= F.col("_max")).drop("_max")


def screen_dwell(screens: DataFrame, same_bits: int = 6, dwell: int = 2) -> DataFrame:
    """Screens (call, ts, hash, id) that became the settled one: another screen, seen so many times in a row. Small differences are the same screen."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = dwell_fold(((r.event_id, int(r.hash)) for r in pdf.sort_values(["ts", "event_id"]).itertuples()), None, None, 0, same_bits, dwell)[0]
        return pd.DataFrame({"call": pdf["call"].iloc[0], "event_id": out})[["call", "event_id"]]

    return screens.groupBy("call").applyInPandas(settle, "call long, event_id long")


def dwell_fold(rows: Iterator[tuple[int, int]], settled: int | None, candidate: int | None, hits: int, same_bits: int = 6, dwell: int = 2) -> tuple[list[int], int | None, int | None, int]:
    """One call's state machine: the ids that settle, and the state after them."""
    out = []
    for event_id, value in rows:
        if settled is not None and (value ^ settled).bit_count() <= same_bits:
            candidate, hits = None, 0
            continue
        if candidate is not None and (value ^ candidate).bit_count() <= same_bits:
            hits += 1
        else:
            candidate, hits = value, 1
        if hits >= dwell:
            out.append(event_id)
            settled, candidate, hits = candidate, None, 0
    return out, settled, candidate, hits
