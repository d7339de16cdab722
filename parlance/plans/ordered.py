"""Queries over conversations and events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.adapters import Tables
from parlance.functions import columns as C
from parlance.operators import ordered as O
from parlance.operators import rollups as R
from parlance.registry import query

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(u+h+m+|u+m+|u+h+|erm?|hmm+)\\b[,]?', '', 'g'), ' {2,}', ' ', 'g'), '\\s+([,.!?;:])', '\\1', 'g'), '^[\\s,]+', ''), ',{2,}', ',', 'g'), '^\\s+|\\s+$', '', 'g')"
_CLOCK = "case when start_ms // 1000 >= 3600 then (start_ms // 3600000) || ':' || lpad(((start_ms // 1000) % 3600 // 60)::varchar, 2, '0') else (start_ms // 60000)::varchar end || ':' || lpad(((start_ms // 1000) % 60)::varchar, 2, '0')"
_LINE = f"'**[' || {_CLOCK} || ']' || case track when 'you' then ' You:' when 'them' then ' Them:' else ' Note:' end || '** ' || replace(text, chr(10), ' ')"
_BODY = f"(select call, string_agg({_LINE}, chr(10) || chr(10) order by start_ms, case when track = 'note' then 1 else 0 end, seq) as body from segments group by call)"


def rendered(segments: DataFrame) -> DataFrame:
    """One body per call: its lines by time, notes after speech at the same instant."""
    label = F.when(F.col("track") == "you", " You:").when(F.col("track") == "them", " Them:").otherwise(" Note:")
    line = F.concat(F.lit("**["), C.clock_text(F.col("start_ms")), F.lit("]"), label, F.lit("** "), F.translate("text", "\n", " "))
    rows = segments.groupBy("call").agg(F.sort_array(F.collect_list(F.struct("start_ms", (F.col("track") == "note").cast("int").alias("ord"), "seq", line.alias("line")))).alias("rows"))
    return rows.select("call", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("body"))


@query("segments", f"select call, seq, text from (select call, seq, replace({_CLEAN}, '_zq_', '') as text from (select call, seq, regexp_replace('um, ' || text || ' Hmm , uh yes', '([^\\x00-\\x7F])', '_zq_\\1_zq_', 'g') as text from segments)) where text <> ''")
def clean_segments(t: Tables) -> DataFrame:
    """Whole texts. Only ASCII counts as a word's part to DuckDB's ``\\b``, so its SQL puts marks of ASCII letters around the texts' other letters meanwhile."""
    spoken = F.concat(F.lit("um, "), "text", F.lit(" Hmm , uh yes"))
    return t.segments.select("call", "seq", C.clean_speech(spoken).alias("text")).where("text <> ''")


@query("segments", f"select call, md5(body) as h, length(body) as n from {_BODY}")
def render_transcripts(t: Tables) -> DataFrame:
    return rendered(t.segments).select("call", F.md5("body").alias("h"), F.length("body").alias("n"))


@query("segments", f"select call, n as line_no, regexp_extract(line, '^\\*\\*(\\[[^\\]]*\\])', 1) as stamp, nullif(regexp_extract(line, '^\\*\\*\\[[^\\]]*\\] ?([^:*]*):\\*\\*', 1), '') as speaker, trim(regexp_replace(line, '^\\*\\*.*?\\*\\*', '')) as text from (select call, unnest(string_split(body, chr(10) || chr(10))) as line, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) as n from {_BODY}) where trim(regexp_replace(line, '^\\*\\*.*?\\*\\*', '')) <> ''")
def transcript_lines(t: Tables) -> DataFrame:
    """Spoken lines of rendered bodies, with stamp and speaker."""
    from parlance.sources.markdown import blocks

    rows = blocks(rendered(t.segments), "call", "body").where("block_type = 'audio'")
    n = F.row_number().over(W.partitionBy("call").orderBy("line_no"))
    return rows.select("call", n.alias("line_no"), "stamp", "speaker", "text")


@query("segments", "select call, seq, start_ms, case when two_sided or track = 'note' then track end as speaker, row_number() over (partition by call order by start_ms, track, seq) as place from (select *, count(distinct case when track <> 'note' then track end) over (partition by call) > 1 as two_sided from segments)")
def interleave_tracks(t: Tables) -> DataFrame:
    return O.interleave(t.segments)


@query("segments", "select call, track as speaker, dense_rank() over (partition by call order by min(seq)) - 1 as slot from segments where track not in ('you', 'note') group by 1, 2")
def speaker_slots(t: Tables) -> DataFrame:
    return O.speaker_slots(t.segments.withColumnRenamed("track", "speaker"))


@query("segments", "select call, seq from segments where track = 'them'")
def filter_speaker(t: Tables) -> DataFrame:
    return t.segments.where("track = 'them'").select("call", "seq")


@query("segments", "select call, sha256(string_agg(start_ms || ':' || track || ':' || text, chr(10) order by start_ms, seq)) as hash from segments group by 1")
def content_hash(t: Tables) -> DataFrame:
    line = F.concat(F.col("start_ms").cast("string"), F.lit(":"), "track", F.lit(":"), "text")
    rows = t.segments.groupBy("call").agg(F.sort_array(F.collect_list(F.struct("start_ms", "seq", line.alias("line")))).alias("rows"))
    return rows.select("call", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 256).alias("hash"))


@query("segments", "select call as path, 'chunk' as stage from segments group by call having call % 3 = 0 or call % 5 = 0")
def stale_stages(t: Tables) -> DataFrame:
    from parlance.operators.documents import stale_stages as stale

    now = t.segments.groupBy("call").agg(F.md5(F.array_join(F.array_sort(F.collect_list("text")), "\n")).alias("hash"))
    now = now.select(F.col("call").alias("path"), F.lit("chunk").alias("stage"), "hash")
    ledger = now.where("path % 3 <> 0").withColumn("hash", F.expr("case when path % 5 = 0 then 'old' else hash end"))
    return stale(now, ledger)


@query("segments", "select display, n from (select lower(track) f, min(track) as display, count(distinct call) as n from segments group by 1)")
def rail_facets(t: Tables) -> DataFrame:
    return R.facets(t.segments, "call", "track", "seq")


@query("segments", "select 'calls' as what, count(distinct call) as n from segments union all select 'passages', count(*) from segments")
def index_stats(t: Tables) -> DataFrame:
    calls = t.segments.agg(F.countDistinct("call").alias("n")).select(F.lit("calls").alias("what"), "n")
    return calls.unionByName(t.segments.agg(F.count(F.lit(1)).alias("n")).select(F.lit("passages").alias("what"), "n"))


@query("segments", "select call, seq, text from segments order by call, seq limit 200")
def chunk_sample(t: Tables) -> DataFrame:
    return t.segments.select("call", "seq", "text").orderBy("call", "seq").limit(200)


@query("segments", "select call, case when length(text) <= 600 then text else regexp_replace(right(text, 600), '^\\S*\\s', '') end as tail from (select call, string_agg(text, ' ' order by seq) as text from segments group by 1)")
def text_tail(t: Tables) -> DataFrame:
    rows = t.segments.groupBy("call").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("rows"))
    return rows.select("call", C.tail(F.array_join(F.transform("rows", lambda r: r["text"]), " ")).alias("tail"))


@query("segments", "select call, seq, 'spoken' as kind, length(text) as n from segments union all select page_id, 0, 'screen', length(html) from pages")
def all_chunks(t: Tables) -> DataFrame:
    spoken = t.segments.select("call", "seq", F.lit("spoken").alias("kind"), F.length("text").alias("n"))
    screen = t.pages.select(F.col("page_id").alias("call"), F.lit(0).alias("seq"), F.lit("screen").alias("kind"), F.length("html").alias("n"))
    return spoken.unionByName(screen)


@query("threads", "select id, workspace, turn, role, length(text) as n from threads")
def thread_scan(t: Tables) -> DataFrame:
    """Threads of old and new form: the workspace falls back to the older field, then to none."""
    old = t.threads.select("id", F.expr("case when id % 2 = 0 then workspace end").alias("workspace"), F.expr("case when id % 2 = 1 and workspace <> '' then workspace end").alias("grp"), "turn", "role", "text")
    return old.select("id", F.coalesce("workspace", "grp", F.lit("")).alias("workspace"), "turn", "role", F.length("text").alias("n"))


@query("threads", "select id, left(min_by(text, turn), 44) as title from threads where role = 'user' group by 1")
def thread_titles(t: Tables) -> DataFrame:
    return t.threads.where("role = 'user'").groupBy("id").agg(F.left(F.min_by("text", "turn"), F.lit(44)).alias("title"))


@query("threads", "select workspace, max(id) as id from threads group by 1")
def latest_thread(t: Tables) -> DataFrame:
    return t.threads.groupBy("workspace").agg(F.max("id").alias("id"))


@query("threads", "select id, workspace, turn from threads where workspace <> ''")
def forget_threads(t: Tables) -> DataFrame:
    """Threads without those of one exact workspace; the unnamed one is a workspace of its own."""
    return t.threads.where(~F.col("workspace").eqNullSafe("")).select("id", "workspace", "turn")


@query("threads", "select id, turn, role from (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by turn) as rn, sum(length(text)) over (partition by id order by turn desc) as after, first_value(length(text)) over (partition by id order by turn) as head from threads) where n <= 2 or rn = 1 or rn = n or after + head <= 2000")
def history_trim(t: Tables) -> DataFrame:
    return O.history_trim(t.threads, 2000).select("id", "turn", "role")


@query("threads", "select id, turn, role, last and role = 'assistant' and not regexp_matches(rtrim(text), '[.!?]$') as interrupted from (select *, row_number() over (partition by id order by turn desc) = 1 as last from (select id, turn, role, case when id % 4 = 0 and role = 'assistant' then '  ' else text end as text from threads)) where not (last and role = 'assistant' and trim(text) = '')")
def close_turns(t: Tables) -> DataFrame:
    rows = t.threads.withColumn("text", F.expr("case when id % 4 = 0 and role = 'assistant' then '  ' else text end"))
    return O.close_turns(rows).select("id", "turn", "role", "interrupted")


@query("", "select event_id, case when event_id % 7 = 0 then null else (event_id % 100) * 60000 + (event_id % 60) * 1000 end as own, coalesce(last_value(case when event_id % 7 = 0 then null else (event_id % 100) * 60000 + (event_id % 60) * 1000 end ignore nulls) over (partition by user_id order by event_id), 0) as ms from events")
def stamp_ms(t: Tables) -> DataFrame:
    """Stamps to milliseconds; one that is no stamp keeps the time before."""
    stamp = F.expr("case when event_id % 7 = 0 then '[--]' else '[' || (event_id % 100) || ':' || lpad(event_id % 60, 2, '0') || ']' end")
    rows = t.events.select("event_id", "user_id", C.stamp_ms(stamp).alias("own"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("event_id", "own", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(0)).alias("ms"))


@query("", f"select event_id, {_CLOCK} as clock from (select event_id, event_id * 977 as start_ms from events where event_id * 977 % 1000 < 500) union all select event_id, {_CLOCK} from (select event_id, event_id * 977 + 500 as start_ms from events where event_id * 977 % 1000 >= 500)")
def clock_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.clock_text(F.col("event_id") * 977).alias("clock"))


@query("", "select event_id, case event_id % 3 when 0 then event_id % 90 when 1 then (event_id % 3) * 60 + event_id % 60 else 15 end as minutes, case when event_id % 2 = 0 then (event_id % 24) * 60 + event_id % 60 else 540 end as starts from events")
def duration_minutes(t: Tables) -> DataFrame:
    text = F.expr("case event_id % 3 when 0 then (event_id % 90) || ':00' when 1 then (event_id % 3) || ':' || lpad(event_id % 60, 2, '0') || ':30' else 'long' end")
    start = F.expr("case when event_id % 2 = 0 then (event_id % 24) || ':' || lpad(event_id % 60, 2, '0') else '' end")
    return t.events.select("event_id", C.duration_minutes(text).alias("minutes"), C.start_minutes(start).alias("starts"))


@query("", "select event_type, max(case when i = least(n - 1, floor(0.5 * n)) then value end) as p50, max(case when i = least(n - 1, floor(0.95 * n)) then value end) as p95 from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) group by 1")
def nearest_rank_pct(t: Tables) -> DataFrame:
    return R.nearest_rank(t.events, "event_type", "value", (0.5, 0.95))


@query("samples", "select event_id, s.track, x * (0.7 / top) as x from samples s join (select track, max(abs(x)) as top from samples group by 1) m on s.track = m.track where top > 0.02")
def peak_normalize(t: Tables) -> DataFrame:
    return O.peak_normalize(t.samples)


@query("passes", "select event_id, scope, attempted, outcome, succeeded, frozen, case when frozen then min(case when frozen then attempted end) over (partition by scope, run order by attempted, event_id rows unbounded preceding) end as frozen_since from (select *, outcome = 'compose_failed' as frozen, last_value(case when outcome <> 'compose_failed' then attempted end ignore nulls) over w as succeeded, sum(case when outcome <> 'compose_failed' then 1 else 0 end) over w as run from passes window w as (partition by scope order by attempted, event_id rows unbounded preceding))")
def refresh_status(t: Tables) -> DataFrame:
    return O.refresh_status(t.passes)


MOVED = "select event_id, scope, was is not null as known, poll > 0 and attempted is not null and was is distinct from attempted as moved from (select *, last_value(attempted ignore nulls) over (partition by scope order by poll, event_id rows between unbounded preceding and 1 preceding) as was from polls)"


@query("polls", MOVED)
def scope_moved(t: Tables) -> DataFrame:
    return O.scope_moved(t.polls)


LATE = "select event_id, key, generation, arrival from (select *, max(generation) over (partition by key order by arrival, event_id rows unbounded preceding) as top from replies) where generation >= top"


@query("replies", LATE)
def late_replies(t: Tables) -> DataFrame:
    return O.late_replies(t.replies)


@query("passes", "select scope, cast(attempted as date) as day, bool_or(outcome = 'compose_failed') as degraded, count(*) filter (outcome = 'compose_failed') as unavailable, case when bool_or(outcome = 'unchanged') then null else round(0.593 / 0.698, 9) end as share from passes group by 1, 2")
def run_quality(t: Tables) -> DataFrame:
    """Whether a scope's runs of a day fell back, and their share of the measured ceiling (null where it was not measured)."""
    failed = F.col("outcome") == "compose_failed"
    rows = t.passes.groupBy("scope", F.col("attempted").cast("date").alias("day"))
    return rows.agg(F.bool_or(failed).alias("degraded"), F.count_if(failed).alias("unavailable"), F.when(~F.bool_or(F.col("outcome") == "unchanged"), F.round(F.lit(0.593) / F.lit(0.698), 9)).alias("share"))


_SERVICE = "case when contains(lower(location), 'zoom.us') then 'Zoom' when contains(lower(location), 'teams.live.com') then 'Teams' end"


@query("recordings meetings", f"select recording, meeting, service, overlap_us from (select *, row_number() over (partition by recording order by service is null, overlap_us desc, meeting) as n from (select recording, meeting, {_SERVICE} as service, epoch_us(least(r.end_ts, m.end_ts)) - epoch_us(greatest(r.start_ts, m.start_ts)) as overlap_us from recordings r join meetings m on m.calendar = r.calendar and m.start_ts < r.end_ts and m.end_ts > r.start_ts where not all_day)) where n = 1")
def meeting_match(t: Tables) -> DataFrame:
    return O.meeting_match(t.recordings, t.meetings)


@query("meetings", f"select meeting, start_ts, calendar, service from (select *, {_SERVICE} as service from meetings) where start_ts between timestamp '2024-01-10' and timestamp '2024-01-12' and calendar in (1, 2, 3) and service is not null")
def upcoming_calls(t: Tables) -> DataFrame:
    return upcoming(t.meetings, "2024-01-10", "2024-01-12", [1, 2, 3]).select("meeting", "start_ts", "calendar", "service")


def upcoming(meetings: DataFrame, since: str, until: str, calendars: list[int] | None = None) -> DataFrame:
    """Meetings within a horizon that name a video service, with it; an empty or missing list of calendars watches all."""
    rows = meetings.where(F.col("start_ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    rows = rows.where(F.col("calendar").isin(*calendars)) if calendars else rows
    return rows.withColumn("service", C.video_service(F.col("location"))).where("service is not null")


@query("meetings", "select meeting, start_ts from meetings where start_ts >= timestamp '2024-01-10' order by start_ts, meeting limit 6")
def next_up(t: Tables) -> DataFrame:
    return t.meetings.where(F.col("start_ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("meeting", "start_ts").orderBy("start_ts", "meeting").limit(6)


@query("meetings", "select meeting, coalesce(case calendar when 1 then 'Alpha' when 2 then 'Beta' end, 'active') as grp from meetings")
def meetings_in_workspace(t: Tables) -> DataFrame:
    """Meetings to the workspace of their calendar, else to the active one; the map of calendars is small and fixed."""
    known = t.spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "calendar long, grp string")
    return t.meetings.join(F.broadcast(known), "calendar", "left").select("meeting", F.coalesce("grp", F.lit("active")).alias("grp"))


@query("", "select doc_id, line from (select doc_id, trim(unnest(string_split(text || chr(10) || '12:30' || chr(10) || 'ab' || chr(10) || '50% +3', chr(10)))) as line from documents) where length(line) > 2 and not regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[\\p{N}:.%+/\\-]*$') group by 1, 2")
def noise_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(O.comparison_lines(F.concat("text", F.lit("\n12:30\nab\n50% +3")))).alias("line"))


@query("", "with l as (select distinct doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), k0 as (select * from l where length(line) > 2 and not regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[\\p{N}:.%+/\\-]*$')), d as (select doc_id, string_agg(line, chr(10) order by line) as body, count(*) as c from k0 group by 1), n as (select min(doc_id) as doc_id, any_value(c) as c, count(*) as copies from d group by body), k as (select k0.* from k0 join n using (doc_id)) select a.doc_id as a, b.doc_id as b, any_value(x.copies) as a_copies, any_value(y.copies) as b_copies, count(*) as common, round(count(*) / (any_value(x.c) + any_value(y.c) - count(*)), 9) as jaccard from k a join k b on a.line = b.line and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by 1, 2 having count(*) / (any_value(x.c) + any_value(y.c) - count(*)) >= 0.5")
def line_jaccard(t: Tables) -> DataFrame:
    """Pairs of line sets that are alike by half or more. Documents of one set are one, named by the smallest id, with its copies."""
    return O.line_pairs(t.documents, lines=O.comparison_lines(F.col("text")))


@query("", "with e as (select user_id as note, row_number() over (partition by user_id order by ts, event_id) as entry_no, ts as stamp, 'event ' || event_id as text from events where event_type = 'view'), n as (select user_id as note, row_number() over (partition by user_id order by ts, event_id) as k, ts as stamp, 'event ' || event_id as text from events where event_type = 'click') select note, entry_no, stamp, text, false as created from e union all select note, k + coalesce(last, 0), stamp, text, last is null from n left join (select note, max(entry_no) as last from e group by 1) using (note)")
def capture_append(t: Tables) -> DataFrame:
    """Captures appended to a workspace's rolling note, which is made where there is none: the entries of all notes."""
    rows = t.events.select(F.col("user_id").alias("note"), F.col("ts").alias("stamp"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("id"), "event_type")
    notes = O.append_entries(None, rows.where("event_type = 'view'")).drop("created")
    return O.append_entries(notes, rows.where("event_type = 'click'"))


@query("", "with m as (select user_id as call, event_id as id, epoch_us(ts) // 1000 as ts_ms, case event_type when 'view' then 'pause' when 'click' then 'resume' else 'note' end as kind from events), s as (select *, last_value(case when kind <> 'note' then kind end ignore nulls) over (partition by call order by ts_ms, id rows between unbounded preceding and 1 preceding) as was, last_value(case when kind <> 'note' then kind end ignore nulls) over (partition by call order by ts_ms, id rows unbounded preceding) as now, min(ts_ms) over (partition by call) as start from m), o as (select *, last_value(case when kind = 'pause' and coalesce(was, 'resume') <> 'pause' then ts_ms end ignore nulls) over (partition by call order by ts_ms, id rows unbounded preceding) as opened from s), p as (select *, sum(case when kind = 'resume' and was = 'pause' then ts_ms - opened else 0 end) over (partition by call order by ts_ms, id rows unbounded preceding) as paused from o) select call, id, kind, (ts_ms - start - paused - case when now = 'pause' then ts_ms - opened else 0 end)::bigint as elapsed_ms from p")
def pause_splice(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "pause").when(F.col("event_type") == "click", "resume").otherwise("note")
    return O.pause_splice(t.events.select(F.col("user_id").alias("call"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), kind.alias("kind")))


@query("", "select user_id as path, clock, min(event_id) as event_id, min_by('caption ' || event_id, event_id) as caption from (select *, lpad(hour(ts)::varchar, 2, '0') || ':' || lpad(minute(ts)::varchar, 2, '0') as clock from events) group by 1, 2")
def caption_patch(t: Tables) -> DataFrame:
    """Captions onto the first screen entry of their call and clock text."""
    rows = t.events.select(F.col("user_id").alias("path"), F.date_format("ts", "HH:mm").alias("clock"), "event_id")
    first = R.first_by(rows, ["path", "clock"], ["event_id"])
    captions = rows.select("path", "clock", F.concat(F.lit("caption "), F.col("event_id").cast("string")).alias("caption"), F.col("event_id").alias("c_id"))
    return first.join(captions, ["path", "clock"], "left").where("c_id = event_id").select("path", "clock", "event_id", "caption")


_CHUNKS = """l as (select call, start_ms::bigint as ms, track as speaker, text, row_number() over (partition by call order by seq, start_ms, track, text) as n from segments where text <> ''),
f(call, n, chunk, start_ms, end_ms, speaker, text) as (
  select call, n, 0, ms, ms, speaker, text from l where n = 1
  union all
  select l.call, l.n, f.chunk + fresh::int, case when fresh then l.ms else f.start_ms end, l.ms, case when fresh then l.speaker else f.speaker end, case when fresh then l.text else f.text || ' ' || l.text end
  from f join l on l.call = f.call and l.n = f.n + 1, lateral (select f.speaker is distinct from l.speaker or length(f.text) >= 500 or l.ms - f.start_ms >= 45000 as fresh) x)"""


@query("segments", f"select call, chunk as chunk_no, start_ms, end_ms, speaker, trim(text) as text from (select *, row_number() over (partition by call, chunk order by n desc) as last from f) where last = 1 and trim(text) <> ''", ctes=_CHUNKS)
def turn_chunks(t: Tables) -> DataFrame:
    return O.turn_chunks(t.segments.select("call", "seq", F.col("start_ms").alias("ms"), F.col("track").alias("speaker"), "text"))


SCREEN_TEXTS = """l as (select conv_id as call, turn as seq, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 2 and not regexp_matches(regexp_replace(x, '\\s', '', 'g'), '^[\\p{N}:.%+/\\-]*$'))) as lines from conversations),
k as (select *, row_number() over (partition by call order by seq) as n from l where len(lines) > 0),
f(call, n, seq, lines, kept) as (
  select call, n, seq, lines, true from k where n = 1
  union all
  select k.call, k.n, k.seq, case when new then k.lines else f.lines end, new
  from f join k on k.call = f.call and k.n = f.n + 1, lateral (select len(list_intersect(f.lines, k.lines)) / len(list_distinct(list_concat(f.lines, k.lines))) < 0.85 as new) x)"""


def screen_texts(t: Tables) -> DataFrame:
    """The turns of conversations as captures of a call."""
    return t.conversations.select(F.col("conv_id").alias("call"), F.col("turn").cast("long").alias("seq"), O.comparison_lines(F.col("text")).alias("lines"))


@query("", f"with recursive {SCREEN_TEXTS} select call, seq from f where kept")
def screen_dedup(t: Tables) -> DataFrame:
    return O.screen_dedup(screen_texts(t))


_LANES = """e as (select grp, day, path as id, start_min, (start_min + greatest(15, duration_min))::bigint as stop, row_number() over (partition by grp, day order by start_min, path) as n, count(*) over (partition by grp, day) as size from calls),
f(grp, day, n, size, id, lane, ends) as (
  select grp, day, n, size, id, 0, [stop] from e where n = 1
  union all
  select e.grp, e.day, e.n, e.size, e.id, (case when free > 0 then free - 1 else len(f.ends) end)::int,
    case when free > 0 then list_concat(list_concat(f.ends[1:free - 1], [e.stop]), f.ends[free + 1:]) else list_append(f.ends, e.stop) end
  from f join e on e.grp = f.grp and e.day = f.day and e.n = f.n + 1, lateral (select coalesce(list_position(list_transform(f.ends, lambda x: x <= e.start_min), true), 0) as free) x)"""


@query("calls", "select f.grp, f.day, f.id, f.lane, len(g.ends) as lanes from f join f g on g.grp = f.grp and g.day = f.day and g.n = g.size", ctes=_LANES)
def calendar_lanes(t: Tables) -> DataFrame:
    """Lanes of each workspace's day."""
    return O.calendar_lanes(t.calls.select("grp", "day", F.col("path").alias("id"), "start_min", "duration_min"))


DWELL = """e as (select *, row_number() over (partition by call order by ts, event_id) as n from screens),
f(call, n, event_id, out, settled, candidate, hits) as (
  select call, n, event_id, false, null::bigint, hash, 1 from e where n = 1
  union all
  select e.call, e.n, e.event_id, done, case when done then cand else f.settled end, case when same or done then null else cand end, case when same or done then 0 else h end
  from f join e on e.call = f.call and e.n = f.n + 1,
    lateral (select coalesce(bit_count(xor(e.hash, f.settled)) <= 6, false) as same, coalesce(bit_count(xor(e.hash, f.candidate)) <= 6, false) as again) x,
    lateral (select case when again then f.candidate else e.hash end as cand, case when again then f.hits + 1 else 1 end as h) y,
    lateral (select not same and h >= 2 as done) z)"""


@query("screens", "select call, event_id from f where out", ctes=DWELL)
def screen_dwell(t: Tables) -> DataFrame:
    return O.screen_dwell(t.screens)
