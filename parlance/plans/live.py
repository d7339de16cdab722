"""Streaming queries, sources and sinks over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.adapters import Tables
from parlance.operators import ordered as O
from parlance.operators.index import PublishedCorpus
from parlance.operators.search import TOPIC_WEIGHTS
from parlance.plans import search as P
from parlance.plans.ordered import DWELL, LATE, MOVED, SCREEN_TEXTS, rendered, screen_texts
from parlance.registry import query
from parlance.sources import markdown as M
from parlance.sources.storage import SnapshotTable, broadcast_few, fresh_path, stored
from parlance.streaming import live as L


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("call"), F.col("event_type").alias("track"), F.col("ts").cast("timestamp").alias("ts"))


@query("", "select distinct user_id as call, event_type as track, i as line_no, 'line ' || i as line from (select user_id, event_type, unnest(range(0, event_id % 5 + 1)) as i from events)")
def stream_lines(t: Tables) -> DataFrame:
    lines = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: F.concat(F.lit("line "), i.cast("string")))
    return L.drain(L.unseen_lines(L.replay(_events(t).withColumn("lines", lines), "ts", "call")))


@query("", "select user_id as call, event_type as track, arg_max('text ' || event_id, (ts, event_id)) as text from events group by 1, 2")
def stream_partials(t: Tables) -> DataFrame:
    rows = _events(t).withColumn("text", F.concat(F.lit("text "), F.col("event_id").cast("string")))
    out = fresh_path(t.spark, "partials")
    L.drain_batches(L.latest_partials(L.replay(rows, "ts", "call", parts=3)), lambda b, _: b.write.mode("overwrite").parquet(out), "complete")
    return t.spark.read.parquet(out)


def _spoken(t: Tables) -> DataFrame:
    """The conversations as lines of live calls that all begin together, and a last heartbeat."""
    lines = t.conversations.select(F.col("conv_id").alias("call"), F.col("turn").alias("seq"), (F.col("turn") * 15000).cast("long").alias("ms"), "text")
    beat = t.conversations.agg(F.max("turn").alias("last")).select(F.lit(-1).cast("long").alias("call"), (F.col("last") + 1).alias("seq"), ((F.col("last") + 1) * 15000 + 10_000_000).cast("long").alias("ms"), F.lit(None).cast("string").alias("text"))
    return L.replay(lines.unionByName(beat), "seq", "call", parts=2)


def _ticks_sql(every: int, tail: str, ready: str) -> list[str]:
    """Questions (q, call, tick, query) of the conversations as live calls."""
    return [
        f"lines as (select conv_id as call, turn as seq, ceil(turn * 15000 / {every})::bigint as tick, replace(text, chr(10), ' ') as text from conversations)",
        "said as (select t.call, t.tick, regexp_replace(string_agg(l.text, ' ' order by seq), '^\\s+|\\s+$', '', 'g') as flat from (select distinct call, tick from lines) t join lines l on l.call = t.call and l.tick <= t.tick group by 1, 2)",
        f"cut as (select call, tick, {tail} as query from said)",
        f"ticks as (select call || '/' || tick as q, call, tick, query from (select *, lag(query) over (partition by call order by tick) as was from cut where {ready}) where was is distinct from query)",
    ]


_RECALL_TAIL = "case when length(flat) <= 600 then flat when contains(right(flat, 600), ' ') then substr(right(flat, 600), strpos(right(flat, 600), ' ') + 1) else right(flat, 600) end"


@query("", P._sql(*_ticks_sql(20_000, _RECALL_TAIL, "length(query) >= 80"), P._DOCS, "g as (select q, query from ticks)", P._queries_sql("g"), P._index_sql("p"), P._SCORE, P._AUTO, select=f"select call, tick, path, rank from ({P._ranked_sql('(select * from auto)', 3, keep=1)}) join ticks using (q)"))
def stream_recall(t: Tables) -> DataFrame:
    return L.recall(_spoken(t), P.index(t))


_RELATED = "asked as (select q, query, null::varchar as participant, null::varchar as tag, null::date as since, null::varchar as speaker, grp, call as own from ticks join talks on talks.path = ticks.call)"


@query("", P._sql(*_ticks_sql(5_000, "right(flat, 400)", "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) >= 4"), *P._whole_ctes(_RELATED, 12, "own <> talks.path"), select="select call, tick, path, start_ms, rank from (select *, row_number() over (partition by call, tick order by place) as rank from (select k.call, k.tick, s.path, min(s.place) as place, min_by(s.start_ms, s.place) as start_ms from shown s join ticks k using (q) where s.start_ms > 0 and s.score <= -0.5 group by 1, 2, 3)) where rank <= 4"))
def stream_related(t: Tables) -> DataFrame:
    return L.related(_spoken(t), P.corpus(t))


@query("screens", "select call, event_id from f where out", ctes=DWELL)
def stream_dwell(t: Tables) -> DataFrame:
    return L.drain(L.settled_screens(L.replay(t.screens.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "call", parts=3)))


@query("", f"with recursive {SCREEN_TEXTS} select call::varchar as call, seq from f where kept")
def stream_screen_dedup(t: Tables) -> DataFrame:
    return L.drain(L.kept_screens(L.replay(screen_texts(t).withColumn("call", F.col("call").cast("string")), "seq", "call", parts=3)))


@query("polls", MOVED)
def stream_scope_moved(t: Tables) -> DataFrame:
    return L.drain(L.moved_scopes(L.replay(t.polls.withColumn("attempted", F.col("attempted").cast("string")), "poll", "scope", parts=3)))


@query("replies", LATE)
def stream_late_replies(t: Tables) -> DataFrame:
    rows = t.replies.withColumn("arrival", F.col("arrival").cast("timestamp"))
    return L.drain(L.timely_replies(L.replay(rows, "arrival", "key", parts=3)))


def _corpus(t: Tables) -> PublishedCorpus:
    return PublishedCorpus(t.spark, fresh_path(t.spark, "published"), TOPIC_WEIGHTS)


def _load(t: Tables, edited: str):
    """Loads documents by path: a call, a passage per line, a topic, and a commitment of those with a source. ``edited``: the text as it is by then."""

    def load(paths: DataFrame) -> dict[str, DataFrame]:
        # Stored, so that the texts meet the paths once and not for each table.
        docs = stored(t.documents.select(F.col("doc_id").alias("path"), F.expr(edited).alias("text"), "source").join(broadcast_few(paths.select("path", "mtime")), "path"), "loaded")
        lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
        title = F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(80))
        return {
            "calls": docs.select("path", "mtime", title.alias("title")),
            "chunks": lines.select("path", F.col("chunk").cast("long").alias("chunk"), "text"),
            "topics": docs.select("path", title.alias("title"), F.left("text", F.lit(160)).alias("summary"), F.lit("").alias("tags"), F.col("source").alias("participants")),
            "commitments": docs.where("source is not null").select("path", F.col("source").alias("owner"), title.alias("text"), F.lit("open").alias("status")),
        }

    return load


_EDITED = "case when doc_id % 13 = 0 then text || '\nrevised edition' else text end"


@query("snapshot_new", "select path, mtime + case when path % 26 = 0 and path % 2 = 0 then 10 else 0 end as mtime from snapshot_new")
def stream_reconcile(t: Tables) -> DataFrame:
    """Three scans: the old state; the new one, complete; half of it again, later and incomplete, which removes nothing."""
    scan = lambda df, n, complete: df.select(F.lit(n).cast("long").alias("scan"), "path", "mtime", F.lit(complete).alias("complete"))
    half = t.snapshot_new.where("path % 2 = 0").withColumn("mtime", F.expr("mtime + case when path % 26 = 0 then 10 else 0 end"))
    scans = scan(t.snapshot_old, 0, True).unionByName(scan(t.snapshot_new, 1, True)).unionByName(scan(half, 2, False))
    corpus = _corpus(t)
    L.reconcile_stream(L.replay(scans, "scan", "path", parts=3), corpus, _load(t, "text"))
    return corpus.read("calls").select("path", "mtime")


@query("", "select user_id as note, count(*) as entries, max(ts) as updated from events group by 1")
def stream_captures(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("note"), F.col("ts").alias("stamp"), F.col("event_type").alias("text"))
    return L.capture_stream(L.replay(rows, "stamp", "note", parts=3))


_NEW = f"new as (select path, mtime, source, case when path % 13 = 0 then text || chr(10) || 'revised edition' else text end as text from snapshot_new join documents on doc_id = path), lines as (select path, unnest(string_split(text, chr(10))) as line from new)"


@query("snapshot_new", f"select 'calls' as tbl, path, 1::bigint as n, mtime::varchar as v from new union all select 'chunks', path, count(*), sum(length(line))::varchar from lines group by path union all select 'topics', path, 1, left(text, 160) from new union all select 'commitments', path, 1, source from new where source is not null union all select 'revised', path, count(*), 'revised' from lines where list_contains({P._SPLIT.format('line')}, 'revised') group by path", ctes=_NEW)
def index_publish(t: Tables) -> DataFrame:
    """The old state, then the new one's changes and removals, under one manifest each; a replayed batch; a merge. All tables as they are then, and a phrase of the index."""
    from parlance.operators.documents import reconcile
    from parlance.operators.search import phrase_hits, term_hits

    corpus = _corpus(t)
    corpus.apply(**_load(t, "text")(t.snapshot_old), batch=0)
    changes = reconcile(t.snapshot_new, corpus.read("calls"))
    fresh = t.snapshot_new.join(changes.where("change in ('new', 'changed')").select("path"), "path", "left_semi")
    edits = _load(t, _EDITED)(fresh)
    assert corpus.apply(**edits, removed=changes.where("change = 'removed'").select("path"), batch=1)
    assert not corpus.apply(**edits, batch=1)
    before = term_hits(t.spark.createDataFrame([("revised",)], "term string"), corpus.spoken).count()
    corpus.merge()
    found = phrase_hits(t.spark.createDataFrame([("revised edition",)], "phrase string"), corpus.spoken).unionByName(phrase_hits(t.spark.createDataFrame([("revised",)], "phrase string"), corpus.spoken)).select("path", "chunk").distinct()
    assert found.count() == before
    rows = lambda name, n, v, by=("path",): corpus.read(name).groupBy(*by).agg(n.alias("n"), v.alias("v")).select(F.lit(name).alias("tbl"), "path", "n", F.col("v").cast("string").alias("v"))
    one = F.count(F.lit(1))
    out = rows("calls", one, F.first("mtime")).unionByName(rows("chunks", one, F.sum(F.length("text")))).unionByName(rows("topics", one, F.first("summary"))).unionByName(rows("commitments", one, F.first("owner")))
    return out.unionByName(found.groupBy("path").agg(one.alias("n")).select(F.lit("revised").alias("tbl"), "path", "n", F.lit("revised").alias("v")))


@query("registry", "select id, name, kind, grp, confirmed from registry where id % 2 = 0")
def registry_publish(t: Tables) -> DataFrame:
    table = SnapshotTable(t.spark, fresh_path(t.spark, "registry"))
    table.publish(t.registry, 0)
    assert not table.publish_changed(t.registry, 1)
    table.publish_changed(t.registry.where("id % 2 = 0"), 2)
    return table.current()


@query("registry", "select id, name, kind, grp from registry")
def registry_scan(t: Tables) -> DataFrame:
    """Entities written as JSON and read with their schema."""
    path = fresh_path(t.spark, "registry-json")
    t.registry.select("id", "name", "kind", F.array("grp").alias("groups")).write.json(path)
    rows = t.spark.read.schema("id long, name string, kind string, aliases array<string>, groups array<string>, confirmed boolean, gloss string").json(path)
    return rows.select("id", "name", "kind", F.element_at("groups", 1).alias("grp"))


def notes(t: Tables) -> DataFrame:
    """One Markdown file per call: metadata, summary, transcript and screen texts, made from the conversations."""
    n = F.col("call").cast("string")
    head = F.concat(F.lit("---\napp: call-transcriber\ntitle: 'Call ''"), n, F.lit("'' [Draft]'\ndate: 2024-01-"), F.lpad((F.col("call") % 28 + 1).cast("string"), 2, "0"), F.lit("\ngroup: \"w"), (F.col("call") % 5).cast("string"), F.lit("\"\nparticipants: [Ann @ A, \"Bob, B\"]\ntags: [call, t"), (F.col("call") % 3).cast("string"), F.lit("]\n---\n# Call\n## Summary\nabout "), n, F.lit("\nand more\n## Transcript\n"))
    foot = F.concat(F.lit("\n\n- **2024-01-01 10:00** — entry "), n, F.lit(" ([[Call "), n, F.lit("|shown]])\n\n## Screen Context\n\n**[0:"), F.lpad((F.col("call") % 60).cast("string"), 2, "0"), F.lit("]**\n\nscreen "), n, F.lit("\n\n---\n\nplain "), n)
    return rendered(t.segments).select(F.col("call").alias("path"), F.concat(head, "body", foot).alias("content"))


_CALLS = "(select distinct conv_id as path from conversations)"


@query("", f"select 'Call ''' || path || ''' [Draft]' as title, '2024-01-' || lpad((path % 28 + 1)::varchar, 2, '0') as date, 'w' || (path % 5) as grp, 'Ann @ A|Bob, B' as participants, 'call|t' || (path % 3) as tags from {_CALLS}")
def corpus_metadata(t: Tables) -> DataFrame:
    rows = M.corpus_metadata(notes(t))
    return rows.select("title", "date", "grp", F.array_join("participants", "|").alias("participants"), F.array_join("tags", "|").alias("tags"))


@query("", f"select path, 'about ' || path || ' and more' as summary from {_CALLS}")
def summary_sections(t: Tables) -> DataFrame:
    return notes(t).select("path", M.summary_section(F.col("content")).alias("summary"))


@query("", f"select path, 0 as entry, (path % 60) * 1000 as start_ms, 'Screen' as speaker, 'screen ' || path as text from {_CALLS} union all select path, 1, 0, 'Screen', 'plain ' || path from {_CALLS}")
def screen_chunks(t: Tables) -> DataFrame:
    return M.screen_chunks(notes(t), "path")


@query("", f"select path, '2024-01-01 10:00' as stamp, 'entry ' || path as text, 'Call ' || path || '|shown' as linked_call from {_CALLS}")
def note_entries(t: Tables) -> DataFrame:
    return M.note_entries(notes(t), "path").select("path", "stamp", "text", "linked_call")


@query("", f"select path as source, 'Call ' || path as name, 'shown' as shown from {_CALLS}")
def wikilink_edges(t: Tables) -> DataFrame:
    return M.wikilinks(notes(t), "path").select("source", "name", "shown")


@query("", "select doc_id as path, count(*) filter (n = 1) as headings, count(*) filter (n > 1 and n % 3 = 0) as bullets from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) group by 1")
def note_blocks(t: Tables) -> DataFrame:
    """Lines of documents with marks put before them: the first a heading, every third a bullet."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 3 == 2, F.concat(F.lit("- "), x)).otherwise(x))
    rows = M.note_blocks(t.documents.select(F.col("doc_id").alias("path"), F.array_join(marked, "\n").alias("content")), "path")
    return rows.groupBy("path").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "bullets").alias("bullets"))


@query("", f"select count(*) as files, count(*) as owned from {_CALLS}")
def corpus_scan(t: Tables) -> DataFrame:
    """Files written one per call, then scanned by their folders.

    A task's files are in a folder of its own: the commit moves a folder at a time and a scan lists as many, however many calls there are.
    """
    path = fresh_path(t.spark, "corpus")
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = notes(t).repartition(tasks, "path").select("content", F.spark_partition_id().alias("folder"))
    dealt.write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    files = M.scan_corpus(t.spark, [f"{path}/folder=*"], "*.txt")
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(M.is_owned(M.front(F.col("content")))).alias("owned"))


@query("", f"select count(*) as lines_ from {_CALLS}")
def export_text(t: Tables) -> DataFrame:
    """Titles and bodies without metadata, written as text; the titles are counted when read again."""
    path = fresh_path(t.spark, "export")
    meta = M.front(F.col("content"))
    notes(t).select(F.concat(M.field(meta, "title"), F.lit("\n\n"), M.body(F.col("content"))).alias("value")).write.text(path)
    return t.spark.read.text(path).where(F.col("value").rlike(r"^Call '\d+' \[Draft\]$")).agg(F.count(F.lit(1)).alias("lines_"))
