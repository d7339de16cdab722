"""Queries over calls, entities and commitments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.adapters import Tables
from parlance.functions import columns as C
from parlance.operators import entities as E
from parlance.operators import rollups as R
from parlance.registry import query


@query("calls mentions", "select c.path, c.title, c.day, min(m.start_ms) as first_ms from calls c join mentions m using (path) where entity_id = 42 and kind = 'call' group by all order by c.day desc, c.path limit 50")
def calls_mentioning(t: Tables) -> DataFrame:
    return R.calls_mentioning(t.mentions, t.calls, 42)


@query("calls mentions registry", "select r.id, r.name, count(distinct m.path) as n_calls from registry r join mentions m on r.id = m.entity_id join calls c using (path) where c.kind = 'call' group by all")
def entity_counts(t: Tables) -> DataFrame:
    return R.entity_counts(t.mentions, t.calls, t.registry)


@query("mentions", "select entity_id, count(distinct path) as n_calls from mentions where entity_id <> 42 and path in (select path from mentions where entity_id = 42) group by 1")
def co_occurring(t: Tables) -> DataFrame:
    return R.co_occurring(t.mentions, 42)


@query("mentions calls registry", "select r.id, r.name, r.kind, count(distinct m.path) as n_calls from mentions m join calls c using (path) join registry r on r.id = m.entity_id where c.grp = 'BUILDING' and m.entity_id <> 42 and m.path in (select path from mentions where entity_id = 42) group by all order by n_calls desc, r.name, r.id limit 20")
def co_occurring_workspace(t: Tables) -> DataFrame:
    """The twenty entities that share most calls of one workspace with one."""
    return R.co_occurring_in(t.mentions, t.calls, t.registry, 42, "BUILDING")


@query("mentions", "select x.entity_id as a, y.entity_id as b, count(*) as n_calls from (select distinct path, entity_id from mentions) x join (select distinct path, entity_id from mentions) y on x.path = y.path and x.entity_id < y.entity_id group by 1, 2 having count(*) >= 2")
def co_occurring_all(t: Tables) -> DataFrame:
    return R.co_occurring_all(t.mentions)


@query("mentions registry", "select id, name from registry where id not in (select entity_id from mentions)")
def orphan_entities(t: Tables) -> DataFrame:
    return E.orphans(t.registry, t.mentions)


@query("calls", "select path, title, day, start_min from calls where grp = 'BUILDING' and kind = 'call' order by day desc, start_min desc, path limit 400")
def digest_recent(t: Tables) -> DataFrame:
    return R.recent_digest(t.calls, "BUILDING")


@query("calls", "select day, count(*) as n, string_agg(title, ', ' order by start_min, path) as titles from calls where kind = 'call' group by 1")
def digest_by_day(t: Tables) -> DataFrame:
    return R.digest_by_day(t.calls)


@query("calls", "select day, slot, path, title, greatest(n - 3, 0) as more from (select *, row_number() over (partition by day order by start_min, path) as slot, count(*) over (partition by day) as n from calls) where slot <= 3")
def calendar_month(t: Tables) -> DataFrame:
    return R.calendar_month(t.calls)


@query("calls", "select path, day, case when duration_min < 10 then '0' else '' end || duration_min || ':00' as duration, case when title = '' then 'Untitled' else title end as display, concat_ws(' · ', cast(day as varchar), nullif(participant, '')) as subtitle from calls")
def display_titles(t: Tables) -> DataFrame:
    duration = F.concat(F.when(F.col("duration_min") < 10, "0").otherwise(""), F.col("duration_min").cast("string"), F.lit(":00"))
    return t.calls.select("path", "day", duration.alias("duration"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")).alias("display"), F.concat_ws(" · ", F.col("day").cast("string"), F.nullif(F.col("participant"), F.lit(""))).alias("subtitle"))


@query("calls", "select path, case date_diff('day', day, date '1998-08-02') when 0 then 'Today' when 1 then 'Yesterday' else case when date_diff('day', day, date '1998-08-02') between 2 and 6 then dayname(day) else strftime(day, '%Y-%m-%d') end end as label from calls")
def day_buckets(t: Tables) -> DataFrame:
    past = F.date_diff(F.lit("1998-08-02").cast("date"), "day")
    return t.calls.select("path", F.when(past == 0, "Today").when(past == 1, "Yesterday").when(past.between(2, 6), F.date_format("day", "EEEE")).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("label"))


@query("calls", "select path, base || case when n = 1 then '' else ' (' || n || ')' end as name from (select path, base, row_number() over (partition by base order by path) as n from (select path, grp || ' — ' || strftime(day, '%Y-%m-%d') || ' ' || lpad(cast(start_min // 60 as varchar), 2, '0') || lpad(cast(start_min % 60 as varchar), 2, '0') as base from calls))")
def unique_names(t: Tables) -> DataFrame:
    """One name per (title, minute); later ones get a number."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    base = F.concat(C.file_name(F.col("grp")), F.lit(" — "), F.date_format("day", "yyyy-MM-dd"), F.lit(" "), two(F.floor(F.col("start_min") / 60)), two(F.col("start_min") % 60))
    rows = t.calls.select("path", base.alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy("path"))
    return rows.select("path", F.concat("base", F.when(n == 1, "").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(")")))).alias("name"))


@query("calls", "select path, day from calls where day >= date '1998-01-01'")
def filter_since(t: Tables) -> DataFrame:
    return t.calls.where(F.col("day") >= F.lit("1998-01-01").cast("date")).select("path", "day")


@query("commitments", "select path, owner, text, day from commitments where status = 'open' and grp = 'BUILDING' and owner = 'you' order by day desc, path limit 200")
def open_commitments(t: Tables) -> DataFrame:
    return E.open_commitments(t.commitments, "BUILDING", "you", 200)


@query("commitments calls", "select grp, count(*) filter (kind = 'call') as calls, (select count(*) from commitments m where m.grp = c.grp and m.status = 'open') as open_items from calls c group by grp")
def stat_counts(t: Tables) -> DataFrame:
    calls = t.calls.groupBy("grp").agg(F.count_if(F.col("kind") == "call").alias("calls"))
    items = t.commitments.groupBy("grp").agg(F.count_if(F.col("status") == "open").alias("open_items"))
    return calls.join(items, "grp", "left").select("grp", "calls", F.coalesce("open_items", F.lit(0)).alias("open_items"))


@query("commitment_lines", "select path, coalesce(nullif(split_part(replace(line, ' [done]', ''), ': ', 1), ''), '') as owner, substr(replace(line, ' [done]', ''), strpos(line, ': ') + 2) as text, case when line like '% [done]' then 'done' else 'open' end as status from commitment_lines")
def commitment_rows(t: Tables) -> DataFrame:
    return E.commitment_rows(t.commitment_lines)


@query("spoken_owners registry_people people_aliases people_merges", "select c.path, c.text, case when c.owner = 'you' then 'you' else coalesce(cast(k.root as varchar), c.owner) end as owner_id from spoken_owners c left join known k on k.grp = c.grp and k.key = lower(trim(c.owner))", ctes="forms as (select id, grp, lower(trim(name)) as key from registry_people where confirmed union all select p.id, grp, lower(trim(alias)) from registry_people p join people_aliases using (id) where confirmed), first as (select grp, key, min(id) as id from forms group by 1, 2), w(id, root, n) as (select id, id, 0 from (select distinct id from first) union all select w.id, m.a, n + 1 from w join people_merges m on w.root = m.b where n < 64), known as (select f.grp, f.key, r.root from first f join (select id, arg_max(root, n) as root from w group by 1) r using (id))")
def resolve_owners(t: Tables) -> DataFrame:
    """Owners by name or alias of a confirmed person of the workspace, after merges."""
    return E.resolve_owners(t.spoken_owners, t.registry_people, t.people_aliases, t.people_merges)


@query("commitments", "select owner = 'you' as is_you, owner, row_number() over (partition by owner order by path, text) as place, path, text, count(*) over (partition by owner) as n from commitments where status = 'open'")
def commitments_by_owner(t: Tables) -> DataFrame:
    """Open commitments in their owner's order, with the owner's number; one's own are marked. Rows, since an owner can have any number."""
    from pyspark.sql import Window as W

    rows = t.commitments.where("status = 'open'").select("owner", "path", "text")
    counts = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("owner").orderBy("path", "text"))
    return rows.withColumn("place", place).join(counts, "owner").select((F.col("owner") == "you").alias("is_you"), "owner", "place", "path", "text", "n")


@query("call_items", "select path, place, owner, text, case when status = 'open' and owner = 'you' and text = 'item 1' and path % 3 = 0 and row_number() over (partition by path, owner, text, status order by place) = 1 then 'done' else status end as status from call_items")
def mark_done(t: Tables) -> DataFrame:
    """One's own ``item 1`` is resolved in every third call."""
    named = t.call_items.where("path % 3 = 0").select("path", F.lit("you").alias("owner"), F.lit("item 1").alias("text")).distinct()
    return E.mark_done(t.call_items, named)


@query("calls", "select grp, count(*) as n from calls where kind = 'call' group by 1 order by 2 desc, 1")
def workspace_counts(t: Tables) -> DataFrame:
    return t.calls.where("kind = 'call'").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp")


@query("mentions calls", "select entity_id, count(distinct path) as documents from mentions group by 1")
def entity_roster(t: Tables) -> DataFrame:
    return t.mentions.groupBy("entity_id").agg(F.countDistinct("path").alias("documents"))


@query("mentions", "select path, entity_id, start_ms from (select *, row_number() over (partition by path order by start_ms, entity_id) as n from mentions) where n <= 2")
def top2_per_call(t: Tables) -> DataFrame:
    return R.first_by(t.mentions.select("path", "entity_id", "start_ms"), ["path"], ["start_ms", "entity_id"], 2)


@query("mentions", "select path, entity_id, start_ms from (select *, row_number() over (partition by path order by start_ms desc, entity_id) as n from mentions) where n = 1")
def first_hit_per_path(t: Tables) -> DataFrame:
    return R.first_by(t.mentions.select("path", "entity_id", "start_ms"), ["path"], [F.desc("start_ms"), "entity_id"])


@query("calls mentions registry", "select grp, id, name, n, links from (select c.grp, r.id, r.name, count(distinct c.path) as n, string_agg(distinct '[[' || c.title || ']]', chr(10) order by '[[' || c.title || ']]') as links from mentions m join calls c using (path) join registry r on r.id = m.entity_id where c.kind = 'call' group by 1, 2, 3)")
def entity_link_stubs(t: Tables) -> DataFrame:
    return E.link_stubs(t.mentions, t.calls, t.registry).drop("kind")


_STUBS = """s as (select c.grp, r.id, r.name, r.kind, string_agg(distinct '[[' || c.title || ']]', chr(10) order by '[[' || c.title || ']]') as links from mentions m join calls c using (path) join registry r on r.id = m.entity_id where c.kind = 'call' group by all),
o as (select *, '<!-- links: begin -->' || chr(10) || '- ' || replace(links, chr(10), chr(10) || '- ') || chr(10) || '<!-- links: end -->' as region, '---' || chr(10) || 'app: call-transcriber' || chr(10) || 'kind: ' || kind || chr(10) || 'group: "' || grp || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10) || chr(10) as head from s)"""


@query("calls mentions registry", "select grp, id, md5(case id % 5 when 0 then head || region || chr(10) when 2 then head || 'mine' || chr(10) || region || ' more' else head || 'no marks' || chr(10) || chr(10) || region || chr(10) end) as hash, id % 5 = 0 as made from o where id % 5 in (0, 2, 4)", ctes=_STUBS)
def entity_stub_files(t: Tables) -> DataFrame:
    """Stubs against the files that are there: none, one that is up to date, one with old links and a reader's words, another's, and one without marks."""
    stubs = E.link_stubs(t.mentions, t.calls, t.registry)
    head = F.concat(F.lit("---\napp: call-transcriber\nkind: "), "kind", F.lit('\ngroup: "'), "grp", F.lit('"\n---\n\n# '), "name", F.lit("\n\n"))
    kept = F.concat(head, F.lit(E.LINKS_BEGIN + "\n- "), F.replace("links", F.lit("\n"), F.lit("\n- ")), F.lit("\n" + E.LINKS_END + "\n"))
    old = F.concat(head, F.lit(f"mine\n{E.LINKS_BEGIN}\n- [[gone]]\n{E.LINKS_END} more"))
    kind = F.col("id") % 5
    files = stubs.where(kind != 0).select("grp", "id", F.when(kind == 1, kept).when(kind == 2, old).when(kind == 3, F.lit("# another's note")).otherwise(F.concat(head, F.lit("no marks"))).alias("content"))
    return E.stub_files(stubs, files).select("grp", "id", F.md5("content").alias("hash"), "made")


@query("", "select c_mktsegment as stored, count(*) as n, 'BUILDING' as real from customer where lower(c_mktsegment) = lower('Building') group by 1")
def casing_repair(t: Tables) -> DataFrame:
    """Stored spellings folded onto the real one where exactly one real spelling matches."""
    real = t.customer.select(F.col("c_mktsegment").alias("real")).distinct()
    stored = t.customer.where(F.lower("c_mktsegment") == "building").groupBy(F.col("c_mktsegment").alias("stored")).agg(F.count(F.lit(1)).alias("n"))
    return E.repair_casing(stored, real)


@query("", "select s_suppkey, split_part(s_name || ' @ ' || n_name, ' @ ', 1) as short, s_name || ', ' || n_name as first_three from supplier join nation on s_nationkey = n_nationkey")
def short_names(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", C.first_name(F.concat("s_name", F.lit(" @ "), "n_name")).alias("short"), F.array_join(F.slice(F.array("s_name", "n_name"), 1, 3), ", ").alias("first_three"))


@query("", "select n_nationkey, string_agg(s_name, ', ' order by s_suppkey) as attendees, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_suppkey <> 1 group by 1")
def attendee_lists(t: Tables) -> DataFrame:
    """Names per meeting: the organiser first, oneself left out, each name once whatever its case."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), (F.col("s_suppkey") == 1).alias("is_self"))
    return E.attendee_lists(rows, "n_nationkey")


@query("calls", "select path, day from calls where regexp_matches(title || ' — ' || strftime(day, '%Y-%m-%d') || ' ' || lpad(cast(start_min // 60 as varchar), 2, '0') || lpad(cast(start_min % 60 as varchar), 2, '0'), ' — \\d{4}-\\d{2}-\\d{2} \\d{4}( \\(\\d+\\))?$') and kind = 'call' and day < date '1998-08-02' - interval 365 days")
def retention_list(t: Tables) -> DataFrame:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    name = F.concat("title", F.lit(" — "), F.date_format("day", "yyyy-MM-dd"), F.lit(" "), two(F.floor(F.col("start_min") / 60)), two(F.col("start_min") % 60))
    files = t.calls.select("path", name.alias("name"), (F.col("kind") == "call").alias("owned"), "day")
    return E.retention_list(files, "1998-08-02", 365).select("path", "day")


@query("calls mentions commitments", "select 'calls' as tbl, count(*) as n from calls where grp <> 'BUILDING' union all select 'mentions', count(*) from mentions where path not in (select path from calls where grp = 'BUILDING') union all select 'commitments', count(*) from commitments where grp <> 'BUILDING'")
def wipe_cascade(t: Tables) -> DataFrame:
    left = E.wipe({"calls": t.calls, "mentions": t.mentions, "commitments": t.commitments}, t.calls.where("grp = 'BUILDING'").select("path"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tbl"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
