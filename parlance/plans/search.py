"""Search queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.adapters import Tables
from parlance.functions import columns as C
from parlance.operators import search as S
from parlance.operators.index import Index, build_index
from parlance.operators.index import postings as index_postings
from parlance.registry import query
from parlance.sources.storage import exists, version

_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)


def _queries_sql(source: str, legacy: bool = False) -> str:
    """Terms (q, term, n_terms) of rows (q, query)."""
    content = "true" if legacy else f"term not in ({_STOP})"
    cap = "" if legacy else "where r <= 10"
    size = "n" if legacy else "least(n, 10)"
    return f"""raw_t as (select q, term, min(i) as i from (select q, unnest(l) as term, generate_subscripts(l, 1) as i from (select q, {_SPLIT.format("query")} as l from {source})) where length(term) >= 2 group by 1, 2),
    con_t as (select *, {content} as content, count(*) filter ({content}) over (partition by q) as nc from raw_t),
    top_t as (select q, term, row_number() over (partition by q order by length(term) desc, i) as r, count(*) over (partition by q) as n from con_t where content or nc = 0),
    terms as (select q, term, {size} as n_terms from top_t {cap})"""


def _index_sql(passages: str) -> str:
    return f"""tok as (select path, chunk, unnest({_SPLIT.format("text")}) as token from {passages}),
    len as (select path, chunk, count(*) as len from tok group by all),
    st as (select (select count(*) from {passages}) as n_docs, (select sum(len) from len) / (select count(*) from {passages}) as mean_len),
    tf as (select token, path, chunk, count(*) as tf from tok group by all)"""


_SCORE = """pre as (select t.term, token from (select distinct term from terms) t join (select distinct token from tf) k on starts_with(token, t.term)),
    met as (select term, path, chunk, sum(tf) as tf from pre join tf using (token) group by all),
    df as (select term, count(*) as df from met group by 1),
    part as (select term, path, chunk, -greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)) as part from met join df using (term) join len using (path, chunk), st),
    hits as (select q, path, chunk, round(sum(part), 9) as score, count(*) as matched, any_value(n_terms) as n_terms from terms join part using (term) group by 1, 2, 3)"""
_AUTO = "auto as (select * from hits where matched = n_terms union all select * from hits where q not in (select q from hits where matched = n_terms))"
_DOCS = "p as (select doc_id as path, 0 as chunk, text from documents)"
_GOLD = "g as (select item_id as q, text as query from benchmark)"


def _sql(*ctes: str, select: str) -> str:
    return "with recursive " + ", ".join(ctes) + " " + select


def _ranked_sql(source: str, limit: int = 10, per_call: bool = True, keep: int = 2) -> str:
    inner = f"select *, row_number() over (partition by q order by score, path, chunk) as r from {source}"
    mid = f"select *, row_number() over (partition by q, path order by score, path, chunk) as c from ({inner}) where r <= {4 * limit}"
    return f"select * from (select q, path, chunk, score, row_number() over (partition by q order by score, path, chunk) as rank from ({mid}) {f'where c <= {keep}' if per_call else ''}) where rank <= {limit}"


def passages(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("chunk"), "text")


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("path"), F.col("turn").alias("chunk"), "text")


def questions(t: Tables) -> DataFrame:
    """The benchmark's whole texts as queries."""
    return t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("query"))


_indexes: dict[tuple, Index] = {}
_SOURCES = {"documents": (lambda t: passages(t), ("documents",), None), "conversations": (lambda t: turns(t), ("conversations",), None), "topics": (lambda t: topics(t).withColumn("chunk", F.lit(0).cast("long")), ("documents", "labels"), S.TOPIC_WEIGHTS), "talks": (lambda t: talk_topics(t).withColumn("chunk", F.lit(0).cast("long")), ("conversations",), S.TOPIC_WEIGHTS)}


def index(t: Tables, name: str = "documents") -> Index:
    """The stored index of documents, conversations or their topics: built once per state of the tables' files, read by every search."""
    made, tables, weights = _SOURCES[name]
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name, *[version(t.spark, f"{t.sf_dir}/{x}.parquet") for x in tables])
    if key not in _indexes or not exists(t.spark, _indexes[key].root):
        _indexes[key] = build_index(made(t), weights)
    return _indexes[key]


@query("", _sql(_GOLD, _queries_sql("g"), select="select q, string_agg(term, ' ' order by term) as terms, any_value(n_terms) as n_terms from terms group by 1"))
def query_terms(t: Tables) -> DataFrame:
    rows = S.terms_of(t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("query")))
    return rows.groupBy("q").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"), F.first("n_terms").alias("n_terms"))


@query("", _sql(_DOCS, _index_sql("p"), select="select token, path, tf from tf"))
def postings(t: Tables) -> DataFrame:
    return index_postings(passages(t)).select("token", "path", F.col("uses").alias("tf"))


@query("", _sql(_DOCS, _index_sql("p"), select="select n_docs, round(mean_len, 9) as mean_len from st"))
def corpus_stats(t: Tables) -> DataFrame:
    return S.corpus_stats(passages(t)).select("n_docs", F.round("mean_len", 9).alias("mean_len"))


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, select="select term, path, tf::bigint as tf from met"))
def prefix_match(t: Tables) -> DataFrame:
    return S.term_hits(S.terms_of(questions(t)), index(t)).select("term", "path", F.col("tf").cast("long").alias("tf"))


@query("", f"with w as (select distinct {_SPLIT.format('text')} as l from benchmark), d as (select doc_id as path, ' ' || array_to_string({_SPLIT.format('text')}, '  ') || ' ' as s from documents) select distinct array_to_string(l, ' ') as phrase, path, (length(s) - length(replace(s, ' ' || array_to_string(l, '  ') || ' ', ''))) // length(' ' || array_to_string(l, '  ') || ' ') as tf from w join d on contains(s, ' ' || array_to_string(l, '  ') || ' ')")
def phrase_match(t: Tables) -> DataFrame:
    """Every benchmark text, whole, as an exact phrase."""
    phrases = t.benchmark.select(F.array_join(C.tokens(F.col("text")), " ").alias("phrase")).distinct()
    return S.phrase_hits(phrases, index(t)).select("phrase", "path", "tf")


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, select="select q, path, score from hits where matched = n_terms"))
def and_search(t: Tables) -> DataFrame:
    return S.search(index(t), questions(t), "and").select("q", "path", "score")


@query("", _sql("p as (select conv_id as path, turn as chunk, text from conversations)", _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, select=_ranked_sql("hits")))
def passage_search(t: Tables) -> DataFrame:
    return S.best(index(t, "conversations"), questions(t), mode="or").select("q", "path", "chunk", "score", "rank")


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, select=_ranked_sql("auto")))
def search_all(t: Tables) -> DataFrame:
    return S.best(index(t), questions(t)).select("q", "path", "chunk", "score", "rank")


@query("", _sql(_DOCS, _GOLD, _queries_sql("g", legacy=True), _index_sql("p"), _SCORE, select=_ranked_sql("hits")))
def legacy_search(t: Tables) -> DataFrame:
    return S.best(index(t), questions(t), mode="or", legacy=True).select("q", "path", "chunk", "score", "rank")


def topics(t: Tables) -> DataFrame:
    return t.docs.select("path", "title", "summary", F.concat_ws(" ", "tag_lang", "tag_quality").alias("tags"), F.col("grp").alias("participants"))


_TOPIC = ["topic as (select path, title, summary, concat_ws(' ', tag_lang, tag_quality) as tags, grp as participants from docs)", f"ttok as (select path, w, unnest(t) as token from (select path, 4.0 as w, {_SPLIT.format('title')} as t from topic union all select path, 1.0, {_SPLIT.format('summary')} from topic union all select path, 3.0, {_SPLIT.format('tags')} from topic union all select path, 0.5, {_SPLIT.format('participants')} from topic))", "tlen as (select path, count(*) as len from ttok group by 1)", "tst as (select (select count(*) from topic) as n_docs, (select sum(len) from tlen) / (select count(*) from topic) as mean_len)", "ttf as (select token, path, sum(w)::double as tf from ttok group by all)", "tmet as (select t.term, path, sum(tf) as tf from (select distinct term from terms) t join ttf on starts_with(token, t.term) group by all)", "tdf as (select term, count(*) as df from tmet group by 1)", "tpart as (select term, path, -greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)) as part from tmet join tdf using (term) join tlen using (path), tst)", "thits as (select q, path, score, left(summary, 160) as snippet from (select q, path, round(sum(part), 9) as score, count(*) as matched, any_value(n_terms) as n_terms from terms join tpart using (term) group by 1, 2) join topic using (path) where matched = n_terms)"]


def titled(t: Tables) -> DataFrame:
    """The titles of the documents whose id is divisible by 50, as queries."""
    return t.docs.where("path % 50 = 0").select(F.col("path").alias("q"), F.col("title").alias("query"))


_TITLED = "g as (select path as q, title as query from docs where path % 50 = 0)"


def _docs_cte() -> str:
    from parlance.adapters import select

    return f"docs as ({select('docs')})"


@query("", _sql(_docs_cte(), _TITLED, _queries_sql("g"), *_TOPIC, select="select q, path, score, snippet from thits"))
def topic_search(t: Tables) -> DataFrame:
    return S.topic_search(topics(t), titled(t), index(t, "topics"))


@query("", _sql(_docs_cte(), _DOCS, _TITLED, _queries_sql("g"), _index_sql("p"), _SCORE, *_TOPIC, f"pass as ({_ranked_sql('(select * from hits where matched = n_terms)')})", "lone as (select q, path, row_number() over (partition by q order by score, path) as rank from thits where not exists (select 1 from pass x where x.q = thits.q and x.path = thits.path))", "kept as (select q, least(count(*), 3) as kept from lone group by 1)", "every as (select pass.q, path, 'passage' as source, rank, case when rank <= 10 - coalesce(kept, 0) then 0 else 2 end as stage from pass left join kept using (q) union all select q, path, 'topic', rank, 1 from lone)", select="select q, path, source, place from (select *, row_number() over (partition by q order by stage, rank) as place from every) where place <= 10"))
def fused_search(t: Tables) -> DataFrame:
    found = S.best(index(t), titled(t), mode="and")
    return S.fuse(found, S.topic_search(topics(t), titled(t), index(t, "topics"))).drop("chunk")


def _alias_sql(alias: str) -> str:
    """Alias search: the benchmark texts, with a group for each of their first words, which has an alias made of the text's words l."""
    spaced = f"' ' || array_to_string({_SPLIT.format('text')}, '  ') || ' '"
    return _sql(
        _DOCS,
        f"b as (select item_id, text, {_SPLIT.format('text')} as l from benchmark)",
        _GOLD,
        _queries_sql("g"),
        _index_sql("p"),
        f"groups as (select item_id as grp_no, [l[1], {alias}] as members from b where len(l) > 0)",
        "first as (select term, arg_min(members, grp_no) as members from (select grp_no, members, unnest(members) as term from groups) where not contains(term, ' ') group by 1)",
        "forms as (select distinct term, unnest(list_prepend(term, coalesce(members, []))) as form from (select distinct term from terms) left join first using (term))",
        *_form_sql("tf", "p", "st", "len"),
        select="select q, path, round(sum(part), 9) as score from (select q, term, n_terms, form from terms join forms using (term)) join part using (form) group by 1, 2 having count(distinct term) = any_value(n_terms)",
    )


def _form_sql(tf: str, source: str, st: str, length: str, name: str = "", spaced: str | None = None) -> list[str]:
    """Parts of scores of forms (form): prefixes, or phrases of the source's texts (``spaced``: its words with two spaces between)."""
    spaced = spaced or f"' ' || array_to_string({_SPLIT.format('text')}, '  ') || ' '"
    return [
        f"{name}word as (select form, token from (select distinct form from forms where not contains(form, ' ')) join (select distinct token from {tf}) on starts_with(token, form))",
        f"{name}wm as (select form, path, chunk, sum(tf)::double as tf from {name}word join {tf} using (token) group by all)",
        f"{name}s as (select path, chunk, {spaced} as s from {source})",
        f"{name}want as (select distinct form, ' ' || replace(form, ' ', '  ') || ' ' as f from forms where contains(form, ' '))",
        # Every place where a phrase begins counts, those within another of its uses too ("of of" in "of of of"), as in phrase_hits.
        f"{name}pm as (select form, path, chunk, len(list_filter(range(1, len(l) - len(w) + 2), lambda i: l[i:i + len(w) - 1] = w))::double as tf from (select form, path, chunk, regexp_split_to_array(trim(s), ' +') as l, string_split(form, ' ') as w from {name}want join {name}s on contains(s, f)))",
        f"{name}fm as (select * from {name}wm union all select * from {name}pm)",
        f"{name}fdf as (select form, count(*) as df from {name}fm group by all)",
        f"{name}part as (select form, path, chunk, -greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)) as part from {name}fm join {name}fdf using (form) join {length} using (path, chunk), {st})",
    ]


def _aliased(t: Tables, alias) -> DataFrame:
    rows = t.benchmark.select("item_id", C.tokens(F.col("text")).alias("l")).where("size(l) > 0")
    groups = rows.select(F.col("item_id").alias("grp_no"), F.array_compact(F.array(F.element_at("l", 1), alias)).alias("members"))
    return S.alias_search(index(t), questions(t), groups).select("q", "path", "score")


@query("", _alias_sql("coalesce(l[2], l[1])"))
def alias_search(t: Tables) -> DataFrame:
    """The benchmark's whole texts; the first word of each is also the word after it."""
    return _aliased(t, F.coalesce(F.try_element_at("l", F.lit(2)), F.element_at("l", 1)))


@query("", _alias_sql("coalesce(l[-2] || ' ' || l[-1], l[1])"), name="alias_groups_search")
def alias_groups_search(t: Tables) -> DataFrame:
    """The same, each also as a phrase: the last two words of its text."""
    return _aliased(t, F.when(F.size("l") > 1, F.concat_ws(" ", F.try_element_at("l", F.lit(-2)), F.element_at("l", -1))).otherwise(F.element_at("l", 1)))


#: The conversations as calls: filters, topics and aliases for whole searches.
_FIRST_WORDS = _SPLIT.format("first_text")
_TALKS = """talks as (select path, title, summary, date '2024-01-01' + (path % 60)::int as day, case path % 5 when 0 then '' else 'w' || (path % 5) end as grp, case path % 7 when 3 then 'note' else 'call' end as kind, ['Ann ' || (path % 4), 'Bob ' || (path % 3)] as participants, ['t' || (path % 3), 'call'] as tags, first_text
  from (select conv_id as path, left(min_by(text, turn), 60) as title, case when conv_id % 11 = 0 then '' else max_by(text, turn) end as summary, min_by(text, turn) as first_text from conversations group by 1))"""


def talks(t: Tables) -> DataFrame:
    """path, title, summary, day, grp, kind, participants, tags, first_text of every conversation."""
    rows = t.conversations.groupBy(F.col("conv_id").alias("path")).agg(F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"))
    numbered = lambda name, n: F.concat(F.lit(name), (F.col("path") % n).cast("string"))
    return rows.select(
        "path",
        F.left("first_text", F.lit(60)).alias("title"),
        F.when(F.col("path") % 11 == 0, "").otherwise(F.col("last_text")).alias("summary"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("path") % 60).cast("int")).alias("day"),
        F.when(F.col("path") % 5 == 0, "").otherwise(numbered("w", 5)).alias("grp"),
        F.when(F.col("path") % 7 == 3, "note").otherwise("call").alias("kind"),
        F.array(numbered("Ann ", 4), numbered("Bob ", 3)).alias("participants"),
        F.array(numbered("t", 3), F.lit("call")).alias("tags"),
        "first_text",
    )


def talk_topics(t: Tables) -> DataFrame:
    return talks(t).select("path", "title", "summary", F.array_join("tags", " ").alias("tags"), F.array_join("participants", " ").alias("participants"))


def corpus(t: Tables) -> S.Corpus:
    """The conversations as a searchable corpus, with alias groups made of the first words of some."""
    from parlance.sources.storage import stored

    chunks = t.segments.select(F.col("call").alias("path"), F.col("seq").alias("chunk"), "start_ms", F.col("track").alias("speaker"), "text")
    calls = stored(talks(t), "talks")
    words = calls.where("path % 20 = 0").select("path", C.tokens(F.col("first_text")).alias("l")).where("size(l) >= 3")
    aliases = words.select(F.col("path").alias("grp_no"), F.expr("case when path % 3 = 0 then '' else 'w1' end").alias("grp"), F.array(F.element_at("l", 1), F.concat_ws(" ", F.element_at("l", 2), F.element_at("l", 3))).alias("members"))
    return S.Corpus(index(t, "conversations"), index(t, "talks"), calls, chunks, aliases)


_ASKED = f"asked as (select path as q, array_to_string(list_slice(l, 1, 3), ' ') || case when path % 40 = 0 then ' zzqx' else '' end as query, case kind6 when 2 then 'ANN ' || (path % 4) end as participant, case kind6 when 3 then 'T' || (path % 3) end as tag, case kind6 when 4 then date '2024-01-20' end as since, case kind6 when 5 then 'them' end as speaker, case kind6 when 1 then grp end as grp from (select *, path // 10 % 6 as kind6, {_FIRST_WORDS} as l from talks where path % 10 = 0))"


def asked(t: Tables, calls: DataFrame) -> DataFrame:
    """Questions of a stated set (every tenth conversation's first three words), each sixth with another filter, some with a word that nothing has."""
    words = F.array_join(F.slice(C.tokens(F.col("first_text")), 1, 3), " ")
    kind = F.floor(F.col("path") / 10) % 6
    n = lambda k: (F.col("path") % k).cast("string")
    return calls.where("path % 10 = 0").select(
        F.col("path").alias("q"),
        F.concat(words, F.when(F.col("path") % 40 == 0, " zzqx").otherwise("")).alias("query"),
        F.when(kind == 2, F.concat(F.lit("ANN "), n(4))).alias("participant"),
        F.when(kind == 3, F.concat(F.lit("T"), n(3))).alias("tag"),
        F.when(kind == 4, F.lit("2024-01-20").cast("date")).alias("since"),
        F.when(kind == 5, "them").alias("speaker"),
        F.when(kind == 1, F.col("grp")).alias("grp"),
    )


def _whole_ctes(asked_sql: str, limit: int = 10, candidates: str = "true") -> list[str]:
    """The whole search of questions ``asked``, up to what is shown; ``candidates``: which calls a question may find at all."""
    topic_tokens = " union all ".join(f"select path, 0 as chunk, {w} as w, {k} << 26 as gap, unnest(t) as token from (select path, {_SPLIT.format(f)} as t from ttext)" for k, (f, w) in enumerate(S.TOPIC_WEIGHTS.items()))
    spaced = "' ' || " + " || '   |   ' || ".join(f"array_to_string({_SPLIT.format(f)}, '  ')" for f in S.TOPIC_WEIGHTS) + " || ' '"
    fits = f"({candidates}) and (participant is null or list_contains(list_transform(participants, lambda x: lower(x)), lower(participant))) and (tag is null or list_contains(list_transform(tags, lambda x: lower(x)), lower(tag))) and (since is null or day >= since) and (asked.grp is null or asked.grp = talks.grp)"
    return [
        _TALKS,
        "p as (select conv_id as path, turn as chunk, text from conversations)",
        "ttext as (select path, title, summary, array_to_string(tags, ' ') as tags, array_to_string(participants, ' ') as participants from talks)",
        asked_sql,
        _queries_sql("asked"),
        f"groups as (select path as grp_no, case when path % 3 = 0 then '' else 'w1' end as grp, [l[1], l[2] || ' ' || l[3]] as members from (select path, {_FIRST_WORDS} as l from talks where path % 20 = 0) where len(l) >= 3)",
        "sterms as (select terms.*, asked.grp as scope from terms join asked using (q))",
        "first as (select scope, term, arg_min(members, grp_no) as members from (select scope, grp_no, members, unnest(members) as term from (select distinct scope from sterms) s join groups on s.scope is null or groups.grp = '' or groups.grp = s.scope) where not contains(term, ' ') group by 1, 2)",
        "sforms as (select distinct x.scope, x.term, unnest(list_prepend(x.term, coalesce(members, []))) as form from (select distinct scope, term from sterms) x left join first on first.term = x.term and first.scope is not distinct from x.scope)",
        "forms as (select distinct form from sforms)",
        _index_sql("p"),
        *_form_sql("tf", "p", "st", "len"),
        f"xtok as ({topic_tokens})",
        "xlen as (select path, chunk, count(*) as len from xtok group by all)",
        "xst as (select (select count(*) from talks) as n_docs, (select sum(len) from xlen) / (select count(*) from talks) as mean_len)",
        "xtf as (select token, path, chunk, sum(w)::double as tf from xtok group by all)",
        *[x.replace(" as s from ttext", " as s from (select *, 0 as chunk from ttext)") for x in _form_sql("xtf", "ttext", "xst", "xlen", "x", spaced)],
        "qforms as (select q, sterms.term, n_terms, form from sterms join sforms on sforms.term = sterms.term and sforms.scope is not distinct from sterms.scope)",
        "ph as (select q, path, chunk, round(sum(part), 9) as score, count(distinct term) as matched, any_value(n_terms) as n_terms from qforms join part using (form) group by 1, 2, 3)",
        "th as (select q, path, round(sum(part), 9) as score, count(distinct term) as matched, any_value(n_terms) as n_terms from qforms join xpart using (form) group by 1, 2)",
        f"pf as (select ph.*, g.track as spk, g.start_ms from ph join asked using (q) join talks using (path) join (select conv_id as path, turn as chunk, case role when 'user' then 'you' when 'assistant' then 'them' else 'note' end as track, turn * 15000 as start_ms from conversations) g on g.path = ph.path and g.chunk = ph.chunk where {fits} and (speaker is null or speaker = g.track))",
        f"tfl as (select th.* from th join asked using (q) join talks using (path) where kind = 'call' and speaker is null and {fits})",
        "wh as (select q, bool_or(matched = n_terms) as whole from (select q, matched, n_terms from pf union all select q, matched, n_terms from tfl) group by 1)",
        "pu as (select pf.* from pf join wh using (q) where not whole or matched = n_terms)",
        f"pr as ({_ranked_sql('pu', limit)})",
        f"tr as (select * from (select tfl.*, row_number() over (partition by q order by score, path) as t from tfl join wh using (q) where not whole or matched = n_terms) where t <= {limit})",
        "lone as (select q, path, score, row_number() over (partition by q order by score, path) as rank from tr where not exists (select 1 from pr where pr.q = tr.q and pr.path = tr.path))",
        "kept as (select q, least(count(*), 3) as kept from lone group by 1)",
        f"every as (select pr.q, path, chunk, 'passage' as source, score, rank, case when rank <= {limit} - coalesce(kept, 0) then 0 else 2 end as stage from pr left join kept using (q) union all select q, path, null, 'topic', score, rank, 1 from lone)",
        "placed as (select *, row_number() over (partition by q order by stage, rank) as place from every)",
        f"shown as (select placed.*, title, day, case when source = 'topic' then 0 else chunk * 15000 end as start_ms, summary from placed join talks using (path) where place <= {limit})",
    ]


_WHOLE_SNIPPETS = [
    "sw as (select q, place, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws from shown join p on p.path = shown.path and p.chunk = shown.chunk)",
    "w as (select q, place, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from sw)",
    "m as (select distinct w.*, form from w join (select distinct q, form from qforms where not contains(form, ' ')) using (q) where starts_with(regexp_replace(lower(word), '^[^\\p{L}\\p{M}\\p{N}]+', ''), form))",
    "v as (select distinct q, place, form, unnest(range(greatest(0, pos - 13), least(pos, greatest(0, n - 14)) + 1)) as s from m)",
    "best as (select q, place, s from (select *, row_number() over (partition by q, place order by k desc, s) as o from (select q, place, s, count(*) as k from v group by all)) where o = 1)",
    "hit as (select distinct q, place, pos from m)",
    "line as (select w.q, w.place, any_value(n) as n, max(coalesce(s, 0)) as first, string_agg(case when hit.pos is null then word else '⟦' || word || '⟧' end, ' ' order by w.pos) as line from w left join best on best.q = w.q and best.place = w.place left join hit on hit.q = w.q and hit.place = w.place and hit.pos = w.pos where w.pos >= coalesce(s, 0) and w.pos < coalesce(s, 0) + 14 group by 1, 2)",
]
_SPEAKER = "case role when 'user' then 'you' when 'assistant' then 'them' else 'note' end"


@query("", _sql(*_whole_ctes(_ASKED), *_WHOLE_SNIPPETS, select=f"select q, place, source, shown.path, title, day, start_ms, case when source = 'passage' then (select {_SPEAKER} from conversations c where c.conv_id = shown.path and c.turn = shown.chunk) end as speaker, score, case when source = 'topic' then coalesce(nullif(left(summary, 160), ''), 'matched on topic') else case when first > 0 then '…' else '' end || line || case when first + 14 < n then '…' else '' end end as snippet from shown left join line using (q, place)"))
def whole_search(t: Tables) -> DataFrame:
    """Questions with filters over passages and topics, with aliases, all terms before any, two hits of a call, places kept for topics."""
    made = corpus(t)
    return S.whole_search(made, asked(t, made.calls))


_SNIPPETS = [
    f"r as ({_ranked_sql('auto', 5)})",
    "sw as (select q, path, rank, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as ws from r join documents on doc_id = path)",
    "w as (select q, path, rank, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from sw)",
    "m as (select w.*, term from w join terms using (q) where starts_with(regexp_replace(lower(word), '^[^\\p{L}\\p{M}\\p{N}]+', ''), term))",
    "v as (select distinct q, path, rank, term, unnest(range(greatest(0, pos - 13), least(pos, greatest(0, n - 14)) + 1)) as s from m)",
    "k as (select q, path, rank, s, count(*) as k from v group by all)",
    "best as (select q, path, rank, s from (select *, row_number() over (partition by q, path, rank order by k desc, s) as o from k) where o = 1)",
    "hit as (select distinct q, path, rank, pos from m)",
    "line as (select w.q, w.path, w.rank, any_value(n) as n, max(coalesce(s, 0)) as first, string_agg(case when hit.pos is null then word else '⟦' || word || '⟧' end, ' ' order by w.pos) as line from w left join best on best.q = w.q and best.path = w.path and best.rank = w.rank left join hit on hit.q = w.q and hit.path = w.path and hit.rank = w.rank and hit.pos = w.pos where w.pos >= coalesce(s, 0) and w.pos < coalesce(s, 0) + 14 group by 1, 2, 3)",
    "snip as (select q, path, rank, case when first > 0 then '…' else '' end || line || case when first + 14 < n then '…' else '' end as snippet from line)",
]


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, *_SNIPPETS, select="select q, path, rank, snippet from snip"))
def snippets(t: Tables) -> DataFrame:
    found = S.best(index(t), questions(t), 5).select("q", "path", "rank")
    texts = found.join(t.documents.select(F.col("doc_id").alias("path"), "text"), "path").join(questions(t), "q")
    return S.snippets(texts.select("q", "path", "rank", "text", C.query_terms(F.col("query")).alias("terms")), ["q", "path", "rank"])


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, *_SNIPPETS, select="select q, path, rank, len(regexp_extract_all(snippet, '⟦')) as spans from snip"))
def span_count(t: Tables) -> DataFrame:
    return snippets(t).select("q", "path", "rank", S.span_count(F.col("snippet")).alias("spans"))


@query("", _sql(_docs_cte(), _DOCS, "g as (select path as q, title || ' ' || concat_ws(' ', tag_lang, tag_quality) as query from docs where path % 50 = 0)", _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, select="select q, path, score, rank from (" + _ranked_sql("(select * from auto where q <> path and score <= -0.5)", 4, per_call=False) + ")"))
def related_items(t: Tables) -> DataFrame:
    """For the documents whose id is divisible by 50 (a set of questions) their four nearest others by title and tags."""
    asked = t.docs.where("path % 50 = 0").select(F.col("path").alias("q"), F.concat_ws(" ", "title", F.concat_ws(" ", "tag_lang", "tag_quality")).alias("query"))
    hits = S.search(index(t), asked, keep=4 * S.OVERFETCH + 1, floor=-0.5).where("q <> path")  # one more than are ranked, for the document itself
    return S.ranked(hits, 4, per_call=None).select("q", "path", "score", "rank")


@query("", _sql(_docs_cte(), _DOCS, "recent as (select path, grp, title from (select *, row_number() over (partition by grp order by path desc) as n from docs) where n <= 6)", "g as (select grp as q, string_agg(title, ' ' order by path desc) as query from recent group by 1)", _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, select=_ranked_sql("(select * from auto a where score <= -0.5 and not exists (select 1 from recent r where r.grp = a.q and r.path = a.path))", 6, per_call=False)))
def recent_neighbours(t: Tables) -> DataFrame:
    """What is like the six newest documents of each workspace, without these."""
    from parlance.operators.rollups import first_by

    recent = first_by(t.docs.select("path", "grp", "title"), ["grp"], [F.desc("path")], 6)
    asked = recent.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("path", "title")), asc=False).alias("rows"))
    asked = asked.select(F.col("grp").alias("q"), F.array_join(F.transform("rows", lambda r: r["title"]), " ").alias("query"))
    hits = S.search(index(t), asked, keep=6 * S.OVERFETCH + 6, floor=-0.5).join(recent.select(F.col("grp").alias("q"), "path"), ["q", "path"], "left_anti")
    return S.ranked(hits, 6, per_call=None).select("q", "path", "chunk", "score", "rank")


_BLOCKS = [
    f"r as ({_ranked_sql('auto', 8)})",
    "asked as (select q, min(query) as query from g group by 1)",
    "found as (select q, rank, path, coalesce(body, '') as body, greatest(400, 8000 // count(*) over (partition by q)) as size, concat_ws(' · ', case when document_class = 'conversation' then 'from a call' end, status, confidence, case when vault <> '' then '@' || vault end) as spine from r join docs using (path))",
    "ctx as (select q, count(*) as used, sum(least(length(body), size))::bigint as chars, string_agg('[' || path || ' · ' || spine || ']' || chr(10) || case when length(body) > size then left(body, size) || '…' else body end, chr(10) || chr(10) order by rank) as ctx, string_agg(body, ' ' order by rank) as bodies from found group by 1)",
    "voc as (select q, string_agg(canonical || ' — ' || gloss, chr(10) order by canonical) as lines from (select q, canonical, gloss, row_number() over (partition by q order by canonical) as n from asked join ctx using (q) join glosses on contains(lower(query || ' ' || bodies), lower(canonical))) where n <= 6 group by 1)",
]


def _glosses_cte() -> str:
    from parlance.adapters import select

    return f"glosses as (select canonical, alias as gloss from ({select('terms')}) where alias <> '')"


@query("", _sql(_docs_cte(), _glosses_cte(), _DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, *_BLOCKS, select="select q, coalesce(used, 0) as used, coalesce(chars, 0) as chars, case when used is null then '' else case when lines is null then '' else 'Glossary (the user''s own definitions):' || chr(10) || lines || chr(10) || chr(10) end || 'Context:' || chr(10) || ctx || chr(10) || chr(10) || 'Question: ' || query end as block from asked left join ctx using (q) left join voc using (q)"))
def answer_contexts(t: Tables) -> DataFrame:
    """The eight best documents of each question as the block that a model is given: glossary (the terms, with their aliases as meanings), labelled texts cut to their budget, question."""
    docs = t.docs.select("path", F.col("body").alias("text"), "document_class", "status", "confidence", "vault")
    return S.answer_contexts(questions(t), S.best(index(t), questions(t), 8), docs, t.terms.select("canonical", F.col("alias").alias("gloss")))


@query("", "with t0 as (select split_part(p_name, ' ', 1) as canonical from part group by 1), h as (select item_id as q, canonical, row_number() over (partition by item_id order by canonical) as n from benchmark join t0 on contains(lower(text || ' ' || case when item_id % 2 = 0 then 'blue STEEL ' else '' end), lower(canonical))) select q, canonical from h where n <= 6")
def glossary_terms(t: Tables) -> DataFrame:
    """Terms contained in a question's text, six at most. The vocabulary is one row per first word of the parts' names."""
    from parlance.operators.rollups import first_by

    asked = t.benchmark.select(F.col("item_id").alias("q"), F.expr("text || ' ' || case when item_id % 2 = 0 then 'blue STEEL ' else '' end").alias("text"))
    return first_by(S.glossary_hits(asked, t.terms.select("canonical")), ["q"], ["canonical"], 6)


_RUNS = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}''-]+'), lambda x: x <> '')"


@query("", f"with d as (select doc_id as path, {_RUNS} as l from documents), k as (select distinct lower(name) as id from (select array_to_string(list_slice({_RUNS}, 1, 1 + item_id % 4), ' ') as name from benchmark union all select source from documents where source is not null)), w as (select path, unnest(l) as w1, generate_subscripts(l, 1) as pos from d), x as (select path, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4 from w window p as (partition by path order by pos)), g as (select path, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4]) as surface from x), s as (select path, surface from g where regexp_matches(surface, '\\p{{Lu}}') union all select doc_id, source from documents where source is not null) select id, path, surface, count(*) as n from s join k on lower(surface) = id where length(surface) >= 2 group by 1, 2, 3")
def dictionary_mentions(t: Tables) -> DataFrame:
    """The beginnings of the benchmark texts, one to four words, as a dictionary; sources are the documents' attendees."""
    run = F.filter(F.split("text", r"[^\p{L}\p{M}\p{N}'-]+"), lambda x: x != "")
    attendees = t.documents.where("source is not null").select(F.col("doc_id").alias("path"), F.col("source").alias("name"))
    names = t.benchmark.select(F.array_join(F.slice(run, F.lit(1), (1 + F.col("item_id") % 4).cast("int")), " ").alias("name")).unionByName(attendees.select("name").distinct())
    chunks = t.documents.select(F.col("doc_id").alias("path"), F.lit(0).alias("start_ms"), "text")
    return S.mentions(chunks, names.select(C.norm(F.col("name")).alias("id"), "name"), attendees=attendees).select("id", "path", "surface", "n")


@query("", "with w as (select regexp_replace(unnest(string_split(text, ' ')), '^\\p{P}+|\\p{P}+$', '', 'g') as word from documents) select word, count(*) as n from w where regexp_matches(word, '^\\p{Lu}{2,5}$') and lower(word) not in ('ok', 'am', 'pm', 'tv', 'us', 'uk', 'id', 'ai', 'iou', 'the') group by 1 having count(*) >= 2 order by n desc, word limit 5")
def acronym_candidates(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("The",)], "word string")
    return S.acronyms(t.documents.select("text"), known)


@query("", "select item_id as id, text as query, (select string_agg(doc_id, ',' order by doc_id) from documents where contains(text, b.text)) as expect from benchmark b")
def gold_cases(t: Tables) -> DataFrame:
    """Questions with the documents that hold the benchmark text.

    Candidates share its longest word that has other characters on both sides, which stands whole in
    both; texts without such a word are compared with every document.
    """
    gold = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    split = lambda c: F.split(c, r"[^\p{L}\p{M}\p{N}]+")
    inner = F.slice(split("query"), F.lit(2), F.greatest(F.size(split("query")) - 2, F.lit(0)))
    keyed = gold.select("id", "query", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"].alias("word"))
    words = t.documents.select("doc_id", F.explode(F.array_distinct(split("text"))).alias("word"))
    pairs = words.join(keyed.where("word is not null"), "word").select("id", "query", "doc_id").distinct()
    hits = pairs.join(t.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("query"))).select("id", "doc_id")
    bare = t.documents.select("doc_id", "text").join(keyed.where("word is null"), F.contains("text", F.col("query"))).select("id", "doc_id")
    hits = hits.unionByName(bare)
    lists = hits.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("expect"))
    return gold.join(lists, "id", "left").select("id", "query", "expect")


def _gold(t: Tables) -> DataFrame:
    rows = gold_cases(t).where("expect is not null")
    return rows.select(F.col("id").alias("q"), "query", F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("slice"), F.transform(F.split("expect", ","), lambda x: x.cast("long")).alias("expect"))


_WANT = "want as (select item_id as q, doc_id as path from benchmark b join documents d on contains(d.text, b.text))"
_BEST = f"best as (select w.q, min(rank) as rank from want w left join ({_ranked_sql('auto')}) r on r.q = w.q and r.path = w.path group by 1)"


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, _WANT, _BEST, select="select 's' || (q % 2) as slice, count(*) as cases, round(avg(case when rank = 1 then 1.0 else 0.0 end), 9) as recall_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 9) as recall_k, round(avg(coalesce(1.0 / rank, 0)), 9) as mrr from best group by 1"))
def eval_metrics(t: Tables) -> DataFrame:
    gold = _gold(t)
    return S.evaluate(S.best(index(t), questions(t)), gold)


@query("", _sql(_DOCS, _GOLD, _queries_sql("g"), _index_sql("p"), _SCORE, _AUTO, _WANT, _BEST, select="select 'docs' as fingerprint, q from best where coalesce(rank, 99) > 1 and q % 2 = 0"))
def eval_regressions(t: Tables) -> DataFrame:
    gold = _gold(t)
    hits = S.best(index(t), questions(t))
    best = gold.select("q", F.explode("expect").alias("path")).join(hits.select("q", "path", "rank"), ["q", "path"], "left").groupBy("q").agg(F.min("rank").alias("rank"))
    now = best.select(F.lit("docs").alias("fingerprint"), "q", (F.coalesce("rank", F.lit(99)) == 1).alias("passed"))
    before = now.select("fingerprint", "q", (F.col("q") % 2 == 0).alias("passed"))
    return S.regressions(now, before)


_EVERYWHERE = "asked as (select a.q * 10 + s.n as q, a.query, null::varchar as participant, null::varchar as tag, null::date as since, null::varchar as speaker, s.grp from (select path as q, array_to_string(list_slice(" + _FIRST_WORDS + ", 1, 3), ' ') as query from talks where path % 50 = 0) a, (select grp, row_number() over (order by grp) as n from (select distinct grp from talks)) s)"


@query("", _sql(*_whole_ctes(_EVERYWHERE), select="select s.grp as scope, count(shown.path) as hits, 0::bigint as leaks from (select distinct grp from talks) s left join asked on asked.grp = s.grp left join shown on shown.q = asked.q group by 1"))
def leak_check(t: Tables) -> DataFrame:
    """Every fiftieth conversation's first words, asked within every workspace: what is found, and what of it is another workspace's by the conversations themselves (none may be)."""
    made = corpus(t)
    places = made.calls.select("grp").distinct().withColumn("n", F.row_number().over(W.orderBy("grp")))  # one row per workspace
    asked_ = made.calls.where("path % 50 = 0").select(F.col("path").alias("p"), F.array_join(F.slice(C.tokens(F.col("first_text")), 1, 3), " ").alias("query"))
    probes = asked_.withColumn("grp", F.explode(F.array(*[F.lit(r["grp"]) for r in places.select("grp").collect()]))).join(F.broadcast(places), "grp")
    probes = probes.select((F.col("p") * 10 + F.col("n")).alias("q"), "query", *[F.lit(None).cast("string").alias(c) for c in ("participant", "tag", "since", "speaker")], "grp")
    found = S.whole_search(made, probes).join(probes.select("q", F.col("grp").alias("scope")), "q").select("scope", "path")
    truth = t.conversations.select(F.col("conv_id").alias("path")).distinct().select("path", F.expr("case path % 5 when 0 then '' else 'w' || (path % 5) end").alias("grp"))
    counts = S.leaks(found, truth)
    return places.select(F.col("grp").alias("scope")).join(counts, "scope", "left").select("scope", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("leaks", F.lit(0)).alias("leaks"))
