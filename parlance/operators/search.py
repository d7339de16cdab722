"""Full-text search: index, prefix and phrase matching, BM25, alias groups, fused results.

The index (operators/index.py) is stored, so a corpus is tokenised once and any number of searches read it, each only the
buckets of its terms. Many queries run in one job: queries are rows. A passage is (path, chunk, text, ...).
Scores are negative, lower is better, rounded to nine places; ties go by path and chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators.index import Index, build_index
from parlance.operators.scoring import best_hits, expand_prefixes, form_hits, phrase_lists, small
from parlance.sources.storage import broadcast_few, stored

OVERFETCH, PER_CALL, LIMIT, TOPIC_SLOTS = 4, 2, 10, 3
#: Weights of the topic fields.
TOPIC_WEIGHTS = {"title": 4.0, "summary": 1.0, "tags": 3.0, "participants": 0.5}
# Short words in capitals that are no acronyms of the corpus.
PLAIN_CAPITALS = ("ok", "am", "pm", "tv", "us", "uk", "id", "ai", "iou")


def corpus_stats(passages: DataFrame) -> DataFrame:
    """One row: n passages, mean length in tokens."""
    sizes = passages.select(F.size(C.tokens(F.col("text"))).alias("len"))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("len") / F.count(F.lit(1))).alias("mean_len"))


def terms_of(queries: DataFrame, legacy: bool = False) -> DataFrame:
    """q, term, n_terms of queries (q, query)."""
    rows = queries.select("q", C.query_terms(F.col("query"), legacy).alias("terms"))
    return rows.select("q", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def indexed(passages: DataFrame | Index) -> Index:
    """The index itself, or that of passages."""
    return passages if isinstance(passages, Index) else build_index(passages)


def term_hits(terms: DataFrame, index: Index) -> DataFrame:
    """term, path, chunk, tf, len: uses of all tokens that begin with the term. Only the buckets of the terms are read."""
    buckets = index.buckets_of(terms)
    matches = expand_prefixes(terms, index.dictionary(buckets))
    return index.postings(buckets).join(matches, "token").groupBy("term", "path", "chunk").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def phrase_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """phrase, path, chunk, tf, len: exact word sequences, from positions, by shards of passages. Phrases without a word have no hits."""
    named = stored(phrases.select("phrase").distinct().select("phrase", F.monotonically_increasing_id().alias("t"), C.tokens(F.col("phrase")).alias("tokens")).where("size(tokens) > 0"), "phrases")
    lists = phrase_lists(index, named).join(named.select("t", "phrase"), "t").select("phrase", F.explode(F.arrays_zip("path", "chunk", "tf", "len")).alias("x"))
    return lists.select("phrase", "x.path", "x.chunk", F.col("x.tf").cast("long").alias("tf"), "x.len")


def ranked(hits: DataFrame, limit: int = LIMIT, per_call: int | None = PER_CALL, overfetch: int = OVERFETCH) -> DataFrame:
    """The best of each query: over-fetched, then so many per call, then the limit; rank from 1."""
    order = ["score", "path", "chunk"]
    w = W.partitionBy("q").orderBy(*order)
    rows = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit * overfetch)
    if per_call:
        rows = rows.withColumn("_c", F.row_number().over(W.partitionBy("q", "path").orderBy(*order))).where(F.col("_c") <= per_call).drop("_c")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_r")


def search(passages: DataFrame | Index, queries: DataFrame, mode: str = "auto", legacy: bool = False, keep: int | None = None, floor: float | None = None) -> DataFrame:
    """All scored hits. ``and``: every term; ``or``: any; ``auto``: any, only for queries that no passage meets whole.

    ``keep``: only each query's so many best, for those who rank them; ``floor``: only scores of that or lower. The mode looks at all hits.
    """
    return best_hits(indexed(passages), stored(terms_of(queries, legacy), "search-terms"), mode, keep, floor)


def best(passages: DataFrame | Index, queries: DataFrame, limit: int = LIMIT, per_call: int | None = PER_CALL, mode: str = "auto", legacy: bool = False) -> DataFrame:
    """The ranked search: no more of a query's hits than its ranking looks at leave their shard."""
    return ranked(search(passages, queries, mode, legacy, limit * OVERFETCH), limit, per_call)


def leaks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """scope, hits, leaks: hits (scope, path), and those that by the truth (path, grp) belong to another group."""
    return hits.join(truth.select("path", "grp"), "path").groupBy("scope").agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("grp").eqNullSafe(F.col("scope"))).alias("leaks"))


def topic_index(topics: DataFrame, weights: dict[str, float] | None = None) -> Index:
    """The index of rows (path, title, summary, tags, participants as text) by their weighted fields."""
    return build_index(topics.withColumn("chunk", F.lit(0).cast("long")), weights or TOPIC_WEIGHTS)


def topic_search(topics: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """Column-weighted BM25 over topics, all terms: q, path, score, snippet."""
    hits = search(index or topic_index(topics), queries, "and")
    return hits.join(topics.select("path", F.left("summary", F.lit(160)).alias("snippet")), "path").select("q", "path", "score", "snippet")


def fuse(passages: DataFrame, topics: DataFrame, limit: int = LIMIT, slots: int = TOPIC_SLOTS) -> DataFrame:
    """q, path, chunk, source, place: passages (q, path, rank; chunk, if they have it) first, up to ``slots`` places kept for calls that only topics (q, path, score) find, then the rest."""
    only = topics.join(passages.select("q", "path").distinct(), ["q", "path"], "left_anti")
    only = only.select("q", "path", F.row_number().over(W.partitionBy("q").orderBy("score", "path")).alias("rank"))
    kept = only.groupBy("q").agg(F.least(F.count(F.lit(1)), F.lit(slots)).alias("kept"))
    passages = passages if "chunk" in passages.columns else passages.withColumn("chunk", F.lit(None).cast("long"))
    first = passages.join(kept, "q", "left").select("q", "path", "chunk", F.lit("passage").alias("source"), "rank", F.when(F.col("rank") <= limit - F.coalesce("kept", F.lit(0)), 0).otherwise(2).alias("stage"))
    every = first.unionByName(only.select("q", "path", F.lit(None).cast("long").alias("chunk"), F.lit("topic").alias("source"), "rank", F.lit(1).alias("stage")))
    place = F.row_number().over(W.partitionBy("q").orderBy("stage", "rank"))
    return every.withColumn("place", place).where(F.col("place") <= limit).select("q", "path", "chunk", "source", "place")


def _forms(terms: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, form: what a term (keys, term) can be: itself, and the members of the first group (keys, grp_no, members) that has it as a single word."""
    member = groups.select(*keys, "grp_no", "members", F.explode("members").alias("term")).where("not contains(term, ' ')")
    first = member.groupBy(*keys, "term").agg(F.min(F.struct("grp_no", "members"))["members"].alias("members"))
    forms = terms.select(*keys, "term").distinct().join(first, [*keys, "term"], "left")
    forms = forms.select(*keys, "term", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("members", F.array().cast("array<string>"))))).alias("form"))
    return forms.withColumn("form", F.trim(F.regexp_replace(F.translate("form", '"', " "), " +", " "))).where("form <> ''").distinct()


def alias_search(passages: DataFrame | Index, queries: DataFrame, groups: DataFrame) -> DataFrame:
    """Search in which a term that is a single-word member of an alias group (grp_no, members array) means any member; the first group counts."""
    index, terms = indexed(passages), stored(terms_of(queries), "search-terms")
    forms = stored(_forms(terms, groups, []), "search-forms")
    return form_hits(index, terms, forms, [], whole=True).drop("matched")


@dataclass
class Corpus:
    """What a whole search reads: two indexes and the tables that filter and show their hits.

    calls: path, title, day, grp, kind, participants, tags (arrays), summary; chunks: path, chunk, start_ms, speaker, text;
    aliases: grp_no, grp ("" for all workspaces), members (array, lower case).
    """

    passages: Index
    topics: Index
    calls: DataFrame
    chunks: DataFrame
    aliases: DataFrame


def _filters(asked: DataFrame, calls: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the questions ask of a passage: filters by passage (filter, path, chunk) and by question (q, filter).

    Every question has a workspace, "*" for all of them; participants and tags are whole ones whatever their case, ``since`` is a first
    day. ``passages``: path, chunk and, where questions name one, speaker.
    """
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    named = [one("scope", F.coalesce(F.concat(F.lit("s"), "grp"), F.lit("*"))), one("participant", F.lower("participant")), one("tag", F.lower("tag")), one("since", F.col("since"))]
    named += [one("speaker", F.col("speaker"))] if "speaker" in passages.columns else []
    rows = stored(asked.select("q", F.explode(F.array(*named)).alias("x")).select("q", "x.kind", "x.value").where("value is not null"), "asked-filters")
    values = stored(rows.select("kind", "value").distinct().withColumn("filter", F.monotonically_increasing_id()), "filters")
    has = lambda kind, column: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: one(kind, F.lower(x)))
    own = F.concat(F.array(one("scope", F.lit("*")), one("scope", F.concat(F.lit("s"), "grp"))), has("participant", "participants"), has("tag", "tags"))
    of_calls = calls.select("path", F.explode(own).alias("x")).select("path", "x.kind", "x.value").join(small(values.where("kind not in ('since', 'speaker')")), ["kind", "value"]).select("path", "filter")
    days = calls.select("path", "day").join(F.broadcast(values.where("kind = 'since'")), F.col("day") >= F.col("value").cast("date")).select("path", "filter")
    allowed = of_calls.unionByName(days).distinct().join(passages.select("path", "chunk").distinct(), "path").select("filter", "path", "chunk")
    if "speaker" in passages.columns:
        spoke = passages.select("path", "chunk", F.col("speaker").alias("value")).distinct().join(small(values.where("kind = 'speaker'")), "value")
        allowed = allowed.unionByName(spoke.select("filter", "path", "chunk"))
    return stored(allowed, "filter-passages"), stored(rows.join(values, ["kind", "value"]).select("q", "filter"), "question-filters")


def whole_search(corpus: Corpus, queries: DataFrame, limit: int = LIMIT, slots: int = TOPIC_SLOTS, snippet_words: int = 14, without: DataFrame | None = None) -> DataFrame:
    """q, place, source, path, title, day, start_ms, speaker, score, snippet for questions (q, query, participant, tag, since, speaker, grp; null: any).

    Spoken passages and topics (title, summary, tags, participants) are both asked, with the workspace's aliases. A question
    is answered by hits of all its terms if there are any on either surface, else by hits of any term. Filters are applied to the
    candidates, before any limit. Passages come first, two of a call at most; places are kept for calls that only their topic finds;
    a question for one speaker has no topics. ``without``: calls (q, path) that are no candidates of a question.
    """
    shown, words = _placed(corpus, queries, limit, slots, without)
    shown = stored(shown, "shown")
    texts = shown.where("source = 'passage'").select("q", "place", "path", "chunk").join(corpus.chunks.select("path", "chunk", "text"), ["path", "chunk"]).join(words, "q")
    cut = snippets(texts.select("q", "place", "text", "terms"), ["q", "place"], snippet_words)
    topic_text = F.coalesce(F.nullif(F.left("summary", F.lit(160)), F.lit("")), F.lit("matched on topic"))
    out = shown.join(cut, ["q", "place"], "left")
    return out.select("q", "place", "source", "path", "title", "day", "start_ms", "speaker", "score", F.when(F.col("source") == "passage", F.col("snippet")).otherwise(topic_text).alias("snippet"))


def placed(corpus: Corpus, queries: DataFrame, limit: int = LIMIT, slots: int = TOPIC_SLOTS, without: DataFrame | None = None) -> DataFrame:
    """The hits of a whole search (q, place, source, path, title, day, start_ms, speaker, score), for those who don't show snippets."""
    return _placed(corpus, queries, limit, slots, without)[0].drop("chunk", "summary")


def _placed(corpus: Corpus, queries: DataFrame, limit: int, slots: int, without: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The hits of a whole search in their places, and the words (q, terms) that their snippets mark."""
    asked = stored(queries.select("q", "query", "participant", "tag", F.col("since").cast("date").alias("since"), "speaker", "grp"), "asked")
    scope = F.coalesce(F.concat(F.lit("s"), "grp"), F.lit("")).alias("scope")  # "" for every workspace, which no name is
    terms = terms_of(asked).join(asked.select("q", scope), "q")
    terms = stored(terms, "search-terms")
    scopes = terms.select("scope").distinct()
    seen = corpus.aliases.join(scopes, (F.col("scope") == "") | (F.col("grp") == "") | (F.concat(F.lit("s"), "grp") == F.col("scope")))
    forms = stored(_forms(terms, seen.select("scope", "grp_no", "members"), ["scope"]), "search-forms")
    allowed, wanted = _filters(asked, corpus.calls, corpus.chunks.select("path", "chunk", "speaker"))
    spoken = form_hits(corpus.passages, terms, forms, ["scope"], keep=limit * OVERFETCH, allowed=allowed, wanted=wanted, without=without)
    spoken = spoken.join(corpus.chunks.select("path", "chunk", "start_ms", "speaker"), ["path", "chunk"]).join(asked.select("q", F.col("speaker").alias("wanted")), "q")
    spoken = stored(spoken.where(F.col("wanted").isNull() | (F.col("wanted") == F.col("speaker"))).drop("wanted"), "passage-hits")
    untold = asked.where("speaker is null")
    allowed, wanted = _filters(untold, corpus.calls.where("kind = 'call'"), corpus.calls.select("path", F.lit(0).alias("chunk")))
    topical = form_hits(corpus.topics, terms, forms, ["scope"], keep=limit, allowed=allowed, wanted=wanted, without=without)
    topical = stored(topical.select("q", "path", "score", "matched", "n_terms"), "topic-hits")
    every = spoken.select("q", "matched", "n_terms").unionByName(topical.select("q", "matched", "n_terms"))
    whole = every.groupBy("q").agg(F.bool_or(F.col("matched") == F.col("n_terms")).alias("_whole"))
    told = lambda hits: hits.join(whole, "q").where(~F.col("_whole") | (F.col("matched") == F.col("n_terms"))).drop("_whole")
    passages = stored(ranked(told(spoken), limit), "passages")
    topics = told(topical).withColumn("_t", F.row_number().over(W.partitionBy("q").orderBy("score", "path"))).where(F.col("_t") <= limit)
    shown = fuse(passages.select("q", "path", "chunk", "rank"), topics.select("q", "path", "score"), limit, slots)
    shown = shown.join(passages.select("q", "path", "chunk", "score", "start_ms", "speaker"), ["q", "path", "chunk"], "left")
    shown = shown.join(topics.select("q", "path", F.col("score").alias("_topic")), ["q", "path"], "left").join(corpus.calls.select("path", "title", "day", "summary"), "path")
    spoke = F.col("source") == "passage"
    shown = shown.select("q", "place", "source", "path", "chunk", "title", "day", "summary", F.when(spoke, F.col("start_ms")).otherwise(0).alias("start_ms"), "speaker", F.when(spoke, F.col("score")).otherwise(F.col("_topic")).alias("score"))
    words = terms.join(forms, ["scope", "term"]).where("not contains(form, ' ')").groupBy("q").agg(F.collect_set("form").alias("terms"))
    return shown, words


def snippets(rows: DataFrame, ids: list[str], size: int = 14) -> DataFrame:
    """ids, snippet of rows (ids, text, terms): the first window of so many words with most distinct matched terms; matches in brackets, cuts marked.

    Words match if they begin with a term. The text's own words are kept, white space is not. Each text is read once
    as rows of words; a match votes for the starts of the windows that hold it.
    """
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    cut = stored(rows.select(*ids, "terms", split.alias("words")).select(*ids, "terms", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word")), "snippet-words")
    bare = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{M}\p{N}]+", "")
    words = cut.withColumn("bare", bare).select(*ids, "n", "pos", "word", F.filter("terms", lambda t: F.startswith(F.col("bare"), t)).alias("met"))
    last = F.greatest(F.lit(0), F.col("n") - size)
    votes = words.where(F.size("met") > 0).select(*ids, "pos", last.alias("last"), F.explode("met").alias("term"))
    votes = votes.select(*ids, "term", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - size + 1), F.least("pos", "last"))).alias("start"))
    tally = votes.groupBy(*ids, "start").agg(F.count_distinct("term").alias("k"))
    best = tally.groupBy(*ids).agg(F.max(F.struct("k", (-F.col("start")).alias("s"))).alias("best")).select(*[F.col(c).alias(f"_{c}") for c in ids], (-F.col("best.s")).alias("start"))
    same = None
    for c in ids:
        now = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = now if same is None else same & now
    start = F.coalesce("start", F.lit(0))
    shown = words.join(best, same, "left").where(F.col("pos").isNull() | ((F.col("pos") >= start) & (F.col("pos") < start + size)))
    mark = F.when(F.size("met") > 0, F.concat(F.lit("⟦"), "word", F.lit("⟧"))).otherwise(F.col("word"))
    lines = shown.groupBy(*ids).agg(F.max(start).alias("at"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", mark.alias("word")))).alias("line"))
    text = F.concat(F.when(F.col("at") > 0, "…").otherwise(""), F.array_join(F.transform("line", lambda x: x["word"]), " "), F.when(F.col("at") + size < F.col("n"), "…").otherwise(""))
    return lines.select(*ids, text.alias("snippet"))


def span_count(text: Column) -> Column:
    """Highlighted spans of a snippet."""
    return F.length(text) - F.length(F.replace(text, F.lit("⟦"), F.lit("")))


def evaluate(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """recall@1, recall@k and MRR by slice, for hits (q, path, rank) and gold (q, slice, expect array)."""
    wanted = gold.select("q", "slice", F.explode_outer("expect").alias("path"))
    best = wanted.join(hits.select("q", "path", "rank"), ["q", "path"], "left").groupBy("q", "slice").agg(F.min("rank").alias("rank"))
    mean = lambda c: F.round(F.avg(c), 9)
    return best.groupBy("slice").agg(F.count(F.lit(1)).alias("cases"), mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("recall_1"), mean(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall_k"), mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def regressions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Cases (fingerprint, q, passed) that passed before and fail now, over the same fingerprint."""
    old = before.where("passed").select("fingerprint", "q")
    return now.where("not passed").join(old, ["fingerprint", "q"], "left_semi").select("fingerprint", "q")


def mentions(chunks: DataFrame, names: DataFrame, longest: int = 4, attendees: DataFrame | None = None) -> DataFrame:
    """Dictionary mentions: known names (id, name) in chunk texts (path, start_ms, text), as sequences of up to so many words with a capital.

    A word is looked up among the first words of names, and only the lengths that names with this first word have are put together.
    Attendees (path, name) are mentions at the beginning, with or without a capital.
    """
    keys = stored(names.select("id", C.norm(F.col("name")).alias("key")).distinct(), "names")
    lengths = F.size(F.split("key", " "))
    firsts = keys.where(lengths <= longest).groupBy(F.split_part("key", F.lit(" "), F.lit(1)).alias("first")).agg(F.collect_set(lengths).alias("lengths"))
    words = F.filter(F.split("text", r"[^\p{L}\p{M}\p{N}'-]+"), lambda x: x != "")
    ahead = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(longest)]
    rows = chunks.select("path", "start_ms", words.alias("w")).select("path", "start_ms", F.inline(F.arrays_zip(*ahead)))
    rows = rows.join(broadcast_few(firsts), F.lower("w0") == F.col("first")).withColumn("n", F.explode("lengths"))
    surface = F.coalesce(*[F.when(F.col("n") == k, F.concat_ws(" ", *[f"w{i}" for i in range(k)])) for k in range(1, longest + 1)])
    rows = rows.where(F.expr(" or ".join(f"n = {k} and w{k - 1} is not null" for k in range(1, longest + 1)))).select("path", "start_ms", surface.alias("surface")).where(F.col("surface").rlike(r"\p{Lu}"))
    if attendees is not None:
        rows = rows.unionByName(attendees.select("path", F.lit(0).cast(chunks.schema["start_ms"].dataType).alias("start_ms"), C.trim_all(F.col("name")).alias("surface")))
    found = rows.where(F.length("surface") >= 2).join(broadcast_few(keys), F.lower("surface") == F.col("key"))
    return found.groupBy("id", "path", "surface").agg(F.min("start_ms").alias("start_ms"), F.count(F.lit(1)).alias("n"))


def glossary_hits(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """q, canonical: terms (canonical) contained in questions (q, text), in any case. Pieces of the questions of the
    lengths that terms have meet the terms by an equi-join."""
    keys = terms.select("canonical", F.lower("canonical").alias("piece")).where("piece <> ''")
    sizes = keys.agg(F.collect_set(F.length("piece")).alias("sizes"))  # one row of the lengths that occur
    rows = asked.select("q", F.lower("text").alias("hay")).crossJoin(F.broadcast(sizes)).select("q", "hay", F.explode("sizes").alias("size"))
    starts = F.sequence(F.lit(1), F.length("hay") - F.col("size") + 1)
    pieces = rows.where(F.length("hay") >= F.col("size")).select("q", "hay", "size", F.explode(starts).alias("at")).select("q", F.substring(F.col("hay"), F.col("at"), F.col("size")).alias("piece"))
    return pieces.distinct().join(keys, "piece").select("q", "canonical").distinct()


def spine() -> Column:
    """What a passage is, as its label says: from a call, its status, its confidence, its vault."""
    return F.concat_ws(" · ", F.when(F.col("document_class") == "conversation", "from a call"), "status", "confidence", F.when(F.col("vault") != "", F.concat(F.lit("@"), "vault")))


def answer_contexts(asked: DataFrame, found: DataFrame, docs: DataFrame, terms: DataFrame, cap: int = 8000, least: int = 400, most_terms: int = 6) -> DataFrame:
    """q, used, chars, block for questions (q, query): what a model is given to answer each, "" if nothing was found for it.

    A block has the glossary (of terms (canonical, gloss) that question or whole texts contain, the first so many by name), then every document
    found (q, path, rank), labelled with its path and spine and cut to its even share of the cap, but to no less than ``least``, then the question. docs: path,
    text, document_class, status, confidence, vault. ``chars``: how many of the texts' characters are in it.
    """
    asked = asked.groupBy("q").agg(F.min("query").alias("query"))
    passage = F.struct("rank", F.concat(F.lit("["), F.col("path").cast("string"), F.lit(" · "), spine(), F.lit("]\n")).alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    rows = found.select("q", "path", "rank").join(docs, "path").groupBy("q").agg(F.array_sort(F.collect_list(passage)).alias("rows"))
    rows = stored(asked.join(rows, "q", "left"), "answer-passages")
    hay = F.lower(F.concat_ws(" ", "query", F.transform("rows", lambda r: r["text"])))
    named = broadcast_few(terms.where("gloss <> ''").select("canonical", "gloss", F.lower("canonical").alias("_name")))
    spoken = rows.where("rows is not null").select("q", hay.alias("_hay")).join(named, F.contains("_hay", F.col("_name"))).select("q", "canonical", "gloss")
    glossary = spoken.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("canonical", "gloss"))), 1, most_terms).alias("g"))
    glossary = glossary.select("q", F.array_join(F.transform("g", lambda x: F.concat(x["canonical"], F.lit(" — "), x["gloss"])), "\n").alias("glossary"))
    size = F.greatest(F.lit(least), F.floor(F.lit(cap) / F.size("rows")).cast("int"))
    cut = lambda r: F.concat(r["label"], F.when(F.length(r["text"]) > size, F.concat(F.left(r["text"], size), F.lit("…"))).otherwise(r["text"]))
    head = F.coalesce(F.concat(F.lit("Glossary (the user's own definitions):\n"), "glossary", F.lit("\n\n")), F.lit(""))
    block = F.concat(head, F.lit("Context:\n"), F.array_join(F.transform("rows", cut), "\n\n"), F.lit("\n\nQuestion: "), "query")
    chars = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.least(F.length(r["text"]), size))
    out = rows.join(glossary, "q", "left")
    return out.select("q", F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("used"), F.coalesce(chars, F.lit(0)).alias("chars"), F.coalesce(block, F.lit("")).alias("block"))


def acronyms(texts: DataFrame, known: DataFrame, least: int = 2, limit: int = 5) -> DataFrame:
    """The most frequent words of two to five capitals that are not known (word) and not blocked."""
    word = F.regexp_replace("raw", r"^\p{P}+|\p{P}+$", "")
    rows = texts.select(F.explode(F.split("text", " ")).alias("raw")).select(word.alias("word")).where(F.col("word").rlike(r"^\p{Lu}{2,5}$"))
    rows = rows.where(~F.lower("word").isin(*PLAIN_CAPITALS))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(known.select(F.lower("word").alias("k")), F.lower("word") == F.col("k"), "left_anti").orderBy(F.desc("n"), "word").limit(limit)
