"""The stored index and the published corpus: segments, manifests, buckets, phrases, whole searches, questions of live calls."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import index as I
from parlance.operators import search as S
from parlance.sources.library import Library
from parlance.sources.storage import fresh_path

WORDS = ["alpha", "beta", "alphabet", "gamma", "be", "a", "delta", "ä"]


def library(spark):
    return Library(spark, fresh_path(spark, "library"), {"calls": "path long, v string", "lines": "path long, n int"})


def rows(lib, table):
    return sorted(tuple(r) for r in lib.read(table).collect())


def test_updates_replace_paths_in_all_tables(spark):
    lib = library(spark)
    assert rows(lib, "calls") == []
    lib.apply({"calls": spark.createDataFrame([(1, "a"), (2, "b")], "path long, v string"), "lines": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "path long, n int")}, batch=0)
    before = lib.current()
    lib.apply({"calls": spark.createDataFrame([(1, "c"), (3, "d")], "path long, v string"), "lines": spark.createDataFrame([(3, 7)], "path long, n int")}, removed=spark.createDataFrame([(9,)], "path long"), batch=1)
    assert rows(lib, "calls") == [(1, "c"), (2, "b"), (3, "d")] and rows(lib, "lines") == [(2, 1), (3, 7)]
    assert sorted(tuple(r) for r in lib.read("calls", before).collect()) == [(1, "a"), (2, "b")]
    assert not lib.apply({"calls": spark.createDataFrame([(1, "again")], "path long, v string")}, batch=1)
    lib.apply({}, removed=spark.createDataFrame([(2,)], "path long"), batch=2)
    assert rows(lib, "calls") == [(1, "c"), (3, "d")] and rows(lib, "lines") == [(3, 7)]
    lib.merge()
    assert rows(lib, "calls") == [(1, "c"), (3, "d")] and len(lib.current().segments) == 1
    lib.apply({"calls": spark.createDataFrame([(3, "e")], "path long, v string")})
    assert rows(lib, "calls") == [(1, "c"), (3, "e")] and rows(lib, "lines") == []


def test_a_failed_update_leaves_all_tables_as_they_were(spark):
    lib = library(spark)
    lib.apply({"calls": spark.createDataFrame([(1, "a")], "path long, v string"), "lines": spark.createDataFrame([(1, 1)], "path long, n int")}, batch=0)
    broken = spark.createDataFrame([(1, 5)], "path long, n int").select("path", F.raise_error(F.lit("no")).cast("int").alias("n"))
    with pytest.raises(Exception):
        lib.apply({"calls": spark.createDataFrame([(1, "b"), (2, "c")], "path long, v string"), "lines": broken}, batch=1)
    with pytest.raises(Exception):
        lib.apply({"calls": spark.createDataFrame([(None, "b")], "path long, v string")}, batch=1)
    with pytest.raises(ValueError):
        lib.apply({"other": spark.createDataFrame([(1, "b")], "path long, v string")}, batch=1)
    assert rows(lib, "calls") == [(1, "a")] and rows(lib, "lines") == [(1, 1)] and lib.current().batch == 0


def size(folder: str) -> int:
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_an_update_writes_what_it_brings(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKETS", 2)
    rng = random.Random(1)
    texts = lambda ids: spark.createDataFrame([(i, 0, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in ids], "path long, chunk long, text string")
    index = I.build_index(texts(range(3000)))
    first = index.snapshot.segments[0][1]
    index.apply(texts(range(30)))
    assert size(index.snapshot.segments[1][1]) < 0.08 * size(first)
    assert index.stats.first()["n_docs"] == 3000


def test_an_updated_index_is_a_new_one(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKETS", 3)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
    old = {(p, c): text() for p in range(30) for c in range(2)}
    frame = lambda d: spark.createDataFrame([(p, c, t) for (p, c), t in d.items()], "path long, chunk long, text string")
    index = I.build_index(frame(old))
    fresh = {(p, 0): text() for p in (1, 2, 3, 40)}
    index.apply(frame(fresh), removed=spark.createDataFrame([(5,), (77,)], "path long"))
    now = {k: t for k, t in old.items() if k[0] not in (1, 2, 3, 5)} | fresh
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 2))) for i in range(8)], "q long, query string")
    phrases = spark.createDataFrame([(" ".join(rng.choice(WORDS) for _ in range(n)),) for n in (1, 2, 2, 3, 3, 4)] + [("be be",), ("nothing",), ("a nothing",), ("",)], "phrase string")
    other = I.build_index(frame(now))
    found = lambda i: sorted(tuple(r) for r in S.search(i, queries).collect())
    assert found(index) == found(other) != []
    texts = {k: f" {t} ".replace(" ", "  ") for k, t in now.items()}
    want = sorted((p, *k, n) for p in {r["phrase"] for r in phrases.collect() if r["phrase"]} for k, t in texts.items() if (n := sum(t[i:].startswith("  ".join(f" {p} ".split(" "))) for i in range(len(t)))))
    met = lambda i: sorted((r["phrase"], r["path"], r["chunk"], r["tf"]) for r in S.phrase_hits(phrases, i).collect())
    assert met(index) == met(other) == want
    index.merge()
    assert found(index) == found(other) and met(index) == want and len(index.snapshot.segments) == 1


def test_a_search_reads_the_buckets_of_its_terms(spark):
    index = I.build_index(spark.createDataFrame([(i, 0, f"{a}{b}word") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "stuvwxyz")], "path long, chunk long, text string"))
    terms = spark.createDataFrame([("as",), ("asw",)], "term string")
    (bucket,) = index.buckets_of(terms)
    hits = S.term_hits(terms, index)
    assert {(r["term"], r["path"]) for r in hits.collect()} == {("as", 0), ("asw", 0)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and f"= {bucket})" in plan.replace(f"IN ({bucket})", f"= {bucket})")
    assert index.buckets_of(spark.createDataFrame([("a",), ("as",)], "term string")) is None


def test_whole_searches(spark):
    calls = [(1, "Budget talk", "2024-01-05", "w1", "call", ["Ann Lee"], ["t1"], "about money"), (2, "Other", "2024-02-05", "w2", "call", ["Bob"], ["T2"], ""), (3, "Budget note", "2024-03-01", "w1", "note", ["Ann Lee"], [], ""), (4, "Budget again", "2024-03-02", "w1", "call", ["ann"], [], "")]
    chunks = [(1, 0, 0, "you", "the budget moved"), (1, 1, 900, "them", "budget review moved"), (1, 2, 1800, "them", "budget budget review"), (2, 0, 0, "you", "budget plan"), (2, 1, 10, "them", "our eta moved"), (4, 0, 0, "them", "the estimated time is late")]
    made = S.Corpus(
        I.build_index(spark.createDataFrame([(p, c, t) for p, c, _, _, t in chunks], "path long, chunk long, text string")),
        S.topic_index(spark.createDataFrame([(p, t, s, " ".join(g), " ".join(n)) for p, t, _, _, _, n, g, s in calls], "path long, title string, summary string, tags string, participants string")),
        spark.createDataFrame(calls, "path long, title string, day string, grp string, kind string, participants array<string>, tags array<string>, summary string").withColumn("day", F.to_date("day")),
        spark.createDataFrame(chunks, "path long, chunk long, start_ms long, speaker string, text string"),
        spark.createDataFrame([(1, "w1", ["eta", "estimated time"])], "grp_no long, grp string, members array<string>"),
    )
    asked = [("plain", "budget", *[None] * 5), ("who", "budget", "ANN LEE", None, None, None, None), ("tag", "budget", None, "t2", None, None, None), ("since", "budget", None, None, "2024-02-01", None, None), ("speaker", "budget", None, None, None, "them", None), ("scope", "moved", None, None, None, None, "w2"), ("none", "budget zzz", None, None, None, None, "w2"), ("alias", "eta", None, None, None, None, "w1"), ("other", "eta", None, None, None, None, "w2"), ("empty", "zzz", *[None] * 5)]
    queries = spark.createDataFrame(asked, "q string, query string, participant string, tag string, since string, speaker string, grp string")
    got = {}
    for r in S.whole_search(made, queries).orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append((r["source"], r["path"], r["start_ms"]))
    assert sorted(x[:2] for x in got["plain"]) == [("passage", 1), ("passage", 1), ("passage", 2), ("topic", 4)]  # two of call 1; the note has no topic
    assert {x[1] for x in got["who"]} == {1} and {x[1] for x in got["tag"]} == {2} and {x[1] for x in got["since"]} == {2, 4}
    assert got["speaker"] and all(x[0] == "passage" and x[2] in (900, 1800) for x in got["speaker"])
    assert got["scope"] == [("passage", 2, 10)] and got["none"] == [("passage", 2, 0)]  # any term, where no hit has all
    assert got["alias"] == [("passage", 4, 0)] and got["other"] == [("passage", 2, 10)] and "empty" not in got
    shown = {(r["q"], r["path"]): r for r in S.whole_search(made, queries).collect()}
    assert shown["tag", 2]["snippet"] == "⟦budget⟧ plan" and shown["plain", 4]["snippet"] == "matched on topic" and shown["plain", 2]["title"] == "Other"


def test_questions_of_live_calls(spark):
    """Ticks without a new line, questions that were asked already, heartbeats, and calls that go silent."""
    from parlance.streaming import live as L

    rng = random.Random(8)
    rows = [(c, i, i * 7000, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 30)))) for c in range(5) for i in range(12)]
    rows += [(7, 0, 5_000, "said once and never again, long enough"), (8, 0, 0, "at the first tick already, long enough")]
    want = set()
    for c in {r[0] for r in rows}:
        mine, asked = sorted(r for r in rows if r[0] == c), ""
        for tick in sorted({-(-r[2] // 20_000) for r in mine}):
            text = " ".join(r[3] for r in mine if r[2] <= tick * 20_000).strip()
            cut = text if len(text) <= 100 else text[-100:].split(" ", 1)[1]
            if len(cut) >= 30 and cut != asked:
                want.add((c, tick, cut))
                asked = cut
    lines = spark.createDataFrame([*rows, (-1, 99, 10_000_000, None)], "call long, seq long, ms long, text string")
    got = [(r["call"], r["tick"], r["query"]) for r in L.drain(L.questions(L.replay(lines, "ms", "call", parts=3), 100, 30)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_failed_batch_is_asked_again(spark):
    from parlance.streaming import live as L

    lines = spark.createDataFrame([(c, i, i * 20_000, f"call {c} says line {i} of many words") for c in range(3) for i in range(4)] + [(-1, 99, 10_000_000, None)], "call long, seq long, ms long, text string")
    failed = []

    def search(batch):
        if len(failed) < 2:
            failed.append(1)
            raise RuntimeError("the search is down")
        return batch.select("call", "tick")

    got = [tuple(r) for r in L.answered(L.questions(L.replay(lines, "ms", "call", parts=2), 200, 10), search, "call long, tick long").collect()]
    assert sorted(got) == [(c, i) for c in range(3) for i in range(4)] and len(failed) == 2
    with pytest.raises(Exception):
        L.answered(L.questions(L.replay(lines, "ms", "call", parts=2), 200, 10), lambda b: 1 / 0, "call long, tick long", tries=1)


def test_postings_are_counted_where_the_passages_are(spark):
    """One shuffle, of the passages; passages in several rows are put together, as are those without ids."""
    rows = spark.createDataFrame([(1, 0, "b a b"), (2, 0, None), (3, 0, "a"), (3, 0, "c a"), (None, 0, "x"), (None, 0, "x y")], "path long, chunk long, text string")
    from parlance.operators.index import postings

    got = {(r["token"], r["path"]): (r["tf"], r["uses"], r["len"], r["positions"]) for r in postings(rows).collect()}
    assert got == {("a", 1): (1.0, 1, 3, [1]), ("b", 1): (2.0, 2, 3, [0, 2]), ("a", 3): (2.0, 2, 3, [0, 1]), ("c", 3): (1.0, 1, 3, [0]), ("x", None): (2.0, 2, 3, [0, 0]), ("y", None): (1.0, 1, 3, [1])}
    once = postings(rows.where("path < 3").withColumn("chunk", F.lit(0).cast("long")))
    once.collect()
    assert once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ShuffleQueryStage") <= 1


def test_forms_are_scored_in_shards(spark, monkeypatch):
    """Whole searches and phrases over many shards find what they find in one; no more than a question's best leave a shard."""
    from parlance.operators import scoring as G

    rng = random.Random(5)
    chunks = [(p, c, " ".join(rng.choice(WORDS) for _ in range(8))) for p in range(12) for c in range(4)]
    index = I.build_index(spark.createDataFrame(chunks, "path long, chunk long, text string"))
    terms = spark.createDataFrame([(q, w, 2) for q in range(3) for w in WORDS[q : q + 2]], "q long, term string, n_terms int")
    forms = spark.createDataFrame([(w, f) for w in WORDS[:4] for f in (w, f"{WORDS[5]} {WORDS[6]}")], "term string, form string")
    allowed = spark.createDataFrame([(p % 2, p, c) for p, c, _ in chunks], "filter long, path long, chunk long")
    wanted = spark.createDataFrame([(q, q % 2) for q in range(3)], "q long, filter long")
    without = spark.createDataFrame([(0, 2)], "q long, path long")
    phrases = spark.createDataFrame([(f"{a} {b}",) for a in WORDS[:4] for b in WORDS[:4]], "phrase string")

    def found():
        hits = [tuple(r) for r in G.form_hits(index, terms, forms, [], keep=3, allowed=allowed, wanted=wanted, without=without).collect()]
        best = {q: sorted((r[3], r[1], r[2]) for r in hits if r[0] == q and (r[4] == 2 or not any(x[0] == q and x[4] == 2 for x in hits)))[:3] for q in range(3)}
        return len(hits), best, sorted(tuple(r) for r in S.phrase_hits(phrases, index).collect())

    one = found()
    assert one[0] <= 9 and all(one[1].values()) and one[2]
    assert all(p % 2 == q % 2 and (q, p) != (0, 2) for q, rows in one[1].items() for _, p, _ in rows)
    monkeypatch.setattr(G, "SHARD_TOKENS", 100)
    many = found()
    assert many[0] <= 9 * 4 and many[1:] == one[1:]


def test_publishing_shuffles_texts_once_and_postings_never(spark, monkeypatch):
    """The plans of what updates and a merge write, where Spark itself broadcasts nothing."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen: dict[str, list[str]] = {}
    plain = Library._write

    def watched(self, tables, removed, more=None):
        def note(made):
            for name, df in made.items():
                seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
            return made

        note(tables)
        return plain(self, tables, removed, more and (lambda there: note(more(there))))

    monkeypatch.setattr(Library, "_write", watched)
    corpus = I.PublishedCorpus(spark, fresh_path(spark, "corpus"), {"title": 1.0, "summary": 1.0, "tags": 1.0, "participants": 1.0})

    def update(paths, text):
        rows = spark.createDataFrame([(p,) for p in paths], "path long")
        corpus.apply(
            rows.select("path", F.lit(1.0).alias("mtime"), F.lit("t").alias("title")),
            rows.select("path", F.lit(0).cast("long").alias("chunk"), F.lit(text).alias("text")),
            rows.select("path", F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("").alias("tags"), F.lit("p").alias("participants")),
            rows.select("path", F.lit("o").alias("owner"), F.lit("x").alias("text"), F.lit("open").alias("status")),
        )

    try:
        update(range(20), "old words")
        update(range(5), "new words")
        corpus.merge()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r["token"] for r in corpus.spoken.postings().collect()) == ["new"] * 5 + ["old"] * 15 + ["words"] * 20
    spoken = seen["spoken_postings"]
    assert len(spoken) == 3 and not any("Exchange hashpartitioning(bucket" in plan for plan in spoken)  # before: by bucket
    assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in (spoken[-1], seen["chunks"][-1]))  # the merge; before: sorted by path


def test_related_calls_make_no_snippets(spark, sf, monkeypatch):
    """Their rows have none; before, every hit's text was taken apart for one."""
    from parlance.plans.catalogue import QUERIES

    def none(*_):
        raise AssertionError("a snippet was made")

    monkeypatch.setattr(S, "snippets", none)
    assert QUERIES["stream_related"](spark, sf).count() > 0
