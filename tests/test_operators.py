"""Operators on small inputs of our own."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import documents as D
from parlance.operators import entities as E
from parlance.operators import ordered as O
from parlance.operators import search as S
from parlance.sources import markdown as M
from parlance.sources.storage import SnapshotTable, fresh_path


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("what about the budget review", ["budget", "review"]), ("what about it", ["what", "about", "it"]), ("Say \"hello\" a x", ["say", "hello"]), ("", []), ("budget budget Review", ["budget", "review"])],
)
def test_query_terms(spark, text, want):
    assert one(spark, C.query_terms(F.lit(text))) == want


def test_long_queries_keep_the_ten_longest_terms(spark):
    words = ["b" * n + "x" for n in range(2, 16)]
    assert one(spark, C.query_terms(F.lit(" ".join(words)))) == sorted(words, key=len, reverse=True)[:10]


@pytest.mark.parametrize("text, want", [("Um, so uhh yes", "so yes"), ("well , um fine .", "well, fine."), ("umbrella", "umbrella"), ("um", "")])
def test_clean_speech(spark, text, want):
    assert one(spark, C.clean_speech(F.lit(text))) == want


@pytest.mark.parametrize("stamp, want", [("[0:05]", 5000), ("[1:23:45]", 5025000), ("[x]", None), ("[1:x:5]", 65000)])
def test_stamps(spark, stamp, want):
    assert one(spark, C.stamp_ms(F.lit(stamp))) == want


def slug_loop(text: str, limit: int = 48) -> str:
    out, gap = "", False
    for c in text.lower():
        if c.isascii() and c.isalnum():
            if gap and out:
                out += "-"
            gap = False
            out += c
        else:
            gap = True
        if len(out) >= limit:
            break
    return out.rstrip("-")


def test_slug_is_the_loop(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 -.é") for _ in range(rng.randrange(70))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.slug(F.col("t")).alias("s")).collect()
    assert all(r["s"] == slug_loop(r["t"]) for r in rows)


def test_chunks_start_anew_with_every_chunk(spark):
    rows = [("c", i, i * 20_000, "You" if i < 5 else "Them", f"line {i}") for i in range(7)]
    got = O.turn_chunks(spark.createDataFrame(rows, "call string, seq int, ms long, speaker string, text string")).orderBy("chunk_no").collect()
    assert [(r["start_ms"], r["end_ms"], r["speaker"]) for r in got] == [(0, 40_000, "You"), (60_000, 80_000, "You"), (100_000, 120_000, "Them")]
    assert got[0]["text"] == "line 0 line 1 line 2"


def trim_loop(sizes: list[int], budget: int) -> list[int]:
    keep = list(range(len(sizes)))
    while len(keep) > 2 and sum(sizes[i] for i in keep) > budget:
        keep.pop(1)
    return keep


def test_history_trim_is_the_loop(spark):
    rng = random.Random(2)
    threads = {i: [rng.randrange(1, 90) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    rows = [(i, t, "x" * n) for i, sizes in threads.items() for t, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id int, turn int, text string")
    got = {}
    for r in O.history_trim(df, 150).collect():
        got.setdefault(r["id"], []).append(r["turn"])
    assert {i: sorted(v) for i, v in got.items()} == {i: trim_loop(s, 150) for i, s in threads.items()}


def test_fused_slots(spark):
    passages = spark.createDataFrame([("q", p, p + 1) for p in range(10)], "q string, path long, rank int")
    topics = spark.createDataFrame([("q", p, -1.0 / (p + 1)) for p in (0, 20, 21, 22, 23)], "q string, path long, score double")
    got = [(r["path"], r["source"]) for r in S.fuse(passages, topics).orderBy("place").collect()]
    assert got[:7] == [(p, "passage") for p in range(7)] and [g[1] for g in got[7:]] == ["topic"] * 3
    assert [r["path"] for r in S.fuse(passages, topics.where("path < 0")).orderBy("place").collect()] == list(range(10))


def test_alias_groups_and_phrases(spark):
    texts = [(1, 0, "the estimated time of arrival moved"), (2, 0, "our eta moved"), (3, 0, "time estimated of arrival moved"), (4, 0, "nothing")]
    passages = spark.createDataFrame(texts, "path long, chunk int, text string")
    queries = spark.createDataFrame([("a", "eta moved")], "q string, query string")
    groups = spark.createDataFrame([(1, ["eta", "estimated time of arrival"])], "grp_no int, members array<string>")
    assert {r["path"] for r in S.alias_search(passages, queries, groups).collect()} == {1, 2}


def test_snippets_mark_the_first_best_window(spark):
    text = " ".join(["zero"] * 20 + ["budget", "then", "Review,"] + ["zero"] * 20)
    rows = spark.createDataFrame([(1, text, ["budget", "review"]), (2, "only plain words", ["budget"]), (3, "", ["budget"]), (None, "budget", ["bud"])], "id long, text string, terms array<string>")
    found = {r["id"]: r["snippet"] for r in S.snippets(rows, ["id"]).collect()}
    assert (found[2], found[3], found[None]) == ("only plain words", "", "⟦budget⟧")
    got = found[1]
    assert got.startswith("…") and got.endswith("…") and "⟦budget⟧ then ⟦Review,⟧" in got and one(spark, S.span_count(F.lit(got))) == 2


def test_mentions_of_several_words(spark):
    chunks = spark.createDataFrame([(1, 500, "Today Ada Lovelace King met Delta. ada lovelace left, Delta"), (2, 900, "nothing")], "path long, start_ms int, text string")
    names = spark.createDataFrame([("a", "Ada Lovelace"), ("k", "ada lovelace king"), ("d", "Delta"), ("z", "zoe")], "id string, name string")
    attendees = spark.createDataFrame([(2, " zoe ")], "path long, name string")
    got = {(r["id"], r["path"], r["surface"], r["start_ms"], r["n"]) for r in S.mentions(chunks, names, attendees=attendees).collect()}
    assert got == {("a", 1, "Ada Lovelace", 500, 1), ("k", 1, "Ada Lovelace King", 500, 1), ("d", 1, "Delta", 500, 2), ("z", 2, "zoe", 0, 1)}


def test_mentions_equal_a_loop_over_all_sequences(spark):
    """Names of one to five words, of shared first words, with odd spaces and letters; a word of a text is one row, whatever its neighbours."""
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    some = ["Ann", "ann", "B-c", "O'Neil", "of", "Of", "ΟΔΟΣ", "Straße", "x1", "Zed"]
    texts = [(i, i % 3, " , ".join(rng.choice(some) for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(99, 0, None), (98, 0, ""), (97, 0, "Ann  of. Zed"), (96, 0, " ".join(["plain"] * 3000))]
    names = sorted({" ".join(rng.choice(some) for _ in range(n)) for n in (1, 2, 2, 2, 3, 3, 4, 4, 5)}) + [" ann ", "ann of", "Ann  of", "", None, "A", "of zed", "straße"]
    names = [(f"n{i}", n) for i, n in enumerate(names)]
    attendees = [(5, " ann of "), (6, None), (7, "Ann  of"), (8, "nobody")]
    want, first = Counter(), {}
    seen = [(p, 0, a.strip()) for p, a in attendees if a is not None]
    for path, ms, text in texts:
        w = [x for x in re.split(r"[^\w'-]+", text or "") if x]
        seen += [(path, ms, g) for n in range(1, 5) for i in range(len(w) - n + 1) if (g := " ".join(w[i : i + n])) != g.lower()]
    for path, ms, g in seen:
        for k in {k for k, n in names if n is not None and len(g) >= 2 and g.lower() == n.strip().lower()}:
            want[k, path, g] += 1
            first[k, path, g] = min(ms, first.get((k, path, g), ms))
    frames = [spark.createDataFrame(texts, "path long, start_ms int, text string"), spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(attendees, "path long, name string")]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.mentions(*frames[:2], attendees=frames[2])
        got = {(r["id"], r["path"], r["surface"]): (r["start_ms"], r["n"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(want) > 100 and got == {k: (first[k], n) for k, n in want.items()}

    def generated(node) -> list[int]:
        mine = [node.metrics().get("numOutputRows").get().value()] if node.nodeName() == "Generate" else []
        return mine + [n for i in range(node.children().size()) for n in generated(node.children().apply(i))]

    words = sum(len([x for x in re.split(r"[^\w'-]+", t or "") if x]) for _, _, t in texts)
    made = generated(out._jdf.queryExecution().executedPlan())
    assert max(made) <= words


def test_and_before_or(spark):
    passages = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha"), (3, 0, "gamma")], "path long, chunk int, text string")
    queries = spark.createDataFrame([("both", "alpha beta"), ("one", "gamma delta")], "q string, query string")
    got = {(r["q"], r["path"]) for r in S.search(passages, queries).collect()}
    assert got == {("both", 1), ("one", 3)}


def test_transcript_blocks(spark):
    content = "---\napp: call-transcriber\n---\n# T\n## Part\n**[0:01] You:** hello\n**[1:02:03]** alone\n**[0:09]**\n| a | b |\n| --- | --- |\n| 1 | 2 |\n---\nplain"
    rows = M.blocks(spark.createDataFrame([(1, content)], "path int, content string"), "path").orderBy("line_no").collect()
    got = [(r["block_type"], r["stamp"], r["speaker"], r["text"]) for r in rows]
    assert got == [("section", None, None, "Part"), ("audio", "[0:01]", "You", "hello"), ("audio", "[1:02:03]", None, "alone"), ("screen", "[0:09]", None, None), ("table", None, None, "| a | b |"), ("table", None, None, "| 1 | 2 |"), ("divider", None, None, None), ("paragraph", None, None, "plain")]


def test_note_blocks(spark):
    text = "# A\n\nx\ny\n- a\n- b\n1. c\n```\n# no\n```\n| h |\n|---|\n| 1 |\n| lone\n***"
    rows = M.note_blocks(spark.createDataFrame([(1, text)], "path int, content string"), "path").orderBy("line_no").collect()
    kinds = []
    for r in rows:
        if not kinds or kinds[-1][0] != r["block"]:
            kinds.append((r["block"], r["kind"]))
    assert [k for _, k in kinds] == ["heading", "paragraph", "bullets", "numbered", "code", "table", "rule"]


def test_vault_rules(spark):
    docs = spark.createDataFrame([(1, "a", "active", None), (2, "b", "odd", "conversation")], "path int, vault string, status string, document_class string")
    with pytest.raises(ValueError):
        D.in_vaults(docs, [])
    assert [r["value"] for r in D.refusals(docs, {"status": ("active",)}).collect()] == ["odd"]
    assert D.clamp_k(500)[0] == 50 and D.clamp_k(5) == (5, [])


def test_an_unreadable_source_removes_nothing(spark):
    a = spark.createDataFrame([(1, 1.0)], "path int, mtime double")
    b = spark.createDataFrame([(1, 1.0), (2, 1.0)], "path int, mtime double")
    change = lambda x: {r["path"]: r["change"] for r in x.collect()}
    assert change(D.reconcile(a, b)) == {1: "unchanged", 2: "removed"}
    assert change(D.reconcile(a, b, ["/away"])) == {1: "unchanged", 2: "kept"}


def test_merges_keep_entities_whose_root_is_none(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    same = spark.createDataFrame([(99, 2), (2, 3), (3, 4)], "a long, b long")
    assert {(r["id"], r["root"]) for r in E.merge_closure(entities, same).collect()} == {(1, 1), (2, 99), (3, 99), (4, 99)}


def test_collisions_need_a_strict_subset_of_words(spark):
    rows = [(1, "Ann", "person", "g"), (2, "Ann Lee", "person", "g"), (3, "Ann Lee", "org", "g"), (4, "ann", "person", "g"), (5, "Ann Poe", "person", "h")]
    df = spark.createDataFrame(rows, "id int, name string, kind string, grp string")
    none = spark.createDataFrame([], "a int, b int")
    assert {(r["a"], r["b"]) for r in E.collision_pairs(df, none).collect()} == {(1, 2), (4, 2)}
    some = spark.createDataFrame([(2, 1)], "a int, b int")
    assert {(r["a"], r["b"]) for r in E.collision_pairs(df, some).collect()} == {(4, 2)}


def test_snapshots(spark):
    table = SnapshotTable(spark, fresh_path(spark, "t"))
    table.publish(spark.createDataFrame([(1, "a"), (2, "b")], "path int, v string"), 0)
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "path int, v string"), 1)
    assert {(r["path"], r["v"]) for r in table.current().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert not table.publish_changed(table.current(), 2)


def test_the_library_works_without_the_llm_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('parlance.llm') or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op1_') for k in e.queries())"
    from helpers import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_terms_of_all_lengths_meet_tokens(spark):
    long = "a" * 39 + "bcdef"
    tokens = spark.createDataFrame([(long,), (long + "g",), ("a" * 39 + "bxdef",), ("a" * 40,), ("abc",)], "token string")
    terms = spark.createDataFrame([(long,), ("a" * 40,), ("ab",)], "term string")
    got = {(r["term"], r["token"]) for r in S.expand_prefixes(terms, tokens).collect()}
    assert got == {(long, long), (long, long + "g"), ("a" * 40, "a" * 40), ("ab", "abc")}
    passages = spark.createDataFrame([(1, 0, f"see {long}"), (2, 0, "see nothing")], "path long, chunk int, text string")
    found = S.search(passages, spark.createDataFrame([(1, long)], "q long, query string"), "and").collect()
    assert [r["path"] for r in found] == [1]


def test_gold_cases_and_snippets_lose_no_document(spark, tmp_path):
    from parlance.plans.catalogue import QUERIES

    cut = "x " + "y" * 70
    late = "plain opening words that fill the first sixty characters of it, zebra"
    spark.createDataFrame([(1, cut), (2, "single"), (3, late)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"a {cut} b"), (2, "a singleton"), (3, "only a zebra here"), (4, f"pre{late}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gold = {r["id"]: r["expect"] for r in QUERIES["gold_cases"](spark, str(tmp_path)).collect()}
    assert gold == {1: "1", 2: "2", 3: "4"}
    shown = {(r["q"], r["path"]): r["snippet"] for r in QUERIES["snippets"](spark, str(tmp_path)).where("q = 3").collect()}
    assert any("⟦zebra⟧" in x for x in shown.values())


def test_leaks_are_counted(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "scope string, path long")
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "path long, grp string")
    assert {(r["scope"], r["hits"], r["leaks"]) for r in S.leaks(hits, truth).collect()} == {("a", 2, 1), ("b", 1, 1)}


def test_vocabularies_are_the_contract(spark):
    fine = [("active", "reference-frozen", "decision", "stated"), ("complete", "unclassified", "how-to", "unstated"), ("archived", "conversation", "digest", "unjudged"), ("superseded", "reference-versioned", "explanation", "proposed"), ("active", None, "reference", "inferred"), ("active", None, None, "verified")]
    bad = [("draft", "decision", "note", "high")]
    rows = [(i, *r) for i, r in enumerate(fine + bad)]
    docs = spark.createDataFrame(rows, "path int, status string, document_class string, doc_type string, confidence string")
    assert {(r["path"], r["field"], r["value"]) for r in D.refusals(docs).collect()} == {(6, "status", "draft"), (6, "document_class", "decision"), (6, "doc_type", "note"), (6, "confidence", "high")}


def test_a_scope_moves_when_its_attempt_does(spark):
    rows = [(1, 0, "a", 5), (2, 0, "b", None), (3, 1, "a", 5), (4, 1, "b", 7), (5, 2, "a", None), (6, 3, "a", 6), (7, 3, "c", 1), (8, 4, "b", 7)]
    got = {r["event_id"]: (r["known"], r["moved"]) for r in O.scope_moved(spark.createDataFrame(rows, "event_id int, poll int, scope string, attempted int")).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, False), 4: (False, True), 5: (True, False), 6: (True, True), 7: (False, True), 8: (True, False)}


def test_done_is_one_entry_of_one_call(spark):
    rows = [(1, 1, "ann", "x", "done"), (1, 2, "ann", "x", "open"), (1, 3, "ann", "x", "open"), (2, 1, "ann", "x", "open"), (1, 4, "bob", "x", "open")]
    items = spark.createDataFrame(rows, "path int, place int, owner string, text string, status string")
    named = spark.createDataFrame([(1, "ann", "x"), (3, "ann", "x"), (2, "ann", "y")], "path int, owner string, text string")
    got = {(r["path"], r["place"]): r["status"] for r in E.mark_done(items, named).collect()}
    assert got == {(1, 1): "done", (1, 2): "done", (1, 3): "open", (2, 1): "open", (1, 4): "open"}


def test_terms_are_no_identities(spark):
    rows = [(i, n, k, "g") for i, (n, k) in enumerate([("Ann", "person"), ("Ann Lee", "person"), ("Ann Poe", "person"), ("Ann Lee Poe", "person"), ("x", "term"), ("x y", "term")])]
    df = spark.createDataFrame(rows, "id int, name string, kind string, grp string")
    pairs = E.collision_pairs(df, spark.createDataFrame([], "a int, b int"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}
    assert [(r["a"], r["b"]) for r in E.first_pairs(pairs).orderBy("place").collect()] == [(0, 1), (0, 2), (0, 3)]


def test_video_meetings_come_first(spark):
    t = lambda m: f"2024-01-01 {9 + m // 60:02d}:{m % 60:02d}:00"
    meetings = [(1, 1, t(0), t(60), None, False), (2, 1, t(50), t(65), "join zoom.us/j/1", False), (3, 1, t(-300), t(400), "zoom.us", True), (4, 2, t(0), t(60), "zoom.us", False), (5, 1, t(-120), t(300), None, False)]
    m = spark.createDataFrame(meetings, "meeting int, calendar int, start_ts string, end_ts string, location string, all_day boolean").withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})
    recordings = [(1, 1, t(0), t(55)), (2, 1, t(0), t(40)), (3, 1, t(299), t(350)), (4, 1, t(300), t(310)), (5, 3, t(0), t(5))]
    r = spark.createDataFrame(recordings, "recording int, calendar int, start_ts string, end_ts string").withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})
    assert {(x["recording"], x["meeting"]) for x in O.meeting_match(r, m).collect()} == {(1, 2), (2, 1), (3, 5)}


def test_search_by_shards_is_the_plain_search(spark, monkeypatch):
    """Every mode, whole and with the best only, over many small shards, against BM25 written out; only as many hits as are kept leave a shard."""
    import math
    import random

    from parlance.operators import scoring

    monkeypatch.setattr(scoring, "SHARD_TOKENS", 40)
    rnd = random.Random(3)
    words = ["alpha", "alphabet", "beta", "gamma", "delta", "rare"]
    texts = {(p, c): " ".join(rnd.choices(words, [5, 3, 5, 4, 2, 0.2], k=rnd.randint(1, 9))) for p in range(40) for c in range(2)}
    index = S.build_index(spark.createDataFrame([(*k, t) for k, t in texts.items()], "path long, chunk long, text string"))
    queries = {1: "alpha beta", 2: "beta alpha", 3: "delta rare zzz", 4: "alpha", 5: "gamma delta"}
    mean = sum(len(t.split()) for t in texts.values()) / len(texts)
    tf = {w: {k: n for k, t in texts.items() if (n := sum(x.startswith(w) for x in t.split()))} for q in queries.values() for w in q.split()}

    def part(w, k):
        idf = max(math.log((len(texts) - len(tf[w]) + 0.5) / (len(tf[w]) + 0.5)), 1e-6)
        return -idf * tf[w][k] * 2.2 / (tf[w][k] + 1.2 * (0.25 + 0.75 * len(texts[k].split()) / mean))

    asked = spark.createDataFrame(list(queries.items()), "q long, query string")
    for mode in ("and", "or", "auto"):
        want = {}
        for q, text in queries.items():
            ws = text.split()
            hits = {k: (round(sum(part(w, k) for w in ws if k in tf[w]), 9), sum(k in tf[w] for w in ws)) for k in texts if any(k in tf[w] for w in ws)}
            whole = {k: v for k, v in hits.items() if v[1] == len(ws)}
            want[q] = sorted((s, *k) for k, (s, _) in (whole if mode == "and" or (mode == "auto" and whole) else hits).items())
        for keep in (None, 7):
            got = {q: [] for q in queries}
            for r in S.search(index, asked, mode, keep=keep).collect():
                got[r["q"]].append((r["score"], r["path"], r["chunk"]))
            for q in queries:
                full = sorted(got[q])
                assert [x[1:] for x in full] == [x[1:] for x in want[q][:keep]]
                assert all(abs(a[0] - b[0]) < 2e-9 for a, b in zip(full, want[q]))


def test_phrases_within_their_own_uses_count_in_query_and_sql(spark):
    """The SQL of forms counted "of of" once in "of of of", where it begins twice."""
    import duckdb

    from parlance.plans import search as P

    rows = [(1, 0, "of of of"), (2, 0, "Of of, a of"), (3, 0, "of a of")]
    values = ", ".join(f"({p}, {c}, '{t}')" for p, c, t in rows)
    sql = P._sql(f"p as (select * from (values {values}) v(path, chunk, text))", "forms as (select 'of of' as form)", P._index_sql("p"), *P._form_sql("tf", "p", "st", "len"), select="select path, tf from pm")
    got = S.phrase_hits(spark.createDataFrame([("of of",)], "phrase string"), S.build_index(spark.createDataFrame(rows, "path long, chunk long, text string")))
    assert sorted((r["path"], float(r["tf"])) for r in got.collect()) == sorted(duckdb.connect().sql(sql).fetchall()) == [(1, 2.0), (2, 1.0)]


def test_first_collisions_are_those_of_all_pairs_with_few_of_a_class_paired(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    names = ["ann", "Ann Lee", "lee ann", "ann lee fox", "fox", "Lee", "bob"]
    rows = [(i, rnd.choice(names), rnd.choice(["person", "org", "term"]), rnd.choice(["w1", "w2", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, grp string")
    told = spark.createDataFrame([(rnd.randrange(40), rnd.randrange(300)) for _ in range(120)], "a long, b long")
    key = lambda r: (r["a"], r["b"], r["grp"], r["place"])
    for verdicts in (told, told.limit(0)):
        assert sorted(map(key, E.first_collisions(df, verdicts).collect())) == sorted(map(key, E.first_pairs(E.collision_pairs(df, verdicts)).collect()))
    paired = []
    whole = E.collision_pairs
    monkeypatch.setattr(E, "collision_pairs", lambda kept, verdicts: paired.append(kept.count()) or whole(kept, verdicts))
    E.first_collisions(df, told.limit(0)).collect()
    assert paired[0] < 220  # before: all 300


def test_collision_classes_stand_for_all_pairs_of_ids(spark):
    import random

    rnd = random.Random(8)
    names = ["ann", "Ann Lee", "lee ann", "ann lee fox", "fox", "Lee", "bob"]
    rows = [(i, rnd.choice(names), rnd.choice(["person", "org", "term"]), rnd.choice(["w1", "w2", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, grp string")
    told = spark.createDataFrame([(rnd.randrange(200), rnd.randrange(200)) for _ in range(900)] + [(3, 3), (None, 4)], "a long, b long")
    members: dict = {}
    for r in E.name_classes(df).collect():
        members.setdefault(r["class"], set()).add(r["id"])
    assert {i for m in members.values() for i in m} == {r[0] for r in rows if r[2] != "term" and r[3]}
    known = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in told.where("a is not null").collect()}
    for verdicts, seen in ((told, known), (told.limit(0), set())):
        made, per = set(), E.collision_classes(df, verdicts).collect()
        for r in per:
            pairs = {(a, b) for a in members[r["a"]] for b in members[r["b"]] if (min(a, b), max(a, b)) not in seen}
            assert (r["a_copies"], r["b_copies"], r["open"]) == (len(members[r["a"]]), len(members[r["b"]]), len(pairs))
            made |= pairs
        whole = {(r["a"], r["b"]) for r in E.collision_pairs(df, verdicts).collect()}
        assert made == whole and len(per) * 5 < len(whole)


def test_answers_are_given_whole_blocks(spark):
    asked = spark.createDataFrame([(1, "What of STEEL?"), (2, "nothing")], "q long, query string")
    found = spark.createDataFrame([(1, 8, 2), (1, 7, 1)], "q long, path long, rank int")
    docs = [(7, "x" * 450, "conversation", "active", None, "va"), (8, "the Tin, here", "reference-frozen", "archived", "stated", ""), (9, "zinc", None, "active", None, "va")]
    docs = spark.createDataFrame(docs, "path long, text string, document_class string, status string, confidence string, vault string")
    terms = spark.createDataFrame([("tin", "a metal"), ("Steel", "an alloy"), ("zinc", "not here"), ("here", "")], "canonical string, gloss string")
    rows = {r["q"]: tuple(r)[1:] for r in S.answer_contexts(asked, found, docs, terms, cap=600).collect()}
    glossary = "Glossary (the user's own definitions):\nSteel — an alloy\ntin — a metal\n\n"
    assert rows[1] == (2, 413, f"{glossary}Context:\n[7 · from a call · active · @va]\n{'x' * 400}…\n\n[8 · archived · stated]\nthe Tin, here\n\nQuestion: What of STEEL?")
    assert rows[2] == (0, 0, "")
    (one,) = S.answer_contexts(asked, found, docs, terms, cap=600, most_terms=1).where("q = 1").collect()
    assert "alloy" in one["block"] and "a metal" not in one["block"]


def test_lots_of_shards_keep_what_one_shard_keeps(spark, monkeypatch):
    """Copies (ties), scores that are too far and questions met whole in some shards only; a task's best of many shards are as many as of one."""
    import random

    from parlance.operators import scoring

    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "rare"]
    texts = [" ".join(rnd.choices(words, [6, 4, 4, 2, 2, 0.3], k=rnd.randint(1, 7))) for _ in range(25)]
    rows = [(f"p{rnd.randrange(10**6)}", c, rnd.choice(texts)) for _ in range(60) for c in range(2)]
    index = S.build_index(spark.createDataFrame(rows, "path string, chunk long, text string"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma rare delta"), (3, "alpha"), (4, "rare zzz"), (5, "alpha beta gamma delta")], "q long, query string")
    left: list[int] = []
    whole = scoring._first
    monkeypatch.setattr(scoring, "_first", lambda found, *a: left.append(found.count()) or whole(found, *a))
    found = lambda mode, floor: sorted(tuple(r) for r in S.search(index, asked, mode, keep=4, floor=floor).collect())
    cases = [("auto", None), ("auto", -1.5), ("or", None)]
    one = [found(*c) for c in cases]
    monkeypatch.setattr(scoring, "SHARD_TOKENS", 40)
    assert scoring._shards(index) > 8
    many = [found(*c) for c in cases]
    monkeypatch.setattr(scoring, "_lots", lambda *_: 1)
    few = [found(*c) for c in cases]
    assert one == many == few and all(one)
    assert max(left[-3:]) <= 5 * 4 < max(left[3:6])  # before: as many of every shard
    terms = spark.createDataFrame([("al", 0), ("beta", 1)], "term string, t long")
    hits = scoring._shard_hits(index, scoring._prefix_rows(index, terms, scoring._shards(index)))[0]
    assert hits.count() <= scoring._shards(index)  # before: a row per term and shard


def test_titles_meet_labels_without_their_texts(spark, sf):
    from parlance.adapters import Tables

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Tables(spark, sf).docs.select("path", "title", "tag_quality")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join = plan.splitlines().index(next(x for x in plan.splitlines() if "Join" in x))
    assert "text#" in plan and "text#" not in "".join(plan.splitlines()[: join + 1])  # before: the text went through the join
