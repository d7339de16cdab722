"""Quality, toxicity, language, URL verdicts and mixing: held-out accuracy, SQL, edge rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import compare
from helpers_llm import edge_docs
from pyspark.sql import functions as F

from parlance.llm import langid, mixing, quality, toxicity, url_filter
from parlance.llm.queries import ORACLES, QUERIES

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])


def accuracy(spark, df, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = df.join(labels, "doc_id").where("held_out")
    return rows.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_quality_on_held_out_rows(spark):
    df = quality.op1_quality_machine(spark, BIG)
    assert df.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(spark, df, "quality") >= 0.93


def test_toxicity_on_held_out_rows(spark):
    df = toxicity.op5_toxicity_lexicon(spark, BIG)
    assert df.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(spark, df, "toxic") >= 0.95


def test_languages_on_held_out_rows(spark):
    rows = langid.op7_language_mixture(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.98


def test_a_mixture_of_two_languages_is_seen(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.fit_languages(docs.select("text", "lang"))
    two = [docs.where(F.col("lang") == x).orderBy("doc_id").select("text").first()["text"] for x in ("de", "es")]
    both = spark.createDataFrame([(1, " ".join(" ".join(t.split()[:60]) for t in two))], "doc_id long, text string")
    assert {x.split(":")[0] for x in langid.tag_languages(both, model).first()["mixture"].split(",")} == {"de", "es"}


def test_the_sum_of_squares_is_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    cells, values = np.array([1, 4, 7, 9]), rng.normal(size=4)
    pairs = sum(m.factors[cells[i]] @ m.factors[cells[j]] * values[i] * values[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(m.logits(cells, values, np.array([0, 4]))[0], 0.3 + m.linear[cells] @ values + pairs)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({("trash", True): 2.0, ("idiot", False): 3.0}, ("trash can",))
    assert lexicon.weigh("You 1d1оt!")[0] == 3.0 and lexicon.weigh("ＩＤＩＯＴic")[0] == 3.0
    assert lexicon.weigh("the trash can")[0] == 0.0 and lexicon.weigh("trash, trash can")[0] == 2.0
    assert lexicon.weigh("trashy xidiot")[0] == 0.0


def test_url_edges(spark):
    urls = ["http://A.NET/x", "https://www.example.net/en/1", "x.net/", None, "", "http://notnet/", "http://a.net", "http://free-bets.site.io/win", "http://a.io/pornography", "ftp://u.org/fr/?q=://b.net/", "http://B.example.com/de/", "http://casino.org/fr/a"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows).orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notnet", "/", None, "allow"), ("a.net", "", None, "allow"),
        ("free-bets.site.io", "/win", None, "block"), ("a.io", "/pornography", None, "allow"), ("u.org", "/fr/", "org/fr/", "allow"), ("b.example.com", "/de/", "example.com/de/", "block"), ("casino.org", "/fr/a", "org/fr/", "allow"),
    ]


def test_mix_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1 + max(r["size"] for r in v)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in v)


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5, 5, 5], [0, 0], [0, 7], [1000, 1, 2, 3, 4, 5, 900], [3]])
def test_targets_are_the_resharing_loop(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    weight = [1.0 + i % 3 for i in range(len(sizes))]
    total, capped = float(sum(sizes)), set()
    while True:
        left = total - sum(3.0 * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weight) if i not in capped)
        want = [3.0 * sizes[i] if i in capped else left * weight[i] / share for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and want[i] > 3.0 * sizes[i]}
        if not over:
            break
        capped |= over
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    assert all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want))


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, empty):
    docs = edge_docs(spark, empty)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    n = docs.count()
    assert quality.score_quality(docs, quality.train_quality(docs, labels)).where("score between 0 and 1").count() == n
    from parlance.llm._labels import labelled

    lexicon = toxicity.fit_lexicon(labelled(docs.select("doc_id", "text"), labels, "toxic", 10))
    assert toxicity.weigh_texts(docs, lexicon).where("score between 0 and 1").count() == n
    tagged = langid.tag_languages(docs, langid.fit_languages(docs.select("text", "lang")))
    assert tagged.count() == n and tagged.where("text is null or trim(text) = ''").where("lang_pred <> 'und' or score <> 0").count() == 0
    assert mixing.mix_sources(docs).count() == n


def test_mix_rows_reach_targets_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{j}" for j in range(int(rng.integers(0, 9)))), ["a", "b", None, "\U0010ffff\U0010ffff"][i % 4], 1) for i in range(400)]
    rows += [(None, "same words here", "a", 1)] * 60 + [(None, "same words here", "tied", 1)] * 7 + [(5, None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, range long").repartition(5)
    per = {r["source"]: r for r in mixing.mix_sources(docs).select("source", "source_size", "target").distinct().collect()}
    assert len(per) == 5
    made = mixing.repeat_to_targets(docs)
    assert made.columns == docs.columns
    words, empty = {}, 0
    for r in made.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
        empty += not (r["text"] or "").split()
    for source, r in per.items():
        assert words[source] == int(r["target"] + 1e-6), source
    assert empty == sum(not (r[1] or "").split() for r in rows)


def test_quality_scores_are_the_plain_machine(spark):
    """Scores of a whole table against the sum over all pairs of each row's features, one row at a time."""
    rng = np.random.default_rng(4)
    size = quality.CELLS + len(quality.STATISTICS) * quality.BINS
    machine = quality.Machine(0.3, rng.normal(0, 0.5, size), rng.normal(0, 0.3, (size, quality.FACTORS)))
    rows = [(0, "Some words, some WORDS.\nAnd 12 more | words", 42), (1, None, None), (2, "", 0), (3, "word", 4), (4, "a b a b a b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(2)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, machine).collect()}
    for i, text, n in rows:
        cells, values, _ = quality.featurise(pa.array([text], pa.string()), pa.array([n], pa.int64()))
        z = machine.bias + sum(machine.linear[c] * v for c, v in zip(cells, values))
        z += sum(machine.factors[a] @ machine.factors[b] * x * y for k, (a, x) in enumerate(zip(cells, values)) for b, y in list(zip(cells, values))[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    cells, values, _ = quality.featurise(pa.array(["one two two"]), pa.array([11]))
    assert sorted(np.round(values[len(quality.STATISTICS) :] * 5**0.5, 9) ** 2) == pytest.approx([1 * 5 / 3, 2 * 5 / 3])


def test_the_lexicon_is_a_plain_scan():
    rng = np.random.default_rng(6)
    lexicon = toxicity.Lexicon({("bad", True): 2.0, ("bad", False): 0.5, ("badly", True): 1.5, ("evil", False): 3.0, ("vil", True): 9.0}, ("not bad",))
    parts = ["bad", "badly", "evil", "3vil", "devil", "evils", "not", "bad.", "good", "vil", "B4D"]
    for _ in range(300):
        text = " ".join(rng.choice(parts, int(rng.integers(0, 12))))
        folded, weight, hits = toxicity.fold(text), 0.0, 0
        spans = [(i, i + 6) for i in range(len(folded)) if folded.startswith("not bad", i) and not (i and folded[i - 1].isalnum()) and not folded[i + 7 : i + 8].isalnum()]
        for i in range(len(folded)):
            if i and folded[i - 1].isalnum():
                continue
            found = [w for (t, whole), w in lexicon.terms.items() if folded.startswith(t, i) and not (whole and folded[i + len(t) : i + len(t) + 1].isalnum())]
            if found and not any(a <= i <= b for a, b in spans):
                weight, hits = weight + max(found), hits + 1
        assert lexicon.weigh(text) == (pytest.approx(weight), hits, len(text.split()))


def test_the_mixture_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    for _ in range(10):
        like = np.exp(rng.normal(0, 2, (60, 3)))
        like /= like.max(axis=1, keepdims=True)
        share, value = langid._mixture(like, 0.0, [0, 2])
        grid = [np.log(like[:, [0, 2]] @ np.array([p, 1 - p])).sum() for p in np.linspace(0, 1, 401)]
        assert abs(share.sum() - 1) < 1e-9 and value >= max(grid) - 0.05 and abs(share[0] - np.linspace(0, 1, 401)[int(np.argmax(grid))]) < 0.1
    loglike = rng.normal(-30, 3, (80, 4))
    out = langid.infer(loglike)
    assert abs(out.sum() - 1) < 1e-9 and langid.infer(loglike, penalty=1e9).max() == 1.0


def test_too_many_languages_are_refused_before_counting(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit_languages(spark.createDataFrame([("a b", "x"), ("c", "y"), ("d", "z")], "text string, lang string"))


def test_labels_with_repeated_ids(spark):
    from parlance.llm._labels import labelled

    docs = spark.createDataFrame([(1, "one"), (1, "two"), (2, None), (3, "three"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in (1, 2, 3, 6) for y in ((0, 1) if i == 1 else (0,))], "doc_id long, quality int")
    rows = labelled(docs, labels, "quality", 10).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) and all(r["label"] == (r["doc_id"] == 1) for r in rows)


def test_url_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", None), ("bad", 1.0), ("meh", 0.5), ("meh", 2.0), ("so", 0.1), (None, 1.0), ("", None)], "term string, weight double")
    strict, soft = url_filter.read_terms(terms)
    assert strict == ("bad",) and soft == {"meh": 2.0, "so": 0.1}
    pages = spark.createDataFrame([(1, "http://a.org/bad"), (2, "http://a.org/meh-so/" + "x" * 100_000), (3, "http://a.org/badly"), (3, "http://a.org/badly")], "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge_urls(pages, strict=strict, soft=soft).collect())
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (3, "allow")]
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    with pytest.raises(ValueError):
        url_filter.read_terms(terms, most=1)


def test_thousands_of_rules_and_terms(spark):
    rng = random.Random(9)
    hosts = ["".join(rng.choice("abc") for _ in range(2)) + f".h{rng.randrange(300)}.org" for _ in range(4000)] + [f"h{i}.org" for i in range(300)] + ["org"]
    rules = [(rng.choice(["block", "allow"]), h, "/" + rng.choice(["", "en/", "e", "en/x"])) for h in hosts for _ in range(2)]
    terms = [f"term{i}" for i in range(200_000)]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice(['', 'en/', 'en/x/y', 'fr', f'term{rng.randrange(250_000)}-'])}?q" for _ in range(500)] + ["http://elsewhere.com/term7/", "http://elsewhere.com/term7x/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("_hits", F.lit(1)).withColumn("hits", F.lit(2)).withColumn("row", F.lit(3))
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows, rules=rules, strict=tuple(terms), soft={}).collect()}
    assert got[0]["_hits"] == 1 and got[0]["hits"] == 2 and got[0]["row"] == 3 and got[500]["verdict"] == "block" and got[501]["verdict"] == "allow"
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    for i, url in enumerate(urls):
        host, path = url.split("://")[1].split("?")[0].split("/", 1)
        fits = next((r for r in order if (host == r[1] or host.endswith("." + r[1])) and f"/{path}".startswith(r[2])), None)
        assert (got[i]["rule"], got[i]["verdict"]) == ((fits[1] + fits[2], fits[0]) if fits else (None, got[i]["verdict"])), url
