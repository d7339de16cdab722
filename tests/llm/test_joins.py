"""Jaccard join, forest and pipeline against brute force."""

import random

import numpy as np
import pytest
from helpers_llm import edge_docs, jaccard_brute, library_ids
from pyspark.sql import functions as F

from parlance.llm import forest, jaccard


def near_copies(seed: int) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        own = list(hot)
        for _ in range(rng.choice([0, 1, 3, 8])):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join([*[word() for _ in range(20)], *passage]) for _ in range(20)]
    texts += ["a b", "a b", "A B", "", None, "a", "a b c"]
    return texts


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (5, 80, 2)])
def test_components(spark, monkeypatch, size, percent, seed):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 12)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 7)  # the hot group is split
    texts = near_copies(seed)
    want, _, n = jaccard_brute(texts, size, percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs, size, percent).collect()}
    for i in range(len(texts)):
        assert (got[i]["component_id"], got[i]["n_shingles"]) == (want[i], n[i]), texts[i]


def test_copies_with_an_edit_share_groups(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(200):
        own = list(words)
        own[rng.randrange(len(own))] = f"edit{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    described = jaccard.describe(docs, jaccard.shingle_sketch(docs))
    groups = jaccard.assign_groups(jaccard.make_nodes(described))
    assert groups.select("grp").distinct().count() <= 3 and groups.count() >= 190
    assert {r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {0}


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard_edges(spark, empty):
    docs = edge_docs(spark, empty)
    got = jaccard.jaccard_components(docs)
    assert got.count() == docs.count()
    if not empty:
        assert {r["component_id"] for r in got.where("doc_id in (10, 11)").collect()} == {10}
        assert {r["component_id"] for r in got.where("doc_id in (0, 1, 2)").collect()} == {0, 1, 2}


def nearest(rows, q, k=10):
    v = np.array(rows[q])
    d = sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x in rows.items() if i != q and len(x) == len(v))
    return d[:k]


def test_forest_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    rows = {i: (centres[i % 20] + rng.normal(size=32)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<float>")
    got = {}
    for r in forest.search_forest(df, df.where("vec_id % 100 = 0"), shards=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = 0
    for q in range(0, 3000, 100):
        want = nearest(rows, q)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((np.array(rows[v]) - np.array(rows[q])) ** 2).sum())) < 1e-12 for _, s, v in mine)
        assert [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
        hits += len({v for _, _, v in mine} & {v for _, v in want})
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_forest_query_on_given_tables(spark, sf_dir):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = {}
    for r in forest.op8_prefix_forest(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [q for q in rows if q % 100 == 0]
    assert sum(len(got[q] & {v for _, v in nearest(rows, q)}) for q in asked) / (10 * len(asked)) >= 0.9
    # With the query's own shards the trees leave most entries of a shard unmeasured.
    vectors = np.array(list(rows.values()), np.float64)
    normals = np.random.default_rng(1).normal(size=(vectors.shape[1], forest.TREES * forest.BITS))
    shard = vectors[:: forest.shards_for(len(vectors))]
    picks = forest.Forest(shard, (normals, np.median(vectors @ normals, axis=0))).search(vectors[:20])
    assert all(0 < len(p) < len(shard) / 2 for p in picks)


def test_larger_shards_measure_a_smaller_share():
    rng = np.random.default_rng(7)
    centres, shares = rng.normal(size=(40, 32)), []
    for n in (500, 4000, 20_000):
        rows = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 32))
        normals = rng.normal(size=(32, forest.TREES * forest.BITS))
        picks = forest.Forest(rows, (normals, np.median(rows[:4096] @ normals, axis=0))).search(rows[:40])
        shares.append(np.mean([len(p) for p in picks]) / n)
        found = [len(set(np.argsort(((rows - rows[i]) ** 2).sum(axis=1))[:11]) & set(p.tolist())) / 11 for i, p in enumerate(picks)]
        assert np.mean(found) >= 0.9, n
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2


def test_forest_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 2.0, 3.0]), (200, [0.0, 0.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in forest.search_forest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100}
    assert [v for _, v, _ in sorted(got[0])] == [1, 100, *range(1001, 1009)] and all(s == 0 for _, _, s in got[0])
    few = spark.createDataFrame(rows[:9] + rows[10:11], "vec_id long, vector array<double>")
    assert [(r["vec_id"], r["rank"]) for r in forest.search_forest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (100, 2), (8, 3)]
    assert forest.search_forest(df.where("false"), df.where("false")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf).persist()
        kept[name] = docs
        if stage is not P.pack:
            assert docs.columns == columns
    before, after = kept["language ID"].collect(), kept["n-gram Jaccard join"].collect()
    classes, _, _ = jaccard_brute([r["text"] for r in sorted(before, key=lambda r: r["doc_id"])], 5, 80)
    ids = sorted(r["doc_id"] for r in before)
    assert sorted(r["doc_id"] for r in after) == sorted({ids[c] for c in classes})
    words = lambda df: df.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    mixed = kept["mixing sources to target weights"]
    assert abs(words(mixed) - words(kept["n-gram Jaccard join"])) <= 40
    ids = sum(len(library_ids(r["text"])) for r in mixed.collect())
    assert kept["packing"].agg(F.sum("length")).first()[0] == ids
    assert P.run(spark, sf).count() == kept["packing"].count()


def test_near_duplicates_with_null_and_repeated_ids(spark, sf):
    import corpus_pipeline as P

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    near = b + " more"
    rows = [(None, a), (None, c), (None, c), (7, d), (7, near), (7, d), (3, b), (9, e), (9, None), (9, ""), (None, None), (8, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    want = [(8, a + " more"), (None, c), (7, d), (3, b), (9, e), (9, None), (9, ""), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_edges(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for _, stage in P.STAGES:
            now = stage(spark, now, str(tmp_path))
        assert (now.count() == 0) == empty
