"""The manifest's proofs against a plain tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers_llm import edge_docs

from parlance.llm import merkle


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def code(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def plain(rows) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"], h("".join(code(r[c]) for c in merkle.COLUMNS)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for i, (doc_id, leaf, r) in enumerate(by[s]):
            folded, siblings, text = leaf, "", r["text"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                folded = h("".join(code(text if c == "text" else r[c]) for c in merkle.COLUMNS))
            for tree, at in ((trees[s], i), (top, place)):
                for level in tree[:-1]:
                    first = at // 16 * 16
                    run = level[first : first + 16]
                    siblings += "".join(run[: at - first] + run[at - first + 1 :])
                    folded = h("".join(run[: at - first] + [folded] + run[at - first + 1 :]))
                    at //= 16
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]))
    return out


def check(docs):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    rows = docs.collect()
    got = [tuple(r) for r in merkle.prove(merkle.build_manifest(merkle.document_leaves(docs))).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


@pytest.mark.parametrize("part", [9, 300, 1 << 15])
def test_proofs_are_those_of_a_plain_tree(spark, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART_LEAVES", part)
    rng = random.Random(part)
    sources = ["hot"] * 40 + [None, "", "a", "Z", "é"] + [f"s{i}" for i in range(45)]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 4]), rng.choice(["Some Text", "some text", None, "", "ÄÖ"])) for i in range(900)]
    got = check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 273])
def test_sizes_around_whole_runs(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "PART_LEAVES", 20)
    check(spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string"))


@pytest.mark.parametrize("empty", [False, True])
def test_merkle_edges(spark, empty):
    docs = edge_docs(spark, empty)
    assert len(check(docs)) == docs.count()


def test_missing_nodes_are_the_minimal_union():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 5000)
        low = rng.randrange(n)
        high = rng.randrange(low, n)
        sizes = [n]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 16))
        derived, wanted = {(0, i) for i in range(low, high + 1)}, set()
        for level, size in enumerate(sizes[:-1]):
            asked = {(level, j) for _, i in {x for x in derived if x[0] == level} for j in range(i // 16 * 16, min(size, i // 16 * 16 + 16))}
            wanted |= asked - derived
            derived |= {(level + 1, i // 16) for _, i in asked}
        got = list(merkle.missing(low, high, n))
        assert set(got) == wanted and len(got) == len(wanted)


def test_a_changed_node_is_found_out(spark, monkeypatch):
    """Partitions that fetch another digest than the tree's own don't come to the root."""
    monkeypatch.setattr(merkle, "PART_LEAVES", 10)
    from dataclasses import replace

    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(64)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build_manifest(merkle.document_leaves(docs))
    spoilt = replace(made, nodes=made.nodes.withColumn("digest", F.when(F.col("level") == 1, F.lit("0" * 64)).otherwise(F.col("digest"))))
    assert {r["verified"] for r in merkle.prove(spoilt).collect()} == {False}
