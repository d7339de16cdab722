"""Stubs, wipe plans and drift verdicts on rows of our own."""

from parlance.operators import documents as D
from parlance.operators import entities as E


def test_stub_files_keep_what_is_not_theirs_and_settle(spark):
    stubs = spark.createDataFrame([("w", i, f"N{i}", "person", "[[A]]\n[[B]]") for i in range(6)] + [(None, 7, "N7", "org", "")], "grp string, id int, name string, kind string, links string")
    own = "---\napp: \"call-transcriber\"\n---\n"
    region = f"{E.LINKS_BEGIN}\n- [[A]]\n- [[B]]\n{E.LINKS_END}"
    files = {1: own + f"a {E.LINKS_BEGIN}old{E.LINKS_END} b {E.LINKS_END}", 2: "theirs", 3: own + "bare", 4: own + f"{E.LINKS_END}{E.LINKS_BEGIN}", 5: None}
    there = spark.createDataFrame([("w", i, c) for i, c in files.items()], "grp string, id int, content string")
    got = {r["id"]: (r["content"], r["made"]) for r in E.stub_files(stubs, there).collect()}
    head = '---\napp: call-transcriber\nkind: person\ngroup: "w"\n---\n\n# N{}\n\n'
    assert got[0] == (head.format(0) + region + "\n", True) and got[5] == (head.format(5) + region + "\n", True)
    assert got[1] == (own + f"a {region} b {E.LINKS_END}", False)
    assert got[3] == (own + "bare\n\n" + region + "\n", False)
    assert got[4][0].endswith(f"{E.LINKS_END}{E.LINKS_BEGIN}\n\n{region}\n")
    assert 2 not in got and f"\n{E.LINKS_BEGIN}\n\n{E.LINKS_END}\n" in got[7][0]
    written = spark.createDataFrame([(None if i == 7 else "w", i, c) for i, (c, _) in got.items() if i != 4] + [("w", 2, "theirs")], "grp string, id int, content string")
    assert E.stub_files(stubs.where("id <> 4"), written).count() == 0
    assert E.stub_files(stubs, there.limit(0)).count() == 7


def test_a_place_that_could_not_be_listed_refuses_the_whole_plan(spark):
    docs = spark.createDataFrame([("a", 1, "conversation"), ("a", 1, "conversation"), ("a", 2, "reference-frozen"), ("a", 3, None), ("b", 4, "conversation"), (None, 5, "decision")], "grp string, path int, document_class string")
    listings = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "z", False), ("b", "q", None), ("b", "x", True), (None, "x", True), ("empty", "x", True)], "grp string, location string, readable boolean")
    got = {r["grp"]: tuple(r)[1:] for r in D.wipe_plans(docs, listings).collect()}
    assert got == {"a": (1, 1, 1, None), "b": (None, None, None, "q; z"), None: (0, 0, 1, None), "empty": (0, 0, 0, None)}


def test_verdicts(spark):
    scopes = spark.createDataFrame([("same", None), ("moved", None), ("part", None), ("lost", "no folder"), ("new", None)], "scope string, error string")
    now = spark.createDataFrame([("same", 1, "h", True), ("moved", 1, "h", True), ("moved", 2, "i", True), ("part", 1, None, False), ("part", 2, None, True), ("lost", 1, "h", True)], "scope string, path int, checksum string, readable boolean")
    then = spark.createDataFrame([("same", 1, "h"), ("moved", 2, "j"), ("moved", 3, "h"), ("part", 1, "h"), ("part", 2, "h"), ("lost", 1, "h")], "scope string, path int, checksum string")
    got = {r["scope"]: r.asDict() for r in D.drift_verdicts(scopes, now, then).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {"same": "unchanged and complete", "moved": "moved", "part": "unchanged but incomplete", "lost": "unavailable", "new": "unchanged and complete"}
    figures = ("added", "removed", "changed", "unverifiable", "unreadable", "checked", "stale", "checkable")
    assert [got["moved"][f] for f in figures] == [1, 1, 1, 0, 0, 1, True, True]
    assert [got["part"][f] for f in figures] == [0, 0, 0, 1, 1, 1, False, False]
    assert [got["lost"][f] for f in figures] == [None] * 8


def test_corpus_files_are_in_a_folder_per_task(spark, sf):
    """A file per call, but no folder per call: the commit and the scan go by folders."""
    from glob import glob

    from parlance.plans.catalogue import QUERIES

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob(f"{root}/corpus-*"))
    row = QUERIES["corpus_scan"](spark, sf).first()
    (made,) = set(glob(f"{root}/corpus-*")) - before
    assert row["files"] == row["owned"] == len(glob(f"{made}/*/*.txt")) > 4
    assert len(glob(f"{made}/*/")) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
