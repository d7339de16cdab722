"""Identity by names, aliases and verdicts, and streams of polls and replies."""

import random

from pyspark.sql import functions as F

from parlance.operators import entities as E
from parlance.operators import ordered as O
from parlance.streaming import live as L


def people(spark):
    rows = [(1, "Ann Lee", "person", "w", False), (2, "Ann Lee", "person", "w", True), (3, "Bo", "person", "w", True), (4, "Cy", "person", "v", True), (5, "Dee", "term", "w", True)]
    return spark.createDataFrame(rows, "id long, name string, kind string, grp string, confirmed boolean")


def aliases(spark):
    return spark.createDataFrame([(3, "Bobby"), (4, "Bobby"), (2, None)], "id long, alias string")


def merges(spark):
    return spark.createDataFrame([(9, 3), (12, 9), (12, 4)], "a long, b long")


def test_owners_are_confirmed_people_of_the_workspace_after_merges(spark):
    rows = [(1, " ann lee ", "w"), (2, "BOBBY", "w"), (3, "Bo", "w"), (4, "Cy", "w"), (5, "you", "w"), (6, "Dee", "w"), (7, "bobby", "v"), (8, None, "w"), (9, "Bo", None)]
    got = E.resolve_owners(spark.createDataFrame(rows, "path int, owner string, grp string").withColumn("text", F.lit("t")), people(spark), aliases(spark), merges(spark))
    assert {r["path"]: r["owner_id"] for r in got.collect()} == {1: "2", 2: "12", 3: "12", 4: "Cy", 5: "you", 6: "Dee", 7: "12", 8: None, 9: "Bo"}


def test_surfaces_meet_the_first_entity_and_new_forms_make_one(spark):
    rows = [("Ann LEE", "person", "x"), ("bobby", "person", "w"), ("bobby ", "person", "v"), ("Zed", "person", "w"), (" zed", "person", "v"), ("Bo", "org", "w"), (None, "person", "w")]
    got = E.resolve_surfaces(spark.createDataFrame(rows, "surface string, kind string, grp string"), people(spark), aliases(spark), merges(spark))
    by = {(r["kind"], r["aliases"]): r for r in got.collect()}
    assert len(by) == 4
    assert (by["person", "ann lee"]["entity"], by["person", "ann lee"]["id"]) == ("1", "1")
    bob = by["person", "bobby"]
    assert (bob["entity"], bob["id"], bob["grps"], bob["n"]) == ("3", "12", "v|w", 2)
    assert by["person", "zed"]["n"] == 2 and len(by["person", "zed"]["id"]) == 16 and by["person", "zed"]["id"] != by["org", "bo"]["id"]


def test_streams_of_polls_and_replies_are_their_batch_forms(spark):
    rng = random.Random(8)
    polls = spark.createDataFrame([(i, i // 6, rng.randrange(3), rng.choice([None, "2024-01-01", "2024-01-02"])) for i in range(60)], "event_id long, poll long, scope long, attempted string")
    got = L.drain(L.moved_scopes(L.replay(polls, "poll", "scope", parts=4)))
    assert sorted(map(tuple, got.select("event_id", "scope", "known", "moved").collect())) == sorted(map(tuple, O.scope_moved(polls).collect()))
    replies = spark.createDataFrame([(i, rng.randrange(3), rng.choice([None, 1, 2, 3]), i // 2) for i in range(60)], "event_id long, key long, generation int, at long").select("event_id", "key", "generation", F.timestamp_seconds("at").alias("arrival"))
    got = L.drain(L.timely_replies(L.replay(replies, "arrival", "key", parts=4)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, O.late_replies(replies).collect()))


def test_keys_of_a_shard_share_a_group_and_keep_their_own_state(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARDS", 2)  # before: every key was a group of its own
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 13).alias("key"), (F.col("id") * 11 % 5).cast("int").alias("generation"), F.timestamp_millis(F.col("id") * 1000).alias("arrival"))
    sharded = L.timely_replies(L.replay(rows, "arrival", "key", parts=4))
    assert "_shard" in sharded._jdf.queryExecution().analyzed().toString()
    top, want = {}, []
    for r in rows.orderBy("event_id").collect():
        if r["generation"] >= top.get(r["key"], 0):
            top[r["key"]] = r["generation"]
            want.append(r["event_id"])
    assert sorted(r["event_id"] for r in L.drain(sharded).collect()) == want
