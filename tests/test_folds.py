"""Folds over long keys, exact percentiles and pairs by blocks, against plain loops."""

import random
import time
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from parlance.operators import ordered as O
from parlance.operators import rollups as R


def chunks_loop(rows, max_chars=500, max_ms=45_000):
    out, now = [], None
    for seq, ms, who, text in sorted(rows):
        if not text:
            continue
        if now and now[2] == who and len(now[3]) < max_chars and ms - now[0] < max_ms:
            now[1], now[3] = ms, now[3] + " " + text
            continue
        if now:
            out.append(now)
        now = [ms, ms, who, text]
    return [tuple(x[:3]) + (x[3].strip(" "),) for x in out + [now]]


def test_chunks_are_the_loop(spark):
    rng = random.Random(3)
    rows = [(c, i, i * rng.randrange(9_000), rng.choice("ab"), rng.choice(["", "x " * rng.randrange(1, 200), "ünd so"])) for c in ("p", "q") for i in range(300)]
    got = O.turn_chunks(spark.createDataFrame(rows, "call string, seq int, ms long, speaker string, text string"))
    for call in ("p", "q"):
        mine = [tuple(r)[2:] for r in got.where(F.col("call") == call).orderBy("chunk_no").collect()]
        assert mine == chunks_loop([r[1:] for r in rows if r[0] == call])


def test_a_long_call_takes_linear_time(spark):
    def seconds(n):
        lines = spark.range(n).select(F.lit(1).alias("call"), F.col("id").alias("seq"), (F.col("id") * 50_000).alias("ms"), F.lit("you").alias("speaker"), F.lit("word").alias("text"))
        began = time.time()
        assert O.turn_chunks(lines).count() == n
        return time.time() - began

    seconds(1_000)
    assert seconds(400_000) < 8 * seconds(100_000) + 5


def test_fold_edges(spark):
    schema = "call string, seq int, ms long, speaker string, text string, lines string"
    assert O.turn_chunks(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, None, None, "a", "z"), (None, 2, 5, None, "b", "z"), ("c", None, 1, "you", None, "z"), ("c", 1, 1, "you", " ", "z")]
    got = [tuple(r) for r in O.turn_chunks(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(None, 0, None, 5, None, "a b")]


def test_lanes_are_the_loop(spark):
    rng = random.Random(4)
    rows = [(g, d, i, rng.randrange(200), rng.choice([None, 0, 5, 40, 90])) for g in ("x", None) for d in (1, 2) for i in range(150)]
    got = O.calendar_lanes(spark.createDataFrame(rows, "grp string, day int, id int, start_min int, duration_min int"))
    lanes = {tuple(r)[:3]: (r["lane"], r["lanes"]) for r in got.collect()}
    for g in ("x", None):
        for d in (1, 2):
            ends, at = [], {}
            for start, i, size in sorted((r[3], r[2], max(15, r[4] or 0)) for r in rows if r[:2] == (g, d)):
                lane = next((k for k, e in enumerate(ends) if e <= start), len(ends))
                ends[lane : lane + 1] = [start + size]
                at[i] = lane
            assert {i: lanes[g, d, i] for i in at} == {i: (lane, len(ends)) for i, lane in at.items()}


def test_ranks_are_the_sorted_values(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([float(rng.randrange(9)), rng.gauss(0, 1) ** 5])) for k in ("hot", None) for _ in range(3_000 if k else 700)]
    rows += [("one", 2.0), ("none", None), ("one", float("nan")), ("flat", 1.0)] + [("flat", 1.0)] * 900
    shares = (0.0, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(v for key, v in rows if key == k and v is not None and v == v)
        if mine:
            want[k] = tuple(mine[min(len(mine) - 1, int(p * len(mine)))] for p in shares)
    for small, keys in ((1 << 20, 9), (40, 9), (1, 9), (40, 0)):
        got = {r["key"]: tuple(r)[1:] for r in R.nearest_rank(df, "key", "v", shares, small=small, keys=keys, cuts=16).collect()}
        assert got == want
    assert R.nearest_rank(df.limit(0), "key", "v", shares).count() == 0


def test_pairs_by_blocks_lose_none(spark):
    rng = random.Random(6)
    rows = [(p, rng.randrange(60)) for p in range(12) for _ in range(40)] + [(99, e) for e in range(60)] + [(None, 1), (99, None), (98, 7)]
    calls = {}
    for path, entity in set(rows):
        if path is not None and entity is not None:
            calls.setdefault(path, set()).add(entity)
    want = {}
    for entities in calls.values():
        for a in entities:
            for b in entities:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "path int, entity_id int")
    for block in (1, 7, 512):
        for least in (1, 3):
            got = {(r["a"], r["b"]): r["n_calls"] for r in R.co_occurring_all(df, least, block).collect()}
            assert got == {k: n for k, n in want.items() if n >= least}


def test_pairs_are_dealt_by_their_number(spark):
    """Lists of small calls and blocks of large ones in one job, and as many parts as there are shares of pairs, so that no task grows with the table."""
    rows = [(p, p * 7 % 23 + e) for p in range(200) for e in range(4)] + [(900 + p, e) for p in range(2) for e in range(40)] + [(5, 35), (5, 35), (None, 3), (3, None)]
    calls = {}
    for path, entity in rows:
        if path is not None and entity is not None:
            calls.setdefault(path, set()).add(entity)
    want = Counter(pair for entities in calls.values() for pair in combinations(sorted(entities), 2))
    out = R.co_occurring_all(spark.createDataFrame(rows, "path int, entity_id int"), block=16, share=100)
    assert {(r["a"], r["b"]): r["n_calls"] for r in out.collect()} == {k: n for k, n in want.items() if n >= 2}
    assert out.rdd.getNumPartitions() >= sum(want.values()) // 100


def shuffled(spark) -> int:
    """Bytes that the stages of the session have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_line_pairs_shuffle_no_texts(spark):
    """All pairs against a loop, at several shares; copies, sets of one line and empty ones among them; long lines that are in no candidate stay where they are."""
    rng = random.Random(8)
    pool = [f"line {i} é\"\\" for i in range(14)]
    sets = [frozenset(rng.sample(pool, rng.randrange(0, 7))) for _ in range(60)] + [frozenset(pool[:n]) for n in (1, 1, 1, 9, 10)] + [frozenset()]
    docs = [(i, rng.sample(sorted(s), len(s))) for i, s in enumerate(sets)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, []).append(i)
    for least in (0.3, 0.5, 0.8):
        want = set()
        for (x, a), (y, b) in combinations(sorted(((s, i) for s, i in first.items() if s), key=lambda x: x[1][0]), 2):
            if len(x & y) / len(x | y) >= least:
                want.add((a[0], b[0], len(a), len(b), len(x & y), round(len(x & y) / len(x | y), 9)))
        got = [(r["a"], r["b"], r["a_copies"], r["b_copies"], r["common"], r["jaccard"]) for r in O.line_pairs(spark.createDataFrame(docs, "doc_id long, lines array<string>"), least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want

    words = F.concat_ws(" ", *[F.sha2(F.concat_ws("/", "id", F.lit(k)), 512) for k in range(20)])
    long = spark.range(500, numPartitions=4).select(F.col("id").alias("doc_id"), F.array(words, F.reverse(words), F.concat(F.lit("near "), (F.col("id") % 100).cast("string"))).alias("lines"))
    before = shuffled(spark)
    assert O.line_pairs(long).count() == 0
    assert shuffled(spark) - before < 500 * 2 * 2560 / 4  # a line of these takes 2,579 characters
