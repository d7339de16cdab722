"""Counts, rollups and digests over calls, entities and commitments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.sources.storage import broadcast_few, stored


def in_workspace(df: DataFrame, grp: str | None, column: str = "grp") -> DataFrame:
    """None: every workspace; "": the rows that have none; else that workspace."""
    return df if grp is None else df.where(F.col(column) == grp)


def calls_mentioning(mentions: DataFrame, calls: DataFrame, entity_id, grp: str | None = None, limit: int = 50) -> DataFrame:
    """Calls that mention an entity, with the first mention's time, newest first."""
    first = mentions.where(F.col("entity_id") == entity_id).groupBy("path").agg(F.min("start_ms").alias("first_ms"))
    rows = in_workspace(calls, grp).where(F.col("kind") == "call").join(first, "path")
    return rows.select("path", "title", "day", "first_ms").orderBy(F.desc("day"), "path").limit(limit)


def entity_counts(mentions: DataFrame, calls: DataFrame, entities: DataFrame, grp: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities with the distinct calls that mention them."""
    seen = mentions.select("entity_id", "path").distinct().join(in_workspace(calls, grp).where(F.col("kind") == "call").select("path"), "path")
    counts = seen.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_calls"))
    out = entities.join(counts, entities["id"] == counts["entity_id"]).select("id", "name", "n_calls")
    return out if limit is None else out.orderBy(F.desc("n_calls"), "name", "id").limit(limit)


def co_occurring(mentions: DataFrame, entity_id) -> DataFrame:
    """Entities that share calls with one, and in how many."""
    paths = mentions.where(F.col("entity_id") == entity_id).select("path").distinct()
    rows = mentions.where(F.col("entity_id") != entity_id).join(paths, "path", "left_semi")
    return rows.groupBy("entity_id").agg(F.countDistinct("path").alias("n_calls"))


def co_occurring_in(mentions: DataFrame, calls: DataFrame, entities: DataFrame, entity_id, grp: str, limit: int = 20) -> DataFrame:
    """The entities (id, name, kind) that share most calls of one workspace with an entity; ties by name, then id. A limit under 1 is 1."""
    counts = co_occurring(mentions.join(calls.where(F.col("grp") == grp).select("path"), "path", "left_semi"), entity_id)
    rows = entities.join(counts, entities["id"] == counts["entity_id"]).select("id", "name", "kind", "n_calls")
    return rows.orderBy(F.desc("n_calls"), "name", "id").limit(max(1, limit))


def co_occurring_all(mentions: DataFrame, least: int = 2, block: int = 512, share: int = 1_000_000) -> DataFrame:
    """Pairs of entities (a < b) with at least so many calls in common.

    Entities of fewer mentions than that can be in no such pair and go first. A call of at most ``block`` mentions is one list, whose pairs are
    made in place. The entities of a larger one are cut into blocks of about so many by their hash, and its pairs are made one pair of
    blocks at a time, so that it is spread over tasks (a block's rows are copied once per block of the call).
    Pairs are counted beforehand and dealt into as many parts as give a task about ``share`` of them, so a task's memory
    doesn't grow with the table. Null ids and paths pair with nothing.
    """
    spark = mentions.sparkSession
    known = mentions.select("path", "entity_id").where("path is not null and entity_id is not null")
    rare = known.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).select("entity_id")
    rows = known.join(broadcast_few(rare), "entity_id", "left_anti")
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    is_large, n_pairs = F.col("_n") > block, F.col("_n") * (F.col("_n") - 1) / 2
    counts = sizes.agg(F.count_if(is_large).alias("large"), F.sum(F.when(is_large, n_pairs)).alias("crossed"), F.sum(F.when(~is_large, n_pairs)).alias("listed")).first()
    listed, crossed = counts["listed"] or 0, counts["crossed"] or 0
    parts = lambda n: max(spark.sparkContext.defaultParallelism, math.ceil(n / share))

    large = broadcast_few(sizes.where(is_large).select("path")) if counts["large"] else None
    few = rows.join(large, "path", "left_anti") if counts["large"] else rows
    lists = few.repartition(parts(listed), "path").groupBy("path").agg(F.array_sort(F.collect_set("entity_id")).alias("es"))
    ahead = lists.select("es", F.posexplode("es").alias("i", "a"))
    pairs = ahead.select("a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    if counts["large"]:
        once = rows.join(large, "path", "left_semi").distinct()
        blocks = once.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).select("path", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
        placed = once.join(blocks, "path").withColumn("_own", F.pmod(F.xxhash64("entity_id"), F.col("_blocks")).cast("int"))
        first = placed.select("path", F.col("entity_id").alias("x"), F.col("_own").alias("i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("j"))
        second = placed.select("path", F.col("entity_id").alias("y"), F.explode(F.sequence(F.lit(0), "_own")).alias("i"), F.col("_own").alias("j"))
        dealt = [side.repartition(parts(crossed), "path", "i", "j") for side in (first, second)]
        met = dealt[0].join(dealt[1], ["path", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
        pairs = pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    if parts(listed + crossed) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.repartition(parts(listed + crossed), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_calls")).where(F.col("n_calls") >= least)


def spelled_rollup(values: DataFrame, column: str = "value") -> DataFrame:
    """Values folded by case: the most frequent spelling (ties: the first in order) and the count of all."""
    forms = values.where(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.lower(column).alias("folded"), F.col(column).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("form").alias("form")))["form"]
    return forms.groupBy("folded").agg(best.alias("display"), F.sum("n").alias("n")).select("display", "n")


def facets(values: DataFrame, row: str, value: str, order: str) -> DataFrame:
    """One count per row and value (case folded), shown as first seen."""
    once = values.groupBy(row, F.lower(value).alias("folded")).agg(F.min(F.struct(order, value)).alias("first"))
    return once.groupBy("folded").agg(F.count(F.lit(1)).alias("n"), F.min("first")[value].alias("display")).select("display", "n")


def recent_digest(calls: DataFrame, grp: str | None, limit: int = 400) -> DataFrame:
    """The newest calls of a workspace."""
    rows = in_workspace(calls, grp).where(F.col("kind") == "call")
    return rows.select("path", "title", "day", "start_min").orderBy(F.desc("day"), F.desc("start_min"), "path").limit(limit)


def digest_by_day(calls: DataFrame) -> DataFrame:
    """Titles of each day's calls in order of start."""
    rows = calls.where(F.col("kind") == "call").groupBy("day").agg(F.sort_array(F.collect_list(F.struct("start_min", "path", "title"))).alias("rows"))
    return rows.select("day", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["title"]), ", ").alias("titles"))


def calendar_month(calls: DataFrame, shown: int = 3) -> DataFrame:
    """Each day's first calls by time and how many more there are."""
    w = W.partitionBy("day").orderBy("start_min", "path")
    rows = calls.select("day", "path", "title", "start_min", F.row_number().over(w).alias("slot"), F.count(F.lit(1)).over(W.partitionBy("day")).alias("n"))
    return rows.where(F.col("slot") <= shown).select("day", "slot", "path", "title", F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def status_rollup(docs: DataFrame, keys: tuple[str, ...] = ("vault", "tier", "status", "doc_type", "confidence")) -> DataFrame:
    """Documents and passages in all and by each key, in one pass over grouping sets."""
    docs.createOrReplaceTempView("_status_rollup")
    sets = ", ".join(f"({k})" for k in keys)
    facet = "case " + " ".join(f"when grouping({k}) = 0 then '{k}'" for k in keys) + " else 'all' end"
    token = "coalesce(" + ", ".join(f"cast({k} as string)" for k in keys) + ", '')"
    return docs.sparkSession.sql(f"select {facet} as facet, {token} as token, count(*) as documents, sum(passages) as passages from _status_rollup group by grouping sets ({sets}, ())")


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def nearest_rank(values: DataFrame, key: str, value: str, shares: tuple[float, ...], small: int = 1 << 20, rounds: int = 3, cuts: int = 256, keys: int = 100_000) -> DataFrame:
    """Percentiles by nearest rank: the sorted value at index min(n - 1, int(share * n)), exactly. Null and NaN values take no part.

    A distributed selection: each key's values are cut into ranges at about equal ranks by a mergeable sketch, exact counts below and inside the range
    of the wanted rank are taken, and again inside that range, until at most ``small`` values are left, whose distinct ones are
    ranked. Nothing sorts a whole key, and all counting is done on the map side first. A range that misses the rank (the sketch
    only estimates) isn't taken, so more is left to rank, and the result is the same. Ranges are broadcast up to ``keys`` keys, else joined.
    """
    rows = values.select(F.col(key).alias("_key"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    names = [f"p{round(p * 100)}" for p in shares]
    share = F.explode(F.array(*[F.struct(F.lit(n).alias("share"), F.lit(float(p)).alias("p")) for n, p in zip(names, shares)]))
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.least(F.col("_n") - 1, F.floor(F.col("s.p") * F.col("_n")))
    none = F.lit(None).cast(rows.schema["_v"].dataType)
    at = stored(counts.select("_key", "_n", share.alias("s")).select("_key", F.col("s.share").alias("share"), rank.cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside"), none.alias("lo"), none.alias("hi")), "ranks")
    few = counts.limit(keys + 1).count() <= keys
    in_range = (F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))

    def against(ranges: DataFrame) -> DataFrame:
        small_side = F.broadcast(ranges) if few else ranges
        return rows.join(small_side, rows["_key"].eqNullSafe(ranges["_key"])).drop(rows["_key"])

    for _ in range(rounds):
        if not at.where(F.col("inside") > small).limit(1).count():
            break
        wide = at.where(F.col("inside") > small)
        sketch = F.percentile_approx("_v", [i / cuts for i in range(cuts + 1)], 16 * cuts).alias("edges")
        edges = against(wide).where(in_range).groupBy("_key", "share").agg(sketch).withColumnRenamed("_key", "_k").withColumnRenamed("share", "_s")
        place = F.floor((F.col("rank") - F.col("below")) * cuts / F.col("inside")).cast("int")
        near = wide.join(edges, wide["_key"].eqNullSafe(F.col("_k")) & (F.col("share") == F.col("_s"))).select("_key", "share", "rank", F.col("below").alias("was_below"), F.col("inside").alias("was_inside"), F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"), F.element_at("edges", F.greatest(place, F.lit(1))).alias("lo"), F.element_at("edges", F.least(place + 3, F.lit(cuts + 1))).alias("hi"))
        near = stored(near, "ranges")
        exact = against(near).groupBy("_key", "share").agg(F.count_if(F.col("_v") < F.col("lo")).alias("now_below"), F.count_if(F.col("_v").between(F.col("lo"), F.col("hi"))).alias("now_inside")).withColumnRenamed("_key", "_k").withColumnRenamed("share", "_s")
        met = (F.col("now_below") <= F.col("rank")) & (F.col("rank") < F.col("now_below") + F.col("now_inside"))
        pick = lambda c: F.when(met, F.col(c if c in ("lo", "hi") else f"now_{c}")).otherwise(F.col(f"was_{c}")).alias(c)
        nearer = near.join(exact, near["_key"].eqNullSafe(F.col("_k")) & (F.col("share") == F.col("_s"))).select("_key", "share", "rank", pick("below"), pick("inside"), pick("lo"), pick("hi"))
        at = stored(nearer.unionByName(at.where(F.col("inside") <= small)), "ranks")
    left = against(at).where(in_range).groupBy("_key", "share", "rank", "below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    after = F.col("below") + F.sum("_c").over(W.partitionBy("_key", "share").orderBy("_v"))
    hits = left.withColumn("_after", after).where(F.col("_after") > F.col("rank"))
    return hits.groupBy(F.col("_key").alias(key)).agg(*[F.min(F.when(F.col("share") == n, F.col("_v"))).alias(n) for n in names])
