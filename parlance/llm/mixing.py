"""Mixing sources to target weights, exact to the word.

Each document gets a hash-random key (md5 of a seed and its id). Within a source
the keys are sorted by ranges: a range is the first hexadecimal digits of the
key, so ranges follow each other and no range holds many rows of even a hot
source. Prefix sums are distributed: sums per range, running sums over the
ranges of a source (small rows), then running sums inside each range. A source
gives all its documents as many whole epochs as its budget holds; the next
epoch is cut at the exact word, so one document per source may be taken in part.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share all words by weight; a target above ``max_epochs`` times its source's size
stops there and the excess is shared anew. That is one level L with target =
min(weight * L, cap): the sources sorted by cap / weight are capped in that
order, so running sums over one row per source find L directly.

Nulls and edge cases: a null text has size 0 and is taken 0 words; a null source is
a source of its own; repeated rows are documents of their own; ties of the key
(equal ids) are ordered by size, and equal rows among themselves take
their words together in any order; an empty table gives no rows. Extra columns of any name
are kept by ``mix_sources`` unless it makes a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm._storage import stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows that a range of keys should hold at most, about.
RANGE_ROWS = 4096


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(squeezed, " \t\n\u000b\f\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for one row per source (source, source_size)."""
    everything = W.partitionBy(F.lit(0))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    by_level = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_level.rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("source_size").over(everything).cast("double")
    # If exactly this source and those before it are capped, the level of the others is:
    rest = F.sum("weight").over(everything) - F.sum("weight").over(upto)
    level = (total - F.sum("cap").over(upto)) / F.when(rest > 0, rest)
    following = F.lead(F.col("cap") / F.col("weight")).over(by_level)
    stepped = named.select("*", F.row_number().over(by_level).alias("place"), level.alias("level"), following.alias("next_level"), (total / F.sum("weight").over(everything)).alias("level_0"), F.min(F.col("cap") / F.col("weight")).over(everything).alias("first_level"))
    fits = F.when((F.col("level") <= F.col("next_level")) & (F.col("level_0") > F.col("first_level")), F.struct("place", "level"))
    found = F.min(fits).over(everything)
    capped = F.when(F.col("level_0") <= F.col("first_level"), 0).otherwise(found["place"])
    chosen = F.when(F.col("level_0") <= F.col("first_level"), F.col("level_0")).otherwise(found["level"])
    return stepped.select("source", "source_size", F.when(F.coalesce(F.col("place") <= capped, F.lit(True)), F.col("cap")).otherwise(F.col("weight") * chosen).alias("target"))


def _keyed(docs: DataFrame, doc_id: str, source: str, seed: str) -> list[Column]:
    """The source as a key of its own (null: empty, others with a letter before), and the hash-random key."""
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return [F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("src"), key.alias("key")]


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows (src, key, ...) with their range of keys."""
    width = max(1, len(f"{max(rows.count() // RANGE_ROWS, 1) - 1:x}"))
    return rows.withColumn("range", F.substring("key", 1, width))


def _ranges(rows: DataFrame, weights, max_epochs: int) -> DataFrame:
    """src, range, range_start, range_size, source_size, target of rows (src, range, size)."""
    ranges = rows.groupBy("src", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(W.partitionBy("src").orderBy("range")) - F.col("range_size")
    sizes = ranges.groupBy("src").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes.select(F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), "source_size"), weights, max_epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("src"), "source_size", "target")
    return ranges.select("src", "range", "range_size", before.alias("range_start")).join(targets, "src")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes) to every document.

    The rows without their texts are stored once and reread by the three sums.
    """
    made = ("size", "source_size", "target", "taken")
    kept = F.struct(*[F.col(c) for c in docs.columns if c not in (*made, text)]).alias("row")  # no name in it can clash
    rows = _ranged(stored(docs.select(kept, *_keyed(docs, doc_id, source, seed), (size if size is not None else count_words(F.col(text))).alias("size")), "mix"))
    inner = F.sum("size").over(W.partitionBy("src", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = rows.withColumn("inner", inner).join(_ranges(rows, weights, max_epochs), ["src", "range"])
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    over = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), over))
    return placed.select("row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def cut_points(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: src, epochs (whole uses of each document), and where the next epoch is cut: at (key, size, mark),
    of whose ``ties`` equal rows ``words`` words are taken. Only the rows of one range per source are sorted."""
    rows = stored(docs.select(*_keyed(docs, doc_id, source, seed), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("mark")), "mix")
    rows = _ranged(rows)
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    ranges = _ranges(rows, weights, max_epochs).withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("range_start"))
    ranges = stored(ranges, "mix-ranges")
    cut = ranges.where((F.col("left") >= 0) & (F.col("left") < F.col("range_size"))).select("src", "range", "left")
    groups = rows.join(cut, ["src", "range"]).groupBy("src", "left", "key", "size", "mark").agg(F.count(F.lit(1)).alias("ties"))
    words = F.col("size") * F.col("ties")
    groups = groups.withColumn("words", F.col("left") - F.sum(words).over(W.partitionBy("src").orderBy("key", "size", "mark")) + words)
    found = groups.where((F.col("words") >= 0) & (F.col("words") < words)).select("src", F.struct("key", "size", "mark").alias("cut"), "words", "ties")
    return stored(ranges.select("src", "epochs").distinct().join(found, "src", "left"), "mix-cuts")


def repeat_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them: whole epochs as rows of their own, the last one cut at the budget's word.

    Texts are not shuffled: they meet one row per source. Documents without words stay once. Rows equal in
    id and text are taken one after the other; ``n_chars`` of a cut text is its own, if there is such a column.
    """
    cuts = cut_points(docs, doc_id, text, source, weights, max_epochs, seed)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    at = F.struct("key", "size", "mark")
    rows = docs.select(row, *_keyed(docs, doc_id, source, seed), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("mark"))
    rows = rows.join(cuts, "src").select("row", "size", "epochs", "words", "ties", "src", (at < F.col("cut")).alias("before"), at.eqNullSafe(F.col("cut")).alias("here"))
    tied = F.col("here") & (F.col("ties") > 1)
    numbered = rows.withColumn("nth", F.lit(1).cast("long"))
    if cuts.where("ties > 1").limit(1).count():
        nth = F.row_number().over(W.partitionBy("src").orderBy(F.lit(1))).cast("long")
        numbered = numbered.where(~tied).unionByName(rows.where(tied).withColumn("nth", nth))
    rest = F.when(F.col("before"), F.col("size")).when(F.col("here"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("size") * (F.col("nth") - 1)))).otherwise(0)
    whole = F.when(F.col("size") > 0, F.col("epochs") + F.when(rest == F.col("size"), 1).otherwise(0)).otherwise(1).cast("int")
    part = F.when((rest > 0) & (rest < F.col("size")), F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = numbered.select("row", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), part)).alias("take"))
    cut = F.when(F.col("take") < 0, F.col(f"row.{text}")).otherwise(first_words(F.col(f"row.{text}"), F.col("take")))
    made = {text: cut} | ({"n_chars": F.when(F.col("take") < 0, F.col("row.n_chars")).otherwise(F.length(cut))} if "n_chars" in docs.columns else {})
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text with its first n words, as it stands there."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(tokens, F.lit(1), n), "")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size, md5('{SEED}/' || coalesce(cast(doc_id as varchar), 'null')) k from documents),
s as (select source, sum(size)::bigint source_size from d group by 1),
w as (select *, (((row_number() over (order by source nulls last) - 1) % 3) + 1)::double weight, source_size * 3.0::double cap from s),
t(round, source, source_size, weight, cap, capped, level) as (
  select 0, source, source_size, weight, cap, false, (sum(source_size) over ())::double / sum(weight) over () from w
  union all
  select round + 1, source, source_size, weight, cap, weight * level > cap,
    ((sum(source_size) over ())::double - coalesce(sum(cap) filter (weight * level > cap) over (), 0)) / nullif(sum(weight) filter (weight * level <= cap) over (), 0)
  from t where round < 60),
g as (select source, source_size, (case when weight * level > cap then cap else weight * level end)::double target from t where round = 60),
p as (select d.doc_id, d.size, g.source_size, g.target, sum(d.size) over (partition by d.source order by d.k, d.size rows unbounded preceding) - d.size before from d join g on d.source is not distinct from g.source),
q as (select *, floor(target + 1e-6)::bigint budget from p)
select doc_id, size::bigint size, source_size, target,
  (case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) else 0 end)::bigint taken
from q"""
