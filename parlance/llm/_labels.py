"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.langid import held_out


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: str = "sample-1") -> DataFrame:
    """The documents of at most ``per_class`` labelled rows of each class, with ``label``; held-out rows are left out.

    The rows are those with the smallest md5 of seed and id, so reruns agree.
    Only ids and labels are sorted; the documents meet them by a broadcast join,
    bounded by twice ``per_class`` rows of two numbers. An id labelled twice counts once (the larger label);
    of several documents with one id the one of the smallest text hash counts.
    """
    known = labels.where(F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col("doc_id").cast("string")))
    some = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    kept = [c for c in docs.columns if c not in ("doc_id", "label")]
    found = docs.drop("label").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("order"), *kept)).alias("first")
    return found.groupBy("doc_id", "label").agg(first).select("doc_id", *[F.col("first").getField(c).alias(c) for c in kept], "label")
