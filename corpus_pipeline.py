"""Corpus pipeline: quality, language, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of the documents table.

Nulls and edge cases: documents with null or repeated ids are documents of their own, told apart
by their text; a null text has no letters, so language ID rejects it; a null source is a source of
its own; rows equal in id and text are one group of near copies; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard, langid, mixing, packing, quality
from parlance.llm._storage import drop, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its main language holds at least this share of its words.
MAIN_LANGUAGE = 0.5


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality machine accepts; it is fitted on the labelled documents of the table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train_quality(docs, labels)
    return quality.score_quality(docs.select(*_columns(docs)), machine, score="_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a known main language."""
    model = langid.fit_languages(docs.where(~F.coalesce(langid.held_out(), F.lit(False))).select("text", "lang"))
    tagged = langid.tag_languages(docs.select(*_columns(docs)), model)
    return tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_LANGUAGE)).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 5-word-shingle Jaccard links of 0.8 or more: the one of the smallest id.

    Ids may be null or repeated: rows are told apart by id and text, and of rows equal in both one stays.
    """
    return jaccard.drop_copies(docs.select(*_columns(docs)), size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to their sources' targets: whole epochs as rows, the last one cut at the budget's word."""
    return mixing.repeat_to_targets(docs.select(*_columns(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens: one row per piece, as in the packing query."""
    import public_tokenizers

    packed = packing.pack_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", filter_quality),
    ("language ID", filter_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL states neither the machine, the mixture model nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None
