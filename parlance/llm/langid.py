"""Language ID by multilingual mixture inference.

A model is learned from labelled texts: for each language the counts of byte
n-grams of words (orders 1 to 3, hashed to a fixed number of cells, add-alpha
smoothed). A document is a mixture of languages: each of its words is drawn
from one language with the document's proportions, and a word's likelihood is the
product of its n-grams'. Expectation-maximisation finds the proportions. The
set of languages is chosen by penalised likelihood: starting from the best single
language, the language that raises the mixture's log-likelihood most is
added as long as the gain exceeds ``PENALTY`` per language (times the logarithm of
the word count). The answer is the language of the largest proportion.

Counting runs over all labelled texts: each task adds up its texts and sends at
most one row per language and used cell; the sums per language have a fixed
number of cells, so the model that goes to the tasks is bounded by languages times
cells (the number of languages is checked, ``MAX_LANGUAGES``).

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0;
a null language is never learned; without any learned language all texts are
``und``; ties go to the language first in code point order; repeated rows are
answered alike; an empty table gives no rows; extra columns are ignored by
the query and kept by ``tag_languages`` unless it makes a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import _bytes as B
from parlance.llm._tokens import release
from parlance.llm.id_files import pieces

#: Cells of the n-gram table; word-bounded n-grams of 1 to 3 bytes are hashed to them.
CELLS = 1 << 16
MAX_LANGUAGES = 512
SMOOTHING = 0.5
PENALTY = 3.0
MAX_STEPS = 30
#: Texts are cut into n-grams about so many bytes at once.
PIECE_BYTES = 1 << 20
#: Words of a document that are longer count by their first so many bytes per n-gram weight only.
_EDGE = np.uint8(0x20)


def _grams(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the 2- and 3-grams of each word with a space on both sides; and how many each word has."""
    size = last - first
    n = size + 1  # 2-grams of " word "; each also closes one 3-gram but the first
    start = np.cumsum(n) - n
    total = int(n.sum())
    at = np.arange(total) - np.repeat(start, n) + np.repeat(first, n)  # the byte behind the gram's middle
    padded = np.concatenate((data, [_EDGE])).astype(np.uint32)
    inside_left = at > np.repeat(first, n)
    inside_right = at < np.repeat(last, n)
    b1 = np.where(inside_left, padded[at - 1], _EDGE)
    b2 = np.where(inside_right, padded[np.minimum(at, len(data))], _EDGE)
    deep = at > np.repeat(first, n) + 1
    b0 = np.where(deep, padded[at - 2], np.where(inside_left, _EDGE, 0))
    key = (b0 << 16) | (b1 << 8) | b2
    key = key * np.uint32(0x9E3779B1)
    return (key >> np.uint32(16)).astype(np.int64), n


def _letters(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes without ASCII digits and marks; words and the words of each text."""
    lowered = [None if x is None else x.lower() for x in texts.to_pylist()]
    data, starts = B.utf8(pa.array(lowered, pa.large_string()))
    data = _PLAIN[data]
    first, last, count = B.words(data, starts)
    return data, first, last, count


_PLAIN = np.arange(256, dtype=np.uint8)
for _i in range(128):
    if not chr(_i).isalpha():
        _PLAIN[_i] = 32


@dataclass
class LanguageModel:
    """languages, and for each cell the log-likelihood under each language."""

    languages: list[str]
    table: np.ndarray


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, cell, n over all rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, np.ndarray] = {}
        for batch in (x for b in batches for x in pieces(b, limit=PIECE_BYTES)):
            langs = batch.column("lang").to_pylist()
            data, first, last, count = _prepared(batch.column("text"))
            cells, n = _grams(data, first, last)
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            of = np.repeat(np.repeat(code, count), n)
            got = np.bincount(of * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
            for i, name in enumerate(names):
                sums[name] = sums[name] + got[i] if name in sums else got[i]
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "cell", "n"])

    counted = texts.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, cell long, n long")
    return counted.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit_languages(texts: DataFrame) -> LanguageModel:
    """Learns from rows (text, lang)."""
    known = texts.where("text is not null and lang is not null").select("lang").distinct()
    languages = sorted(r["lang"] for r in known.limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages, which the model is bounded to")

    def fold(rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        total[np.asarray(rows.column("cell"))] = np.asarray(rows.column("n"))
        return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    table = np.zeros((CELLS, len(languages)))
    # At most CELLS rows per language meet; one row per language comes to the driver.
    for r in count_grams(texts).groupBy("lang").applyInArrow(fold, "lang string, counts binary").toLocalIterator():
        table[:, languages.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    used = max(1, int((table.sum(axis=1) > 0).sum()))
    table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * used))
    return LanguageModel(languages, table.astype(np.float32))


def _mixture(like: np.ndarray, base: float, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages and the log-likelihood, by expectation-maximisation."""
    part = like[:, chosen]
    share = np.full(len(chosen), 1 / len(chosen))
    if len(chosen) == 1:
        return share, base + float(np.log(part[:, 0]).sum())
    before = -np.inf
    for _ in range(MAX_STEPS):
        joint = part * share
        total = joint.sum(axis=1)
        now = float(np.log(total).sum())
        share = (joint / total[:, None]).mean(axis=0)
        if now - before < 1e-3 * max(1.0, abs(now) * 1e-3):
            break
        before = now
    return share, base + now


def infer(loglike: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of all languages in a document, from its words' log-likelihoods (a row per word)."""
    n, k = loglike.shape
    top = loglike.max(axis=1)
    like = np.maximum(np.exp(loglike - top[:, None]), 1e-30)
    base = float(top.sum())
    single = base + np.log(like).sum(axis=0)
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    cost = penalty * np.log(n + 1.0)
    while len(chosen) < k:
        # No mixture of languages beats each word's best one: an upper bound on any gain.
        if base - best <= cost:
            break
        tried = [(_mixture(like, base, [*chosen, j]), j) for j in range(k) if j not in chosen]
        (new_share, value), j = max(tried, key=lambda x: (x[0][1], -x[1]))
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, j], new_share, value
    out = np.zeros(k)
    out[chosen] = share
    return out


def tag_languages(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Adds lang_pred, score (its proportion) and mixture (language and proportion pairs, as text) to every row."""
    made = ("lang_pred", "score", "mixture")
    names = [c for c in docs.columns if c not in made]
    schema = T.StructType([*[docs.schema[c] for c in names], *T.StructType.fromDDL("lang_pred string, score double, mixture string").fields])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        languages, table = shared.value.languages, shared.value.table
        for batch in (x for b in batches for x in pieces(b, text, PIECE_BYTES)):
            texts = batch.column(batch.schema.get_field_index(text))
            data, first, last, count = _prepared(texts)
            cells, n = _grams(data, first, last)
            if len(cells) and languages:
                words = np.add.reduceat(table[cells], np.cumsum(n) - n, axis=0).astype(np.float64)
            else:
                words = np.zeros((len(first), len(languages)))
            cuts = np.concatenate(([0], np.cumsum(count)))
            lang, score, mixture = [], [], []
            for i, x in enumerate(texts.to_pylist()):
                if not languages or not _letters(x):
                    lang.append("und"), score.append(0.0), mixture.append("")
                    continue
                own = words[cuts[i] : cuts[i + 1]]
                share = infer(own, penalty) if len(own) else np.full(len(languages), 1 / len(languages))
                best = int(np.argmax(share))
                lang.append(languages[best]), score.append(min(1.0, float(share[best])))
                mixture.append(",".join(f"{languages[j]}:{share[j]:.3f}" for j in np.argsort(-share, kind="stable") if share[j] > 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(lang), pa.array(score), pa.array(mixture)], [*names, "lang_pred", "score", "mixture"])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True for the rows that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang"))
    tagged = tag_languages(docs.select("doc_id", "text"), model)
    return tagged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
