"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts.

Folding: lower case, letters of other scripts and full-width forms that look like
Latin ones become these, and digits and signs that stand for letters become
the letters. The lexicon is learned from labelled texts: words and beginnings of
words whose uses in toxic texts exceed those in others, by the
likelihood-ratio test; a term's weight is its log-odds. A hit must start at
a word's start, a whole-word term must also end at its end, and a hit inside an
exception phrase does not count. The weights of a text are summed and
normalised by its length; a logistic curve over the sum and the
normalised sum gives the score.

The labelled sample is bounded (``PER_CLASS`` rows of each class), and so is the
lexicon (``MAX_TERMS``), which goes to all tasks. Scoring is one pass without a shuffle.

Nulls and edge cases: a null or empty text has the score of a text without hits;
without labels of both classes the lexicon is empty and all scores are the
base rate; repeated rows score alike; an empty table gives no rows; extra columns are kept
by ``score_toxicity`` unless it makes a column of that name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm._labels import labelled
from parlance.llm.id_files import pieces
from parlance.llm.langid import held_out

#: Labelled rows of each class that the lexicon is learned from, at most.
PER_CLASS = 8000
MAX_TERMS = 20_000
SHORTEST, LONGEST = 4, 12
MIN_TEXTS, MIN_RATIO, MIN_ODDS = 4, 25.0, 3.0
THRESHOLD = 0.5

# Look-alikes of Latin letters, and digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ѡ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum")

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None})
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """A text as the lexicon sees it."""
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """terms: (text, whole word) -> weight; curve: of the score."""

    terms: dict[tuple[str, bool], float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.0)
    _made: object = field(default=None, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_made": None}

    def _automaton(self):
        import ahocorasick

        if self._made is None:
            self._made = ahocorasick.Automaton()
            for text in dict.fromkeys([t for t, _ in self.terms] + [fold(x) for x in self.exceptions]):
                self._made.add_word(text, text)
            self._made.make_automaton()
        return self._made

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Weight of all hits, their number, and the words of a text."""
        if not text or not self.terms:
            return 0.0, 0, len(text.split()) if text else 0
        folded, spans, hits = fold(text), [], {}
        phrases = {fold(x) for x in self.exceptions}
        for end, term in self._automaton().iter(folded):
            start = end - len(term) + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
            if term in phrases and closed:
                spans.append((start, end))
            weight = self.terms.get((term, False), 0.0)
            if closed:
                weight = max(weight, self.terms.get((term, True), 0.0))
            if weight:
                hits[start] = max(weight, hits.get(start, 0.0))  # one hit per word
        kept = [w for s, w in hits.items() if not any(a <= s <= b for a, b in spans)]
        return math.fsum(kept), len(kept), len(text.split())

    def score(self, weight: float, words: int) -> float:
        z = sum(a * b for a, b in zip(self.curve, signals(weight, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def signals(weight: float, words: int) -> tuple[float, float, float]:
    """What the curve sees: one, the sum, and the sum per hundred words (both damped)."""
    return 1.0, math.log1p(weight), math.log1p(100 * weight / (words + 1))


def count_terms(sample: DataFrame) -> DataFrame:
    """term, whole, pos, neg: texts of either label that use a word, and (added up over words) its beginnings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                by_label[label].update(set(_WORD.findall(fold(text or ""))))
        words = list(by_label[0] | by_label[1])
        yield pa.RecordBatch.from_pydict({"word": words, "pos": [by_label[1][w] for w in words], "neg": [by_label[0][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    words = sample.select("text", "label").mapInArrow(count, "word string, pos long, neg long")
    words = words.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    heads = F.when(F.length("word") >= SHORTEST, F.transform(sizes, lambda n: F.struct(F.substring(F.col("word"), F.lit(1), n).alias("term"), F.lit(False).alias("whole"))))
    terms = F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole"))), F.coalesce(heads, F.array()))
    exploded = words.select(F.explode(terms).alias("t"), "pos", "neg").select("t.*", "pos", "neg")
    return exploded.groupBy("term", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= MIN_TEXTS)


def fit_lexicon(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns terms and weights, then the curve, from rows (text, label)."""
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n, m = totals.get(1, 0), totals.get(0, 0)
    if not n or not m:
        rate = (n + 0.5) / (n + m + 1)
        return Lexicon({}, exceptions, (math.log(rate / (1 - rate)), 0.0, 0.0))
    odds = F.log((F.col("pos") + 0.5) / (n + 1)) - F.log((F.col("neg") + 0.5) / (m + 1))

    def part(seen: F.Column, share: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / ((F.col("pos") + F.col("neg")) * share))).otherwise(0.0)

    ratio = 2 * (part(F.col("pos"), n / (n + m)) + part(F.col("neg"), m / (n + m)))
    rows = count_terms(sample).select("term", "whole", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "term", "whole").limit(MAX_TERMS).collect()
    terms: dict[tuple[str, bool], float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["whole"], r["term"])):
        heads = [(r["term"][:k], False) for k in range(SHORTEST, len(r["term"]) + 1)]
        if not any(terms.get(h, -1.0) >= r["odds"] - 1.0 for h in heads):  # a shorter beginning says as much
            terms[(r["term"], r["whole"])] = float(r["odds"])
    lexicon = Lexicon(terms, exceptions)
    rows = weigh_texts(sample.select("text", "label"), lexicon).select("label", "weight", "words").toPandas()
    x = np.array([signals(w, k) for w, k in zip(rows["weight"], rows["words"], strict=True)])
    lexicon.curve = tuple(_logistic(x, rows["label"].to_numpy(float)).tolist())
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weigh_texts(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds weight, hits, words and score to every row."""
    made = ("weight", "hits", "words", "score")
    names = [c for c in df.columns if c not in made and c != text]
    schema = T.StructType([*[df.schema[c] for c in names], *T.StructType.fromDDL("weight double, hits long, words long, score double").fields])
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (x for b in batches for x in pieces(b, text)):
            got = [own.weigh(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], *[pa.array([g[i] for g in got], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))], pa.array([own.score(w, k) for w, _, k in got], pa.float64())], [*names, *made])

    return df.select(*names, text).mapInArrow(run, schema)


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = fit_lexicon(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", PER_CLASS))
    scored = weigh_texts(docs, lexicon)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
