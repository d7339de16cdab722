"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words (lower-cased, hashed to ``CELLS`` cells; the value is the
square root of the count, scaled to length one per text), statistics of its
structure (shares of capitals, marks, digits, repeated words and lines, word and
line lengths, ...) and the table's character count, each statistic as the
cell of its bin. The score is sigmoid(w0 + sum w_i x_i + pairs), where the pairs'
sum over i < j of <v_i, v_j> x_i x_j is taken in linear time as half of
|sum v_i x_i|^2 - sum |v_i|^2 x_i^2.

The machine is fitted by AdaGrad on a bounded sample (``PER_CLASS`` labelled rows
of each class, features only, on the driver) and goes to all tasks; its size is
fixed. Scoring is one pass, vectorised over batches, without a shuffle. Labels,
language, source and id are no inputs.

Nulls and edge cases: a null or empty text has no words and the statistics of an
empty text, and gets a score as well; a null character count has a bin of its own; without
labels of both classes the score is the base rate; repeated rows score alike; an
empty table gives no rows; extra columns are kept by ``score_quality``
unless it makes a column of that name.
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
from parlance.llm._labels import labelled
from parlance.llm._tokens import release
from parlance.llm.id_files import pieces
from parlance.llm.langid import held_out

#: Labelled rows of each class that the machine is fitted on, at most.
PER_CLASS = 4000
CELLS = 1 << 16
BINS = 16
FACTORS = 8
THRESHOLD = 0.3
#: Texts are turned into features about so many bytes at once.
PIECE_BYTES = 1 << 20
STATISTICS = ("chars", "words", "word_length", "line_length", "capitals", "digits", "marks", "bars", "stops", "other_bytes", "distinct_words", "top_word", "distinct_lines", "metadata")


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, cells: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One logit per row of a sparse matrix (rows: where each row starts, one more at the end; no row is empty)."""
        at = rows[:-1]
        out = self.bias + np.add.reduceat(self.linear[cells] * values, at)
        for f in range(self.factors.shape[1]):
            v = self.factors[cells, f] * values
            out += 0.5 * (np.add.reduceat(v, at) ** 2 - np.add.reduceat(v * v, at))
        return out


def _share(top: np.ndarray, of: np.ndarray) -> np.ndarray:
    return top / np.maximum(of, 1)


def featurise(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, values and row starts of a batch."""
    data, starts = B.utf8(texts)
    n = len(starts) - 1
    size = np.diff(starts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[starts])

    lowered = B.lower(data)
    first, last, count = B.words(lowered, starts)
    cells = (B.prints(lowered, first, last) >> np.uint64(48)).astype(np.int64)
    doc = np.repeat(np.arange(n), count)
    keys, uses = np.unique(doc * CELLS + cells, return_counts=True)
    doc, cells = keys // CELLS, keys % CELLS
    value = np.sqrt(uses)
    norm = np.sqrt(np.bincount(doc, uses, n))
    value = value / np.maximum(norm[doc], 1e-9)
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, uses)
    # Lines, by the fingerprints of what stands between line ends
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate((starts[:-1][size > 0], breaks[breaks + 1 < len(data)] + 1)))
    tails = np.concatenate((heads[1:], [len(data)]))
    line_doc = np.searchsorted(starts, heads, side="right") - 1
    line_keys = B.prints(data, heads, np.maximum(tails, heads)) if len(heads) else np.empty(0, np.uint64)
    lines = np.bincount(line_doc, minlength=n)
    unique_lines = np.bincount(np.unique(np.stack((line_doc.astype(np.uint64), line_keys)), axis=1)[0].astype(np.int64), minlength=n)
    mark = (data > 32) & (data < 127) & ~((data >= 48) & (data <= 57)) & ~(((data | 32) >= 97) & ((data | 32) <= 122))
    known = np.array([-1 if x is None else x for x in n_chars.to_pylist()], np.float64)
    stats = {
        "chars": np.log2(size + 1) * 0.75,
        "words": np.log2(count + 1) * 0.9,
        "word_length": _share(per_text(data > 32), count),
        "line_length": np.log2(_share(size, lines) + 1),
        "capitals": 15 * _share(per_text((data >= 65) & (data <= 90)), size) ** 0.5,
        "digits": 15 * _share(per_text((data >= 48) & (data <= 57)), size) ** 0.5,
        "marks": 15 * _share(per_text(mark), size) ** 0.5,
        "bars": 15 * _share(per_text(np.isin(data, np.frombuffer(b"|#*%&$", np.uint8))), size) ** 0.5,
        "stops": 15 * _share(per_text(np.isin(data, np.frombuffer(b".,", np.uint8))), size) ** 0.5,
        "other_bytes": 15 * _share(per_text(data > 127), size) ** 0.5,
        "distinct_words": 15 * _share(distinct, count),
        "top_word": 15 * _share(top, count) ** 0.5,
        "distinct_lines": 15 * _share(unique_lines, lines),
        "metadata": np.where(known < 0, 15, np.log2(np.maximum(known, 0) + 1) * 0.75),
    }
    bins = np.stack([CELLS + i * BINS + np.clip(stats[s], 0, BINS - 1).astype(np.int64) for i, s in enumerate(STATISTICS)], axis=1)
    # Each row: its statistics, then its words
    rows = np.concatenate(([0], np.cumsum(distinct + len(STATISTICS))))
    out_cells, out_values = np.empty(rows[-1], np.int64), np.empty(rows[-1])
    at = rows[:-1, None] + np.arange(len(STATISTICS))
    out_cells[at], out_values[at] = bins, 1 / np.sqrt(len(STATISTICS))
    place = np.arange(len(doc)) + (doc + 1) * len(STATISTICS)
    out_cells[place], out_values[place] = cells, value
    return out_cells, out_values, rows


def fit(cells: np.ndarray, values: np.ndarray, rows: np.ndarray, y: np.ndarray, steps: int = 1500, epochs: int = 12, batch: int = 128, rate: float = 0.2, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss: so many epochs, and more of them on small samples, up to about so many steps."""
    epochs = max(epochs, min(100, steps * batch // max(1, len(y))))
    rng = np.random.default_rng(seed)
    size = CELLS + len(STATISTICS) * BINS
    mean = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not len(y) or y.min() == y.max():
        return Machine(m.bias, m.linear, np.zeros_like(m.factors))
    g_bias, g_linear, g_factors = 1e-2, np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    length = np.diff(rows)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for some in np.split(order, range(batch, len(y), batch)):
            n = length[some]
            at = np.arange(int(n.sum())) + np.repeat(rows[some] - (np.cumsum(n) - n), n)
            c, x, own = cells[at], values[at], np.repeat(np.arange(len(some)), n)
            starts = np.concatenate(([0], np.cumsum(n)))
            p = 1 / (1 + np.exp(-np.clip(m.logits(c, x, starts), -30, 30)))
            g = (p - y[some])[own] * x / len(some)
            used, slot = np.unique(c, return_inverse=True)
            step = np.bincount(slot, g) + decay * m.linear[used]
            g_linear[used] += step * step
            fresh = []
            for f in range(FACTORS):
                v = m.factors[c, f]
                total = np.add.reduceat(v * x, starts[:-1])[own]
                fresh.append(np.bincount(slot, g * (total - v * x)) + decay * m.factors[used, f])
            m.linear[used] -= rate * step / np.sqrt(g_linear[used])
            for f, d in enumerate(fresh):
                g_factors[used, f] += d * d
                m.factors[used, f] -= rate * d / np.sqrt(g_factors[used, f])
            d = float((p - y[some]).mean())
            g_bias += d * d
            m.bias -= rate * d / g_bias**0.5
    return m


def fit_quality(sample: DataFrame) -> Machine:
    """Fits on a bounded sample (doc_id, text, n_chars, label), one row per id; its sparse features come to the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (x for b in batches for x in pieces(b, limit=PIECE_BYTES)):
            cells, values, rows = featurise(batch.column("text"), batch.column("n_chars"))
            cells, values = cells.astype("<i4").tobytes(), values.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([cells[4 * a : 4 * b] for a, b in zip(rows, rows[1:])], pa.binary()), pa.array([values[4 * a : 4 * b] for a, b in zip(rows, rows[1:])], pa.binary())], ["doc_id", "label", "cells", "values"])

    got = sample.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "label").mapInArrow(features, "doc_id long, label int, cells binary, values binary")
    parts = sorted((r["doc_id"], r["label"], bytes(r["cells"]), bytes(r["values"])) for r in got.toLocalIterator())
    cells = np.frombuffer(b"".join(p[2] for p in parts), "<i4").astype(np.int64)
    values = np.frombuffer(b"".join(p[3] for p in parts), "<f4").astype(np.float64)
    rows = np.concatenate(([0], np.cumsum([len(p[2]) // 4 for p in parts]))).astype(np.int64)
    return fit(cells, values, rows, np.array([p[1] for p in parts], float))


def score_quality(df: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars", score: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 to every row."""
    names = [c for c in df.columns if c != score]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (x for b in batches for x in pieces(b, text, PIECE_BYTES)):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            cells, values, rows = featurise(get(text), get(n_chars))
            z = shared.value.logits(cells, values, rows)
            yield pa.RecordBatch.from_arrays([*[get(c) for c in names], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*names, score])

    return df.select(*names).mapInArrow(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine for a documents table and its labels."""
    return fit_quality(labelled(docs.select("doc_id", "text", "n_chars"), labels, "quality", PER_CLASS))


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
