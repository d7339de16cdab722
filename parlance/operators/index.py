"""The stored full-text index: a token dictionary in front of postings in buckets.

Every token belongs to the bucket of its first two characters, so all tokens that begin with
a term stand in one bucket and a search reads the dictionary and postings of its terms'
buckets only (partition filters of the scans). The dictionary has a row per token and
segment with the number of its passages; postings have counts, the passage's length and the
token's positions, so phrases are answered from the index alone. Files are sorted by token; a
bucket has a file of every task that counted passages.

An index is a ``Library`` of three tables: changed passages write a segment of their own, and
readers merge the segments (see there).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.sources.library import Library, Snapshot
from parlance.sources.storage import fresh_path, stored

#: At 100 TB this should be some thousands; files of a bucket grow with the session's shuffle partitions meanwhile.
BUCKETS, HEAD = 32, 2
#: Between the positions of two fields; passages that are counted at a time.
GAP, PASSAGES = 1 << 26, 200


def bucket_of(text: Column) -> Column:
    """The bucket of a token, or of the tokens that begin with a term of two characters or more."""
    return F.pmod(F.xxhash64(F.left(text, F.lit(HEAD))), F.lit(BUCKETS)).cast("int")


def schemas(path: str = "long", chunk: str = "long", prefix: str = "") -> dict[str, str]:
    """The tables of an index; ``prefix`` tells those of several indexes in one library apart."""
    return {
        f"{prefix}postings": f"token string, path {path}, chunk {chunk}, tf double, uses long, len long, positions array<int>, bucket int",
        f"{prefix}lengths": f"path {path}, chunk {chunk}, len long",
        f"{prefix}dictionary": "token string, df long, bucket int",
    }


def _dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df")).select("token", "df", "bucket").repartition("bucket").sortWithinPartitions("bucket", "token")


def _merged_postings(rows: DataFrame, fields: list[tuple[str, float]]) -> DataFrame:
    """Postings of passages that stand in several rows each: words meet by a shuffle."""
    rows = rows.select("path", "chunk", F.posexplode(F.array(*[F.struct(F.lit(float(w)).alias("w"), C.tokens(F.col(f)).alias("t")) for f, w in fields])).alias("field", "f"))
    rows = rows.select("path", "chunk", F.col("f.w").alias("w"), (F.col("field") * GAP).alias("gap"), F.posexplode("f.t").alias("at", "token"))
    counts = rows.groupBy("path", "chunk", "token").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).alias("uses"), F.array_sort(F.collect_list((F.col("gap") + F.col("at")).cast("int"))).alias("positions"))
    return counts.select("token", "path", "chunk", "tf", "uses", F.sum("uses").over(W.partitionBy("path", "chunk")).alias("len"), "positions")


def _counted(weights: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of passages (path, chunk, a list of tokens per field) to their postings, in order of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, PASSAGES):
                batch = whole.slice(begin, PASSAGES)
                lists = [batch.column(2 + i) for i in range(len(weights))]
                sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
                words = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks()
                if not len(words):
                    continue
                coded = pc.dictionary_encode(words)
                coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
                row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
                at = np.concatenate([i * GAP + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for i, n in enumerate(sizes)])
                weight = np.repeat(weights, [n.sum() for n in sizes])
                rank = np.empty(len(coded.dictionary), dtype=np.int64)
                rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
                key = rank[coded.indices.to_numpy()] * batch.num_rows + row
                order = np.argsort(key, kind="stable")  # fields come in order, so positions of a key stay ascending
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                first, uses = order[starts], np.diff(starts, append=len(order))
                of = pa.array(row[first])
                columns = [
                    coded.dictionary.take(coded.indices.take(pa.array(first))),
                    batch.column(0).take(of),
                    batch.column(1).take(of),
                    pa.array(np.add.reduceat(weight[order], starts)),
                    pa.array(uses),
                    pa.array(sum(sizes)[row[first]]),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["token", "path", "chunk", "tf", "uses", "len", "positions"])

    return count


def postings(passages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """token, path, chunk, tf, uses, len, positions. ``weights``: text fields whose tokens count so much; else all tokens of ``text`` count one.

    The passages are dealt out once, by path and chunk; each is counted where it is then, some hundred at a time, so no
    task holds more at any size. Only passages in several rows (found by their keys alone) are put together by a shuffle of words. Positions run
    through the fields, with a gap between two fields so that no phrase spans them.
    """
    fields = list((weights or {"text": 1.0}).items())
    repeated = stored(passages.groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("path").alias("_path"), F.col("chunk").alias("_chunk")), "repeated")
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("chunk").eqNullSafe(F.col("_chunk"))
    kinds = [f"{c} {passages.schema[c].dataType.simpleString()}" for c in ("path", "chunk")]
    schema = f"token string, {kinds[0]}, {kinds[1]}, tf double, uses long, len long, positions array<int>"
    once = passages.select("path", "chunk", *[f for f, _ in fields]).join(repeated, same, "left_anti").repartition("path", "chunk")
    once = once.select("path", "chunk", *[C.tokens(F.col(f)).alias(f"t{i}") for i, (f, _) in enumerate(fields)]).mapInArrow(_counted([float(w) for _, w in fields]), schema)
    if not repeated.limit(1).count():
        return once
    return once.unionByName(_merged_postings(passages.join(repeated, same, "left_semi"), fields))


class Index:
    """Searchable passages (path, chunk, text fields) in a folder. ``weights``: the text fields, with what a token in each counts."""

    def __init__(self, spark: SparkSession, root: str, path: str = "long", chunk: str = "long", weights: dict[str, float] | None = None, library: Library | None = None, prefix: str = ""):
        self.spark, self.root, self.weights, self.prefix = spark, root, weights, prefix
        self.kinds = {"path": path, "chunk": chunk}
        self.library = library or Library(spark, root, schemas(path, chunk, prefix), path, **self.layout(prefix))
        self.refresh()

    @staticmethod
    def layout(prefix: str = "") -> dict[str, dict]:
        """How a library keeps the tables."""
        return {"partitioned": {f"{prefix}postings": "bucket", f"{prefix}dictionary": "bucket"}, "derived": {f"{prefix}dictionary": (f"{prefix}postings", _dictionary)}}

    def refresh(self) -> "Index":
        """Reads the newest manifest. Until then the index stays as it was."""
        self.snapshot: Snapshot = self.library.current()
        self._stats: DataFrame | None = None
        self._counts: Row | None = None
        return self

    def tables(self, passages: DataFrame) -> dict[str, DataFrame]:
        """What the index has to hold of passages."""
        rows = passages.select(*[F.col(c).cast(t).alias(c) for c, t in self.kinds.items()], *(self.weights or {"text": 1.0}))
        # Postings are not shuffled: each task has passages dealt to it and writes a file of its own to every bucket.
        laid = postings(rows, self.weights).withColumn("bucket", bucket_of(F.col("token"))).sortWithinPartitions("bucket", "token")
        size = sum((F.size(C.tokens(F.col(f))) for f in self.weights or ("text",)), F.lit(0)).cast("long")
        return {f"{self.prefix}postings": laid, f"{self.prefix}lengths": rows.select("path", "chunk", size.alias("len"))}

    def apply(self, passages: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """Replaces the passages of the paths that ``passages`` bring and drops those of ``removed``: writes a segment of what is new."""
        done = self.library.apply(self.tables(passages), removed, batch)
        self.refresh()
        return done

    def merge(self) -> None:
        """One segment of all that is live."""
        self.library.merge()
        self.refresh()

    def buckets_of(self, terms: DataFrame) -> list[int] | None:
        """The buckets of terms (term), at most ``BUCKETS`` numbers; None (all) if a term is shorter than a bucket's head."""
        got = terms.agg(F.collect_set(bucket_of(F.col("term"))).alias("b"), F.min(F.length("term")).alias("n")).first()
        return sorted(got["b"]) if got["n"] is None or got["n"] >= HEAD else None

    def _of(self, table: str, buckets: list[int] | None) -> DataFrame:
        rows = self.library.read(self.prefix + table, self.snapshot)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def dictionary(self, buckets: list[int] | None = None) -> DataFrame:
        """token, df of some buckets. Counts are of passages as they were written, dead ones too: good for choosing, not for scores."""
        return self._of("dictionary", buckets).groupBy("token").agg(F.sum("df").alias("df"))

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        return self._of("postings", buckets)

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs, mean_len of the live passages; counted once per snapshot."""
        if self._stats is None:
            rows = self.library.read(f"{self.prefix}lengths", self.snapshot).agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("len") / F.count(F.lit(1))).alias("mean_len"))
            self._stats = stored(rows, "search-stats")
        return self._stats

    @property
    def counts(self) -> Row:
        """The same row, read once."""
        if self._counts is None:
            self._counts = self.stats.first()
        return self._counts


def build_index(passages: DataFrame, weights: dict[str, float] | None = None) -> Index:
    """An index of its own for passages (path, chunk, text fields), in the shared folder."""
    kind = lambda c: passages.schema[c].dataType.simpleString()
    index = Index(passages.sparkSession, fresh_path(passages.sparkSession, "search-index"), kind("path"), kind("chunk"), weights)
    index.apply(passages)
    return index


class PublishedCorpus:
    """Calls, their passages, topics and commitments and the indexes of passages and topics, published together.

    calls: path, mtime, title; chunks: path, chunk, text; topics: path, title, summary, tags, participants (texts);
    commitments: path, owner, text, status.
    """

    def __init__(self, spark: SparkSession, root: str, topic_weights: dict[str, float], path: str = "long"):
        self.tables = {
            "calls": f"path {path}, mtime double, title string",
            "chunks": f"path {path}, chunk long, text string",
            "topics": f"path {path}, title string, summary string, tags string, participants string",
            "commitments": f"path {path}, owner string, text string, status string",
        }
        both = [Index.layout(p) for p in ("spoken_", "topical_")]
        layout = {k: both[0][k] | both[1][k] for k in both[0]}
        self.library = Library(spark, root, self.tables | schemas(path, "long", "spoken_") | schemas(path, "long", "topical_"), path, **layout)
        self.spoken = Index(spark, root, path, "long", None, self.library, "spoken_")
        self.topical = Index(spark, root, path, "long", topic_weights, self.library, "topical_")

    def apply(self, calls: DataFrame, chunks: DataFrame, topics: DataFrame, commitments: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """Replaces all that belongs to the paths of ``calls`` and drops ``removed``, in one manifest. False: the batch was applied before."""
        if batch is not None and batch <= self.library.current().batch:
            return False
        rows = {"calls": calls, "chunks": chunks, "topics": topics, "commitments": commitments}
        indexed = lambda there: self.spoken.tables(there("chunks")) | self.topical.tables(there("topics").withColumn("chunk", F.lit(0)))
        done = self.library.apply(rows, removed, batch, indexed)
        self.spoken.refresh()
        self.topical.refresh()
        return done

    def read(self, table: str) -> DataFrame:
        return self.library.read(table)

    def merge(self) -> None:
        self.library.merge()
        self.spoken.refresh()
        self.topical.refresh()
