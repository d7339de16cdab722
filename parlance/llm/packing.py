"""Lexical retrieval packing: windows of tokens filled with a document's BM25 neighbours.

Documents are encoded once and staged. Counts of documents per token (over all
documents) give the weights. Documents are dealt by ranges of a lexical signature
(two min-hashes of their token ids, then a hash of the id, so that copies of one text
can be split), which brings similar ones together; inside a partition, runs of
about ``SHARD_IDS`` ids are shards, each with an inverted index of BM25 weights.

A window starts with a seed, the document cut last or else the next unused one. Its
rarest terms (``QUERY_TERMS``) ask the index for unused neighbours; they fill the
window greedily, best first (ties: dealt order), and without a neighbour the next
unused document does. The last document is cut where the window is full and its rest is the
next seed, so windows have no padding. What is left at the end of a partition is cut
into windows of powers of two, which need none either.

The shuffle carries each document's ids once; nothing but counts per vocabulary id
reaches the driver. Each partition holds one shard at a time.

Nulls and edge cases: a null or empty text is the end id alone; a null doc_id is
packed as well; repeated rows are packed each; long documents span many windows;
an empty table gives no rows; extra columns are ignored by the query
and kept by ``pack_documents(keep=...)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm._storage import stored
from parlance.llm._tokens import END_ID, tokenizer
from parlance.llm.id_files import as_ids, pieces

WINDOW = 1024
#: Ids in a shard of the index, about.
SHARD_IDS = 1 << 20
QUERY_TERMS = 12
K1, B = 1.2, 0.75
_MIX = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def stage(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = (), end: int = END_ID) -> DataFrame:
    """doc_id, keep..., n_ids, ids, signature of every document (doc_id, text, keep...)."""
    names = ("doc_id", *keep)
    schema = T.StructType([*[docs.schema[c] for c in names], *T.StructType.fromDDL("n_ids long, ids binary, signature long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        hashes = [(np.arange(bpe.size, dtype=np.uint32) + np.uint32(1)) * m for m in _MIX]
        for batch in (x for b in batches for x in pieces(b)):
            ids, sizes = bpe.encode(batch.column(batch.schema.get_field_index("text")), end)
            at = np.cumsum(sizes) - sizes
            first, second = (np.minimum.reduceat(h[ids], at).astype(np.int64) for h in hashes)
            raw, cuts = ids.astype(kind).tobytes(), np.append(at, len(ids)) * kind().itemsize
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sizes), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array((first << 31) ^ (second >> 1))], schema.fieldNames())

    return docs.select(*names, "text").mapInArrow(run, schema)


def count_documents(staged: DataFrame) -> DataFrame:
    """token, n: documents that hold each id; one row per id and task is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column("n_ids").to_pylist(), batch.column("ids")):
                ids = as_ids(raw.as_buffer(), n)
                if int(ids.max(initial=0)) >= len(total):
                    total = np.concatenate((total, np.zeros(int(ids.max()) + 1, np.int64)))
                total[ids] += 1  # an id that stands several times in one index counts once
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    return staged.select("n_ids", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Index:
    """BM25 postings of a shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), size)
        keys = np.sort(doc * len(idf) + np.concatenate(ids))
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(np.append(new, len(keys)))
        doc, term = np.divmod(keys[new], len(idf))
        self.rows = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.terms, self.idf = term, idf
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        order = np.argsort(term.astype(np.uint32), kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(ids), bool)

    def query(self, doc: int, most: int = QUERY_TERMS) -> np.ndarray:
        """The rarest terms of a document that others of the shard have as well."""
        own = self.terms[self.rows[doc] : self.rows[doc + 1]]
        own = own[self.post[own + 1] - self.post[own] > 1]
        if len(own) > most:
            own = own[np.argpartition(-self.idf[own], most)[:most]]
        return own

    def neighbours(self, terms: np.ndarray, most: int) -> np.ndarray:
        """Unused documents by falling score."""
        spans = [(int(self.post[t]), int(self.post[t + 1])) for t in terms]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.post_doc[a:b] for a, b in spans]), np.concatenate([self.post_weight[a:b] for a, b in spans]), len(self.unused))
        score[~self.unused] = 0
        if len(score) > most:
            top = np.sort(np.argpartition(-score, most)[:most])
        else:
            top = np.arange(len(score))
        top = top[score[top] > 0]
        return top[np.argsort(-score[top], kind="stable")]


class Packer:
    """Fills windows shard by shard; ``pieces`` are (document, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.sequence, self.fill = window, 0, 0
        self.open: list[tuple] = []
        self.pieces: list[tuple] = []

    def _put(self, doc, start: int, length: int) -> int:
        """As much of a document as fits; returns where it was cut."""
        n = min(length - start, self.window - self.fill)
        self.open.append((doc, start, n, self.sequence, self.fill))
        self.fill += n
        if self.fill == self.window:
            self.pieces += self.open
            self.open, self.fill, self.sequence = [], 0, self.sequence + 1
        return start + n

    def add(self, docs: list, ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        """Packs a shard whole; the last window may stay open for the next shard."""
        index, length = Index(ids, idf, mean), [len(x) for x in ids]
        following, queue, terms = 0, [], None
        while True:
            if self.fill == 0 or terms is None:  # a new window: its seed is the next unused document
                while following < len(docs) and not index.unused[following]:
                    following += 1
                if following == len(docs):
                    return
                take, queue, terms = following, [], index.query(following)
            else:
                if not queue and terms is not None and len(terms):
                    queue = index.neighbours(terms, 8)[::-1].tolist()
                    if not queue:
                        terms = terms[:0]
                if queue:
                    take = queue.pop()
                else:
                    while following < len(docs) and not index.unused[following]:
                        following += 1
                    if following == len(docs):
                        return
                    take = following
                    terms = index.query(take)
            index.unused[take] = False
            at = 0
            while at < length[take]:
                full = self.sequence
                at = self._put(docs[take], at, length[take])
                if self.sequence != full and at < length[take]:  # cut: the rest seeds the next window
                    queue, terms = [], index.query(take)

    def close(self) -> None:
        """Cuts what is open into windows of powers of two."""
        left, at, self.open, pending = self.fill, 0, [], self.open
        self.fill = 0
        sizes = [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if left >> b & 1]
        room = sizes.pop(0) if sizes else 0
        for doc, start, n, _, _ in pending:
            while n:
                part = min(n, room - at)
                self.pieces.append((doc, start, part, self.sequence, at))
                start, n, at = start + part, n - part, at + part
                if at == room:
                    self.sequence, at = self.sequence + 1, 0
                    room = sizes.pop(0) if sizes else 0


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, keep: tuple[str, ...] = (), end: int = END_ID) -> DataFrame:
    """keep..., doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit) of every piece. Columns of these names, or of the staged ones, can't be kept."""
    if clash := {"doc_id", "text", "n_ids", "signature", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"} & set(keep):
        raise ValueError(f"columns that packing makes itself: {sorted(clash)}")
    spark = docs.sparkSession
    staged = stored(stage(docs, vocabulary, keep, end), "pack-staged")
    totals = staged.agg(F.count(F.lit(1)).alias("n"), F.sum("n_ids").alias("ids")).first()
    n, all_ids = totals["n"] or 0, totals["ids"] or 0
    counts = count_documents(staged).toPandas()  # one row per id of the vocabulary
    df = np.zeros(max(1 << 16, int(counts["token"].max() or 0) + 1) if len(counts) else 1 << 16)
    df[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy()
    model = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), all_ids / max(n, 1)))
    names = ["doc_id", *keep]
    schema = T.StructType([*[staged.schema[c] for c in names], *T.StructType.fromDDL("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        idf, mean = model.value
        packer = Packer(window)
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            made, packer.pieces = packer.pieces, []
            for at in range(0, len(made), 2000):
                some = made[at : at + 2000]
                rows = [p[0] for p in some]
                cols = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(kinds)]
                numbers = [[p[1] for p in some], [p[2] for p in some], [len(r[1]) for r in rows], [base + p[3] for p in some], [p[4] for p in some]]
                ids = [p[0][1][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int64()) for x in numbers], pa.array(ids, pa.binary())], schema.fieldNames())

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for i, (k, raw) in enumerate(zip(batch.column(batch.schema.get_field_index("n_ids")).to_pylist(), batch.column(batch.schema.get_field_index("ids")))):
                held.append((tuple(c[i] for c in columns), as_ids(raw.as_buffer(), k)))
                size += k
                if size >= SHARD_IDS:
                    packer.add(held, [h[1] for h in held], idf, mean)
                    held, size = [], 0
                    yield from out()
        if held:
            packer.add(held, [h[1] for h in held], idf, mean)
        packer.close()
        yield from out()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(all_ids // (8 * SHARD_IDS)))
    spread = F.xxhash64("doc_id", "n_ids")
    dealt = staged.repartitionByRange(parts, F.col("signature"), spread).sortWithinPartitions("signature", spread)
    return dealt.mapInArrow(run, schema)


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
