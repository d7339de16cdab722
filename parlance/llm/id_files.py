"""Token ids in a binary file format: frequency ranks, byte-aligned, with separate control bytes.

Format of one block (all numbers little-endian):

* ``control``: two bits a rank, four ranks a byte, low bits first; a code c
  says that the rank takes c + 1 bytes. The last byte is filled up with zeros.
* ``data``: the ranks' bytes one after the other.
* ``n_ids``: ranks in the block; ``doc_ids``, ``lengths``: its documents in order.

Rank 0 is the most frequent id (ties: the smaller id). The rank table is part of
the file set (folder ``ranks``), so the blocks can be read without the vocabulary.
The usual ids take one byte, all others of a 50k vocabulary two. A control
byte gives the places of its four ranks by one lookup in a table of 256 rows.

The blocks are rows of a Parquet table, in ascending ``doc_id`` order over
``part`` and ``block``, written by Spark: a lost executor's blocks are written
again and never half seen. A document is never split over blocks; a block is
closed at ``BLOCK_IDS`` ids.

Steps: (1) texts are encoded once and staged, and each task counts its ids; (2)
counts give ranks (one row per id of the vocabulary, so its size bounds the
broadcast); (3) staged rows are dealt by ranges of doc_id, sorted, and written
as blocks; (4) starts are sums over parts, then blocks, then documents: no
global window over documents.

Nulls and edge cases: a null text is an empty one and gives only the end id; a
null doc_id sorts first; repeated ids and rows are kept, next to each other, and may be
spread over several parts; an empty table gives an empty file set. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm._storage import shared_dir, write
from parlance.llm._tokens import END_ID, tokenizer

#: A block is closed when it has at least this many ids.
BLOCK_IDS = 1 << 18
#: Rows that a task encodes at once are cut so that they hold about this many bytes.
BATCH_BYTES = 4 << 20
#: A part (one task's ids) should hold about this many ids; there are as many parts as shuffle partitions at least.
PART_IDS = 1 << 22

STAGED = "doc_id long, n_ids long, ids binary"
BLOCKS = "part int, block int, n_ids long, doc_ids binary, doc_nulls binary, lengths binary, control binary, data binary"

_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
_PLACES = np.cumsum(_SIZES, axis=1) - _SIZES
_TOTALS = _SIZES.sum(axis=1)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each piece hold about ``limit`` bytes (one text at least)."""
    sizes = batch.column(column).cast(pa.binary())
    sizes = np.asarray([len(x) if (x := v.as_buffer()) is not None else 0 for v in sizes], np.int64)
    group = np.cumsum(sizes) // limit
    for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        if len(cut):
            yield batch.slice(cut[0], len(cut))


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def stage_ids(docs: DataFrame, vocabulary: str, end: int = END_ID) -> DataFrame:
    """doc_id, n_ids and ids (unsigned 16-bit, or 32-bit for vocabularies over 65,536) of every document, with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        for batch in (x for b in batches for x in pieces(b)):
            ids, sizes = bpe.encode(batch.column("text"), end)
            raw, at = ids.astype(kind).tobytes(), np.concatenate(([0], np.cumsum(sizes))) * kind().itemsize
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), _binary([raw[a:b] for a, b in zip(at, at[1:])])], ["doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, STAGED)


def as_ids(raw: bytes | memoryview, n: int) -> np.ndarray:
    """Staged ids of one row."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def count_ids(staged: DataFrame) -> DataFrame:
    """token, n: uses of each id over all documents. Each task sends one row per id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column("n_ids").to_pylist(), batch.column("ids")):
                ids = as_ids(raw.as_buffer(), n)
                got = np.bincount(ids)
                if len(got) > len(total):
                    total = np.concatenate((total, np.zeros(len(got) - len(total), np.int64)))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    counted = staged.select("n_ids", "ids").mapInArrow(count, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def rank_table(rows: pd.DataFrame) -> np.ndarray:
    """Ids by falling frequency, of counts (token, n): one row per id of the vocabulary."""
    order = np.lexsort((rows["token"].to_numpy(), -rows["n"].to_numpy()))
    return rows["token"].to_numpy(np.int64)[order]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks under 2^32."""
    ranks = np.ascontiguousarray(ranks, np.uint32)
    need = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = need - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < need[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of a block: a table gives each control byte's four places, the rest is array lookups."""
    codes = np.frombuffer(control, np.uint8)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)))
    totals = _TOTALS[codes]
    at = (np.cumsum(totals) - totals)[:, None] + _PLACES[codes]
    at, sizes = at.ravel()[:n], _SIZES[codes].ravel()[:n]
    out = raw[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_id_files(docs: DataFrame, vocabulary: str, path: str, parts: int | None = None, end: int = END_ID) -> None:
    """Writes the documents' ids below ``path``: ``blocks``, ``parts`` and ``ranks``."""
    spark = docs.sparkSession
    staged = spark.read.schema(STAGED).parquet(write(stage_ids(docs, vocabulary, end), "staged-ids"))
    counts = count_ids(staged).toPandas()
    by_rank = rank_table(counts)
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(by_rank)], "rank int, token int").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    rank_of = spark.sparkContext.broadcast(ranks)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts["n"].sum()) // PART_IDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([rank_of.value[x] for _, _, x in held])
            control, data = pack(ids)
            doc_ids = np.array([d or 0 for d, _, _ in held], "<i8")
            nulls = np.array([d is None for d, _, _ in held], np.uint8)
            lengths = np.array([n for _, n, _ in held], "<i8")
            row = [part, block, len(ids), doc_ids.tobytes(), nulls.tobytes(), lengths.tobytes(), control, data]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5))], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for d, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_ids").to_pylist(), batch.column("ids")):
                held.append((d, n, as_ids(raw.as_buffer(), n)))
                size += n
                if size >= BLOCK_IDS:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    # An id that many rows have (null, say) is split by the rows' places.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = staged.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document in the files."""
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["token"].to_numpy(np.uint32)
    by_rank = spark.sparkContext.broadcast(table)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("part", "block", "n_ids").select("part", "block", inner.alias("block_start"))
    starts = starts.join(F.broadcast(before), "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank.value[unpack(row["control"], row["data"], row["n_ids"])]
                lengths = np.frombuffer(row["lengths"], "<i8")
                upto = np.cumsum(lengths)
                doc_ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
                raw = ids.astype("<u4").tobytes()
                at = np.concatenate(([0], upto)) * 4
                for a in range(0, len(lengths), 256):
                    b = min(a + 256, len(lengths))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:b], mask=nulls[a:b]), pa.array(row["start"] + upto[a:b] - lengths[a:b]), pa.array(lengths[a:b]), _binary([raw[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1])])],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.join(starts, ["part", "block"]).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def crc32_column(name: str = "ids") -> F.Column:
    """Unsigned crc32 of a binary column."""
    return F.crc32(F.col(name))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the files."""
    import uuid

    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/parlance-id-files-{uuid.uuid4().hex}"
    write_id_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_id_files(spark, path).select("doc_id", "start", "n_tokens", crc32_column().alias("ids_crc32"))
