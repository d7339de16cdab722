"""WARC archives: written deterministically in shards, committed by a manifest, read back.

Writing: (1) sizes and SHA-256 digests of the payloads are taken where the pages are; (2)
the narrow keys (id, url, digest) are range-sorted, and sums over parts say how many bytes
stand before each, so shard k begins at the first key with k * ``shard_bytes`` before it:
the bounds follow from the rows alone, not from samples or the number of tasks; (3) of
records with one digest the first in order is the response, marks tell the others, hot
digests included, by a join of narrow rows; (4) pages and marks are dealt to their shards
in one shuffle, sorted there and written as a stream: one gzip member per record, headers
and digests made anew, a new file whenever the next member would pass ``file_bytes``. The
same rows give the same bytes in the same files.

Commit: a task writes under a temporary name of its own attempt, and Spark's committed
rows say which attempts count. Those files are then renamed to their final names (a step that can
be repeated), and last of all the manifest is renamed into place. Readers see the files
that the manifest names, or none; leftovers of lost attempts go with the temporary folder.

Files are opened with pyarrow's file systems (local, S3, GCS, HDFS), by the URI of the folder.

Records: ``response`` (HTTP header and payload) or ``revisit`` of the identical-payload-digest
profile (HTTP header only). Payloads under ``LEAST`` bytes are always responses.

Nulls and edge cases: a null html is an empty payload; a null url leaves out the target; null
ids come last, so they are responses only where no row with an id has the payload; control characters and
spaces of urls are percent-coded; rows equal in id, url and payload stand next to each
other in one shard, the first as response; an empty table gives a manifest without files.
Extra columns are left out. A payload must fit into a task's memory; a shard need not.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._order import placed
from parlance.llm._storage import shared_dir, stored, table

#: Payloads of fewer bytes are written again rather than referred to.
LEAST = 100
#: Files are closed at this many compressed bytes at least, and at so much more that a corpus gives ``MOST_FILES`` or so; a shard has four times the bytes before compression.
FILE_BYTES, MOST_FILES, SHARD_FILES = 2 << 20, 100_000, 4
#: Keys of a sorted part, about.
PART_KEYS = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "shard long, number int, temporary string, name string, bytes long, sha256 string, records long"
RECORDS = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_id string, file string, offset long, payload binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_CHUNK = 1 << 20


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def file_system(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """A name that follows from what is recorded."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}\n{copy}')}>"


def target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, named: str, headers: list[tuple[str, str | int | None]], block: bytes, content: str) -> bytes:
    """One record, with its date, length and block digest."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", named), ("WARC-Date", DATE)]
    last = [("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"), ("Content-Type", content), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*first, *headers, *last] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int = 0, refers_to: str | None = None) -> bytes:
    """The response of a page, or the revisit of the record that it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", None if url is None else target(url)), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    named, content = record_id(page_id, url, digest, copy), "application/http; msgtype=response"
    if refers_to is None:
        return record("response", named, headers, http + payload, content)
    return record("revisit", named, [*headers, ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)], http, content)


def member(data: bytes) -> bytes:
    """A gzip member; its header holds no time."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


class _Files:
    """The files of one shard after the other, under temporary names."""

    def __init__(self, root: str, file_bytes: int):
        self.fs, self.folder = file_system(root)
        self.folder, self.file_bytes, self.attempt = f"{self.folder.rstrip('/')}/_temporary", file_bytes, uuid.uuid4().hex
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.number, self.out = -1, 0, None

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            yield self.shard, self.number, self.temporary, self.name, self.size, self.hash.hexdigest(), self.records
        self.out = None

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        """Writes a member; gives the files that it closes."""
        if shard != self.shard:
            yield from self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.size + len(data) > self.file_bytes and self.records:
            yield from self.close()
            self.number += 1
        if self.out is None:
            self.name = f"pages-{shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.attempt}-{self.name}"
            self.out, self.size, self.hash, self.records = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), 0, sha256(), 0
            info = f"software: parlance\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\n".encode()
            self._write(member(record("warcinfo", record_id(None, self.name, ""), [("WARC-Filename", self.name)], info, "application/warc-fields")))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)


def _key(page_id: int | None, url: str | None, digest: str) -> tuple:
    """A key as the sorted shards have it."""
    return page_id is None, page_id or 0, url is not None, (url or "").encode(), digest


def _order() -> list[Column]:
    return [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("digest")]


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), "payload")


def write_archive(pages: DataFrame, root: str, file_bytes: int | None = None, shard_bytes: int | None = None) -> None:
    """Writes the pages (page_id, url, html) below the folder ``root``, which has no archive yet."""
    spark, rows = pages.sparkSession, _pages(pages)
    fs, folder = file_system(root)
    fs.create_dir(folder, recursive=True)
    if any(f.type for f in fs.get_file_info([f"{folder}/manifest"])):
        raise FileExistsError(f"{root} has an archive")
    keys = stored(rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("bytes")), "warc-keys")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    file_bytes = file_bytes or max(FILE_BYTES, total // MOST_FILES)
    shard_bytes = shard_bytes or SHARD_FILES * file_bytes
    keys = stored(placed(keys, _order(), PART_KEYS, "bytes"), "warc-places")
    first = keys.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min_by(F.struct("page_id", "url", "digest"), "place").alias("key"))
    bounds = [_key(*r["key"]) for r in first.orderBy("shard").collect()]  # one row per shard

    @F.pandas_udf("long")
    def shard_of(page_id: pd.Series, url: pd.Series, digest: pd.Series) -> pd.Series:
        ids = [None if pd.isna(p) else int(p) for p in page_id]
        return pd.Series([max(0, bisect_right(bounds, _key(p, u, d)) - 1) for p, u, d in zip(ids, url, digest)], dtype="int64")

    same = keys.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("page_id", "url"), "place").alias("response")).where("n > 1")
    marks = keys.where(F.col("bytes") >= LEAST).select("page_id", "url", "digest").join(same, "digest")
    marks = marks.where(~(F.col("page_id").eqNullSafe(F.col("response.page_id")) & F.col("url").eqNullSafe(F.col("response.url")))).select("page_id", "url", "digest", "response").distinct()
    shard = shard_of(F.col("page_id").cast("string"), "url", "digest").alias("shard")
    marks = marks.select(shard, F.lit(0).alias("kind"), "page_id", "url", "digest", F.lit(None).cast("binary").alias("payload"), F.col("response.page_id").alias("of_page"), F.col("response.url").alias("of_url"))
    dealt = rows.select(shard, F.lit(1).alias("kind"), "page_id", "url", "digest", "payload", F.lit(None).cast("long").alias("of_page"), F.lit(None).cast("string").alias("of_url")).unionByName(marks)
    dealt = dealt.repartitionById(max(1, len(bounds)), F.col("shard").cast("int")).sortWithinPartitions("shard", *_order(), "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, copy, mark = _Files(root, file_bytes), None, 0, None
        for batch in batches:
            closed: list[tuple] = []
            columns = [batch.column(c) for c in ("shard", "kind", "page_id", "url", "digest", "payload", "of_page", "of_url")]
            for i in range(batch.num_rows):
                at, kind, page_id, url, digest, payload, of_page, of_url = (c[i].as_py() for c in columns)
                if (page_id, url, digest) != now:
                    now, copy, mark = (page_id, url, digest), 0, None
                if kind == 0:
                    mark = record_id(of_page, of_url, digest)
                    continue
                refers = mark or (record_id(page_id, url, digest) if copy and len(payload) >= LEAST else None)
                closed += files.add(at, member(page_record(page_id, url, payload, digest, copy, refers)))
                copy += 1
            yield _batch(closed, WRITTEN)
        yield _batch(list(files.close()), WRITTEN)

    _commit(spark, stored(dealt.mapInArrow(write, WRITTEN), "warc-written"), root)


def _commit(spark: SparkSession, written: DataFrame, root: str) -> None:
    """Renames the files of the rows to their final names, then publishes the manifest."""
    from pyarrow import fs as pafs

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        for batch in batches:
            for temporary, name, size in zip(*[batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")]):
                there, ready = fs.get_file_info([f"{folder}/_temporary/{temporary}", f"{folder}/{name}"])
                if there.type != pafs.FileType.NotFound:
                    fs.move(there.path, ready.path)
                elif ready.size != size:  # an earlier attempt of this task may have renamed it
                    raise FileNotFoundError(there.path)
            yield batch.select(["name", "shard", "number", "bytes", "sha256", "records"])

    fs, folder = file_system(root)
    unnamed = f"manifest-{uuid.uuid4().hex}"
    moved = written.mapInArrow(move, "name string, shard long, number int, bytes long, sha256 string, records long")
    moved.write.parquet(f"{root.rstrip('/')}/{unnamed}")
    fs.move(f"{folder}/{unnamed}", f"{folder}/manifest")
    if fs.get_file_info(f"{folder}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{folder}/_temporary")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """name, shard, number, bytes, sha256, records of an archive's files."""
    return spark.read.parquet(f"{root.rstrip('/')}/manifest")


def members(stream, digest) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream; the bytes read go into ``digest`` too."""
    data, at, total, held = b"", 0, 0, []
    opened = zlib.decompressobj(31)
    while True:
        if not data:
            data = stream.read(_CHUNK)
            digest.update(data)
            total += len(data)
            if not data:
                if held:
                    raise ValueError("the last member is cut")
                return
        held.append(opened.decompress(data))
        data = opened.unused_data
        if opened.eof:
            yield at, b"".join(held)
            held, opened = [], zlib.decompressobj(31)
            at = total - len(data)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block's length and digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{sha256(block).hexdigest()}":
        raise ValueError(f"a damaged record: {fields.get('WARC-Record-ID')}")
    return fields, block


def read_archive(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records (columns of ``RECORDS``) of the files that the manifest names; files and blocks are held against their digests.

    Size and digest are those of the payload that was read; a revisit has none, so its size is null and its digest the claimed one.
    """
    files = manifest(spark, root).select("name", "sha256")
    n = max(1, min(files.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        for name, wanted in ((n, h) for b in batches for n, h in zip(b.column("name").to_pylist(), b.column("sha256").to_pylist())):
            digest, out, size = sha256(), [], 0
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for offset, data in members(stream, digest):
                    fields, block = parse(data)
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload, claimed = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    got = sha256(payload).hexdigest() if kind == "response" else claimed
                    if got != claimed:
                        raise ValueError(f"another payload than that of the digest: {fields['WARC-Record-ID']}")
                    page = fields.get("X-Page-Id")
                    out.append((fields["WARC-Record-ID"], kind, page and int(page), fields.get("WARC-Target-URI"), len(payload) if kind == "response" else None, got, fields.get("WARC-Refers-To"), name, offset, payload if payloads and kind == "response" else None))
                    size += len(data)
                    if size >= 4 * _CHUNK:
                        yield _batch(out, RECORDS)
                        out, size = [], 0
            if digest.hexdigest() != wanted:
                raise ValueError(f"{name} is not the file of the manifest")
            yield _batch(out, RECORDS)

    return files.repartition(n, "name").mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records: a revisit has those of the response that it refers to."""
    plain = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    of = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("digest"))
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to_id").join(of, "refers_to_id", "left")
    same = F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a revisit of nothing: "), F.col("refers_to_id"))))
    return plain.unionByName(again.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to"))


def op11_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from its record in the archives."""
    root = f"{shared_dir(spark)}/parlance-warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), root)
    return resolved(stored(read_archive(spark, root, payloads=False), "warc-records"))


ORACLE = f"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, row_number() over w as n, first_value(page_id) over w as response from d window w as (partition by payload_digest order by page_id nulls last, url nulls first))
select page_id, payload_bytes, payload_digest, case when n > 1 and payload_bytes >= {LEAST} then 'revisit' else 'response' end as record_type, case when n > 1 and payload_bytes >= {LEAST} then response end as refers_to from r"""
