"""Archives: the contract, the same bytes for the same rows, and damage that is found."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import warc
from parlance.sources.storage import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, shard long, kind int"


def some_pages(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    same = ["short", "", "x" * 100, "y" * 99, "ä" * 60, "<p>hot page</p>" * 30, "z" * 200_000]
    rows = [(i, f"http://h{i % 7}.example/{i}", rng.choice([*same, None, same[5], f"<p>{rng.random()}</p>" * 20]), "d", 1, 2) for i in range(300)]
    rows += [rows[5], rows[5], rows[17], (None, "http://none/", same[2], None, None, None), (None, None, same[5], None, None, None), (40, "http://two ids/\r\nX: y", same[5], None, None, None), (None, "u", "only here" * 20, None, None, None), (None, "u", "only here" * 20, None, None, None)]
    rng.shuffle(rows)
    return rows


def contract(rows: list[tuple]) -> list[tuple]:
    out, first = [], {}
    for page_id, url, html in sorted((r[:3] for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        out.append((page_id, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page_id)
    return out


def names(root: str) -> dict[str, bytes]:
    return {n: open(f"{root}/{n}", "rb").read() for n in os.listdir(root) if n.endswith(".gz")}


def test_records_are_the_contract_and_runs_agree(spark):
    rows = some_pages(1)
    roots = []
    for parts in (1, 7):
        root = fresh_path(spark, "warc-test")
        warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(parts), root, file_bytes=3000, shard_bytes=20_000)
        roots.append(root)
        got = [tuple(r) for r in warc.resolved(warc.read_archive(spark, root)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(map(str, got)) == sorted(map(str, contract(rows)))
        rows = rows[::-1]
    files = names(roots[0])
    assert files == names(roots[1]) and len(files) > 10
    assert not os.path.exists(f"{roots[0]}/_temporary")
    listed = {r["name"]: r for r in warc.manifest(spark, roots[0]).collect()}
    assert set(listed) == set(files) and sum(r["records"] for r in listed.values()) == len(rows)
    assert all(r["bytes"] == len(files[n]) and (r["bytes"] <= 3000 or r["records"] == 1 or "z" * 1000 in gzip.decompress(files[n]).decode()) for n, r in listed.items())
    assert len({n.split("-")[1] for n in files}) > 3 and any(not n.endswith("0000.warc.gz") for n in files)


def test_records_are_plain_warc(spark):
    root = fresh_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(1, "http://a/ b", "é" * 60, "", 0, 0), (2, None, "é" * 60, "", 0, 0)], SCHEMA), root)
    (data,) = names(root).values()
    text = gzip.decompress(data).decode()
    assert [x.split("\r\n")[0] for x in text.split("WARC/1.1\r\n")[1:]] == ["WARC-Type: warcinfo", "WARC-Type: response", "WARC-Type: revisit"]
    assert "WARC-Target-URI: http://a/%20b\r\n" in text and text.count("é" * 60) == 1
    rows = {r["page_id"]: r for r in warc.read_archive(spark, root).collect()}
    assert bytes(rows[1]["payload"]).decode() == "é" * 60 and rows[2]["refers_to_id"] == rows[1]["record_id"] and rows[2]["payload"] is None
    # Each record can be read by its offset alone.
    assert gzip.decompress(data[rows[2]["offset"] :]).startswith(b"WARC/1.1\r\nWARC-Type: revisit")


def test_damage_is_found_and_leftovers_are_not_read(spark):
    root = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame(some_pages(2), SCHEMA)
    warc.write_archive(pages, root, file_bytes=4000)
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, root)
    n = warc.read_archive(spark, root).count()
    with open(f"{root}/pages-999999-0000.warc.gz", "wb") as f:
        f.write(b"left by a lost attempt")
    assert warc.read_archive(spark, root).count() == n
    name = sorted(names(root))[0]
    data = bytearray(names(root)[name])
    data[len(data) // 2] ^= 1
    with open(f"{root}/{name}", "wb") as f:
        f.write(data)
    with pytest.raises(Exception):
        warc.read_archive(spark, root).collect()


def test_a_move_can_be_repeated(spark):
    """A task that died after it had renamed its files is run again."""
    root = fresh_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(some_pages(3), SCHEMA), root, file_bytes=4000)
    written = warc.manifest(spark, root).withColumn("temporary", F.concat(F.lit("gone-"), "name"))
    written = spark.createDataFrame(written.collect(), written.schema)
    os.rename(f"{root}/manifest", f"{root}/manifest-before")
    warc._commit(spark, written, root)
    assert warc.manifest(spark, root).count() == written.count()


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc_shards(spark, str(tmp_path)).count() == 0
