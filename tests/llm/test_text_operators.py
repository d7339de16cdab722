"""Tokens, id files, packing, FLAC: exact round trips and edge rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import TEXTS, crc, edge_docs, library_ids
from pyspark.sql import functions as F

from parlance.llm import flac, id_files, packing
from parlance.llm._tokens import BatchTokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_librarys():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "'", "1", "²", ".", ",", "!!", "\x1c", "　", "中", "😀", "word", "<|endoftext|>", "\r\n", "\x00", "\x01", "ﬁ", "__", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + [t for t in TEXTS if t]
    bpe = BatchTokenizer(VOCABULARY)
    ids, sizes = bpe.encode(texts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library_ids(t).tolist(), repr(t)


def test_rank_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 30, n) >> rng.integers(0, 30, n)).astype(np.uint32)
        control, data = id_files.pack(ranks)
        assert len(control) == -(-n // 4) and id_files.unpack(control, data, n).tolist() == ranks.tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_id_files(spark, tmp_path, empty):
    docs = edge_docs(spark, empty)
    id_files.write_id_files(docs, VOCABULARY, f"{tmp_path}/f", parts=3)
    got = id_files.read_id_files(spark, f"{tmp_path}/f").collect()
    want = Counter((r["doc_id"], library_ids(r["text"]).tobytes()) for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


def test_an_id_of_all_rows_is_split(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"word {i % 7}") for i in range(400)], "doc_id long, text string").repartition(4)
    id_files.write_id_files(docs, VOCABULARY, f"{tmp_path}/hot", parts=8)
    sizes = [r["n_ids"] for r in spark.read.parquet(f"{tmp_path}/hot/blocks").collect()]
    assert len(sizes) >= 6 and sum(sizes) == sum(len(library_ids(f"word {i % 7}")) for i in range(400)) and max(sizes) < sum(sizes) // 3
    rows = sorted(id_files.read_id_files(spark, f"{tmp_path}/hot").collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


def test_id_files_query_on_a_table(spark, sf):
    rows = {r["doc_id"]: r for r in id_files.op10_token_id_files(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for d in docs:
        ids = library_ids(d["text"])
        assert (rows[d["doc_id"]]["start"], rows[d["doc_id"]]["n_tokens"], rows[d["doc_id"]]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, empty):
    docs = edge_docs(spark, empty).drop("ids").withColumn("tag", F.col("lang"))
    rows = packing.pack_documents(docs, VOCABULARY, keep=("tag",)).collect()
    texts = docs.collect()
    total = Counter()
    for r in texts:
        total.update(zip([r["doc_id"]] * 10**6, library_ids(r["text"]).tolist()))
    got = Counter()
    windows = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        got.update(zip([r["doc_id"]] * len(ids), ids.tolist()))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == total
    for pieces in windows.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 1024 and (end == 1024 or end & (end - 1) == 0)


def test_packing_joins_neighbours():
    """A seed's window is filled with the document that shares its rare words, not with the next one."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 500, 300) for _ in range(30)]
    docs[20] = np.concatenate((docs[0][:250], docs[20][:50]))
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=500)
    packer = packing.Packer(1024)
    packer.add(list(range(30)), docs, np.log1p((30 - df + 0.5) / (df + 0.5)), 300.0)
    packer.close()
    assert packer.pieces[0][0] == 0 and packer.pieces[1][0] == 20
    assert sum(p[2] for p in packer.pieces) == 9000


def test_flac_round_trips():
    rng = random.Random(6)
    payloads = [b"", b"a", bytes(1152), bytes(range(256)) * 9, b"z" * 1151 + b"\0", b"\0\xff" * 700, bytes(rng.randrange(256) for _ in range(3000)), b"the quick brown fox " * 200]
    for p, blocks in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert b"".join(b.tobytes() for b in blocks) == p


def test_flac_without_a_seek_table():
    streams = flac.encode([b"hello world, hello flac " * 150, b"x" * 10])
    bare = []
    for s in streams:
        info = bytearray(s[4:42])
        info[0] |= 128  # STREAMINFO is the last block now
        size = int.from_bytes(s[43:46], "big")
        bare.append(b"fLaC" + bytes(info) + s[46 + size :])
    assert [b"".join(b.tobytes() for b in x) for x in flac.decode(bare)] == [b"hello world, hello flac " * 150, b"x" * 10]


def test_flac_other_subframes():
    """A verbatim subframe and fixed order 3 and 4, with partitioned and escaped residuals, built bit by bit."""

    def stream(samples, subframe):
        n = len(samples)
        head = bytes([0xFF, 0xF8, 7 << 4, 2, 0]) + (n - 1).to_bytes(2, "big")
        head += bytes([int(flac._crc8(np.frombuffer(head, np.uint8)[None], np.array([len(head)]))[0])])
        bits = subframe + "0" * (-len(subframe) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
        raw = bytes((s + 256) % 256 for s in samples)
        info = n.to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
        return b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame

    eight = lambda s: "".join(f"{x & 255:08b}" for x in s)

    def rice(values, k):
        out = ""
        for v in values:
            u = v * 2 if v >= 0 else -v * 2 - 1
            out += "0" * (u >> k) + "1" + (f"{u & ((1 << k) - 1):0{k}b}" if k else "")
        return out

    samples = [3, -7, 20, 50, -100, 90, 2, 1, 0, -128, 127, 5, 6, 7, 8, 9]
    made = {"verbatim": "0" + "000001" + "0" + eight(samples)}
    for order in (3, 4):
        d = samples
        for _ in range(order):
            d = np.diff(d).tolist()
        made[f"fixed{order}"] = "0" + f"{8 + order:06b}" + "0" + eight(samples[:order]) + "00" + "0000" + "0101" + rice(d, 5)
        half = 8 - order
        made[f"parts{order}"] = "0" + f"{8 + order:06b}" + "0" + eight(samples[:order]) + "01" + "0001" + "00100" + rice(d[:half], 4) + "11111" + f"{13:05b}" + "".join(f"{x & 8191:013b}" for x in d[half:])
    for name, bits in made.items():
        (blocks,) = flac.decode([stream(samples, bits)])
        assert (np.concatenate(blocks).astype(int) - 128).tolist() == samples, name


def test_flac_checksums():
    s = flac.encode([b"some payload of text " * 100])[0]
    start = s.index(b"\xff\xf8")
    for k in range(start, len(s), 31):
        broken = bytearray(s)
        broken[k] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


@pytest.mark.parametrize("empty", [False, True])
def test_flac_query(spark, empty):
    docs = edge_docs(spark, empty)
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    media = flac.encode_media(docs.select("doc_id", "text", n, flac.padded_payload(F.col("text")).alias("payload")))
    rows = flac.media_features(media).collect()
    assert len(rows) == docs.count()
    seen = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert seen.setdefault(payload, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    blocks = flac.pcm_blocks(media.select("doc_id", "media").where("doc_id = 8"), "doc_id").orderBy("block").collect() if not empty else []
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip() == (TEXTS[8].encode().rstrip() if not empty else b"")
    assert all(b["first_sample"] == b["block"] * flac.BLOCK for b in blocks)


def test_flac_query_stores_its_streams(spark, tmp_path):
    import glob
    import hashlib

    spark.createDataFrame([(1, "hello flac " * 40), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/parlance-media-*"))
    got = {r["doc_id"]: r for r in flac.op9_flac_media(spark, str(tmp_path)).collect()}
    (written,) = set(glob.glob(f"{folder}/parlance-media-*")) - before
    media = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(written).collect()}
    assert set(media) == {1, 2}
    assert all(hashlib.sha256(media[i]).hexdigest() in got[i].asDict().values() for i in media)


def test_packed_pieces_are_the_librarys_ids(spark, sf):
    rows = packing.op2_retrieval_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    known = {i: library_ids(x) for i, x in texts.items()}
    at, windows = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = known[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in known.items()}
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and (ends[-1] == 1024 or ends[-1] & (ends[-1] - 1) == 0)


def test_packing_neighbours_are_in_bm25_order():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 60, int(rng.integers(5, 80))) for _ in range(25)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    idf, mean = np.log1p((25 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, idf, mean)
    index.unused[[3, 7]] = False
    terms = index.query(3, 6)
    held = sorted({t for t in docs[3].tolist() if df[t] > 1}, key=lambda t: -idf[t])
    assert len(terms) == 6 and min(idf[terms]) >= idf[held[5]] - 1e-12

    def score(d):
        return sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms)

    want = sorted((i for i in range(25) if i not in (3, 7) and score(docs[i]) > 0), key=lambda i: (-round(score(docs[i]), 9), i))
    assert index.neighbours(terms, 25).tolist() == want


def test_packing_refuses_columns_it_makes(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(edge_docs(spark), VOCABULARY, keep=("ids",))


def test_texts_longer_than_a_piece(spark):
    long = " ".join(f"word{i % 997}, and{i % 7}" for i in range(330_000))  # over 4 MB
    assert len(long) > id_files.BATCH_BYTES
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_ids"] for r in id_files.stage_ids(docs, VOCABULARY).select("doc_id", "n_ids").collect()}
    assert rows == {1: len(library_ids("short")), 2: len(library_ids(long)), 3: 1}


def test_encoding_holds_little_per_word():
    """A use of a word costs its place among the batch's distinct words and its ids, not two runs of 64-bit numbers."""
    import tracemalloc

    import public_tokenizers

    from parlance.llm._tokens import BatchTokenizer

    bpe = BatchTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two, three " * 1000 + "end"] * 100 + ["", None]
    bpe.encode(texts)
    tracemalloc.start()
    ids, sizes = bpe.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * 300_000 and sizes.sum() == len(ids) and sizes.tolist()[-2:] == [1, 1]
