"""N-gram Jaccard join with a token-group matrix: all links, as components.

A document is the set of its distinct word shingles (64-bit fingerprints). Two
documents link when their Jaccard similarity reaches a threshold. Steps:

1. Counts of all shingles go to a sketch of a fixed number of cells. It orders the
   shingles, rare cells first, so passages that many documents share come last.
2. Documents with equal sets become one node. A node keeps its signature: the
   first shingles in that order, enough that two linked nodes must have
   some of them in common (``least_shared``), and its min-hash values.
3. Similar nodes form groups: nodes that share a min-hash key look at the first node that
   has it, and join it if enough of all their min-hash values agree. A group beyond
   ``GROUP_SHINGLES`` or ``GROUP_SETS`` is split evenly, with its first node in every part.
4. Each group is compared with itself, exactly, and contracted: what links becomes one class.
5. The token-group matrix has one row per shingle and group, where a group is now a class, or
   what is left of a group: the union of the members' signatures. Shingles that two
   groups share bound the overlap of any of their members; only pairs of groups, still apart, that reach the least
   number any link needs are opened.
6. Opening a pair compares whole sets, exactly, by matrix products; it returns
   a spanning forest of the links, never all pairs.
7. Components are found by contracting the links to each node's smallest neighbour, round by round.

Copies are never expanded into pairs; skewed keys are only summed or joined with
unique rows. Nothing about all documents reaches the driver but counts.

Nulls and edge cases: a text that is null or without words has no shingles and
is a component of its own; fewer words than a shingle make one shingle of all
words; rows that repeat an id or a text are all returned; null ids
are returned with the smallest id of their component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._storage import drop, stored
from parlance.llm._tokens import release
from parlance.llm.id_files import pieces

#: Words in a shingle, and the least similarity in percent, of the query.
WORDS, PERCENT = 4, 85
#: Cells of the count sketch (a byte each goes to every task).
SKETCH_BITS = 23
#: Signature shingles that a linked pair must share: five in a hundred of the set, one to ``SHARED``.
SHARED, SHARED_PERCENT = 8, 5
#: Min-hash values per node; the first ``KEYS`` are keys, and a node joins another's group if ``ALIKE`` values agree.
HASHES, KEYS, ALIKE = 16, 4, 6
#: Shingles and sets in a group, about; a pair of groups is what a task opens at once.
GROUP_SHINGLES, GROUP_SETS = 1 << 18, 1 << 11
ROUNDS = 40
#: Texts are cut into shingles about so many bytes at once.
PIECE_BYTES = 1 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64)) for j in range(HASHES)]
_PAIR = "src long, dst long"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit fingerprints."""
    data, starts = B.utf8(texts)
    data = B.lower(data)
    first, last, count = B.words(data, starts)
    words = B.prints(data, first, last)
    upto = np.concatenate(([0], np.cumsum(count)))
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        rolled = rolled * _M[0] + B.mix(words[k : k + len(rolled)] ^ _SEEDS[k % HASHES])
    rolled = B.mix(rolled)
    out = []
    for a, b in zip(upto, upto[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = B.mix(whole * _M[2] + w)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed number."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sketch(docs: DataFrame, size: int = WORDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each cell of shingles a level: how often it occurs (documents), on a logarithmic scale. Fixed size."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        release()
        total = np.zeros(1 << bits, np.int32)
        for batch in (x for b in batches for x in pieces(b, limit=PIECE_BYTES)):
            np.add.at(total, np.concatenate([np.empty(0, np.uint64), *shingle_sets(batch.column("text"), size)]) >> np.uint64(64 - bits), np.int32(1))
        blocks = total.reshape(-1, min(chunk, len(total)))
        used = np.flatnonzero(blocks.any(axis=1))
        packed = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed.compress(blocks[i].astype("<i4").tobytes()) for i in used], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.clip(np.log2(v + 1) * 4, 0, 255).astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], ["chunk", "levels"])

    parts = docs.select("text").mapInArrow(count, "chunk long, counts binary").repartition("chunk").mapInArrow(add, "chunk long, levels binary")
    levels = np.zeros(1 << bits, np.uint8)
    for r in parts.toLocalIterator():  # at most one row per chunk of the sketch
        got = np.frombuffer(r["levels"], np.uint8)
        levels[r["chunk"] * len(got) : (r["chunk"] + 1) * len(got)] = got
    return levels


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any linked set."""
    return (percent * n + 99) // 100


def least_shared(n: int) -> int:
    """Shingles of the signatures that a set of n must share with any linked set."""
    return min(SHARED, max(1, n * SHARED_PERCENT // 100))


def describe(docs: DataFrame, levels: np.ndarray, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, node (stands for the set; null: no shingles), signature (uint64), keys and hashes of every document, with its mark (a long) if it has one."""
    mark = [c for c in docs.columns if c == "mark"]
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(np.log2(len(levels))))
    names = ["doc_id", "n", "node", "signature", "keys", "hashes", *mark]
    schema = "doc_id long, n long, node long, signature binary, keys array<long>, hashes array<int>" + "".join(f", {c} long" for c in mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (x for b in batches for x in pieces(b, limit=PIECE_BYTES)):
            sets = shingle_sets(batch.column("text"), size)
            n = np.array([len(t) for t in sets], np.int64)
            some = np.flatnonzero(n)
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            at = (np.cumsum(n) - n)[some]
            order = (shared.value[(flat >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (B.mix(flat ^ _M[3]) >> np.uint64(8))
            signatures: list[bytes] = [b""] * len(sets)
            for i, a in zip(some.tolist(), at.tolist()):
                k = int(n[i]) - least_overlap(int(n[i]), percent) + least_shared(int(n[i]))
                signatures[i] = (sets[i][np.argpartition(order[a : a + n[i]], k - 1)[:k]] if k < n[i] else sets[i]).tobytes()
            least = np.zeros((len(sets), HASHES), np.uint64)
            for j, seed in enumerate(_SEEDS if len(some) else []):
                least[some, j] = B.mix(np.minimum.reduceat(flat * (seed | np.uint64(1)), at) ^ seed)
            lists = lambda x, t, k: pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * k + 1, k), pa.int32()), pa.array(x.ravel(), t))
            keys = lists(least[:, :KEYS].copy().view(np.int64), pa.int64(), KEYS)
            hashes = lists((least & np.uint64(0x7FFFFFFF)).astype(np.int32), pa.int32(), HASHES)
            node = pa.array([digest(t) if len(t) else None for t in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), node, pa.array(signatures, pa.binary()), keys, hashes, *[batch.column(c) for c in mark]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *mark).mapInArrow(run, schema)


def make_nodes(described: DataFrame) -> DataFrame:
    """node, doc_id (the smallest), n, keys, hashes: one row per distinct set, without the empty one."""
    # Rows of one node have equal n, keys and hashes.
    some = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("hashes").alias("hashes"))
    return stored(some, "jaccard-nodes")


def splits(sets: str = "sets", total: str = "total") -> F.Column:
    """Parts that so many sets with so many shingles are cut into."""
    return F.greatest(F.ceil(F.col(total) / GROUP_SHINGLES), F.ceil(F.col(sets) / GROUP_SETS), F.lit(1))


def assign_groups(nodes: DataFrame) -> DataFrame:
    """node, grp for the nodes that are in a group with others; the first node of a split group is in each of its parts."""
    keyed = nodes.select("node", F.explode("keys").alias("key"), "hashes")
    firsts = keyed.groupBy("key").agg(F.min(F.struct("node", "hashes")).alias("first"), F.count(F.lit(1)).alias("uses")).where("uses > 1").select("key", "first")
    agree = F.size(F.filter(F.zip_with("hashes", F.col("first.hashes"), lambda x, y: x == y), lambda x: x))
    ups = keyed.join(firsts, "key").where(agree >= ALIKE).groupBy("node").agg(F.min("first.node").alias("up"))
    ups = stored(ups, "jaccard-ups")
    # The first node of a group may have joined an earlier one itself: two hops bring most of them together.
    for _ in range(2):
        ups = ups.join(ups.select(F.col("node").alias("up"), F.col("up").alias("root")), "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    placed = stored(ups.join(nodes.select("node", "n"), "node"), "jaccard-placed")
    sizes = placed.groupBy("up").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("up", splits().alias("parts"))
    number = lambda part: F.xxhash64("up", part)
    dealt = placed.join(sizes, "up").select("node", number(F.pmod(F.xxhash64("node"), "parts")).alias("grp"))
    first = sizes.where("parts > 1").select(F.col("up").alias("node"), "up", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.unionByName(first.select("node", number(F.col("part")).alias("grp"))).distinct()


def group_pairs(described: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b (a < b): units of classes (node, unit, n) that share enough signature shingles for a link between members."""

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends a set once, however many copies it meets
        for batch in batches:
            nodes, rows = batch.column("node").to_pylist(), []
            for i, x in enumerate(nodes):
                if x not in seen:
                    seen.add(x)
                    rows.append(i)
            if not rows:
                continue
            raw = batch.column("signature").take(pa.array(rows)).to_pylist()
            tokens = np.frombuffer(b"".join(raw), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(np.array([nodes[i] for i in rows], np.int64), [len(x) // 8 for x in raw]))], ["token", "node"])

    dealt = described.where("n > 0").select("node", "signature").mapInArrow(matrix, "token long, node long").repartition(F.col("token"))
    several = lambda rows, by: rows.groupBy("token").agg(F.min(by).alias("low"), F.max(by).alias("high")).where("low < high").select("token")
    met = stored(dealt.join(several(dealt, "node"), "token", "left_semi"), "jaccard-met")
    units = stored(met.join(classes.select("node", "unit"), "node").select("token", "unit").distinct(), "jaccard-units")
    # What a link between any two members needs: shingles in common, and sizes not too far apart.
    need = F.least(F.lit(SHARED), F.greatest(F.lit(1), F.floor(F.col("n") * SHARED_PERCENT / 100)))
    limits = classes.groupBy("unit").agg(F.min(need).alias("least"), F.min("n").alias("low"), F.max("n").alias("high"))
    table = stored(units.join(several(units, "unit"), "token", "left_semi").join(limits, "unit"), "jaccard-matrix")
    of = lambda x: table.select("token", F.col("unit").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("least", "low", "high")])
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    bound = of("a").join(of("b"), "token").where((F.col("a") < F.col("b")) & sizes)
    bound = bound.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min(F.least("least_a", "least_b")).alias("least"))
    pairs = stored(bound.where("common >= least").select("a", "b"), "jaccard-bound")
    drop(met, units, table)
    return pairs


def compare(tokens: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs among sets: within the only side, or between sides 0 and 1. Exact, by products of 0/1 matrices."""
    size = np.array([len(t) for t in tokens], np.int64)
    if len(tokens) == 2:  # the usual case: two single documents
        x, y = tokens
        both = len(np.intersect1d(x, y, assume_unique=True))
        hit = 100 * both >= percent * (len(x) + len(y) - both)
        return (np.array([0]), np.array([1])) if hit else (np.empty(0, int), np.empty(0, int))
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), size)
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    often = uses > 1  # a shingle of one set only adds to no overlap
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    both_sides = len(np.unique(side)) > 1
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if both_sides else left
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = np.empty(len(tokens), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    step = max(1, (4 << 20) // max(len(left), len(right)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        c, o = column[lo:hi] - at, owner[lo:hi]
        width = min(step, int(often.sum()) - at)
        x = np.zeros((len(left), width), np.float32)
        mine = side[o] == 0
        x[place[o[mine]], c[mine]] = 1
        if both_sides:
            y = np.zeros((len(right), width), np.float32)
            y[place[o[~mine]], c[~mine]] = 1
        else:
            y = x
        overlap += x @ y.T
    found = []
    for at in range(0, len(left), 256):  # a few rows at a time keeps the whole numbers small
        part = overlap[at : at + 256].astype(np.int64)
        hit = 100 * part >= percent * (size[left[at : at + 256]][:, None] + size[right][None, :] - part)
        if not both_sides:
            hit &= np.arange(at, at + len(part))[:, None] < np.arange(len(right))[None, :]
        found.append(np.argwhere(hit) + (at, 0))
    i, j = np.concatenate(found).T
    return left[i], right[j]


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked node to the smallest node of its part."""
    up = list(range(len(nodes)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            if nodes[a] > nodes[b]:
                a, b = b, a
            up[b] = a
    return [(int(nodes[x]), int(nodes[find(x)])) for x in set(i.tolist()) | set(j.tolist()) if find(x) != x]


FILTER_BITS = 25


def filter_place(doc_id: F.Column) -> F.Column:
    """A document's place in the filter of ids."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << FILTER_BITS))


def id_filter(members: DataFrame) -> np.ndarray:
    """Bits of the ids that members have, a fixed number: documents whose bit is off need not be read further."""
    place = filter_place(F.col("doc_id"))
    words = members.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << FILTER_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.toLocalIterator():  # at most one row per word of the filter
        out[r["word"]] = r["bits"]
    return out


def whole_sets(docs: DataFrame, members: DataFrame, size: int = WORDS) -> DataFrame:
    """node, tokens of the documents that members (node, doc_id) name, and of few others; a set may come more than once."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            place = np.asarray(batch.column("place"))
            some = batch.filter(pa.array((bits.value[place >> 6] >> (place & 63) & 1).astype(bool)))
            for part in pieces(some, limit=PIECE_BYTES):
                tokens = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["node", "tokens"])

    return docs.select(filter_place(F.col("doc_id").cast("long")).alias("place"), "text").mapInArrow(run, "node long, tokens binary")


def verify(opened: DataFrame, percent: int) -> DataFrame:
    """src, dst: spanning links of every task (pair, side, node, tokens): of its sets among each other, or between sides 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # a repeated row gives its set twice

        def close() -> list[tuple[int, int]]:
            rows = list(held.values())
            held.clear()
            if len(rows) < 2:
                return []
            i, j = compare([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[1] for r in rows]), percent)
            return _forest(np.array([r[2] for r in rows]), i, j) if len(i) else []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["src", "dst"])

        now, made = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("pair", "side", "node", "tokens")], strict=True):
                if row[0] != now:
                    made += close()
                    now = row[0]
                held[row[2]] = row
            if len(made) > 10_000:
                yield out(made)
                made = []
        yield out(made + close())

    dealt = opened.select("pair", "side", "node", "tokens").repartition(F.col("pair")).sortWithinPartitions("pair", "side")
    return dealt.mapInArrow(run, _PAIR)


def open_groups(docs: DataFrame, nodes: DataFrame, groups: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """src, dst: spanning links inside each group."""
    members = groups.join(nodes.select("node", "doc_id"), "node").select("node", "doc_id")
    opened = whole_sets(docs, members, size).join(groups, "node").select(F.col("grp").alias("pair"), F.lit(0).alias("side"), "node", "tokens")
    return verify(opened, percent)


def open_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """src, dst: spanning links between the units of each pair (a, b); classes: node, doc_id, n, unit."""
    ends = pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct()
    some = classes.join(ends, "unit", "left_semi")
    parts = some.groupBy("unit").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total")).select("unit", splits().alias("parts"))
    members = stored(some.join(parts, "unit").withColumn("chunk", F.xxhash64("unit", F.pmod(F.xxhash64("node"), "parts"))).select("node", "doc_id", "n", "unit", "chunk"), "jaccard-members")
    chunks = members.groupBy("unit", "chunk").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    of = lambda x: chunks.select(F.col("unit").alias(x), F.struct("sets", "total", "chunk").alias(f"size_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("size_a", "size_b").alias("big"), F.least("size_a", "size_b").alias("small"))
    both = both.select(F.col("big.chunk").alias("big"), F.col("small.chunk").alias("small"), F.col("small.sets").alias("sets"), F.col("small.total").alias("total"))
    # The larger chunk of a pair meets its smaller partners in batches, so it is sent once per batch and not once per pair.
    batches = both.groupBy("big").agg(F.sum("sets").alias("sets"), F.sum("total").alias("total")).select("big", splits().alias("batches"))
    both = both.join(batches, "big").select("big", "small", F.xxhash64("big", F.pmod(F.xxhash64("small"), "batches")).alias("pair"))
    wanted = both.select(F.col("big").alias("chunk"), F.lit(0).alias("side"), "pair").distinct().unionByName(both.select(F.col("small").alias("chunk"), F.lit(1).alias("side"), "pair"))
    opened = whole_sets(docs, members, size).join(members.select("node", "chunk"), "node").join(wanted, "chunk")
    return verify(opened, percent)


def components(edges: DataFrame) -> DataFrame:
    """node, label (one node of its component) for the nodes with links.

    Every node moves to its smallest neighbour's smallest neighbour; then the graph is
    contracted to these, which leaves few links after the first round.
    """
    links = stored(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "jaccard-edges")
    labels = None
    for _ in range(ROUNDS):
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        nearest = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("up")), "jaccard-nearest")
        jump = nearest.select(F.col("node").alias("up"), F.col("up").alias("far"))
        moved = stored(nearest.join(jump, "up").select("node", F.least("up", "far").alias("up")), "jaccard-moved")
        a, b = moved.select(F.col("node").alias("src"), F.col("up").alias("a")), moved.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        left = links.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        left = stored(left, "jaccard-edges")
        drop(links, nearest)
        links = left
        if labels is None:
            labels = stored(moved.select("node", F.col("up").alias("label")), "jaccard-labels")
        else:
            joined = labels.join(moved.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels, old = stored(joined, "jaccard-labels"), labels
            drop(old)
        drop(moved)
        if not links.limit(1).count():
            drop(links)
            return labels
    raise RuntimeError("the components did not settle")


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    return labelled(docs.select("doc_id", "text"), size, percent).select("doc_id", "n_shingles", "component_id")


def text_mark(text: F.Column) -> F.Column:
    """A number that stands for a text, so that rows of one id are told apart."""
    return F.xxhash64(text.cast("string"))


def drop_copies(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns as they are: the one with the smallest id (nulls last; ties: the text's mark).

    Rows are told apart by id and text, of rows equal in both one stays; texts without words are components by
    themselves. Only rows that a bounded filter (``FILTER_BITS``) points out are
    shuffled with their texts: those to drop, and few others.
    """
    rows = labelled(docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark")), size, percent)
    rows = stored(rows.groupBy("label", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies")), "jaccard-ids")
    own = [F.when(F.col("label").isNull(), F.col(c)).alias(f"own_{c}") for c in ("doc_id", "mark")]
    best = rows.groupBy("label", *own).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "copies")).alias("best"))
    kept = stored(best.select("best.doc_id", "best.mark", "best.copies"), "jaccard-kept")
    sure = kept.where("copies = 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    doubt = rows.join(sure, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_anti")
    place = lambda i, m: F.pmod(F.xxhash64(i, m), F.lit(1 << FILTER_BITS))
    bit = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
    words = doubt.select(place("doc_id", "mark").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit("p")).alias("bits"))
    words = stored(words, "jaccard-words")  # at most 2 ** (FILTER_BITS - 6) rows of two numbers
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col("doc_id").cast("long").alias("id"), text_mark(F.col("text")).alias("mark"))
    marked = marked.withColumn("p", place("id", "mark")).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(words), "word", "left")
    marked = marked.select("row", "id", "mark", F.coalesce(F.col("bits").bitwiseAND(bit("p")) != 0, F.lit(False)).alias("doubtful"))
    clear = marked.where(~F.col("doubtful")).select("row.*")
    some = marked.where("doubtful").join(kept.select("doc_id", F.col("mark").alias("kept_mark")), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    if kept.where("copies > 1").limit(1).count():
        some = some.dropDuplicates(["id", "mark"])
    return clear.unionByName(some.select("row.*"))


def labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of jaccard_components with the label of their component (null: no words) and their mark if docs have one."""
    mark = [c for c in docs.columns if c == "mark"]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *mark)
    described = stored(describe(docs, shingle_sketch(docs, size), size, percent), "jaccard-docs")
    nodes = make_nodes(described)
    groups = stored(assign_groups(nodes), "jaccard-groups")
    labels = components(open_groups(docs, nodes, groups, size, percent))
    # A unit of the matrix: a class, or what is left of a group, or a single node.
    left = groups.groupBy("node").agg(F.min("grp").alias("grp"))
    kept = nodes.select("node", "doc_id", "n").join(labels, "node", "left").join(left, "node", "left")
    classes = stored(kept.select("node", "doc_id", "n", "label", F.when(F.col("label").isNotNull(), F.xxhash64(F.lit("class"), "label")).otherwise(F.coalesce("grp", F.xxhash64(F.lit("single"), "node"))).alias("unit")), "jaccard-classes")
    drop(nodes, groups)
    pairs = group_pairs(described, classes, percent)
    between = stored(open_pairs(docs, classes, pairs, size, percent), "jaccard-between")
    inside = classes.where("label <> node").select(F.col("node").alias("src"), F.col("label").alias("dst"))
    final = components(inside.unionByName(between)).select("node", F.col("label").alias("last"))
    joined = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("last", "label", "node").alias("label"))
    joined = stored(joined, "jaccard-joined")
    smallest = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stored(joined.join(smallest, "label").select("node", "label", "component_id"), "jaccard-named")
    rows = stored(described.select("doc_id", "n", "node", *mark), "jaccard-rows")
    drop(described, classes, pairs, between, joined)
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "label", *mark)


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
