"""Merkle manifest of a table, proved by one octopus multiproof per leaf partition.

Tree: a row's leaf is H of its columns (``column_code``), H being the lower-case hex
SHA-256. Per source the leaves ascend by id; while several nodes remain, every 16
consecutive ones (the last run may be shorter, even one) become their H. What remains is
the source's subroot; the subroots in order of source (null first, then by UTF-8 bytes)
give the root in the same way.

Steps: (1) leaves are hashed where the rows are, so texts are never shuffled; (2) the
narrow leaves are range-sorted over source and id, which splits a hot source, and get
their places by sums over parts; (3) blocks of 16^3 consecutive nodes give three levels
at a time, so a tree of n leaves takes log(n) / log(4096) rounds; (4) every leaf partition
(a run of leaves) computes the minimal union of the node coordinates that it can't derive
from its own leaves (``missing``: at most 15 on either side of each level), all partitions
fetch theirs in one join, and each partition derives the interior nodes that its proofs
share and expands the individual proofs from them. No partition reads more than its
leaves and those coordinates, and no task holds more than ``PART_LEAVES`` leaves.

Nulls and edge cases: null columns are coded as ``-``; a null id comes first and is never
tampered with; repeated ids stand in the order of their leaves and have proofs of their
own; a lone leaf is its subroot and a lone subroot the root (without siblings the proof is the H of nothing); an
empty table has no root and gives no rows. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._order import placed
from parlance.llm._storage import stored, table

#: Children of a node, and consecutive nodes that a task folds at once (three levels).
ARITY = 16
BLOCK = ARITY**3
#: Leaves of a leaf partition, about.
PART_LEAVES = 1 << 15
#: The number of the tree that stands over the sources' trees.
TOP = -1
HEX = 64

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """leaves: id, claimed, part, tree, idx, n, digest; nodes: tree, level, idx, digest above the leaves; trees and root: of the whole table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def digest(data: str) -> str:
    return sha256(data.encode()).hexdigest()


def column_code(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[column_code(v) for v in values]), 256)


def _folded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to three levels over the blocks of nodes (tree, idx, n, digest) that come in order: tree, up, idx, n, digest."""

    def every() -> Iterator[tuple]:
        for batch in rows:
            yield from zip(*[batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest")])

    out: list[tuple] = []
    for (tree, block), run in groupby(every(), lambda r: (r[0], r[1] // BLOCK)):
        nodes, n, up, at = list(run), 0, 0, block * BLOCK
        n, nodes = nodes[0][2], [r[3] for r in nodes]
        while up < 3 and n > 1:
            nodes = [digest("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
            n, at, up = -(-n // ARITY), at // ARITY, up + 1
            out += [(tree, up, at + k, n, d) for k, d in enumerate(nodes)]
        if len(out) >= 20_000:
            yield _batch(out, NODES)
            out = []
    yield _batch(out, NODES)


NODES = "tree long, up int, idx long, n long, digest string"
COORDINATES = "part int, tree long, level int, idx long"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def grow(leaves: DataFrame, largest: int) -> DataFrame:
    """tree, level, idx, n, digest of all nodes over leaves (tree, idx, n, digest) of trees of up to ``largest`` leaves."""
    made, level, now = [], 0, leaves.select("tree", "idx", "n", "digest")
    while largest > 1:
        block = F.floor(F.col("idx") / BLOCK)
        runs = now.where("n > 1").repartition("tree", block).sortWithinPartitions("tree", "idx")
        got = stored(runs.mapInArrow(_folded, NODES), "merkle-nodes")
        made.append(got.select("tree", (F.col("up") + level).cast("int").alias("level"), "idx", "n", "digest"))
        now = got.where("up = 3")
        level, largest = level + 3, -(-largest // BLOCK)
    if not made:
        return leaves.where("false").select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def build_manifest(rows: DataFrame, group: str = "source") -> Manifest:
    """The manifest of rows (doc_id, group, leaf, claimed): claimed is the digest that is to be proved."""
    leaves = stored(rows.select("doc_id", F.col(group).alias("source"), "leaf", "claimed"), "merkle-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    leaves = stored(placed(leaves, order, PART_LEAVES), "merkle-places")
    sources = stored(leaves.groupBy("source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    sources = stored(placed(sources, [F.col("start")], PART_LEAVES).select("source", "start", "n", F.col("place").alias("tree")), "merkle-trees")
    sizes = sources.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    known = sources.withColumnRenamed("source", "_source")
    leaves = leaves.join(known, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "claimed", "part", "tree", (F.col("place") - F.col("start")).alias("idx"), "n", F.col("leaf").alias("digest"))
    leaves = stored(leaves, "merkle-indexed")
    nodes = grow(leaves, sizes["largest"])
    tops = leaves.where("n = 1").select("tree", "digest").unionByName(nodes.where("n = 1").select("tree", "digest"))
    tops = stored(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(sizes["trees"]).cast("long").alias("n"), "digest"), "merkle-subroots")
    over = grow(tops, sizes["trees"])
    root = (over if sizes["trees"] > 1 else tops).where("n = 1").first()
    nodes = nodes.unionByName(tops.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")).unionByName(over)
    return Manifest(leaves, nodes.select("tree", "level", "idx", "digest"), sizes["trees"], root and root["digest"])


def missing(low: int, high: int, n: int) -> Iterator[tuple[int, int]]:
    """The (level, idx) that whoever has the leaves from low to high (both included) of n lacks for the proofs of all of them:
    the others of the runs at both ends, level by level; what lies between is derived."""
    level = 0
    while n > 1:
        first, last = low // ARITY * ARITY, min(n, (high // ARITY + 1) * ARITY)
        yield from ((level, i) for i in range(first, low))
        yield from ((level, i) for i in range(high + 1, last))
        low, high, n, level = low // ARITY, high // ARITY, -(-n // ARITY), level + 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("part", "tree", "low", "high", "n")])
        yield _batch([(part, tree, level, i) for part, tree, low, high, n in rows for level, i in missing(low, high, n)], COORDINATES)


def derive(low: int, nodes: list[str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """For consecutive leaves from ``low`` on: the nodes of each level from a first one on, whole runs, and the top node."""
    levels, level = [], 0
    while n > 1:
        first, high = low // ARITY * ARITY, low + len(nodes)
        last = min(n, -(-high // ARITY) * ARITY)
        nodes = [fetched[level, i] for i in range(first, low)] + nodes + [fetched[level, i] for i in range(high, last)]
        levels.append((first, nodes))
        nodes = [digest("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
        low, n, level = first // ARITY, -(-n // ARITY), level + 1
    return levels, nodes[0]


class Proofs:
    """The proofs of a run of leaves of one tree: runs of siblings, shared by all leaves below them."""

    def __init__(self, low: int, nodes: list[str], n: int, fetched: dict[tuple[int, int], str], above: "Proofs | None" = None, place: int = 0):
        self.levels, self.top = derive(low, nodes, n, fetched)
        self.runs = [(first, ["".join(level[k : k + ARITY]) for k in range(0, len(level), ARITY)]) for first, level in self.levels]
        self.above, self.place = above, place
        self.known: dict[tuple[int, int, str], str] = {}
        self.upper: dict[tuple[int, int], str] = {}

    def _run(self, level: int, i: int) -> tuple[str, int]:
        first, runs = self.runs[level]
        return runs[(i - first) // ARITY], i % ARITY * HEX

    def siblings(self, i: int, level: int = 0) -> str:
        """The siblings of a leaf up to the root, level by level, as one text. From level 1 on they are shared."""
        if level and (got := self.upper.get((level, i))) is not None:
            return got
        if level == len(self.levels):
            out = self.above.siblings(self.place) if self.above else ""
        else:
            run, at = self._run(level, i)
            out = run[:at] + run[at + HEX :] + self.siblings(i // ARITY, level + 1)
        if level:
            self.upper[level, i] = out
        return out

    def fold(self, i: int, value: str, level: int = 0) -> str:
        """The root that a digest at a place gives with that place's siblings. Paths that meet are followed once."""
        if (got := self.known.get((level, i, value))) is not None:
            return got
        if level == len(self.levels):
            out = self.above.fold(self.place, value) if self.above else value
        else:
            run, at = self._run(level, i)
            out = self.fold(i // ARITY, digest(run[:at] + value + run[at + HEX :]), level + 1)
        if level:
            self.known[level, i, value] = out
        return out


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf: its claimed digest (else its own) is folded with
    the original siblings."""
    leaves, trees, root = manifest.leaves, manifest.trees, manifest.root
    own = leaves.groupBy("part", "tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.first("n").alias("n"))
    over = own.groupBy("part").agg(F.min("tree").alias("low"), F.max("tree").alias("high"))
    over = over.select("part", F.lit(TOP).cast("long").alias("tree"), "low", "high", F.lit(trees).cast("long").alias("n"))
    wanted = own.where("low > 0 or high < n - 1").unionByName(over).mapInArrow(_wanted, COORDINATES)
    every = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest").unionByName(manifest.nodes)
    fetched = wanted.join(every, ["tree", "level", "idx"])

    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        got: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, i, d in zip(*[others.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")]):
            got.setdefault(tree, {})[level, i] = d
        rows = list(zip(*[mine.sort_by([("tree", "ascending"), ("idx", "ascending")]).column(c).to_pylist() for c in ("tree", "idx", "n", "digest", "doc_id", "claimed")]))
        runs = [(tree, list(run)) for tree, run in groupby(rows, lambda r: r[0])]
        tops = [derive(run[0][1], [r[3] for r in run], run[0][2], got.get(tree, {}))[1] for tree, run in runs]
        top = Proofs(runs[0][0] if runs else 0, tops, trees, got.get(TOP, {})) if runs else None
        out = []
        for tree, run in runs:
            proofs = Proofs(run[0][1], [r[3] for r in run], run[0][2], got.get(tree, {}), top, tree)
            for _, i, _, leaf, doc_id, claimed in run:
                folded = proofs.fold(i, claimed or leaf)
                out.append((doc_id, leaf, proofs.top, root, digest(proofs.siblings(i)), folded, folded == root))
        return pa.Table.from_batches([_batch(out, PROVED)])

    keyed = leaves.select("part", "tree", "idx", "n", "digest", "doc_id", "claimed").groupBy("part")
    return keyed.cogroup(fetched.select("part", "tree", "level", "idx", "digest").groupBy("part")).applyInArrow(expand, PROVED)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and claimed (null: as the leaf) of documents. Where 5 divides the crc32 of the id, the claimed text has its A-Z lower-cased."""
    columns = [F.col(c).cast("string" if c in ("source", "lang", "text") else "long") for c in COLUMNS]
    tampered = [*columns[:-1], F.translate(columns[-1], _UPPER, _LOWER)]
    hit = F.crc32(columns[0].cast("string").cast("binary")) % 5 == 0
    return docs.select(columns[0].alias("doc_id"), columns[1].alias("source"), leaf_digest(*columns).alias("leaf"), F.when(hit, leaf_digest(*tampered)).alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of every document against the manifest of all; a fifth of the texts is tampered with before."""
    return prove(build_manifest(document_leaves(table(spark, sf_dir, "documents"))))


#: Unsigned crc32 of a DuckDB text of ASCII characters, bit by bit.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"


def oracle() -> str:
    """The same in DuckDB: all levels of all trees by recursion, and one fold per document and level."""
    code = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    plain = " || ".join(code(c) for c in COLUMNS)
    lowered = " || ".join(code(c) for c in COLUMNS[:-1]) + f" || {code(f"translate(text, '{_UPPER}', '{_LOWER}')")}"
    grown = "sha256(string_agg(h, '' order by idx))"
    return f"""
with recursive d as (select row_number() over () as r, doc_id, source, sha256({plain}) as leaf, case when {CRC32_SQL.format("doc_id::varchar")} % 5 = 0 then sha256({lowered}) end as claimed from documents),
s as (select source, row_number() over (order by source nulls first) - 1 as tree, count(*) as n from d group by source),
l as (select r, doc_id, leaf, coalesce(claimed, leaf) as claimed, tree, n, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from d join s on d.source is not distinct from s.source),
a(tree, level, idx, n, h) as (
  select tree, 0, idx, n, leaf from l
  union all
  select tree, level + 1, idx // 16, (n + 15) // 16, {grown} from a where n > 1 group by tree, level, idx // 16, n),
b(tree, level, idx, n, h) as (
  select -1, 0, tree, (select count(*) from s), h from a where n = 1
  union all
  select tree, level + 1, idx // 16, (n + 15) // 16, {grown} from b where n > 1 group by tree, level, idx // 16, n),
runs as (select tree, level, idx // 16 as up, string_agg(h, '' order by idx) as run from (select * from a union all select * from b) where n > 1 group by 1, 2, 3),
deep as (select tree, max(level) as top from (select tree, level from a union all select tree, level from b) group by 1),
f(r, level, tree, idx, own, h, sib) as (
  select r, 0, tree, idx, tree, claimed, '' from l
  union all
  select f.r, case when f.level = top then 0 else f.level + 1 end, case when f.level = top then -1 else f.tree end, case when f.level = top then f.own else f.idx // 16 end, f.own,
    case when f.level = top then f.h else sha256(left(run, f.idx % 16 * 64) || f.h || substr(run, f.idx % 16 * 64 + 65)) end,
    case when f.level = top then f.sib else f.sib || left(run, f.idx % 16 * 64) || substr(run, f.idx % 16 * 64 + 65) end
  from f join deep on deep.tree = f.tree left join runs on runs.tree = f.tree and runs.level = f.level and runs.up = f.idx // 16
  where not (f.tree = -1 and f.level = top)),
done as (select f.r, f.h, f.sib from f join deep on deep.tree = f.tree where f.tree = -1 and f.level = top)
select doc_id, leaf, t.h as subroot, root.h as root, sha256(sib) as proof_sha256, done.h as folded_root, done.h = root.h as verified
from l join done using (r) join a t on t.tree = l.tree and t.n = 1 cross join (select h from b where n = 1) root"""
