"""Scoring by shards: passages are dealt out by hash, every shard has all hits of its own passages and meets every question there.

Hits leave the scan of the postings in blocks: some million at a time are put together, a compressed block per shard, in which a passage is named
once and a hit is a term, a number and a count. Blocks are shuffled twice, to be put together by shard and to be scored, whatever the number of
questions. A task scores a lot of shards one after the other, each unpacked when its turn comes, and keeps each question's best of all of them, so
the hits that leave it grow with questions times lots. A shard is bounded in tokens and a lot in shards, so no task grows with the
table. Questions of equal terms are one class and are scored once. The work of scoring is questions times hits, as exact search
over all passages is, but only as additions to an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators.index import Index
from parlance.sources.storage import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Tokens of a shard, and rows up to which a table is broadcast.
SHARD_TOKENS, BROADCAST_ROWS = 3_000_000, 500_000
#: Shards that a task scores at most, and hits that are put together before they leave the scan.
LOT, HITS = 16, 2_000_000
BLOCK, ROWS = "shard long, passages binary, hits binary", "shard long, t long, path {path}, chunk {chunk}, tf double, len long"


def small(rows: DataFrame) -> DataFrame:
    """A stored table, marked for a broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _ranks(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, nulls first, and each row's place among them."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _passages(path: pa.ChunkedArray, chunk: pa.ChunkedArray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Paths and chunks of the distinct passages in order, and each row's passage."""
    (paths, p), (chunks, c) = _ranks(path), _ranks(chunk)
    keys, row = np.unique(p * len(chunks) + c, return_inverse=True)
    return paths.take(pa.array(keys // len(chunks))), chunks.take(pa.array(keys % len(chunks))), row


def _packed(columns: dict) -> bytes:
    """Columns as Arrow's stream format, compressed."""
    batch, sink = pa.RecordBatch.from_pydict({n: pa.array(x) if isinstance(x, np.ndarray) else x for n, x in columns.items()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _merged(path: pa.ChunkedArray, chunk: pa.ChunkedArray, size: np.ndarray, of: np.ndarray, t: np.ndarray, tf: np.ndarray) -> tuple:
    """Hits (t, tf, the row of their passage), several perhaps for a term in a passage, to one for each, by term and passage.

    Paths, chunks and sizes of the distinct passages in order; t, passage and tf of the hits, and one of the rows that each was."""
    paths, chunks, row = _passages(path, chunk)
    sizes = np.zeros(len(paths), np.int64)
    np.maximum.at(sizes, row, size)
    row = row[of]
    key = np.unique(t, return_inverse=True)[1] * len(paths) + row
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[starts]
    return paths, chunks, sizes, t[first], row[first], np.add.reduceat(tf[order], starts), first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits (shard, t, path, chunk, tf, len) to blocks, one per shard for every ``HITS`` of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HITS:
            yield from _by_shard(held)
            held = []
    if sum(b.num_rows for b in held):
        yield from _by_shard(held)


def _by_shard(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    paths, chunks, sizes, t, at, tf, first = _merged(rows["path"], rows["chunk"], rows["len"].to_numpy(), np.arange(rows.num_rows), rows["t"].to_numpy(), rows["tf"].to_numpy())
    shard = rows["shard"].to_numpy()[first]
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        there, local = np.unique(at[part], return_inverse=True)
        passages = _packed({"path": paths.take(pa.array(there)), "chunk": chunks.take(pa.array(there)), "len": sizes[there]})
        hits = _packed({"t": t[part], "at": local.astype(np.int32), "tf": tf[part]})
        yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[part[:1]]), "passages": pa.array([passages], pa.binary()), "hits": pa.array([hits], pa.binary())})


_TERMS = [("t", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))]
_GATHERED = pa.schema([("shard", pa.int64()), *_TERMS, ("passages", pa.binary()), ("hits", pa.binary())])


def _gathered(blocks: pa.Table) -> pa.Table:
    """A shard's blocks to one, with its terms and how many of its passages each has."""
    passages, hits = ([_unpacked(x) for x in blocks[c]] for c in ("passages", "hits"))
    begins = np.cumsum([0] + [p.num_rows for p in passages])
    of = np.concatenate([h["at"].to_numpy() + b for h, b in zip(hits, begins)])
    every, told = pa.concat_tables(passages), pa.concat_tables(hits)
    paths, chunks, sizes, t, at, tf, _ = _merged(every["path"], every["chunk"], every["len"].to_numpy(), of, told["t"].to_numpy(), told["tf"].to_numpy())
    terms, df = np.unique(t, return_counts=True)
    packed = _packed({"path": paths, "chunk": chunks, "len": sizes}), _packed({"t": t, "at": at.astype(np.int32), "tf": tf})
    return pa.table([pa.array([x], y.type) for x, y in zip([blocks["shard"][0].as_py(), terms, df, *packed], _GATHERED)], schema=_GATHERED)


def _shard_hits(index: Index, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (shard, t, path, chunk, tf, len) as stored blocks, one per shard, and the weights (t, idf) of their terms; filters (t below 0) weigh nothing."""
    blocks = rows.mapInArrow(_blocks, BLOCK).groupBy("shard").applyInArrow(_gathered, "shard long, t array<long>, df array<long>, passages binary, hits binary")
    hits = stored(blocks, "shard-hits")
    seen = hits.select(F.explode(F.arrays_zip("t", "df")).alias("x")).groupBy("x.t").agg(F.sum("x.df").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = stored(seen.crossJoin(F.broadcast(index.stats)).select("t", F.when(F.col("t") < 0, 0.0).otherwise(idf).alias("idf")), "term-weights")
    return hits.drop("df"), weights


def _prefix_rows(index: Index, named: DataFrame, shards: int) -> DataFrame:
    """shard, t, path, chunk, tf, len: the uses of all tokens that begin with a stored term (term, t).

    The terms go to the postings, which stay where they are; only more terms than can be broadcast meet them by a shuffle, by way of the dictionary.
    """
    buckets = index.buckets_of(named)
    seen = named.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("term")).alias("sizes")).first()  # a few numbers
    if seen["n"] <= BROADCAST_ROWS:
        heads = index.postings(buckets).withColumn("_n", F.explode(F.array(*map(F.lit, sorted(seen["sizes"]) or [1])))).where(F.col("_n") <= F.length("token"))
        rows = heads.withColumn("term", F.expr("left(token, _n)")).join(F.broadcast(named), "term")
    else:
        rows = index.postings(buckets).join(stored(expand_prefixes(named, index.dictionary(buckets)).join(named, "term").select("t", "token"), "term-tokens"), "token")
    return rows.select(_shard_of(shards), "t", "path", "chunk", "tf", "len")


class _Best:
    """Classes' hits over the shards that a task has scored: all, or each one's ``keep`` best; ``met``: classes with hits of all terms, whose others go."""

    def __init__(self, keep: int | None):
        self.keep, self.met, self.bound = keep, set(), {}
        self.kept: list[pa.Table] = []

    def chosen(self, c: int, scores: np.ndarray, found: np.ndarray, whole: bool) -> np.ndarray:
        """Places in ``found`` (passages in order) of hits that can be among the class's best, ties to earlier passages."""
        if self.keep is None:
            return np.arange(len(scores))
        was, worst = self.bound.get(c, (whole, np.inf))
        near = np.flatnonzero(scores <= worst) if was == whole else np.arange(len(scores))
        if len(near) > self.keep:
            some = scores[near]
            near = near[some <= np.partition(some, self.keep - 1)[self.keep - 1]]
            near = near[np.lexsort((found[near], scores[near]))[: self.keep]]
        return near

    def add(self, out: list[tuple], paths: pa.Array, chunks: pa.Array) -> None:
        """A shard's hits: c, terms, whole, passages, scores, matched of each class."""
        if not out:
            return
        n = [len(x[3]) for x in out]
        of = pa.array(np.concatenate([x[3] for x in out]))
        rows = {"c": np.repeat([x[0] for x in out], n), "path": paths.take(of), "chunk": chunks.take(of), "score": np.concatenate([x[4] for x in out]), "matched": np.concatenate([x[5] for x in out]).astype(np.int64), "n_terms": np.repeat([x[1] for x in out], n), "whole": np.repeat([x[2] for x in out], n)}
        self.kept.append(pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in rows.items()}))
        if self.keep is not None:
            self._trim()

    def _trim(self) -> None:
        rows = pa.concat_tables(self.kept)
        c, score, whole = (rows[x].to_numpy() for x in ("c", "score", "whole"))
        order = np.lexsort((_ranks(rows["chunk"])[1], _ranks(rows["path"])[1], score, ~whole, c))
        starts = np.flatnonzero(np.diff(c[order], prepend=c[order[0]] - 1))
        sizes = np.diff(starts, append=len(order))
        place = np.arange(len(order)) - np.repeat(starts, sizes)
        good = order[(place < self.keep) & (whole[order] == np.repeat(whole[order[starts]], sizes))]
        last = order[starts[sizes >= self.keep] + self.keep - 1]
        same = last[whole[last] == whole[order[starts[sizes >= self.keep]]]]
        self.bound = dict(zip(c[same].tolist(), zip(whole[same].tolist(), score[same].tolist())))
        self.kept = [rows.take(pa.array(good)).combine_chunks()]

    def table(self, terms: dict[int, int], schema: pa.Schema) -> pa.Table:
        """What is left. A class that was met whole, but only too far, has a row without a hit (``there``), so that it isn't answered by hits of any term."""
        rows = [t.filter(pa.array([w or c not in self.met for c, w in zip(t["c"].to_pylist(), t["whole"].to_pylist())], pa.bool_())) if self.met else t for t in self.kept]
        rows = [t.drop(["whole"]).append_column("there", pa.array(np.ones(t.num_rows, bool))).select(schema.names).cast(schema) for t in rows]
        bare = sorted(self.met - {c for t in rows for c in t["c"].unique().to_pylist()})
        if bare:
            n, none = [terms[c] for c in bare], [None] * len(bare)
            rows.append(pa.table({"c": bare, "path": none, "chunk": none, "score": [0.0] * len(bare), "matched": n, "n_terms": n, "there": [False] * len(bare)}, schema=schema))
        return pa.concat_tables(rows) if rows else schema.empty_table()


def _opened(hits: pa.Table, mean: float) -> Iterator[tuple]:
    """Paths, chunks, the hits' passages and parts of scores, and each term's span of them, of a lot's shards, one after the other."""
    told = hits.filter(pc.is_null(hits["shard"]))
    ts, idf = (told[c].combine_chunks().flatten().to_numpy() for c in ("t", "idf"))
    order = np.argsort(ts)
    ts, idf = ts[order], idf[order]
    shards = hits.filter(pc.is_valid(hits["shard"]))
    for p, h in zip(shards["passages"], shards["hits"]):
        passages, rows = _unpacked(p), _unpacked(h)
        t, at, tf, size = rows["t"].to_numpy(), rows["at"].to_numpy(), rows["tf"].to_numpy(), passages["len"].to_numpy()[rows["at"].to_numpy()]
        begins = np.flatnonzero(np.diff(t, prepend=t[0] - 1))
        ends = np.append(begins[1:], len(t))
        weight = np.repeat(idf[np.searchsorted(ts, t[begins])], ends - begins)
        part = -weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        yield passages["path"].combine_chunks(), passages["chunk"].combine_chunks(), at, part, {k: slice(a, b) for k, a, b in zip(t[begins].tolist(), begins.tolist(), ends.tolist())}


def _scored(mode: str, keep: int | None, floor: float | None, mean: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(hits: pa.Table, asked: pa.Table) -> pa.Table:
        if not hits.num_rows or not asked.num_rows:
            return schema.empty_table()
        best, classes, lists = _Best(keep), asked["c"].to_pylist(), asked["terms"].combine_chunks()
        every, begins = lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())).tolist()
        for paths, chunks, at, part, spans in _opened(hits, mean):
            out: list[tuple] = []
            total, count = np.zeros(len(paths)), np.zeros(len(paths), dtype=np.int64)
            for i, c in enumerate(classes):
                terms = every[begins[i] : begins[i + 1]].tolist()
                met = [spans[t] for t in terms if t in spans]
                if not met or (len(met) < len(terms) and (mode == "and" or c in best.met)):
                    continue
                total[:], count[:] = 0, 0
                for span in met:
                    total[at[span]] += part[span]
                    count[at[span]] += 1
                found = np.flatnonzero(count == len(terms) if mode != "or" else count)
                whole = mode == "auto" and len(found) > 0
                if whole:
                    best.met.add(c)
                elif mode == "auto" and c not in best.met:
                    found = np.flatnonzero(count)
                scores = np.round(total[found], 9)
                if floor is not None:
                    found, scores = (x[scores <= floor] for x in (found, scores))
                near = best.chosen(c, scores, found, whole)
                if len(near):
                    out.append((c, len(terms), whole, found[near], scores[near], count[found[near]]))
            best.add(out, paths, chunks)
        return best.table(dict(zip(classes, np.diff(begins).tolist())) if best.met else {}, schema)

    return score


def _lots(index: Index, shards: int, keep: int | None) -> int:
    """How many lots the shards are dealt into: where only the best are kept, enough for all cores, and as few as ``LOT`` allows."""
    return shards if keep is None else max(min(shards, 2 * index.spark.sparkContext.defaultParallelism), -(-shards // LOT))


def _by_lots(index: Index, hits: DataFrame, weights: DataFrame, classes: DataFrame, shards: int, keep: int | None, score: Callable[[float, pa.Schema], Callable]) -> DataFrame:
    """The hits (c, path, chunk, score, matched, n_terms, there) of stored classes, by ``score(mean length, schema)``. Where there are fewer lots than cores,
    the classes are dealt out too."""
    kinds = index.kinds
    n = _lots(index, shards, keep)
    pieces = -(-index.spark.sparkContext.defaultParallelism // n)
    lots = F.broadcast(index.spark.range(n * pieces).select(F.col("id").alias("lot")))
    told = weights.groupBy(F.pmod("t", F.lit(256))).agg(F.collect_list(F.struct("t", "idf")).alias("w")).select(F.lit(None).cast("long").alias("shard"), F.col("w.t").alias("t"), F.col("w.idf").alias("idf"), F.lit(None).cast("binary").alias("passages"), F.lit(None).cast("binary").alias("hits")).crossJoin(lots)
    none = F.lit(None)
    rows = hits.select("shard", none.cast("array<long>").alias("t"), none.cast("array<double>").alias("idf"), "passages", "hits", F.explode(F.sequence(F.pmod("shard", F.lit(n)), F.lit(n * pieces - 1).cast("long"), F.lit(n).cast("long"))).alias("lot")).unionByName(told)
    schema = pa.schema([("c", pa.int64()), ("path", _ARROW[kinds["path"]]), ("chunk", _ARROW[kinds["chunk"]]), ("score", pa.float64()), ("matched", pa.int64()), ("n_terms", pa.int64()), ("there", pa.bool_())])
    ddl = f"c long, path {kinds['path']}, chunk {kinds['chunk']}, score double, matched long, n_terms long, there boolean"
    mean = index.counts["mean_len"] or 1.0
    asked = classes.withColumn("_piece", F.pmod(F.xxhash64("c"), F.lit(pieces))).join(lots, F.expr(f"lot div {n} = _piece")).drop("_piece")
    return rows.groupBy("lot").cogroup(asked.groupBy("lot")).applyInArrow(score(mean, schema), ddl)


def _first(found: DataFrame, keep: int | None, whole_first: bool) -> DataFrame:
    """Of hits by lots, each class's ``keep`` best; ``whole_first``: hits of all its terms, if it has any, else of any."""
    whole = F.col("matched") == F.col("n_terms")
    by = [whole.desc(), F.col("there").desc()] if whole_first else []
    w = W.partitionBy("c").orderBy(*by, "score", "path", "chunk")
    if whole_first:
        found = found.withColumn("_whole", F.first(whole).over(w))
    if keep is not None:
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
    return found.where(whole | ~F.col("_whole")).where("there").drop("_whole", "there") if whole_first else found.drop("there")


def best_hits(index: Index, terms: DataFrame, mode: str, keep: int | None = None, floor: float | None = None) -> DataFrame:
    """q, path, chunk, score, matched, n_terms for stored terms (q, term): hits of every term (``and``), of any (``or``), or of any for
    questions that no passage meets whole (``auto``); all of them, or each question's ``keep`` best (by score, path and chunk) of ``floor`` or lower."""
    named = stored(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    lists = terms.select("q", "term").distinct().join(named, "term").groupBy("q").agg(F.array_sort(F.collect_list("t")).alias("terms"))
    lists = stored(lists, "question-terms")
    classes = stored(lists.select("terms").distinct().withColumn("c", F.monotonically_increasing_id()), "question-classes")
    shards = _shards(index)
    hits, weights = _shard_hits(index, _prefix_rows(index, named, shards))
    found = _by_lots(index, hits, weights, classes, shards, keep, lambda mean, schema: _scored(mode, keep, floor, mean, schema))
    found = _first(found, keep, mode == "auto")
    return lists.join(classes, "terms").select("q", "c").join(found, "c").select("q", "path", "chunk", "score", "matched", "n_terms")


def _shards(index: Index) -> int:
    """How many shards an index has."""
    return max(1, -(-int((index.counts["mean_len"] or 0) * index.counts["n_docs"]) // SHARD_TOKENS))


def _shard_of(shards: int) -> Column:
    """A passage's shard, as ``repartition(shards, "path", "chunk")`` deals it."""
    return F.pmod(F.hash("path", "chunk"), F.lit(shards)).cast("long").alias("shard")


def _met(words: pa.Table, asked: pa.Table, schema: pa.Schema) -> pa.Table:
    """A shard's hits of phrases (t, tokens): from its words (token, path, chunk, len, positions) to a list per phrase."""
    if not words.num_rows or not asked.num_rows:
        return schema.empty_table()
    paths, chunks, at = _passages(words["path"], words["chunk"])
    lists = words["positions"].combine_chunks()
    n = pc.list_value_length(lists).to_numpy()
    size = np.zeros(len(paths), np.int64)
    size[at] = words["len"].to_numpy()
    # A place is a passage and a position; positions are below 2^31, so a place before a passage's first is no word's.
    place = (np.repeat(at, n) << 32) + lists.flatten().to_numpy().astype(np.int64)
    token = np.repeat(words["token"].to_numpy(), n)
    order = np.lexsort((place, token))
    place, token = place[order], token[order]
    names, begins = np.unique(token, return_index=True)
    spans = dict(zip(names.tolist(), np.split(place, begins[1:])))
    out = []
    for t, tokens in zip(asked["t"].to_pylist(), asked["tokens"].to_pylist()):
        if any(x not in spans for x in tokens):
            continue
        rarest, *rest = sorted(enumerate(tokens), key=lambda x: len(spans[x[1]]))
        starts = spans[rarest[1]] - rarest[0]
        for k, x in rest:
            near = np.searchsorted(spans[x], starts + k)
            starts = starts[spans[x][np.minimum(near, len(spans[x]) - 1)] == starts + k]
        if len(starts):
            out.append((t, *np.unique(starts >> 32, return_counts=True)))
    if not out:
        return schema.empty_table()
    df = np.array([len(x[1]) for x in out])
    found = np.concatenate([x[1] for x in out])
    ends = pa.array(np.append(0, np.cumsum(df)).astype(np.int32))
    lists = [paths.take(pa.array(found)), chunks.take(pa.array(found)), pa.array(np.concatenate([x[2] for x in out]).astype(np.float64)), pa.array(size[found])]
    shard = pa.array(np.full(len(out), words["shard"][0].as_py(), dtype=np.int64))
    return pa.Table.from_arrays([shard, pa.array([x[0] for x in out], pa.int64()), pa.array(df), *[pa.ListArray.from_arrays(ends, x) for x in lists]], schema=schema)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _lists(index: Index) -> tuple[str, pa.Schema]:
    """The hits of a term in a shard, as DDL and as an Arrow schema."""
    path, chunk = index.kinds["path"], index.kinds["chunk"]
    ddl = f"shard long, t long, df long, path array<{path}>, chunk array<{chunk}>, tf array<double>, len array<long>"
    return ddl, pa.schema([("shard", pa.int64()), ("t", pa.int64()), ("df", pa.int64()), ("path", pa.list_(_ARROW[path])), ("chunk", pa.list_(_ARROW[chunk])), ("tf", pa.list_(pa.float64())), ("len", pa.list_(pa.int64()))])


def phrase_lists(index: Index, phrases: DataFrame) -> DataFrame:
    """shard, t, df and lists of path, chunk, tf, len for stored phrases (t, tokens): a list per phrase and shard.

    The words of all phrases are shuffled once, with their positions, to the shards of their passages, whatever the number of phrases; every shard meets
    all phrases. A phrase starts at the places of the word that is rarest in the shard. A phrase without a word has no hits.
    """
    spark, shards = index.spark, _shards(index)
    words = stored(phrases.select(F.explode("tokens").alias("word")).distinct().select(F.col("word").alias("token"), F.monotonically_increasing_id().alias("w")), "phrase-words")
    buckets = index.buckets_of(words.select(F.col("token").alias("term")))
    coded = phrases.select("t", F.posexplode("tokens").alias("at", "token")).join(words, "token").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("l"))
    asked = coded.select("t", F.transform("l", lambda x: x["w"]).alias("tokens")).crossJoin(F.broadcast(spark.range(shards).select(F.col("id").alias("shard"))))
    rows = index.postings(buckets).join(small(words), "token").select(_shard_of(shards), F.col("w").alias("token"), "path", "chunk", "len", "positions")
    ddl, schema = _lists(index)
    return rows.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(lambda a, b: _met(a, b, schema), ddl)


def form_rows(index: Index, forms: DataFrame) -> DataFrame:
    """shard, t, path, chunk, tf, len for stored forms (form, t): prefixes, or phrases where a form has a space."""
    words = stored(forms.where("not contains(form, ' ')").select(F.col("form").alias("term"), "t"), "form-words")
    rows = _prefix_rows(index, words, _shards(index))
    phrases = stored(forms.where("contains(form, ' ')").select("t", F.split("form", " ").alias("tokens")), "form-phrases")
    if not phrases.limit(1).count():
        return rows
    return rows.unionByName(phrase_lists(index, phrases).select("shard", "t", F.inline(F.arrays_zip("path", "chunk", "tf", "len"))))


def _form_scored(whole: bool, keep: int | None, mean: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(hits: pa.Table, asked: pa.Table) -> pa.Table:
        if not hits.num_rows or not asked.num_rows:
            return schema.empty_table()
        best = _Best(keep)
        questions = sorted(zip(*[asked[c].to_pylist() for c in ("c", "forms", "need", "without")]), key=lambda x: x[2])
        for paths, chunks, at, part, spans in _opened(hits, mean):
            out = _form_hits(best, questions, whole, paths, at, part, spans)
            best.add(out, paths, chunks)
        best.met = best.met if keep is not None else set()
        return best.table({}, schema)

    return score


def _form_hits(best: _Best, questions: list[tuple], whole: bool, paths: pa.Array, at: np.ndarray, part: np.ndarray, spans: dict) -> list[tuple]:
    """A shard's hits of questions (c, forms, need, without), in order of need."""
    first: dict = {}
    for i, p in enumerate(paths.to_pylist()):  # a path's passages stand together
        first.setdefault(p, [i, i])[1] = i + 1
    out: list[tuple] = []
    now, kept, place, seen = None, np.empty(0, np.int64), at[:0], {}
    for c, terms, need, without in questions:
        if need != now:  # the passages that a filter lets through, numbered anew; its questions come one after the other
            allowed = np.ones(len(paths), bool)
            for t in need:
                through = np.zeros(len(paths), bool)
                if t in spans:
                    through[at[spans[t]]] = True
                allowed &= through
            now, kept, place, seen = need, np.flatnonzero(allowed), np.cumsum(allowed) - 1, {}
            full = len(kept) == len(paths)
            total, count = np.zeros(len(kept)), np.zeros(len(kept), np.int64)
        if not len(kept):
            continue
        total[:], count[:] = 0, 0
        for forms in terms:
            got = []
            for t in forms:
                if t not in seen and t in spans:
                    there, add = at[spans[t]], part[spans[t]]
                    seen[t] = (there, add) if full else (place[there[allowed[there]]], add[allowed[there]])
                if t in seen:
                    got.append(seen[t])
                    total[seen[t][0]] += seen[t][1]
            if len(got) == 1:
                count[got[0][0]] += 1
            elif got:
                any_ = np.zeros(len(kept), bool)
                for there, _ in got:
                    any_[there] = True
                count += any_
        for p in without or []:
            if p in first:
                a, b = np.searchsorted(kept, first[p])
                count[a:b] = 0
        found = np.flatnonzero(count == len(terms))
        all_ = len(found) > 0
        if all_:
            best.met.add(c)
        elif not whole and c not in best.met:
            found = np.flatnonzero(count)
        scores = np.round(total[found], 9)
        near = best.chosen(c, scores, found, all_)
        if len(near):
            out.append((c, len(terms), all_, kept[found[near]], scores[near], count[found[near]]))
    return out


def form_hits(index: Index, terms: DataFrame, forms: DataFrame, keys: list[str], whole: bool = False, keep: int | None = None, allowed: DataFrame | None = None, wanted: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """q, path, chunk, score, matched, n_terms for stored terms (q, keys, term), whose forms (keys, term, form) are stored: every form scores
    for itself, a term is met if any form is. ``whole``: only hits of every term; else hits of any term too, for questions that no passage of the
    shard meets whole (with ``keep``: no passage at all). ``keep``: each question's so many best.

    ``allowed`` (filter, path, chunk) and ``wanted`` (q, filter), stored: a question's hits are among the passages of all its filters; a question
    without one has none. ``without`` (q, path): a question's hits are not of these. Hits and filters are shuffled in blocks per shard, never per question.
    """
    shards = _shards(index)
    named = stored(forms.select("form").distinct().withColumn("t", F.monotonically_increasing_id()), "forms")
    rows = form_rows(index, named)
    if allowed is not None:  # filters have numbers below those of forms
        passed = allowed.select((-1 - F.col("filter")).alias("t"), *[F.col(c).cast(k).alias(c) for c, k in index.kinds.items()], F.lit(0.0).alias("tf"), F.lit(0).cast("long").alias("len"))
        rows = rows.unionByName(passed.select(_shard_of(shards), "*"))
    hits, weights = _shard_hits(index, rows)
    lists = terms.select("q", *keys, "term").join(forms, [*keys, "term"]).join(small(named), "form").groupBy("q", "term").agg(F.array_sort(F.collect_list("t")).alias("f"))
    lists = lists.groupBy("q").agg(F.array_sort(F.collect_list("f")).alias("forms"))
    array = F.array().cast("array<long>")
    if wanted is None:
        lists = lists.withColumn("need", array)
    else:
        lists = lists.join(wanted.groupBy("q").agg(F.array_sort(F.collect_set(-1 - F.col("filter"))).alias("need")), "q")
    if without is None:
        lists = lists.withColumn("without", F.array().cast(f"array<{index.kinds['path']}>"))
    else:
        lists = lists.join(without.groupBy("q").agg(F.array_sort(F.collect_set(F.col("path").cast(index.kinds["path"]))).alias("without")), "q", "left")
    lists = stored(lists.withColumn("without", F.coalesce("without", F.array().cast(f"array<{index.kinds['path']}>"))), "question-forms")
    same = ["forms", "need", "without"]
    classes = stored(lists.select(*same).distinct().withColumn("c", F.monotonically_increasing_id()), "question-classes")
    found = _by_lots(index, hits, weights, classes, shards, keep, lambda mean, schema: _form_scored(whole, keep, mean, schema))
    found = _first(found, keep, True) if keep is not None else found.where("there").drop("there")
    return lists.join(classes, same).select("q", "c").join(found, "c").select("q", "path", "chunk", "score", "matched", "n_terms")


def expand_prefixes(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """term, token: every token that begins with a term. Tokens meet terms by their beginnings of the lengths that terms have: an equi-join, no LIKE."""
    wanted = terms.select("term").distinct()
    sizes = wanted.agg(F.collect_set(F.length("term")).alias("sizes"))  # one row of the lengths that occur
    heads = tokens.select("token").crossJoin(F.broadcast(sizes)).select("token", F.explode(F.filter("sizes", lambda n: n <= F.length("token"))).alias("n"))
    return heads.select("token", F.expr("left(token, n)").alias("term")).join(wanted, "term").select("term", "token")
