"""Folds over the sorted rows of a key, in a stream: one row at a time, with a state that is carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], made: list[tuple[str, T.DataType]], begin: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list[tuple]]], end: Callable[[Any], list[tuple]] = lambda state: []) -> DataFrame:
    """The keys and what ``step(state, row) -> (state, tuples)`` and ``end(state) -> tuples`` make of each key's rows in order.

    One shuffle brings a key's rows together, Spark sorts them (and spills), and Python sees a batch of them at a time, so
    time is linear in a key's rows and memory holds one batch and one state, however long the key is. A key is folded in one task,
    since every step needs the state before it. Rows of a null key are a key of their own.
    """
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(name, kind) for name, kind in made])
    kinds = [_ARROW[kind] for _, kind in made]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, types = None, None, None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, *kinds])], names=names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if now is None or key != now:
                    if now is not None:
                        out += [now + x for x in end(state)]
                    now, state = key, begin()
                state, new = step(state, row)
                out += [key + x for x in new]
            yield packed(out)
        if now is not None:
            yield packed([now + x for x in end(state)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
