"""Places of rows in one global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm._storage import stored


def placed(rows: DataFrame, order: list[Column], per_part: int, size: str | None = None) -> DataFrame:
    """Adds part, place (rows before this one in the order) and, with a column of sizes, before (their sum before this row).

    The rows are range-sorted once and stored; a part holds about ``per_part`` rows, one after the other in the order. Sums
    over parts (one row each) go to every task; rows that are equal in the order stand in any order among themselves.
    """
    n = max(1, -(-rows.count() // per_part))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part"), local.alias("local")), "placed")
    made = [F.count(F.lit(1)).alias("_rows")] + ([F.sum(size).alias("_size")] if size else [])
    parts = ranged.groupBy("part").agg(*made)
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("_rows", *(["_size"] if size else []))]
    out = ranged.join(F.broadcast(parts.select("part", *sums)), "part")  # one row per part
    columns = [*rows.columns, "part", (F.col("_rows_ahead") + F.col("local")).alias("place")]
    if size:
        inner = F.sum(size).over(W.partitionBy("part").orderBy("local").rowsBetween(W.unboundedPreceding, W.currentRow))
        columns.append((F.col("_size_ahead") + inner - F.col(size)).alias("before"))
    return out.select(*columns)
