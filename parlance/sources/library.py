"""Tables that are published together: segments, tombstones and one manifest.

A library holds several tables whose rows belong to paths (a call's row, its passages, its
topics, its commitments, its postings). An update writes the new rows of all tables as one
segment, with tombstones for the paths that it replaces or removes; then one manifest row
names the segments that count. Readers see the tables of one manifest, so never a call
without its passages; an update that fails before its manifest row has changed nothing;
a batch whose number the manifest already has is not applied again. The cost of an update
follows the rows that it brings, not the tables. ``merge`` rewrites the live rows as one
segment; readers of older manifests still find their files until ``clean``.

Edge cases: a path with new rows in one table only is replaced in all of them; an update
without rows or removals still records its batch; a library is empty before its first update;
null paths are rejected, since nothing could replace them. ``derived`` tables have no paths: each
segment's is computed from another table of that segment, and readers get those of all segments.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.sources.storage import FEW, exists

_MANIFEST = "version long, body string"
#: Tables of a segment that are written at the same time.
WRITERS = 4


@dataclass(frozen=True)
class Snapshot:
    """What one manifest row names: segments in order (place, folder), the last batch, and how many segments an update has written so far."""

    version: int = -1
    batch: int = -1
    segments: tuple[tuple[int, str], ...] = field(default_factory=tuple)
    next_place: int = 0


class Library:
    """``schemas``: table -> DDL, with a column path unless the table is derived; ``partitioned``: table -> column that its files are laid
    out by; ``derived``: table -> the table that it is computed from, and how."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], path_type: str = "long", partitioned: dict[str, str] | None = None, derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None):
        self.spark, self.root, self.schemas, self.path_type = spark, root, schemas, path_type
        self.partitioned, self.derived = partitioned or {}, derived or {}
        self._dead: dict[str, int] = {}  # tombstones of segments, whose files never change

    def current(self) -> Snapshot:
        """The newest manifest."""
        if not exists(self.spark, f"{self.root}/manifest"):
            return Snapshot()
        last = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").agg(F.max_by(F.struct("version", "body"), "version").alias("m")).first()["m"]
        if last is None:
            return Snapshot()
        body = json.loads(last["body"])
        return Snapshot(last["version"], body["batch"], tuple((p, f) for p, f in body["segments"]), body["next_place"])

    def _name(self, snapshot: Snapshot) -> Snapshot:
        body = json.dumps({"batch": snapshot.batch, "segments": snapshot.segments, "next_place": snapshot.next_place})
        row = self.spark.createDataFrame([(snapshot.version, body)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return snapshot

    def _write(self, tables: dict[str, DataFrame], removed: DataFrame | None, more: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]] | None = None) -> str:
        """A segment of tables, with tombstones of their paths and of what is removed. The paths are taken from the files just written."""
        folder = f"{self.root}/segments/{uuid.uuid4().hex}"
        def write(name: str, rows: DataFrame) -> None:
            writer = rows.write.partitionBy(self.partitioned[name]) if name in self.partitioned else rows.write
            writer.parquet(f"{folder}/{name}")

        # The tables are jobs of their own, so small ones needn't wait for each other.
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(write, tables, tables.values()))
            if more:
                others = self._known(more(lambda name: self.spark.read.schema(self.schemas[name]).parquet(f"{folder}/{name}")))
                list(pool.map(write, others, others.values()))
                tables = tables | others
            made = {n: made(self.spark.read.schema(self.schemas[source]).parquet(f"{folder}/{source}")) for n, (source, made) in self.derived.items() if source in tables}
            list(pool.map(write, made, made.values()))
        dead = self._paths() if removed is None else removed.select(F.col("path").cast(self.path_type).alias("path"))
        for name in tables:
            dead = dead.unionByName(self.spark.read.schema(self.schemas[name]).parquet(f"{folder}/{name}").select("path"))
        sound = F.coalesce("path", F.raise_error(F.lit("a row without a path")).cast(self.path_type))
        dead.distinct().select(sound.alias("path")).write.parquet(f"{folder}/tombstones")
        return folder

    def _paths(self) -> DataFrame:
        return self.spark.createDataFrame([], f"path {self.path_type}")

    def _known(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        unknown = set(tables) - (set(self.schemas) - set(self.derived))
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        return tables

    def apply(self, tables: dict[str, DataFrame], removed: DataFrame | None = None, batch: int | None = None, more: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]] | None = None) -> bool:
        """Replaces the rows of all paths that ``tables`` bring and drops those of ``removed`` (path). False: the batch was applied before. ``more``
        makes further tables from those of this update, which it gets by name as they were written."""
        now = self.current()
        if batch is not None and batch <= now.batch:
            return False
        folder = self._write(self._known(tables), removed, more)
        self._name(Snapshot(now.version + 1, now.batch if batch is None else batch, (*now.segments, (now.next_place, folder)), now.next_place + 1))
        return True

    def _segments(self, snapshot: Snapshot, table: str, schema: str) -> DataFrame | None:
        """Rows of all segments that have the table, with their place."""
        out = None
        for place, folder in snapshot.segments:
            if exists(self.spark, f"{folder}/{table}"):
                rows = self.spark.read.schema(schema).parquet(f"{folder}/{table}").withColumn("_place", F.lit(place))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _tombstones(self, snapshot: Snapshot) -> int:
        """Rows of the segments' tombstones; each segment's are counted once, from the footers of its files."""
        for _, folder in snapshot.segments:
            if folder not in self._dead:
                self._dead[folder] = self.spark.read.schema(f"path {self.path_type}").parquet(f"{folder}/tombstones").count()
        return sum(self._dead[folder] for _, folder in snapshot.segments)

    def read(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """The live rows of a table in a snapshot (the newest, if none is given): those that no later segment replaces."""
        snapshot, schema = snapshot or self.current(), self.schemas[table]
        rows = self._segments(snapshot, table, schema)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        first = snapshot.segments[0][0]
        later = Snapshot(segments=tuple(s for s in snapshot.segments if s[0] > first))
        dead = None if table in self.derived else self._segments(later, "tombstones", f"path {self.path_type}")
        if dead is not None:
            dead = dead.groupBy("path").agg(F.max("_place").alias("_dead"))
            if self._tombstones(later) <= FEW:
                dead = F.broadcast(dead)
            rows = rows.join(dead, "path", "left").where(F.col("_dead").isNull() | (F.col("_place") >= F.col("_dead")))
        return rows.select(*StructType.fromDDL(schema).fieldNames())

    def merge(self) -> None:
        """Rewrites the live rows of all tables as one segment. What is applied meanwhile must wait for it (one writer)."""
        now = self.current()
        if len(now.segments) > 1:
            folder = self._write({t: self.read(t, now) for t in self.schemas if t not in self.derived}, None)
            self._name(Snapshot(now.version + 1, now.batch, ((now.next_place, folder),), now.next_place + 1))
