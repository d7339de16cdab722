"""Where intermediate and published tables go: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to a new folder and reads it back, so that later steps start from its files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most (some 50 MB).
FEW = 1_000_000


def broadcast_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A table of narrow rows, to be broadcast if it has at most so many; it is computed once more to count them."""
    return F.broadcast(df) if df.count() <= rows else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def version(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: their names, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return "/".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


class SnapshotTable:
    """A table published as whole snapshots: rows go to a new folder, then one row names it.

    Readers see the last named snapshot, never half of one; a failed write leaves no name.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def publish(self, rows: DataFrame, version: int) -> None:
        path = f"{self.root}/v{version}"
        rows.write.mode("overwrite").parquet(path)
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(path).alias("path")).coalesce(1).write.mode("append").parquet(f"{self.root}/names")

    def current(self) -> DataFrame:
        last = self.spark.read.parquet(f"{self.root}/names").agg(F.max_by("path", "version").alias("path")).first()
        return self.spark.read.parquet(last["path"])

    def upsert(self, rows: DataFrame, version: int, key: str = "path") -> None:
        """Rows replace those of the same key; all in one snapshot."""
        old = self.current()
        self.publish(old.join(rows, key, "left_anti").unionByName(rows), version)

    def publish_changed(self, rows: DataFrame, version: int) -> bool:
        """Publishes only if the content differs: the tables' order-free hashes are compared."""

        def digest(df: DataFrame):
            hashed = df.select(*sorted(df.columns)).select(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)").alias("h"))
            return hashed.agg(F.count(F.lit(1)), F.sum("h")).first()

        if digest(rows) == digest(self.current()):
            return False
        self.publish(rows, version)
        return True
