"""Tables that cut lineage: written to the folder that the cluster shares, then read again.

The folder is named by ``spark.checkpoint.dir``. Where that is unset (tests on
one machine) a temporary folder is used. Nothing here writes anywhere else.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A temporary one will do only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def write(df: DataFrame, name: str) -> str:
    """Writes a table to a new folder and returns its path."""
    path = f"{shared_dir(df.sparkSession)}/parlance-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back, so that later steps start from its files."""
    path = write(df, name)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[got] = path
    return got


def drop(*frames: DataFrame) -> None:
    """Removes stored tables that no frame still to be computed reads."""
    for df in frames:
        remove(df.sparkSession, _paths.pop(df))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
