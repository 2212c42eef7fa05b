"""Materialised tables in the folder that driver and executors share.

Iterative operators cut their lineage here.  A table written to the shared
checkpoint folder survives the loss of any executor, unlike cached or
local-checkpointed blocks, and is column-pruned when it is read again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no checkpoint folder, as in unit tests.
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session whose tasks all run in this process may leave it unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


#: Paths of tables that this process has written and not dropped.
_written: set[str] = set()


class Table:
    """A written intermediate result: ``df`` reads it, ``drop()`` deletes its files, ``watched`` is the count asked for."""

    def __init__(self, spark: SparkSession, path: str, schema, watched: int | None = None):
        self.spark, self.path, self.watched = spark, path, watched
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def write_table(df: DataFrame, name: str = "table", watch: str | None = None) -> Table:
    """Compute ``df`` once into the shared folder; the plan of the result is a file scan.

    ``watch`` is a condition whose rows are counted in the same pass, so that
    loops need no job of their own to see whether they are done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    seen = Observation() if watch else None
    if seen:
        df = df.observe(seen, F.count(F.when(F.expr(watch), True)).alias("n"))
    df.write.parquet(path)
    return Table(spark, path, df.schema, seen.get["n"] if seen else None)


def read_tables(tables: Sequence[Table]) -> DataFrame:
    """All rows of several tables of one schema, in one scan."""
    return tables[0].spark.read.schema(tables[0].df.schema).parquet(*(t.path for t in tables))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted by ``clear``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    return write_table(df, name).df


def written() -> set[str]:
    """Paths of what this process has written and not dropped."""
    return set(_written)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this process has written; DataFrames that read them become invalid."""
    for path in written():
        drop_path(spark, path)
