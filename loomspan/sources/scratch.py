"""The folder that driver and executors share, and tables that a job keeps there while it runs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a new local one, but on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Tables stored inside each ``removed_after`` that is under way, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, with shuffle files that nothing needs.  DataFrames that read them are void."""
    _scopes.append([])
    try:
        yield
    finally:
        files = Files(spark)
        for path in _scopes.pop():
            files.delete(path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of DataFrames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, outlives: bool = False) -> DataFrame:
    """``df`` as compressed columns in the shared folder; partitions are dealt anew.  ``outlives`` the innermost ``removed_after`` if wanted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    empty = [c for c, kind in df.dtypes if kind == "void"]
    files = df.drop(*empty)
    files.write.option("compression", "zstd").parquet(path)
    scopes = _scopes[:-1] if outlives else _scopes
    if scopes:
        scopes[-1].append(path)
    found = spark.read.schema(files.schema).parquet(path)
    return found.select(*(F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in df.columns)) if empty else found
