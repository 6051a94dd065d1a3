"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is set, a new local one, but on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_made: list[Workspace] = []


@contextmanager
def removed_after() -> Iterator[None]:
    """Files of workspaces made inside are removed at the end.  Write what is to stay before; DataFrames that read them are void."""
    mark = len(_made)
    try:
        yield
    finally:
        for ws in _made[mark:]:
            ws.drop("")
        del _made[mark:]


class Workspace:
    """Parquet tables that cut lineage: a lost executor never forces an earlier phase to run again.

    ``save`` writes a DataFrame and returns one that reads the files; ``drop`` removes files that no
    later phase reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of DataFrames that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """``run`` of mapInArrow or applyInArrow; its buffers go back to the system when it ends.

    Python workers are used again by later tasks, and would hold what their largest task held.
    """

    def end(out):
        if isinstance(out, Iterator):
            return _until_end(out)
        _trim()
        return out

    if run.__code__.co_argcount == 2:
        return lambda left, right: end(run(left, right))
    return lambda rows: end(run(rows))


def _until_end(out: Iterator) -> Iterator:
    yield from out
    _trim()


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each has about ``rows_each`` rows, and never fewer than the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def small_side(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows have at most ``most`` bytes, and as it is (to be shuffled) if not."""
    wide = [c for c, kind in df.dtypes if kind in ("binary", "string")]
    fixed = 8 * len(df.columns)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(fixed).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df
