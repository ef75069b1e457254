"""What several operators of this subpackage share: the shared folder and table reuse."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the folder the cluster shares (spark.checkpoint.dir).

    Only where that setting is missing on one machine, as in tests, a local folder takes its place; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gridspectra-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from `written` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a task has freed back to the machine; workers live on between tasks, and idle ones would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What worker processes keep between tasks, by the functions that `kept` has wrapped.
KEPT: list[Callable] = []


def kept(make: Callable) -> Callable:
    """`make`, whose last result a worker process keeps for later tasks, until a task begins there that does not use it."""
    KEPT.append(lru_cache(maxsize=1)(make))
    return KEPT[-1]


def forget(uses: tuple[Callable, ...] = ()) -> None:
    """Drop what this process keeps by other functions than `uses`: workers go from operator to operator, and hold one's tables only."""
    idle = [held for held in KEPT if held.cache_info().currsize and not any(held is own for own in uses)]
    for held in idle:
        held.cache_clear()
    if idle:
        gc.collect()
        release()


def released(run: Callable, *uses: Callable) -> Callable:
    """`run`, a function from batches to batches, that gives memory back at its end, and before it what is `kept` by other functions than `uses`."""

    def whole(batches):
        forget(uses)
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def fresh(names: list[str], name: str) -> str:
    """`name`, with as many underscores behind it as make it none of `names`: input columns keep their names, added ones give way."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
