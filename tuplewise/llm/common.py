"""What the operators share: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of the written files, of a side that may be broadcast; beyond either the same join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000
#: Rows and bytes of one Arrow batch, so that a Python worker holds few texts at once.
TEXT_BATCH, TEXT_BYTES = 512, 4_000_000

T = TypeVar("T")
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Before a Python stage: bound Arrow batches by rows and bytes (one row can be larger) and let workers find this package.

    Workers look where the driver has it; on a cluster it is installed there or sent with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local session without one gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and the files outlive executors.

    The files go when the session ends, or earlier by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at, files = _files(df.sparkSession, folder)
            if at.getParent().getName() == "tables":
                files.delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised ``df`` of at most ``rows`` rows in files of ``size`` bytes; else leave the join to shuffle."""
    paths = [_files(df.sparkSession, f) for f in df.inputFiles()]
    if sum(files.getFileStatus(at).getLen() for at, files in paths) > size:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What this Python worker keeps between tasks, of one operator at a time.
_kept: dict = {}


def keep(operator: str, key: object, make: Callable[[], T]) -> T:
    """This worker's object for ``key``, made once.

    What was kept before goes first and its memory is given back: workers are used
    again by later stages, which should not pay for what earlier ones held.
    """
    if (operator, key) not in _kept:
        _kept.clear()
        gc.collect()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)
        _kept[operator, key] = make()
    return _kept[operator, key]


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
