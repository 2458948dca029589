"""Folders that driver and executors share, files by Hadoop's file systems, and the package in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A path that does not exist yet, in the folder that spark.checkpoint.dir names; without one, local sessions use a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="scratch-")
    return f"{named}/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def first_signs(spark: SparkSession, path: str) -> list[str]:
    """The first character of each file at ``path`` (a file, a folder or a pattern) that is neither blank nor a byte order mark;
    an empty text for a file without any. Only what comes before it is read."""
    at, system = _at(spark, path)
    out, todo = [], list(system.globStatus(at) or [])
    while todo:
        status = todo.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            todo += [x for x in system.listStatus(status.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        elif name:
            stream = system.open(status.getPath())
            try:
                sign = b""
                while not sign and (part := bytes(stream.readNBytes(65_536))):
                    sign = part.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
            finally:
                stream.close()
            out.append(sign.decode("latin-1"))
    return out


def in_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it; on a cluster it is installed there or sent with --py-files."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
