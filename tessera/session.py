"""Session defaults for local runs and the shared scratch location."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: list[str] = []
_SCOPES = threading.local()


def local_session(app: str = "tessera", cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A cluster names a shared folder in that setting. Where it is unset a temporary
    folder of this machine serves a local master, and goes when Python ends; on any
    other master it would be a different folder on each executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="spark-"))
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
        root = _LOCAL_SCRATCH[0]
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    if keep := getattr(_SCOPES, "open", None):
        keep[-1].append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that are made inside, when it ends.

    For steps whose result is small and written with ``lasting=True``: what led to it
    need not stay on the shared disk until the session ends.
    """
    stack = _SCOPES.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df, purpose: str, partition_by: tuple[str, ...] = (), lasting: bool = False):
    """Write a frame to the shared scratch folder and read it back.

    Used where several actions need one expensive result: unlike a cache the
    written table survives the loss of executors. A ``lasting`` one also survives the
    end of ``intermediate_tables``.
    """
    path = scratch_dir(df.sparkSession, purpose)
    if lasting and getattr(_SCOPES, "open", None):
        _SCOPES.open[-1].remove(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
