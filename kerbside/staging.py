"""Cutting lineage and checking sizes, for operators that need more than one job.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, which driver and
executors share. Where the setting is absent a folder of this process is used, in local mode only. A result
that is read lazily still needs its tables; when it has been read, :func:`release` removes those made since a :func:`mark`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of whole texts that go to a Python worker at a time. A batch is held several times over: as it grows in the JVM, on the way, and in Python.
TEXT_BATCH = 15 << 17

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; off local mode one must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="kerbside-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    _made.append(f"{shared_dir(spark)}/kerbside-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """A point in time for :func:`release`: how many folders there are so far."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove what this process has written here since a :func:`mark` (or ever), and return the number of folders; results that still read from them fail.

    One query at a time: ``since = mark()``, run it and read its result, ``release(spark, since)``. Tables of queries
    that began before stay.
    """
    gone = 0
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of jobs run meanwhile end at ``most`` bytes, where the session sets no size of its own. Rows are never cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The result survives lost executors, and what follows starts from the files, not from the plan.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_from_texts(df: DataFrame, label: str) -> DataFrame:
    """:func:`written`, for a table that Python workers make of whole texts: they get about ``TEXT_BATCH`` bytes at a time."""
    with arrow_batches(df.sparkSession, TEXT_BATCH):
        return written(df, label)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only if a *written* table has at most ``max_rows`` rows; else leave it to Spark's join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
