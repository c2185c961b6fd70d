"""Running a streaming plan over what is there, to a table, with a checkpoint that a later run continues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
_UPKEEP = "spark.sql.streaming.stateStore.maintenanceInterval"
#: Partitions of a state on few cores. Opening and committing one takes a task about half a second a batch, and 4 MB of local disk, whatever it holds.
STATE_PARTITIONS = 6


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB while inside, as ``transformWithState`` needs; a batch commits what changed.

    A stream that begins here has as many state partitions as the cluster has cores, at least ``STATE_PARTITIONS``, but
    no more than the session's shuffle partitions: those follow the size of tables, a batch's state does not. A checkpoint
    keeps the number that it began with. States of runs that have ended are soon closed.
    """
    few = min(int(spark.conf.get(_PARTITIONS)), max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _CHANGELOG: "true", _UPKEEP: "10s", _PARTITIONS: str(few)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_available(build: Callable[[DataFrame], DataFrame], source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """STR-10: begin to process all files that are there, to append the result to ``out`` and to stop then; the checkpoint makes reruns continue."""
    with rocksdb(source.sparkSession):
        return build(source).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def run_available(build: Callable[[DataFrame], DataFrame], source: DataFrame, out: str, checkpoint: str) -> None:
    """STR-10: :func:`start_available`, and wait for its end."""
    start_available(build, source, out, checkpoint).awaitTermination()
