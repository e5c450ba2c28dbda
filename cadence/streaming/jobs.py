"""Run a streaming plan to completion over landed files (``availableNow``),
with checkpoints and outputs under the shared checkpoint root."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cadence.plans.session import read_table, scratch_path
from cadence.streaming.streams import batch_name


def drain(stream: DataFrame, name: str, mode: str = "append",
          checkpoint: str | None = None) -> DataFrame:
    """Run ``stream`` with trigger(availableNow) and return all rows it put out.
    Each micro-batch writes its rows to a folder of its own, which a retry
    replaces, so nothing passes through the driver."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"out-{name}")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_name(batch, epoch_id)}")

    drain_foreach(stream, write, name, checkpoint, mode)
    written = read_table(spark, out)
    return spark.createDataFrame([], stream.schema) if written is None else written.drop("batch")


#: Fewest partitions of a stream's shuffles and state, should the cluster not have its executors yet.
LEAST_PARTITIONS = 8


@contextmanager
def _stream_partitions(spark: SparkSession):
    """A stream started in here has as many shuffle partitions as the cluster has cores (no more than are set).

    The number is fixed when a stream starts, nothing merges small ones, and each is a state store for
    every stateful step, which is written in every micro-batch however few rows came: with Spark's 200
    most of a batch is that.  A checkpoint that goes on keeps the number it began with."""
    key = "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    spark.conf.set(key, str(min(int(given), max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def drain_foreach(stream: DataFrame, fn, name: str, checkpoint: str | None = None, mode: str = "append") -> None:
    """Run ``stream`` with trigger(availableNow) through a foreachBatch
    function and wait for it."""
    spark = stream.sparkSession
    ck = checkpoint or scratch_path(spark, f"stream-{name}")
    with _stream_partitions(spark):
        q = (stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", ck)
                   .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
