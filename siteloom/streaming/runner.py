"""Starting streams: file sources, state store, sinks in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siteloom.session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


FILES_PER_BATCH = 64


def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Stream the parquet files that ``pattern`` names in ``folder``; a name may be a file or a table's folder of files.

    A micro-batch is at most ``files_per_batch`` files: operators that put a key's rows of a micro-batch in order hold no more than those.
    """
    path = f"{folder}/{{{pattern}}}"  # as a glob, which may be a file: a plain path of a stream must be a folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State beyond executor memory: RocksDB keeps it on disk with changelog checkpoints."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_table(
    stream: DataFrame,
    name: str,
    output_mode: str = "append",
    partition_by: list[str] | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Process everything available, append to a parquet table in the shared folder, return it.

    With ``on_batch`` every micro-batch goes to that function instead, which writes to
    ``<table>/batch=<id>``; the folder of a repeated batch is overwritten, so a restart after
    a lost executor or driver does not double rows. ``progress`` takes the reports of the micro-batches
    (the last 100), among them the rows that the state holds.
    """
    spark = stream.sparkSession
    table, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    with rocksdb_state(spark):
        writer = stream.writeStream.option("checkpointLocation", marks).outputMode(output_mode).trigger(availableNow=True)
        if on_batch is None:
            writer = writer.format("parquet")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            query = writer.start(table)
        else:

            def save(batch: DataFrame, batch_id: int) -> None:
                on_batch(batch, batch_id).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

            query = writer.foreachBatch(save).start()
        query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
    if query.exception() is not None:
        raise query.exception()
    reader = spark.read if on_batch is not None else spark.read.schema(stream.schema)
    return reader.parquet(table)
