"""Incremental ingest of landed snapshot files into the history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelf.sources.tables import HISTORY_PARTITION, merge_history


def ingest_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
                  keys: list[str], ts: str, max_files: int | None = None) -> StreamingQuery:
    """Follow a folder of Parquet files and merge each micro-batch into the history table.

    The file source remembers the files it has read, which is the high-water mark. A batch rewrites
    only the (date, pincode) partitions it touches; within them the latest row per key stays. Running
    a batch again after a failure gives the same table.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source)

    def merge(batch: DataFrame, _epoch: int) -> None:
        merge_batch(batch, target, keys, ts)

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def merge_batch(batch: DataFrame, target: str, keys: list[str], ts: str) -> None:
    spark, old = batch.sparkSession, batch.limit(0)
    if table_exists(spark, target):
        touched = batch.select(*HISTORY_PARTITION).distinct()
        # joined on the partition columns, so only the touched partitions are read
        old = spark.read.schema(batch.schema).parquet(target).join(touched, HISTORY_PARTITION, "left_semi")
    merge_history(old.select(*batch.columns), batch, target, keys, ts)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
