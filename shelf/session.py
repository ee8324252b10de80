"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "shelf", cpus: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (builder.config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.driver.memory", memory)
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a scratch folder serves a local master. On a cluster each executor would write
    to a disk of its own, so there an unset folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not is_local(context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="shelf-checkpoint-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return current


def is_local(master: str) -> bool:
    """Whether driver and executor are one process (local-cluster is not local)."""
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder as Parquet and continue from the written table.

    Used where an intermediate result feeds several later joins: without it each of them
    would compute it again. The table lives in shared storage, so it survives the loss of
    executors; being Parquet, later reads take only the columns they need and its known
    size lets the optimizer choose the join. ``delete_written`` removes the tables.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "shelf")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Fixed value: times by which rows in the driver's memory may exceed their compressed files.
FILE_TO_ROWS = 40


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, a side of a join is broadcast if its rows are found to be few when it is shuffled; files count as ``FILE_TO_ROWS`` times their size.

    Outside, the size of a file decides, and the driver has to hold what it broadcasts. For runs that write their results
    inside; what is run later follows the session's settings.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    before = {key: spark.conf.get(key, None) for key in (planned, measured)}
    if limit > 0:
        spark.conf.set(planned, limit // FILE_TO_ROWS)
        if before[measured] is None:
            spark.conf.set(measured, limit)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def discard(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``table``, which nothing reads any more, before the job ends."""
    _WRITTEN.remove(table.written_to)
    _delete(table.sparkSession, table.written_to)


#: Folders written by this driver and not yet deleted.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage for what is written and read back; ``delete_written`` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def delete_written(spark: SparkSession) -> int:
    """Delete what this driver wrote to folders of ``scratch_path``, once no result needs it; returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def _delete(spark: SparkSession, written: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
