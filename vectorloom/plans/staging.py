"""Tables written to the folder that all executors share, to cut lineage.

The folder lies in the session's ``spark.checkpoint.dir``. Where that is unset, a session whose master
is local takes a folder under /tmp; on a cluster each executor would write to its own disk there, so it
is refused. All tables of one application lie in one folder, which goes when the application ends;
operators ``unstage`` earlier what no later plan reads, and ``release`` drops whatever is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter

CHECKPOINT_DIR = "spark.checkpoint.dir"
LOCAL_DIR = "/tmp/vectorloom-staging"
#: While a table is written: shuffle files of its plan go as soon as it is there, and what goes to Python
#: at once is bounded by bytes, not by rows alone, which may be long.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8000000"}
#: Bytes of input that one task is meant to hold.
TASK_BYTES = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staging tables."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidParameter(CHECKPOINT_DIR, "is unset: staging tables need a folder that all executors share")
        spark.conf.set(CHECKPOINT_DIR, LOCAL_DIR)
        spark.sparkContext.setCheckpointDir(LOCAL_DIR)
        found = LOCAL_DIR
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; Hadoop deletes it when the application ends."""
    folder = f"{shared_dir(spark)}/vectorloom-{spark.sparkContext.applicationId}"
    fs, path = _on_disk(spark, folder)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def _on_disk(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staging tables that no later plan reads."""
    for df in tables:
        fs, path = _on_disk(df.sparkSession, df._staged_at)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all staging tables of this application: results that still read from them are lost."""
    fs, path = _on_disk(spark, own_dir(spark))
    fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle partition count that the cluster is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, column: str, task_bytes: int = TASK_BYTES) -> int:
    """Partitions in which each holds about ``task_bytes`` of a text column, at least one a core; measured by one aggregate."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(-(-size // task_bytes), min(df.sparkSession.sparkContext.defaultParallelism, partitions(df.sparkSession)))
