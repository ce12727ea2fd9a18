"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Session settings that suit the operators: small checkpoints that go when unused, no
# call-site capture for each column expression while plans are built, the order of arranged
# tables taken as given (else each scan sorts rows that are sorted), and few buckets at a time
# in memory where they are packed.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "32",
    _STATE_STORE: _ROCKSDB,
}


def keep_state_on_disk(spark: SparkSession) -> None:
    """Typed streaming state exists in RocksDB only; it also spills to disk."""
    if spark.conf.get(_STATE_STORE, None) != _ROCKSDB:
        spark.conf.set(_STATE_STORE, _ROCKSDB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in spark.checkpoint.dir.

    Only in local mode, where driver and executors share one machine, a folder is made if
    none is named; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegate-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is not planned again."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
