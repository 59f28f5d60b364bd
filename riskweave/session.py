"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcasts are chosen by Spark from measured sizes, never forced on tables that grow:
# below these thresholds a dimension is shipped whole, above them the join shuffles and
# adaptive execution splits the skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Needed by the stream jobs only.
STREAM_SETTINGS = {
    # Rows behind the watermark must be dropped, also in the batch right after it moved.
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Scratch folders of local sessions that name no shared folder, by application.
_LOCAL_DIRS: dict[str, str] = {}


def apply_settings(spark: SparkSession, streaming: bool = False) -> SparkSession:
    """Put the settings above on a running session."""
    for key, value in (SETTINGS | STREAM_SETTINGS if streaming else SETTINGS).items():
        spark.conf.set(key, value)
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Make zone-less timestamps mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only by local sessions that name none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="riskweave-")
        return _LOCAL_DIRS[app]
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def working_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder of the shared folder."""
    return os.path.join(shared_dir(spark), "riskweave", f"{purpose}-{uuid.uuid4().hex}")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and read it back."""
    path = working_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
