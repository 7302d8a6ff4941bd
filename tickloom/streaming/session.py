"""Settings and folders streaming queries need."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tickloom.plans.staging import stage_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """Keyed state lives in RocksDB with changelog checkpoints, so it may exceed memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """New folder among the tables the application has staged; ``release`` removes it with them."""
    return f"{stage_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
