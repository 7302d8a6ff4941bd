"""Hand-off tables between job stages.

A table that several later steps read (the feature table, candidate orders, replay results) is
written once to the cluster's shared checkpoint folder and read back. That cuts the lineage, so
a lost executor costs a re-read and not a recomputation, and each reader prunes its own columns.

All tables of an application lie in one folder. ``release`` removes it when the results are written;
at the end of the application it is removed anyway.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()
_LOCAL: dict[str, str] = {}


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, with its scheme.

    ``spark.checkpoint.dir`` or the context's checkpoint folder, which all executors share by contract, whether
    or not the path names a scheme; without either the warehouse, in local mode a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        application = spark.sparkContext.applicationId
        root = _LOCAL.get(application) or _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    where, system = _hadoop_path(spark, root or spark.conf.get("spark.sql.warehouse.dir"))
    return system.makeQualified(where).toString()


def stage_folder(spark: SparkSession) -> str:
    """This application's folder below the root; removed when its driver ends."""
    folder = f"{stage_root(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        where, system = _hadoop_path(spark, folder)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _MARKED.add(folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    where, system = _hadoop_path(spark, path)
    system.delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove all tables this application staged; whatever still reads them fails from then on."""
    folder = stage_folder(spark)
    remove_folder(spark, folder)
    _MARKED.discard(folder)


def stage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the stage folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
