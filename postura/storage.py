"""Intermediate results that outlive an executor: checkpoints and tables in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder under the warehouse where that is unset (a laptop)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


#: Tables that written() has left behind in this process.
LEFT: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables that written() left behind, once the results that read them are stored.

    Checkpoints go by themselves where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    while LEFT:
        path = spark._jvm.org.apache.hadoop.fs.Path(LEFT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table, for readers that each need some of its columns."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    LEFT.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
