"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local folder serves one machine; on a cluster it would lose data, and is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in the shared folder: computed once, whole after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again; column pruning then holds for later reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.compression.codec.zstd.level", "6").parquet(path, compression=compression)
    return spark.read.parquet(path)


def released(spark: SparkSession) -> None:
    """Asks for what no plan holds any longer to be collected: Spark drops shuffle files only once the driver's garbage is, which can be long after they are read."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
