"""Tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may go without one; it then gets a folder in /tmp."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        # a folder without a scheme is on the cluster's own file system, as Spark takes it
        plain = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///") if known.startswith("/") else "file:///"
        return (known if plain.startswith("file:") else plain.rstrip("/") + known).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/biblioflow-checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
