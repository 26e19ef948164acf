"""Incremental reading: records as they arrive in a folder, and running statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions import marc
from biblioflow.operators import rdf
from biblioflow.sources import codecs


def mrk(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """leader, fields and _error of mnemonic records, a bounded number of files in a batch."""
    text = spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", files_per_trigger).text(path).where("trim(value) <> ''")
    leader, fields, error = codecs.mrk_fields(F.col("value"))
    return text.select(leader.alias("leader"), fields.alias("fields"), error.alias("_error"))


def nquads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Statements of N-Triples and N-Quads files; malformed lines set _error."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rdf.parse_nquads(lines.withColumn("pos", F.monotonically_increasing_id()))


def tag_counts(records: DataFrame) -> DataFrame:
    """Running counts of records and tags; state grows with the number of tags, not of records."""
    keys = F.concat(F.array(F.lit("records")), F.transform("fields", lambda f: f["tag"]))
    return records.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def invalid(records: DataFrame) -> DataFrame:
    return records.select("*", marc.validate(F.col("leader"), F.col("fields")).alias("error")).where("error is not null")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs everything that is there now into Parquet files, exactly once across restarts."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
