"""Records of a stream numbered by source over all its micro-batches, and errors that last.

A record without a name of its own is named after its place in its source, so places must not depend on how the source was cut into batches, nor on
restarts. Each batch is numbered as a table: rows are dealt out in ranges of (source, order), counted within ranges, and ranges are summed, so that one source
may fill a batch. What is carried from batch to batch is one row a source: its next number, and its first error. It is written beside the batch's
rows under the number of the batch, so a batch that runs again, after a failure, writes the same rows in the same place again.

With ``sticky`` a source ends at its first bad record: that record keeps its own error, and every later one, in this batch or any other, has it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.functions.shared import saved


def _folder(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}/batch={batch:012d}"


def number(rows: DataFrame, source: str, order: list[str], before: DataFrame | None = None, sticky: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with ``index``, counted from 0 within each source in the order of some columns, and (source, next, error) to go on from. before: the same of
    what came earlier."""
    dealt = rows.repartitionByRange(source, *order).withColumn("__part", F.spark_partition_id())
    dealt = saved(dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__part", source).orderBy(*order)) - 1), "dealt")
    counts = dealt.groupBy(source, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(source).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(source).alias("__source"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    known = rows.sparkSession.createDataFrame([], f"__known {rows.schema[source].dataType.simpleString()}, __next long, __error string")
    if before is not None:
        known = before.select(F.col(source).alias("__known"), F.col("next").alias("__next"), F.col("error").alias("__error"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = dealt.join(starts, same(source, "__source") & (F.col("__part") == F.col("__p"))).join(known, same(source, "__known"), "left")
    out = out.withColumn("index", (F.coalesce("__next", F.lit(0)) + F.col("__before") + F.col("__in")).cast("long"))
    out = saved(out.select(*[F.col(f"`{c}`") for c in rows.columns], "index", "__error"), "indexed")
    own = F.col("_error") if "_error" in rows.columns else F.lit(None).cast("string")
    ends = out.groupBy(source).agg((F.max("index") + 1).alias("next"), F.coalesce(F.max("__error"), F.min_by(own, F.when(own.isNotNull(), F.col("index")))).alias("error"), F.min(F.when(own.isNotNull(), F.col("index"))).alias("__at"))
    if sticky:
        first = ends.select(F.col(source).alias("__s"), F.col("error").alias("__first"), "__at")
        out = out.join(first, same(source, "__s"))
        late = F.when(F.col("__error").isNotNull() | (F.col("index") > F.col("__at")), F.col("__first"))
        out = out.withColumn("_error", F.coalesce(late, own))
    out = out.select(*[F.col(f"`{c}`") for c in rows.columns], "index")
    state = ends.select(source, "next", "error")
    if before is not None:
        state = state.unionByName(before.join(ends.select(F.col(source).alias("__s")), same(source, "__s"), "left_anti"))
    return out, state


def drain(stream: DataFrame, path: str, checkpoint: str, source: str, order: list[str], sticky: bool = False) -> None:
    """Numbers everything that is there now into Parquet files under path, each record once, going on from earlier runs."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(_folder(path, "state", batch_id - 1)) if batch_id else None
        rows, state = number(batch, source, order, before, sticky)
        rows.write.mode("overwrite").parquet(_folder(path, "rows", batch_id))
        state.write.mode("overwrite").parquet(_folder(path, "state", batch_id))

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")
