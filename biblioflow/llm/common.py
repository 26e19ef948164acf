"""What the corpus operators share: reading tables, shared storage, Arrow text blocks and vectorised word hashing.

Nothing here keeps state on a machine: intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can read again after an executor is lost.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts average a few kB, so a batch stays near ten MB.
BATCH_ROWS = 1000
#: UTF-8 bytes that the vectorised helpers take at a time (a longer text is taken whole, by itself).
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share. Only a local session may go without one; it then gets a folder in /tmp."""
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


def fold(column: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


#: Ranges of rows are at most so many; beyond, each holds more bytes. What a task does with a range is a stream.
MOST_RANGES = 1 << 16


def byte_cuts(sizes: DataFrame, each: int) -> list[tuple[bool, int, int]]:
    """Cuts of (key, mark, size) rows, in the order of key (null first), then mark, into ranges of about `each` bytes: (not
    null, key, mark) of the first row of each range but the first one. Bytes are summed within ranges of rows, then over
    the ranges' totals, so that any dealing into ranges gives the same cuts. Rows alike in key and mark are not parted."""
    order = ["some", "key", "mark"]
    rows = sizes.select(F.col("key").isNotNull().alias("some"), F.coalesce("key", F.lit(0)).alias("key"), "mark", "size")
    sums = saved(rows.groupBy(*order).agg(F.sum("size").alias("size")).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sums")
    totals = sorted((r["range"], r["size"]) for r in sums.groupBy("range").agg(F.sum("size").alias("size")).collect())
    total, before = 0, []
    for k, size in totals:
        before.append((k, total))
        total += size
    size = max(each, -(-total // MOST_RANGES))
    if total <= size:
        return []
    start = F.broadcast(sizes.sparkSession.createDataFrame(before, "range int, before long"))
    run = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.join(start, "range").withColumn("cut", F.floor((F.col("before") + F.coalesce(run, F.lit(0))) / size))
    firsts = sums.groupBy("cut").agg(F.min(F.struct(*order)).alias("first")).where("cut > 0").collect()
    return sorted((r["first"]["some"], r["first"]["key"], r["first"]["mark"]) for r in firsts)


def cut_number(cuts: list[tuple[bool, int, int]], key: Column, mark: Column) -> Column:
    """The number of cuts at or before a row. Only key and mark go to Python."""
    if not cuts:
        return F.lit(0)

    @F.arrow_udf("int")
    def of(key: pa.Array, mark: pa.Array) -> pa.Array:
        rows = zip(key.to_pylist(), mark.to_pylist())
        return pa.array([bisect.bisect_right(cuts, (False, 0, m) if k is None else (True, k, m)) for k, m in rows], pa.int32())

    return of(key, mark)


def text_blocks(ids: pa.Array, texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows; a null text is empty. Every row is in one block."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, _inverse(base), np.uint64)
        down[0] = 1
        have = _POWERS[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row of each word: a run of bytes other than space and 0x09-0x0D within a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever its place."""
    up, down = powers(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Runs:
    """Hashes of runs of words: run(i, j) hashes words i to j - 1 of a block, alike wherever the run stands."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        base = _BASES[which]
        up, self.down = powers(base, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(which + 1)) * up[: len(hashes)], out=self.total[1:])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.total[j] - self.total[i]) * self.down[i] + (j - i).astype(np.uint64))


def shingles(hashes: np.ndarray, row: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words within a row; a row of fewer words has one, its whole sequence."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = Runs(hashes, which)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    i = np.arange(n)
    last = np.repeat(first + count, count)
    short = np.repeat(count < k, count)
    keep = (i + k <= last) | (short & (i == np.repeat(first, count)))
    i = i[keep]
    return run(i, np.minimum(i + k, last[keep])), row[i]
