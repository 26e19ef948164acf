"""Substring dedup by level-wise doubling of repeated word windows.

A window of n words that starts at two places of the corpus holds, at both, the same runs of n / 2 words. So the first
level looks at runs of half the length only, and of these at one for each window: the run of least hash (the leftmost
of equal ones), its anchor, which is the same wherever the window stands. Neighbouring windows share anchors, so about
one word in six starts one. Only windows whose anchor repeats are extended to the full length; while windows of one
length repeat they can be doubled again (``levels``), until no candidate is left.

At the full length, the stretch that the windows of one anchor cover is compared first. Where all stretches with an
anchor are equal, or a stretch equals an earlier one, its windows are settled as one. What is left, the first of each of
several different stretches around one anchor, is compared window by window, by 128-bit hashes.

Counts and firsts are aggregated before the shuffle, and joins have one row for each hash on one side, so a passage that
a third of all documents share does not land in one task. Bloom filters of a fixed size keep most of what does not repeat
out of the shuffles; when full they pass everything, and the joins behind them are exact.

Words are runs of bytes other than space and 0x09-0x0D, unchanged. Nulls: a null text has no words. A null doc_id comes
before all others. Rows with equal doc_id are told apart by a hash of the text (the smaller is earlier); rows equal in
both count as one document, and each gets its result. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import Runs, read, saved, text_blocks, word_hashes, words

WINDOW = 20
BLOOM_BITS = 1 << 27
_FIRST = -(2**63)


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit set of the long column `key`, one bit a key; its size is fixed, whatever the number of keys."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.floor(place / 32768).cast("long").alias("bucket"), place.alias("place"))
    rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(len(filter_) * 8 - 1)
    at = at.astype(np.int64)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1




class Anchors:
    """The anchors of all windows of a block: arrays with one entry for each anchor."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int):
        starts, ends, row = words(buf, off)
        n, half = len(starts), window // 2
        self.words = np.bincount(row, minlength=len(off) - 1) if n else np.zeros(len(off) - 1, np.int64)
        hashes = word_hashes(buf, starts, ends)
        self.first = np.r_[0, np.cumsum(self.words)[:-1]]
        i = np.arange(max(0, n - window + 1))
        i = i[row[i] == row[i + window - 1]] if len(i) else i
        self.runs = (Runs(hashes, 0), Runs(hashes, 1))
        if not len(i):
            self.row = self.hash = self.span = self.at = self.low = self.high = np.zeros(0, np.int64)
            return
        grams = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
        j = np.arange(n - half + 1)
        grams[: len(j)] = self.runs[0](j, j + half)
        # the leftmost least of half + 1 neighbouring runs
        best = i.copy()
        for k in range(1, window - half + 1):
            less = grams[i + k] < grams[best]
            best[less] = i[less] + k
        new = np.r_[True, (best[1:] != best[:-1]) | (i[1:] != i[:-1] + 1)]
        k = np.flatnonzero(new)
        last = np.r_[k[1:] - 1, len(i) - 1]
        at, low, high = best[k], i[k], i[last]
        self.row, self.hash = row[at], grams[at].view(np.int64)
        span = self.runs[1](low, high + window) ^ ((at - low).astype(np.uint64) << np.uint64(8))
        self.span = span.view(np.int64)
        base = self.first[self.row]
        self.at, self.low, self.high = at - base, low - base, high - base


def _order(docs: DataFrame) -> DataFrame:
    """(id, mark, text, given): id is never null (given may be), mark tells texts of equal id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(given, F.lit(_FIRST)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), given.alias("given"))


def _anchors(docs: DataFrame, window: int, passed: np.ndarray | None = None) -> DataFrame:
    """(hash, span, id, mark, low, high) of every anchor, or only (hash) where no filter is given yet."""
    sent = None if passed is None else docs.sparkSession.sparkContext.broadcast(passed)

    def run(batches):
        for batch in batches:
            for i, _, buf, off in text_blocks(batch.column(0), batch.column(2)):
                a = Anchors(buf, off, window)
                if sent is None:
                    yield pa.RecordBatch.from_arrays([pa.array(a.hash)], ["hash"])
                    continue
                keep = holds(sent.value, a.hash)
                at = pa.array(i + a.row[keep])
                cols = [pa.array(x[keep]) for x in (a.hash, a.span)] + [batch.column(0).take(at), batch.column(1).take(at)]
                cols += [pa.array(x[keep].astype(np.int32)) for x in (a.low, a.high)]
                yield pa.RecordBatch.from_arrays(cols, ["hash", "span", "id", "mark", "low", "high"])

    return docs.mapInArrow(run, "hash long" if sent is None else "hash long, span long, id long, mark long, low int, high int")


_PLACE = ("id", "mark", "low")


def _place() -> Column:
    return F.struct(*_PLACE)


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h1, h2, id, mark, low) of every window that starts in wanted's (id, mark, low, high) stretches."""
    lists = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))

    def run(batches):
        for batch in batches:
            stretches = batch.column(3).to_pylist()
            for i, j, buf, off in text_blocks(batch.column(0), batch.column(2)):
                starts, ends, row = words(buf, off)
                hashes = word_hashes(buf, starts, ends)
                runs = (Runs(hashes, 0), Runs(hashes, 1))
                first = np.searchsorted(row, np.arange(j - i))
                rows, lows = [], []
                for r in range(j - i):
                    own = [np.arange(s["low"], s["high"] + 1) for s in stretches[i + r]]
                    at = np.concatenate(own) if own else np.zeros(0, np.int64)
                    rows.append(np.full(len(at), r))
                    lows.append(at)
                rows, lows = np.concatenate(rows), np.concatenate(lows)
                at = first[rows] + lows
                whole = pa.array(i + rows)
                cols = [pa.array(run_(at, at + window).view(np.int64)) for run_ in runs]
                cols += [batch.column(0).take(whole), batch.column(1).take(whole), pa.array(lows.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "id", "mark", "low"])

    return docs.join(lists, ["id", "mark"]).select("id", "mark", "text", "stretches").mapInArrow(run, "h1 long, h2 long, id long, mark long, low int")


def _doc_filter(rows: DataFrame) -> np.ndarray:
    return bloom(rows.select(F.xxhash64("id", "mark").alias("key")).distinct(), 1 << 24)


def _only(docs: DataFrame, filter_: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows of _order() that a filter of documents holds (or does not)."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for batch in batches:
            have = holds(sent.value, batch.column(4).to_numpy())
            yield batch.select([0, 1, 2, 3]).filter(pa.array(have == keep))

    return docs.withColumn("key", F.xxhash64("id", "mark")).mapInArrow(run, "id long, mark long, text string, given long")


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, mark, low, high): stretches of window starts whose windows all also start earlier. docs: (id, mark, text)."""
    again = saved(_anchors(docs, window).groupBy("hash").count().where("count > 1").select("hash"), "anchors")
    rows = _anchors(docs, window, bloom(again.select(F.col("hash").alias("key"))))
    rows = saved(rows.join(again, "hash", "left_semi"), "stretches")
    # aggregates are written before they are joined again: a join of two shuffles can split a hash that many rows share
    kinds = rows.groupBy("hash").agg(F.min("span").alias("s0"), F.max("span").alias("s1"), F.min(_place()).alias("first"))
    rows = rows.join(saved(kinds, "kinds"), "hash")
    equal = rows.where("s0 = s1").where(_place() != F.col("first")).select("id", "mark", "low", "high")
    mixed = saved(rows.where("s0 <> s1").select("hash", "span", "id", "mark", "low", "high"), "mixed")
    firsts = saved(mixed.groupBy("hash", "span").agg(F.min(_place()).alias("first")), "firsts")
    mixed = mixed.join(firsts, ["hash", "span"])
    settled = mixed.where(_place() != F.col("first")).select("id", "mark", "low", "high")
    open_ = saved(mixed.where(_place() == F.col("first")).select("id", "mark", "low", "high").distinct(), "open")
    some = _only(docs, _doc_filter(open_)).dropDuplicates(["id", "mark"])
    windows = saved(_windows(some, open_, window), "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = windows.join(saved(earliest.drop("n"), "earliest"), ["h1", "h2"]).where(_place() != F.col("first")).select("id", "mark", "low", F.col("low").alias("high"))
    return equal.unionByName(settled).unionByName(late)


def levels(docs: DataFrame, start: int = WINDOW, most: int = 1 << 20) -> DataFrame:
    """(words, stretches): how many stretches of windows repeat at start words, twice as many, and so on until none does."""
    spark, own, out, n = docs.sparkSession, _order(docs).dropDuplicates(["id", "mark"]), [], start
    own = saved(own, "documents")
    while n <= most:
        count = repeated(own, n).distinct().count()
        if not count:
            break
        out.append((n, count))
        n *= 2
    return spark.createDataFrame(out, "words int, stretches long")


_RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def _kept(rows: DataFrame, window: int, with_lists: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            total, gone, shas = [], [], []
            lists = batch.column(1).to_pylist() if with_lists else [None] * batch.num_rows
            for text, stretches in zip(batch.column(2).to_pylist(), lists):
                w = text.encode("utf-8", "surrogatepass").split()
                total.append(len(w))
                if stretches:
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, [s["low"] for s in stretches], 1)
                    np.add.at(edge, [s["high"] + window for s in stretches], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    w = [w[k] for k in np.flatnonzero(keep).tolist()]
                gone.append(total[-1] - len(w))
                shas.append(hashlib.sha256(b" ".join(w)).hexdigest())
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, _RESULT)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    own = _order(docs)
    stretches = saved(repeated(own, window).distinct(), "repeats")
    touched = _doc_filter(stretches)
    plain = _kept(_only(own, touched, False).select(F.col("given").alias("id"), F.lit(None).cast("int").alias("x"), "text"), window, False)
    lists = stretches.groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    cut = _kept(_only(own, touched).join(lists, ["id", "mark"], "left").select(F.col("given").alias("id"), "stretches", "text"), window, True)
    out = plain.unionByName(cut)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))
