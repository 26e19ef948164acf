"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its components that are not zero, each under its dimension, which plays the term. Candidates are dealt into
lanes and queries into groups, both of bounded size, and each pair of a lane and a group is one task's unit. There the postings of
one dimension after the other (the candidates that have it, with their weights) are multiplied by the weights of the queries that
have it and scattered into the queries' dense score arrays; a partition selection takes the k best of each array, with
all ties at its edge settled by vec_id, and the units' selections are merged. Nothing is skipped or estimated.

Each lane is sent once for each group and each group once for each lane, as blocks of a stated query set against all
rows; both are far less work than the products themselves.

Components are floor(scale * x) of x as double, as longs (beyond their range: its ends; products wrap like Java's). Vectors that are null, or hold a null
or a component that is not finite, take no part, nor do rows without a vec_id. Missing components count as zero, so vectors of
other lengths and empty ones can be compared. Rows that share a vec_id are one candidate and one query, of the highest score among
them, and never each other's results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.llm.common import read, saved

K = 5
SCALE = 256
#: Components in a lane of candidates or a group of queries: 32 MB each.
UNIT = 4 << 20
#: A lane has so many rows at least before more lanes than needed are made to keep all cores busy.
LEAST_ROWS = 512
#: Scores in the arrays that are filled at a time.
CELLS = 1 << 18
#: Whole arrays are added where at least one in so many scores gets something; fewer are scattered one by one.
DENSE = 8


def weights(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, w): the weights of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(F.forall("x", finite), F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("w"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their weights, a row for each dimension."""
    lists = table.column("w").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], table.schema.field("w").type)
    ends = lists.offsets.to_numpy().astype(np.int64)
    count = np.diff(ends)
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    out = np.zeros((int(count.max(initial=0)), len(ids)), np.int64)
    row = np.repeat(np.arange(len(ids)), count)
    out[np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], count), row] = lists.values.to_numpy()[ends[0] : ends[-1]]
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(out[:, order])


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of each query (row) and candidate (column), summed dimension by dimension over the postings of those that have it."""
    dims = min(len(queries), len(candidates))
    high = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    kind = np.int32 if high(queries) * high(candidates) * max(dims, 1) < 1 << 31 else np.int64
    scores = np.zeros((queries.shape[1], candidates.shape[1]), kind)
    part = np.empty_like(scores)
    for q, c in zip(queries.astype(kind), candidates.astype(kind)):
        asked, posted = np.count_nonzero(q), np.count_nonzero(c)
        if DENSE * asked * posted >= scores.size:  # most have it: those that have not add zeros
            np.multiply(q[:, None], c[None, :], out=part)
            scores += part
        elif asked and posted:
            has, held = np.flatnonzero(q), np.flatnonzero(c)
            scores[np.ix_(has, held)] += q[has, None] * c[None, held]
    return scores


def _firsts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties by place; ids ascend."""
    n = len(scores)
    if n > k:
        places = np.flatnonzero(scores >= np.partition(scores, n - k)[n - k])
    else:
        places = np.arange(n)
    return places[np.argsort(-scores[places].astype(object) if scores.dtype == np.int64 else -scores[places].astype(np.int64), kind="stable")][:k]


def unit(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): each query's k best of the candidates, but for its own id."""
    cid, c = _matrix(candidates)
    qid, q = _matrix(queries)
    groups, starts = _firsts(cid), _firsts(qid)
    out_q, out_c, out_s = [], [], []
    step = max(1, CELLS // max(1, len(cid)))
    cuts = np.r_[starts, len(qid)]
    i = 0
    while i < len(starts) and len(cid):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + step, side="right")) - 1)
        scores = accumulate(q[:, cuts[i] : cuts[j]], c)
        if len(groups) < len(cid):  # the best of the rows that share an id
            scores = np.maximum.reduceat(scores, groups, axis=1)
        if j - i < len(scores):
            scores = np.maximum.reduceat(scores, starts[i:j] - cuts[i], axis=0)
        for own, row in zip(qid[starts[i:j]].tolist(), scores):
            places = best(cid[groups], row, k + 1)
            found = cid[groups][places]
            keep = np.flatnonzero(found != own)[:k]
            out_q.append(np.full(len(keep), own))
            out_c.append(found[keep])
            out_s.append(row[places][keep].astype(np.int64))
        i = j
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s)]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols)})


def _dealt(rows: DataFrame, parts: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)).cast("int"))


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of weights() rows: the k best of all vectors for each one for which is_query holds."""
    rows = saved(vectors, "weights")
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    (n, values), (m, asked) = size(rows), size(rows.where(is_query))
    busy = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    lanes, groups = max(1, busy, -(-values // UNIT)), max(1, -(-asked // UNIT))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(int(count) - 1)))
    left = saved(_dealt(rows, lanes, "lane"), "lanes").withColumn("group", every(groups)).groupBy("lane", "group")
    right = saved(_dealt(rows.where(is_query), groups, "group"), "groups").withColumn("lane", every(lanes)).groupBy("lane", "group")
    met = left.cogroup(right).applyInArrow(lambda c, q: unit(q, c, k), "query_id long, vec_id long, score long")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(weights(read(spark, sf_dir, "embeddings")), F.pmod("vec_id", F.lit(50)) == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.w, c.w))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
