"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

A document's score for an item is the sum of the partial scores of the item's terms; a term's postings hold every document's
partial score for it. They are saved in the order of term, then falling partial score, in ranges of even size, so
that a long list lies in many files and a list's head in one.

1. The first k postings of every list give sums that the k-th best document of an item reaches at least: tau.
2. A document that is below tau / m in each of the item's m lists is below tau as a whole, so every list is read down to
   the uniform threshold ceil(tau / m). A list is first cut at the lowest threshold of all items that use it. What is left is dealt
   out by documents and summed there. The sums seen raise tau, and documents whose unseen lists could not lift them there go.
3. The rest are looked up in all lists of their item, and their exact scores ranked.

All of it is integer arithmetic and every bound is kept with its ties, so the result is the exhaustive one. Texts are cut
into terms and counted row by row in Arrow batches; only terms that may stand in an item (a bitmap of fixed size tells) leave the
scan. The rest is joins and sums on evenly spread keys, or on terms, where each posting meets one row.

Nulls: a null or termless text is no document (it counts neither in N nor in L), and a termless item has no rows. A null doc_id is
a document that stands after all others at equal scores. Each row of documents is a document, repeated rows too. Items
that share both id and text are one; items that share an id alone are ranked each. Empty tables give an empty result. Extra
columns are ignored. Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.llm.common import read, saved

K = 10
#: Bits of the map of hashes of the items' terms, which every task gets: 1 MB.
MAP_BITS = 1 << 23
#: Postings in a file, about.
POSTINGS = 2_000_000
#: Rows of a table of items' terms that is sent whole to all tasks, at most 40 bytes each.
SENT = 500_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters and code points beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, m): the distinct terms of each distinct item; item numbers the items, m counts its terms."""

    def run(batches):
        for batch in batches:
            own = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            cols = [pa.array(own, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().mapInArrow(run, f"item_id {kind}, terms array<string>")
    rows = rows.where(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "terms")
    rows = saved(rows, "items")
    return rows.select("item", "item_id", F.explode("terms").alias("term"), F.size("terms").cast("long").alias("m"))


def term_map(wanted: DataFrame) -> bytes:
    """A bit for each hash value of the wanted terms; its size is fixed."""
    bit = (F.crc32(F.col("term").cast("binary")) % MAP_BITS).cast("long")
    octets = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 8).alias("octet"))
    rows = octets.agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits"))
    found = rows.toArrow()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    out[found.column("octet").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def counted(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(doc_id, n, terms, counts) of each row with a term: the number of its terms, and those that may be wanted with their
    occurrences."""

    def run(batches):
        crc, mask = zlib.crc32, MAP_BITS - 1
        for batch in batches:
            sizes, flat, times, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                own = terms(text)
                sizes.append(len(own))
                for t, c in Counter(own).items():
                    h = crc(t) & mask
                    if wanted[h >> 3] >> (h & 7) & 1:
                        flat.append(t)
                        times.append(c)
                ends.append(len(flat))
            ends = pa.array(ends, pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.array(flat, pa.binary()).cast(pa.string()))
            counts = pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), words, counts], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, n long, terms array<string>, counts array<long>").where("n > 0")


def postings(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (list, row, part) of every document that holds a wanted term: part is the term's share of its score. Also (term, list), the
    numbers of the lists, and (row, doc_id). wanted: distinct terms."""
    rows = saved(counted(docs, term_map(wanted)).withColumn("row", F.monotonically_increasing_id()), "term-counts")
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    N, L = F.lit(total["docs"]).cast("long"), F.lit(max(1, total["terms"])).cast("long")
    held = rows.select("row", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted, "term")
    weight = F.floor(1000 * F.log((2 * N + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).alias("w")
    weights = saved(df.select("term", weight).withColumn("list", F.monotonically_increasing_id()), "weights")
    m = 10 + _div(90 * F.col("n") * N, L)
    part = F.col("w") * _div(1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    scored = held.join(_small(weights), "term").select("list", "row", part.alias("part")).where("part > 0")
    scored = scored.repartitionByRange(int(total["postings"] // POSTINGS) + 1, F.col("list"), F.col("part").desc(), F.col("row"))
    return saved(scored.sortWithinPartitions("list", F.col("part").desc()), "postings"), weights.select("term", "list"), rows.select("row", "doc_id")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _small(table: DataFrame) -> DataFrame:
    """A saved table that comes from the items: sent to all tasks if it has few rows; else Spark joins it as any other."""
    return F.broadcast(table) if table.count() <= SENT else table


def _best(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each value of by; Spark cuts to k before it shuffles, so that no list is gathered whole."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _bound(sums: DataFrame, k: int) -> DataFrame:
    """(item, tau): the k-th largest sum of each item that has so many."""
    return _best(sums, "item", k, F.col("sum").desc(), F.col("row")).where(F.col("rank") == k).select("item", F.col("sum").alias("tau"))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 of each item, ties by ascending doc_id."""
    asked = saved(item_terms(items), "item-terms")
    lists, numbers, ids = postings(docs, asked.select("term").distinct())
    asked = saved(asked.join(numbers, "term").select("item", "item_id", "m", "list"), "item-lists")
    # 1: list heads
    heads = saved(_best(lists, "list", k, F.col("part").desc(), F.col("row")).select("list", "row", "part"), "heads")
    first = _bound(asked.join(heads, "list").groupBy("item", "row").agg(F.sum("part").alias("sum")), k)
    # 2: every list down to the uniform threshold
    least = F.greatest(F.ceil(F.coalesce("tau", F.lit(0)) / F.col("m")), F.lit(1)).cast("long")
    asked = saved(asked.join(first, "item", "left").select("item", "item_id", "m", "list", least.alias("least")), "thresholds")
    cut = asked.groupBy("list").agg(F.min("least").alias("lowest"))
    high = lists.join(_small(saved(cut, "cuts")), "list").where(F.col("part") >= F.col("lowest")).select("list", "row", "part")
    # all lists of a document meet in one task, so its sums need no further shuffle
    seen = high.repartition("row").join(_small(asked.select("item", "list", "least")), "list").where(F.col("part") >= F.col("least"))
    seen = seen.groupBy("item", "row").agg(F.sum("part").alias("sum"), F.count(F.lit(1)).alias("lists"))
    limits = asked.groupBy("item").agg(F.first("m").alias("m"), F.first("least").alias("least"))
    limits = saved(limits.join(_bound(seen, k), "item", "left"), "limits")
    most = F.col("sum") + (F.col("m") - F.col("lists")) * (F.col("least") - 1)
    left = saved(seen.join(_small(limits), "item").where(most >= F.coalesce("tau", F.lit(0))).select("item", "row"), "candidates")
    # 3: exact scores
    look = left.join(asked.select("item", "list"), "item")
    exact = saved(look.join(lists, ["list", "row"]).groupBy("item", "row").agg(F.sum("part").alias("score")), "scores")
    named = exact.join(ids, "row").join(asked.groupBy("item").agg(F.first("item_id").alias("item_id")), "item")
    ranked = _best(named, "item", k, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_CUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_CUT}') AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_CUT}')) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, unnest(terms) AS term FROM i),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT term, row, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS part FROM p JOIN w USING (term), s),
r AS (SELECT item, item_id, row, doc_id, sum(part)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY item, item_id, row, doc_id HAVING sum(part) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM r) WHERE rank <= {K}
"""
