"""Filter interaction audit: what each of several document filters removes, in every order in which they can be applied.

Duplicates are found by partition refinement. Documents are split by their length in code points, then by the hash of one block of the
text after the other (``BLOCKS``: each sixteen times as long as the one before it, the last takes the rest), and classes of one
document are dropped after every split. The full text of each document in a class that is left is then compared
with that of its class's smallest id; documents that differ from it, which takes a collision of all hashes, are grouped by their full texts.
Every document with an equal text under a smaller id is marked.

Each document then has a mask of the filters it fails. Masks are counted by part, labels beside them, and all that is
reported follows from these counts, at most 2^filters a part: a filter removes, at its step, the documents whose mask has
its bit and none of the earlier ones; over all orders, a mask of j bits falls to each of its filters in 1/j of them.

Nulls: a null text is empty; a null lang is the part ''; a null doc_id is no copy of any other and no other's original, and has no
labels. Empty texts are copies of each other. Rows with equal ids are not each other's copies, and each row counts. Where labels
has several rows of an id, a label holds if one of them says so. Empty tables give an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import read, saved

#: Code points of the blocks that are hashed one after the other; what lies behind them is one more block.
BLOCKS = (64, 1024, 16384)
MARKS = "#$%&*|"


def filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, of a text that is not null. E, the copies, is not a matter of one row."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(f"[{MARKS}]"),
    }


def block_hashes(text: Column, digest: Callable[[Column], Column] = F.xxhash64) -> list[Column]:
    """The length of a text, then the hashes of its blocks."""
    out, at = [F.length(text).cast("long")], 1
    for size in (*BLOCKS, None):
        out.append(digest(F.substring(text, at, F.length(text) if size is None else size)))
        at += size or 0
    return out


def classes(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, least): the classes of two and more documents that all splits leave, and their smallest doc_id."""
    text = F.coalesce("text", F.lit(""))
    splits = block_hashes(text, digest)
    names = [f"b{k}" for k in range(len(splits))]
    rows = docs.where("doc_id is not null").select(F.col("doc_id"), *[c.alias(n) for n, c in zip(names, splits)])
    rows = saved(rows, "blocks").withColumn("key", F.lit(0).cast("long"))
    for k, name in enumerate(names):
        rows = rows.withColumn("key", F.xxhash64("key", name)).drop(name)
        # a table of its own, so that Spark can split a class of very many documents in the join
        several = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), f"several{k}")
        rows = saved(rows.join(several, "key", "left_semi"), f"split{k}")
    return rows.groupBy("key").agg(F.min("doc_id").alias("least"))


def class_key(text: Column, digest: Callable[[Column], Column] = F.xxhash64) -> Column:
    key = F.lit(0).cast("long")
    for split in block_hashes(text, digest):
        key = F.xxhash64(key, split)
    return key


def masks(docs: DataFrame, part: str = "lang", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) of each row of docs: bit j of mask is set if it fails the j-th of the filters A to E."""
    found = saved(classes(docs, digest), "classes")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    keyed = rows.withColumn("key", class_key(F.col("text"), digest))
    # one text a class; where rows of one id have several, the others count as different from it
    first = keyed.join(found, (keyed["key"] == found["key"]) & (keyed["doc_id"] == found["least"])).select(found["key"], "least", "text")
    first = saved(first.groupBy("key", "least").agg(F.min("text").alias("of")).withColumnRenamed("key", "of_key"), "firsts")
    bits = sum((F.when(c, F.lit(1 << j)).otherwise(0) for j, c in enumerate(filters(F.col("text")).values())), F.lit(0))
    met = keyed.join(first, (keyed["key"] == first["of_key"]) & keyed["doc_id"].isNotNull(), "left")
    odd = F.col("of") != F.col("text")
    met = met.select(
        "doc_id", "part", "key", F.when(odd, F.col("text")).alias("text"),
        (bits + F.when((F.col("of") == F.col("text")) & (F.col("doc_id") > F.col("least")), 16).otherwise(0)).alias("mask"),
    )
    met = saved(met, "masks")
    sure, rest = met.where("text is null"), met.where("text is not null")
    least = rest.groupBy("key", "text").agg(F.min("doc_id").alias("least"))
    rest = rest.join(least, ["key", "text"]).withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0))
    return sure.select("doc_id", "part", "mask").unionByName(rest.select("doc_id", "part", "mask"))


def mask_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic)."""
    is_ = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(f"is_{name}")
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(is_("quality"), is_("toxic"))
    rows = found.join(own, found["doc_id"] == own["labelled"], "left")
    one = lambda c: F.count(F.when(F.col(c), F.lit(1)))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("is_quality").alias("good"), one("is_toxic").alias("toxic"))


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, bit, earlier bits) of each step of every order of the filters."""
    bit = {x: 1 << j for j, x in enumerate(letters)}
    return [("".join(o), k + 1, bit[x], sum(bit[y] for y in o[:k])) for o in itertools.permutations(letters) for k, x in enumerate(o)]


def report(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The audit's rows, one for each part, order and step, from the counts of masks."""
    lits = [F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, k, b, e in steps(letters)]
    rows = counts.withColumn("s", F.explode(F.array(*lits))).select("part", "mask", "n", "good", "toxic", "s.*")
    has = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda cond, c="n": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    share = F.floor(F.lit(math.factorial(len(letters))) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~has & ~gone).alias("kept"), total(has & ~gone).alias("removed"), total(has & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(has & ~gone, "good").alias("good_lost"), total(has & ~gone, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(has, F.col("n") * share)), F.lit(0)).cast("long").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mask_counts(masks(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
    return report(saved(counts, "mask-counts"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(txt, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(txt, '[^A-Z]+', '', 'g')) > 3 * length(txt) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(txt, '[{MARKS}]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic FROM m GROUP BY ALL),
s(filter_order, step, bit, earlier) AS (VALUES {', '.join(map(str, steps('ABCDE')))})
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (WHERE mask & bit = 0 AND mask & earlier = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (WHERE mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
