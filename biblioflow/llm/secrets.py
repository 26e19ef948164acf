"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are always reported: assigned secrets, access identifiers and long hexadecimal runs. Weak parts (a
short assigned secret, a mixed-character blob, a login or client id, an endpoint URL) mean nothing alone. An interval
join within a document puts each weak part beside the parts that start within ``SCOPE`` code points of it; it is
reported only with a strong part of another role there, or with parts of both other roles (identifier, secret,
endpoint). The join runs on scope-wide bins that are reduced to their first and last start of each role, so a weak
part meets at most three bins and pairs are never listed.

Positions are code points, ends exclusive. Matches are found by splitting the text at the pattern, which gives their
places without Python. Nulls: a null text is empty and has no span; a null doc_id keeps its row. Repeated rows stay
as rows. Extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import read, saved

SCOPE = 400
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i:((?:client|account|access_?key)_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})"""
BLOB = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
#: Kinds in the order of their listing, with their roles.
KINDS = ("assign", "access", "hex", "ident", "short", "blob", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "short": "secret", "blob": "secret", "endpoint": "endpoint"}
STRONG = ("assign", "access")
_SPAN = "array<struct<start:int,end:int,kind:int,size:int,word:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; size and word are of the group."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            F.length(x["part"]).alias("size"), x["part"].alias("word"),
        )
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    all_ = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), all_).otherwise(_none())


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), base: reported spans, weak: candidates; sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        F.xxhash64(text).alias("mark"),
        matches(text, ASSIGN, "assign", 2).alias("assigned"),
        F.concat(matches(text, ACCESS, "access"), matches(text, HEX, "hex")).alias("plain"),
        F.concat(matches(text, IDENT, "ident", 2), matches(text, ENDPOINT, "endpoint")).alias("hints"),
        matches(text, BLOB, "blob").alias("blobs"),
    )
    base = F.concat(F.filter("assigned", lambda x: x["size"] >= 12), "plain")
    found = found.withColumn("base", base)
    short = F.transform(
        F.filter("assigned", lambda x: x["size"].between(6, 11)),
        lambda x: x.withField("kind", F.lit(KINDS.index("short"))),
    )
    blob = F.filter(
        "blobs",
        lambda x: x["word"].rlike("[A-Z]") & x["word"].rlike("[a-z]") & x["word"].rlike("[0-9]")
        & ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])),
    )
    weak = F.concat("hints", short, blob)
    return found.select("doc_id", "mark", F.array_sort(_plain(F.col("base"))).alias("base"), F.array_sort(_plain(weak)).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, mark, added): the weak spans that complementary parts confirm, of documents that have such."""
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    some = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "mark"])
    rows = some.select("doc_id", "mark", F.explode(F.concat("base", "weak")).alias("x")).select(
        "doc_id", "mark", "x.*", F.get(roles, F.col("x.kind")).alias("role"), F.floor(F.col("x.start") / scope).alias("bin")
    )
    strong = F.col("kind").isin([KINDS.index(k) for k in STRONG])
    bins = rows.groupBy("doc_id", "mark", "bin", "role", strong.alias("strong")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    bins = bins.select(*[F.col(c).alias(f"p_{c}") for c in bins.columns])
    weak = rows.where(F.col("kind") > 2).withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = (
        F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("mark") == F.col("p_mark")) & (F.col("at") == F.col("p_bin"))
        & (F.col("role") != F.col("p_role")) & (F.col("p_last") >= F.col("start") - scope) & (F.col("p_first") <= F.col("start") + scope)
    )
    met = weak.join(bins, near).groupBy("doc_id", "mark", "start", "kind", "end")
    kept = met.agg(F.max("p_strong").alias("strong"), F.count_distinct("p_role").alias("others")).where("strong or others = 2")
    return kept.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, mark, base and added spans as arrays of (start, kind, end)."""
    found = saved(parts(docs), "secret-parts")
    added = linked(found).select(F.col("doc_id").alias("l_doc_id"), F.col("mark").alias("l_mark"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("mark") == F.col("l_mark"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return found.join(added, same, "left").select("doc_id", "mark", "base", F.coalesce("added", none).alias("added"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span (overlaps taken together) replaced by mask, and n_chars set anew; columns as before."""
    found = scan(docs).where(F.size("base") + F.size("added") > 0).dropDuplicates(["doc_id", "mark"])
    found = found.select(
        F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark"), F.array_sort(F.concat("base", "added")).alias("__spans")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(text) == F.col("__mark"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(acc["text"], F.substring(acc["all"], acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise(acc["text"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), gap.alias("text"), acc["all"].alias("all"))

    clean = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), text.alias("all")),
        step,
        lambda acc: F.concat(acc["text"], F.substring(acc["all"], acc["at"] + 1, F.length(acc["all"]))),
    )
    out = docs.join(found, same, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"),
    )


def _sql_matches(pattern: str, kind: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, rid, {KINDS.index(kind)} AS kind, i,
      CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s,
      length(hits[i]) AS n, length(bits[i]) AS size, bits[i] AS word
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, rid, regexp_split_to_array(txt, '{p}') AS gaps, regexp_extract_all(txt, '{p}', 0) AS hits, regexp_extract_all(txt, '{p}', {group}) AS bits
      FROM t WHERE regexp_matches(txt, '{p}')))"""


ORACLE = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS txt FROM documents),
m AS ({' UNION ALL '.join(_sql_matches(*x) for x in ((ASSIGN, 'assign', 2), (ACCESS, 'access', 0), (HEX, 'hex', 0), (IDENT, 'ident', 2), (BLOB, 'blob', 0), (ENDPOINT, 'endpoint', 0)))}),
b AS (SELECT rid, kind, s, s + n AS e FROM m WHERE kind IN (1, 2) OR (kind = 0 AND size >= 12)),
w AS (SELECT rid, CASE WHEN kind = 0 THEN 4 ELSE kind END AS kind, s, s + n AS e FROM m
  WHERE kind IN (3, 6) OR (kind = 0 AND size BETWEEN 6 AND 11)
    OR (kind = 5 AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[0-9]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = m.rid AND b.s < m.s + m.n AND m.s < b.e))),
p AS (SELECT *, CASE WHEN kind IN (1, 3) THEN 'id' WHEN kind = 6 THEN 'endpoint' ELSE 'secret' END AS role, kind IN (0, 1) AS strong
  FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
k AS (SELECT c.rid, c.kind, c.s, c.e FROM p c JOIN p o ON c.rid = o.rid AND c.role <> o.role AND abs(c.s - o.s) <= {SCOPE}
  WHERE c.kind > 2 GROUP BY ALL HAVING bool_or(o.strong) OR count(DISTINCT o.role) = 2),
o AS (SELECT rid, kind, s, e, 0 AS linked FROM b UNION ALL SELECT rid, kind, s, e, 1 FROM k),
n AS (SELECT *, [{', '.join(f"'{k}'" for k in KINDS)}][kind + 1] || ':' || s || ':' || e AS span FROM o)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE linked = 0), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE span IS NOT NULL), '') AS spans,
  count(*) FILTER (WHERE linked = 1) AS n_linked
FROM t LEFT JOIN n USING (rid) GROUP BY t.rid, t.doc_id
"""
