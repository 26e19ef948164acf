"""Registered queries over graphs made of the orders, parts and places of the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions import schema
from biblioflow.operators import rdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASE = "http://example.org/"
SK = schema.SKOS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of orders and their lines; the first line of every order is said twice."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    subject = lambda k: rdf.iri(F.concat(F.lit(BASE + "order/"), F.col(k).cast("string")))
    graph = rdf.iri(F.concat(F.lit(BASE + "g/"), F.substring("o_orderpriority", 1, 1)))
    n = F.col("o_orderkey") * 100
    a = o.select(n.alias("pos"), subject("o_orderkey").alias("s"), rdf.iri(schema.RDF + "type").alias("p"), rdf.iri(BASE + "Order").alias("o"), graph.alias("g"))
    b = o.select((n + 1).alias("pos"), subject("o_orderkey").alias("s"), rdf.iri(BASE + "status").alias("p"), rdf.literal(F.col("o_orderstatus")).alias("o"), graph.alias("g"))
    none = F.lit(None).cast(schema.TERM)
    m = F.col("l_orderkey") * 100 + 10 + F.col("l_linenumber")
    line = li.select(m.alias("pos"), subject("l_orderkey").alias("s"), rdf.iri(BASE + "ships").alias("p"), rdf.literal(F.col("l_returnflag"), "en").alias("o"), none.alias("g"))
    again = line.where(F.col("pos") % 10 == 1).withColumn("pos", F.col("pos") + 50)
    return a.unionByName(b).unionByName(line).unionByName(again)


_RDF = schema.RDF
CTE = f"""q AS (SELECT o_orderkey * 100 AS pos, '<{BASE}order/' || o_orderkey || '>' AS s, '<{_RDF}type>' AS p, '<{BASE}Order>' AS o, '<{BASE}g/' || substr(o_orderpriority, 1, 1) || '>' AS g FROM orders
UNION ALL SELECT o_orderkey * 100 + 1, '<{BASE}order/' || o_orderkey || '>', '<{BASE}status>', '"' || o_orderstatus || '"', '<{BASE}g/' || substr(o_orderpriority, 1, 1) || '>' FROM orders
UNION ALL SELECT l_orderkey * 100 + 10 + l_linenumber + x, '<{BASE}order/' || l_orderkey || '>', '<{BASE}ships>', '"' || l_returnflag || '"@en', NULL FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), (SELECT unnest([0, 50]) AS x) WHERE x = 0 OR l_linenumber = 1)"""
_LINE = "s || ' ' || p || ' ' || o || ' ' || coalesce(g || ' ', '') || '.'"


@query("a4_dedupe", f"WITH {CTE} SELECT min(pos) AS pos, {_LINE} AS line FROM q GROUP BY s, p, o, g")
def dedupe(spark, sf_dir):
    return rdf.to_nquads(rdf.dedupe(_orders(spark, sf_dir)))


@query("a3_graph_sizes", f"WITH {CTE} SELECT coalesce(g, '') AS graph, count(*) AS n, min(pos) AS first FROM q GROUP BY g")
def graph_sizes(spark, sf_dir):
    out = rdf.graph_sizes(_orders(spark, sf_dir))
    return out.select(F.coalesce(rdf.term_text(F.col("g")), F.lit("")).alias("graph"), "n", "first")


@query("f6_named_graph", f"WITH {CTE} SELECT pos, s, o FROM q WHERE g = '<{BASE}g/1>'")
def named_graph(spark, sf_dir):
    own = rdf.in_graph(_orders(spark, sf_dir), rdf.iri(BASE + "g/1"))
    return own.select("pos", rdf.term_text(F.col("s")).alias("s"), rdf.term_text(F.col("o")).alias("o"))


@query("a5_distinct_objects", f"WITH {CTE} SELECT s, p, o, row_number() OVER (PARTITION BY s, p ORDER BY min(pos)) - 1 AS n FROM q GROUP BY s, p, o")
def distinct_objects(spark, sf_dir):
    out = rdf.objects(_orders(spark, sf_dir))
    return out.select(*[rdf.term_text(F.col(c)).alias(c) for c in ("s", "p", "o")], F.col("n").cast("long").alias("n"))


@query("j8_first_literal", f"WITH {CTE} SELECT s, p, arg_min(o, pos) AS o FROM q WHERE o LIKE '\"%' GROUP BY s, p")
def first_literal(spark, sf_dir):
    out = rdf.first_literal(_orders(spark, sf_dir))
    return out.select(*[rdf.term_text(F.col(c)).alias(c) for c in ("s", "p", "o")])


@query("a7_subjects_of_type", f"WITH {CTE} SELECT s, min(pos) AS pos FROM q WHERE p = '<{_RDF}type>' AND o = '<{BASE}Order>' GROUP BY s")
def subjects_of_type(spark, sf_dir):
    return rdf.subjects_of_type(_orders(spark, sf_dir), BASE + "Order").select(rdf.term_text(F.col("s")).alias("s"), "pos")


@query("k11_nquads", f"WITH {CTE} SELECT pos, {_LINE} AS line FROM q")
def nquads(spark, sf_dir):
    return rdf.to_nquads(_orders(spark, sf_dir))


@query("s10_nquads_roundtrip", f"WITH {CTE} SELECT pos, {_LINE} AS line, '' AS error FROM q UNION ALL SELECT -o_orderkey, '', 'malformed line <broken ' || o_orderkey FROM orders UNION ALL SELECT -1000000000 - doc_id, '<{BASE}doc/' || doc_id || '> <{BASE}text> \"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\" .', '' FROM documents")
def nquads_roundtrip(spark, sf_dir):
    lines = rdf.to_nquads(_orders(spark, sf_dir)).withColumnRenamed("line", "value")
    bad = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bad = bad.select((-F.col("o_orderkey")).alias("pos"), F.concat(F.lit("<broken "), F.col("o_orderkey").cast("string")).alias("value"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast(schema.TERM)
    docs = docs.select(
        (F.lit(-1000000000) - F.col("doc_id")).alias("pos"), rdf.iri(F.concat(F.lit(BASE + "doc/"), F.col("doc_id").cast("string"))).alias("s"), rdf.iri(BASE + "text").alias("p"),
        rdf.literal(F.col("text")).alias("o"), none.alias("g"),
    )
    lines = lines.unionByName(rdf.to_nquads(docs).withColumnRenamed("line", "value"))
    parsed = rdf.parse_nquads(lines.unionByName(bad))
    error = parsed.select("pos", F.lit("").alias("line"), F.col("_error").alias("error")).where("error is not null")
    good = rdf.to_nquads(parsed.where("_error is null")).withColumn("error", F.lit(""))
    return good.unionByName(error)


@query("p19_local_name", "SELECT DISTINCT p, CASE WHEN p LIKE '%#%' THEN split_part(p, '#', 2) ELSE split_part(p, '/', -1) END AS name FROM (SELECT trim(p, '<>') AS p FROM q)".join([f"WITH {CTE} ", ""]))
def local_names(spark, sf_dir):
    return _orders(spark, sf_dir).select("p.value").distinct().select(F.col("value").alias("p"), rdf.local_name(F.col("value")).alias("name"))


def _blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each nation, with a blank node of its own for each customer of a bounded balance."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    node = rdf.blank(F.concat(F.lit("n"), F.col("c_custkey").cast("string")))
    g = rdf.iri(F.concat(F.lit(BASE + "nation/"), F.col("c_nationkey").cast("string")))
    return c.select(F.col("c_custkey").alias("pos"), node.alias("s"), rdf.iri(BASE + "name").alias("p"), rdf.literal(F.col("c_name")).alias("o"), g.alias("g"), F.col("c_nationkey").alias("scope"))


@query(
    "k11_blank_names",
    f"""SELECT c_custkey AS pos, '_:b' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) || ' <{BASE}name> "' || c_name || '" <{BASE}nation/' || c_nationkey || '> .' AS line FROM customer""",
)
def blank_names(spark, sf_dir):
    return rdf.to_nquads(rdf.renumber_blanks(_blanks(spark, sf_dir), "scope"))


@query(
    "g1_first_degree_hashes",
    f"""SELECT 'n' || c_custkey AS label, sha256('_:a <{BASE}name> "' || c_name || '" <{BASE}nation/' || c_nationkey || '> .' || chr(10)) AS hash FROM customer""",
)
def first_degree_hashes(spark, sf_dir):
    return rdf.first_degree(_blanks(spark, sf_dir).drop("scope"))


@query("f5_graphs", f"WITH {CTE} SELECT 1 AS k, count(*) > 0 AS answer FROM q WHERE g = '<{BASE}g/1>' UNION ALL SELECT 2, count(*) > 0 FROM q WHERE g = '<{BASE}g/none>' UNION ALL SELECT 3, count(*) = 0 FROM q UNION ALL SELECT 4, count(*) = 0 FROM q WHERE g = '<{BASE}g/none>'")
def graphs_there(spark, sf_dir):
    own = _orders(spark, sf_dir)
    none = rdf.iri(BASE + "g/none")
    asked = [rdf.has_graph(own, rdf.iri(BASE + "g/1")), rdf.has_graph(own, none), rdf.is_empty(own), rdf.is_empty(rdf.in_graph(own, none))]
    out = None
    for k, x in enumerate(asked, 1):
        x = x.toDF("answer").select(F.lit(k).alias("k"), "answer")
        out = x if out is None else out.unionByName(x)
    return out


@query("a11_sole_value", f"WITH {CTE} SELECT s, p, min(o) AS o FROM q GROUP BY s, p HAVING count(DISTINCT o) = 1")
def sole_value(spark, sf_dir):
    out = rdf.sole_value(_orders(spark, sf_dir))
    return out.select(*[rdf.term_text(F.col(c)).alias(c) for c in ("s", "p", "o")])


def _thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as SKOS concepts."""
    r, n = spark.read.parquet(f"{sf_dir}/region.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = None
    r_uri = rdf.iri(F.concat(F.lit(BASE + "region/R"), F.col("r_regionkey").cast("string")))
    n_uri = rdf.iri(F.concat(F.lit(BASE + "nation/N"), F.col("n_nationkey").cast("string")))
    up = rdf.iri(F.concat(F.lit(BASE + "region/R"), F.col("n_regionkey").cast("string")))
    rows = [
        (r, r_uri, 0, schema.RDF + "type", rdf.iri(SK + "Concept"), None), (r, r_uri, 1, SK + "prefLabel", rdf.literal(F.col("r_name"), "en"), None),
        (r, r_uri, 2, SK + "prefLabel", rdf.literal(F.concat(F.lit("FR "), F.col("r_name")), "fr"), None), (r, r_uri, 3, SK + "inScheme", rdf.iri(BASE + "scheme"), None),
        (n, n_uri, 0, schema.RDF + "type", rdf.iri(SK + "Concept"), None), (n, n_uri, 1, SK + "prefLabel", rdf.literal(F.concat(F.lit("FR "), F.col("n_name")), "fr"), None),
        (n, n_uri, 2, SK + "prefLabel", rdf.literal(F.col("n_name"), "en"), "n_nationkey % 3 <> 0"), (n, n_uri, 3, SK + "altLabel", rdf.literal(F.lower("n_name"), "en"), "n_nationkey % 2 = 0"),
        (n, n_uri, 4, SK + "broader", up, None), (n, n_uri, 5, SK + "broader", rdf.iri(BASE + "region/other"), "n_nationkey % 5 = 0"),
    ]
    for df, s, k, p, o, when in rows:
        key = F.col("r_regionkey") if df is r else F.col("n_nationkey") + 1000
        own = df.where(when) if when else df
        own = own.select((key.cast("long") * 10 + k).alias("pos"), s.alias("s"), rdf.iri(p).alias("p"), o.alias("o"), F.lit(None).cast(schema.TERM).alias("g"))
        out = own if out is None else out.unionByName(own)
    return out


_CONCEPTS = f"""SELECT '{BASE}region/R' || r_regionkey AS uri, 'R' || r_regionkey AS id, '{BASE}scheme' AS scheme, r_name AS label, 'en:' || r_name || '|fr:FR ' || r_name AS pref, '' AS alt, 0 AS broader FROM region
UNION ALL SELECT '{BASE}nation/N' || n_nationkey, 'N' || n_nationkey, '', CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 'FR ' || n_name END,
  'fr:FR ' || n_name || CASE WHEN n_nationkey % 3 <> 0 THEN '|en:' || n_name ELSE '' END, CASE WHEN n_nationkey % 2 = 0 THEN 'en:' || lower(n_name) ELSE '' END, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END FROM nation"""


@query("s17_skos_concepts", _CONCEPTS)
def skos_concepts(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["lang"], F.lit(":"), x["text"])), "|")
    out = rdf.concepts(_thesaurus(spark, sf_dir))
    return out.select("uri", "id", "scheme", rdf.english_first(F.col("pref")).alias("label"), joined("pref").alias("pref"), joined("alt").alias("alt"), F.size("broader").alias("broader"))


@query(
    "j3_skos_references",
    f"""SELECT '{BASE}nation/N' || n_nationkey AS uri, 0 AS n, '{BASE}region/R' || n_regionkey AS target, 'R' || n_regionkey AS target_id, r_name AS target_label FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT '{BASE}nation/N' || n_nationkey, 1, '{BASE}region/other', 'other', 'other' FROM nation WHERE n_nationkey % 5 = 0""",
)
def skos_references(spark, sf_dir):
    return rdf.resolve(rdf.concepts(_thesaurus(spark, sf_dir)), "broader")


@query(
    "a2_skos_tally",
    f"""SELECT 'language' AS what, 'en' AS key, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey % 3 <> 0) AS n
    UNION ALL SELECT 'language', 'fr', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) UNION ALL SELECT 'scheme', '{BASE}scheme', count(*) FROM region
    UNION ALL SELECT 'base', '{BASE}region/', count(*) FROM region UNION ALL SELECT 'base', '{BASE}nation/', count(*) FROM nation""",
)
def skos_tally(spark, sf_dir):
    return rdf.tally(rdf.concepts(_thesaurus(spark, sf_dir)))


@query(
    "k15_skos_report",
    f"""SELECT '{BASE}region/R' || r_regionkey AS uri, 'R' || r_regionkey || '  ' || r_name || ' [en]' || chr(10) || '  uri: {BASE}region/R' || r_regionkey || chr(10) AS text FROM region
    UNION ALL SELECT '{BASE}nation/N' || n_nationkey, 'N' || n_nationkey || '  ' || CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' [en]' ELSE 'FR ' || n_name || ' [fr]' END || chr(10) ||
      '  uri: {BASE}nation/N' || n_nationkey || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '  alt: ' || lower(n_name) || ' [en]' || chr(10) ELSE '' END ||
      '  broader: ' || r_name || ' (R' || n_regionkey || ')' || CASE WHEN n_nationkey % 5 = 0 THEN ', other (other)' ELSE '' END || chr(10)
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def skos_report(spark, sf_dir):
    return rdf.report(rdf.concepts(_thesaurus(spark, sf_dir))).select("uri", "text")


def _works(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as works and orders as their instances, linked by hasInstance (even orders) or instanceOf."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("work"))
    forward = li.where("l_orderkey % 2 = 0").select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("instance"))
    backward = li.where("l_orderkey % 2 = 1 or l_orderkey % 10 = 0").select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("instance"))
    return part, forward.withColumn("pos", F.col("instance")).unionByName(backward.withColumn("pos", F.col("instance") + 10**9))


@query(
    "j4_work_instances",
    """SELECT p_partkey AS work, l_orderkey AS instance, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END, l_orderkey) - 1 AS n
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = p_partkey""",
)
def work_instances(spark, sf_dir):
    """A row for each work and instance (either direction of the link, once), or for a work alone."""
    from pyspark.sql import Window

    works, links = _works(spark, sf_dir)
    once = links.groupBy("work", "instance").agg(F.min("pos").alias("pos"))
    out = works.join(once, "work", "left")
    return out.select("work", "instance", (F.row_number().over(Window.partitionBy("work").orderBy("pos")) - 1).cast("long").alias("n"))


@query("j5_top_works", "SELECT p_partkey AS work FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)")
def top_works(spark, sf_dir):
    works, _ = _works(spark, sf_dir)
    nested = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("work"))
    return works.join(nested, "work", "left_anti")


@query("o8_graph_difference", f"WITH {CTE} SELECT {_LINE} AS line FROM q WHERE g IS NOT NULL EXCEPT ALL SELECT {_LINE} FROM q WHERE g = '<{BASE}g/1>'")
def graph_difference(spark, sf_dir):
    quads = _orders(spark, sf_dir)
    a = rdf.to_nquads(quads.where("g is not null")).select("line")
    return a.exceptAll(rdf.to_nquads(rdf.in_graph(quads, rdf.iri(BASE + "g/1"))).select("line"))


@query(
    "x12_skos_authority",
    f"""SELECT '{BASE}region/R' || r_regionkey AS uri, '001=R' || r_regionkey || ' 024={BASE}region/R' || r_regionkey || ' 150=' || r_name || ' 450=FR ' || r_name AS record FROM region
    UNION ALL SELECT '{BASE}nation/N' || n_nationkey, '001=N' || n_nationkey || ' 024={BASE}nation/N' || n_nationkey || ' 150=' || CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 'FR ' || n_name END ||
      ' 450=FR ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' 450=' || lower(n_name) ELSE '' END || ' 550=' || r_name || CASE WHEN n_nationkey % 5 = 0 THEN ' 550=other' ELSE '' END
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def skos_authority(spark, sf_dir):
    from biblioflow.functions import marc

    out = rdf.authority(rdf.concepts(_thesaurus(spark, sf_dir)))
    shown = F.transform("fields", lambda f: F.concat(f["tag"], F.lit("="), F.when(f["tag"] < "010", f["value"]).otherwise(marc.value(f, "a"))))
    return out.select("uri", F.array_join(shown, " ").alias("record"))


_TTL = {"ex": BASE, "rdf": schema.RDF}


@query(
    "k12_turtle",
    f"""WITH {CTE}, t AS (SELECT pos, s, CASE p WHEN '<{_RDF}type>' THEN 'a' ELSE 'ex:' || trim(replace(p, '{BASE}', ''), '<>') END AS p, CASE WHEN o = '<{BASE}Order>' THEN 'ex:Order' ELSE o END AS o FROM q),
    byp AS (SELECT s, p, min(pos) AS pos, p || ' ' || string_agg(o, ', ' ORDER BY pos) AS t FROM t GROUP BY s, p)
    SELECT min(pos) AS pos, s || ' ' || string_agg(t, ' ;' || chr(10) || '    ' ORDER BY pos) || ' .' || chr(10) AS text FROM byp GROUP BY s""",
)
def turtle(spark, sf_dir):
    return rdf.to_turtle(_orders(spark, sf_dir), _TTL)


@query(
    "x13_provenance",
    f"""SELECT o_orderkey AS k, x.n AS pos, x.p AS p FROM orders, (SELECT unnest([CAST(0 AS BIGINT), 1, 2]) AS n, unnest(['type', 'wasDerivedFrom', 'generatedAtTime']) AS p) x WHERE x.n <> 2 OR o_orderstatus <> 'O'""",
)
def provenance(spark, sf_dir):
    """Provenance of the graph of every order; open orders have no time."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    graph = rdf.iri(F.concat(F.lit(BASE + "order/"), F.col("o_orderkey").cast("string")))
    time = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    out = rdf.provenance(o, graph, rdf.iri(BASE + "source"), F.lit(None).cast(schema.TERM), time)
    return out.select(rdf.local_name(F.col("s.value")).cast("long").alias("k"), F.col("pos").cast("long").alias("pos"), F.regexp_extract("p.value", "([A-Za-z]+)$", 1).alias("p"))
