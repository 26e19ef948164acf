"""RDF lists read back by pointer jumping, against following them cell by cell."""

import random

from pyspark.sql import functions as F

from biblioflow.functions import schema
from biblioflow.operators import rdf


def quads(spark, links):
    """links: (cell, first or None, rest or None)."""
    rows = [(c, "first", f, False) for c, f, _ in links if f is not None] + [(c, "rest", r, r == "nil") for c, _, r in links if r is not None]
    df = spark.createDataFrame(rows, "c string, p string, o string, nil boolean")
    o = F.when(F.col("nil"), rdf.iri(schema.RDF + "nil")).when(F.col("p") == "rest", rdf.blank(F.col("o"))).otherwise(rdf.literal(F.col("o")))
    return df.select(F.monotonically_increasing_id().alias("pos"), rdf.blank(F.col("c")).alias("s"), rdf.iri(F.concat(F.lit(schema.RDF), "p")).alias("p"), o.alias("o"))


def found(spark, links):
    return {r["head"]["value"]: r["_error"] or [t["value"] for t in r["items"]] for r in rdf.lists(quads(spark, links)).collect()}


def chain(name, n, end="nil"):
    return [(f"{name}{k}", f"{name}:{k}", f"{name}{k + 1}" if k + 1 < n else end) for k in range(n)]


def test_lists_of_any_length(spark):
    links = chain("a", 1) + chain("b", 2) + chain("c", 700) + chain("d", 33)
    random.Random(1).shuffle(links)
    got = found(spark, links)
    assert got == {f"{x}0": [f"{x}:{k}" for k in range(n)] for x, n in (("a", 1), ("b", 2), ("c", 700), ("d", 33))}


def test_lists_that_are_none(spark):
    links = chain("ok", 3) + chain("open", 3, "nowhere") + chain("ring", 5, "ring0") + chain("fork", 3) + [("fork1", "another", None)] + chain("two", 2) + [("two0", None, "two0x")]
    links += chain("p", 2, "t0") + chain("q", 3, "t0") + chain("t", 2) + [("lone", None, "nil"), ("self", "1", "self")]
    got = found(spark, links)
    assert got["ok0"] == ["ok:0", "ok:1", "ok:2"]
    assert got["open0"] == "open" and got["ring0"] == "circle" and got["fork0"] == "fork" and got["lone"] == "fork" and got["self"] == "circle"
    assert got["two0"] == "fork" and got["p0"] == got["q0"] == got["t0"] == "shared"
    assert rdf.lists(quads(spark, chain("a", 2)).limit(0)).count() == 0
