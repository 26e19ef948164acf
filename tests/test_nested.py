"""Graphs written as RDF/XML and JSON-LD and read back to the same canonical lines."""

import pytest

from biblioflow.operators import rdf, rdf_nested
from biblioflow.sources import documents

GRAPH = """@prefix ex: <http://e/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:a a ex:C ; ex:p "x < & \\"y\\" \\r\\n z", "deux"@fr, 3, "t"^^ex:type ; ex:n [ ex:p "in" ; ex:n [ ex:p "deeper" ; ex:n [] ] ] .
ex:b ex:n _:shared, ex:a . ex:c ex:n _:shared . _:shared ex:p "shared" .
_:one ex:n _:two . _:two ex:n _:three . _:three ex:n _:one ; ex:p "circle" . _:self ex:n _:self .
ex:l ex:list ( 1 "two" [ ex:p "three" ] ) . [] ex:p "alone" .
"""


def quads(spark, text, form):
    found = documents.parsed(spark.createDataFrame([("d", text)], "_source string, content string"), form)
    return found.selectExpr("pos", "s", "p", "o", "cast(null as struct<kind:tinyint,value:string,lang:string,datatype:string>) as g", "_error")


def lines(df):
    return [r["line"] for r in rdf.canonical(df.drop("_error")).collect()]


@pytest.mark.parametrize("form", ["rdfxml", "jsonld"])
def test_written_graphs_read_back(spark, form):
    own = quads(spark, GRAPH, "turtle").cache()
    made, how = rdf_nested.texts(own, form).collect(), rdf_nested.FORMS[form]
    assert not any(r["_error"] for r in made) and len(made) == 10  # a, b, c, l, shared, self, alone, three of the circle; nothing nested
    back = quads(spark, how.head + how.separator.join(r["text"] for r in made) + how.tail, form).cache()
    assert back.where("_error is not null").count() == 0
    assert lines(back) == lines(own)
    assert rdf_nested.texts(own.limit(0), form).count() == 0


def test_what_xml_cannot_hold(spark):
    own = quads(spark, '<http://a> <http://e/p> "\\u0001" . <http://b> <http://e/1> "x" . <http://c> <http://e/n> [ <http://e/p> "\\u0002" ] . <http://d> <http://e/p> "x" .', "turtle")
    got = {r["s"]["value"]: r["_error"] for r in rdf_nested.texts(own, "rdfxml").collect()}
    assert got == {"http://a": "not representable in rdfxml", "http://b": "not representable in rdfxml", "http://c": "not representable in rdfxml", "http://d": None}
    assert not any(r["_error"] for r in rdf_nested.texts(own, "jsonld").collect())
