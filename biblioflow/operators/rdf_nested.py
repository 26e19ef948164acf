"""Graphs written as nested documents: RDF/XML and JSON-LD.

A blank node that one statement alone refers to is written where it is referred to; everything else that has statements stands by
itself, and is referred to by its name. Who stands in whom is a forest, found from its roots downward, a join a level; blank nodes in a
circle, which no root leads to, stand by themselves. Texts are then folded from the deepest level upward, each into the property that
refers to it, so no graph is ever gathered, and a node's text is as large as what stands in it. Properties keep the order of pos.

Statements of named graphs are left out; both forms here write the default graph. A text that XML cannot hold, and a predicate that ends
in no XML name, makes the text null and sets _error, in all that it stands in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions import schema
from biblioflow.functions.shared import saved
from biblioflow.functions.text import escape_json, escape_xml

_NAME = r"\A(.*[^\p{L}\p{N}_.\-])([\p{L}_][\p{L}\p{N}_.\-]*)\z"


@dataclass(frozen=True)
class Form:
    """How an object is written (of p, o, and the text of what stands in it, or null), a node's properties (of an array of p and
    the objects' texts), and a node from its name, whether it is inside another, and its properties; what files of nodes begin with,
    are parted by and end with."""

    prop: Callable[[Column, Column, Column], Column]
    body: Callable[[Column], Column]
    node: Callable[[Column, Column, Column], Column]
    head: str
    separator: str
    tail: str


def _xml_prop(p: Column, o: Column, inside: Column) -> Column:
    ns, local = F.regexp_extract(p, _NAME, 1), F.regexp_extract(p, _NAME, 2)
    open_ = F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), escape_xml(ns), F.lit('"'))
    close = F.concat(F.lit("</n:"), local, F.lit(">"))
    value = F.when(~o["value"].rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"), F.replace(escape_xml(o["value"]), F.lit("\r"), F.lit("&#13;")))
    kind = F.when(o["lang"] != "", F.concat(F.lit(' xml:lang="'), o["lang"], F.lit('"'))).when(o["datatype"].isin("", schema.XSD + "string"), "")
    kind = kind.otherwise(F.concat(F.lit(' rdf:datatype="'), escape_xml(o["datatype"]), F.lit('"')))
    said = (
        F.when(inside.isNotNull(), F.concat(F.lit(">"), inside, close))
        .when(o["kind"] == schema.IRI, F.concat(F.lit(' rdf:resource="'), escape_xml(o["value"]), F.lit('"/>')))
        .when(o["kind"] == schema.BLANK, F.concat(F.lit(' rdf:nodeID="'), o["value"], F.lit('"/>')))
        .otherwise(F.concat(kind, F.lit(">"), value, close))
    )
    return F.when(local != "", F.concat(open_, said))


def _xml_node(s: Column, inside: Column, props: Column) -> Column:
    name = F.when(s["kind"] == schema.IRI, F.concat(F.lit(' rdf:about="'), escape_xml(s["value"]), F.lit('"')))
    name = name.when(inside, "").otherwise(F.concat(F.lit(' rdf:nodeID="'), s["value"], F.lit('"')))
    return F.concat(F.lit("<rdf:Description"), name, F.lit(">"), props, F.lit("</rdf:Description>"))


def _json_prop(p: Column, o: Column, inside: Column) -> Column:
    value = F.concat(F.lit('{"@value":'), escape_json(o["value"]))
    kind = F.when(o["lang"] != "", F.concat(F.lit(',"@language":'), escape_json(o["lang"]))).when(o["datatype"].isin("", schema.XSD + "string"), "")
    said = (
        F.when(inside.isNotNull(), inside)
        .when(o["kind"] == schema.IRI, F.concat(F.lit('{"@id":'), escape_json(o["value"]), F.lit("}")))
        .when(o["kind"] == schema.BLANK, F.concat(F.lit('{"@id":'), escape_json(F.concat(F.lit("_:"), o["value"])), F.lit("}")))
        .otherwise(F.concat(value, kind.otherwise(F.concat(F.lit(',"@type":'), escape_json(o["datatype"]))), F.lit("}")))
    )
    return said


def _xml_body(props: Column) -> Column:
    return F.array_join(F.transform(props, lambda x: x["prop"]), "")


def _json_body(props: Column) -> Column:
    """The objects of a predicate are one array: a name that comes twice would be lost."""

    def values(p: Column) -> Column:
        own = F.transform(F.filter(props, lambda x: x["p"] == p), lambda x: x["prop"])
        return F.concat(escape_json(p), F.lit(":["), F.array_join(own, ","), F.lit("]"))

    return F.array_join(F.transform(F.array_distinct(F.filter(F.transform(props, lambda x: x["p"]), lambda p: p.isNotNull())), values), ",")


def _json_node(s: Column, inside: Column, props: Column) -> Column:
    name = F.when(s["kind"] == schema.IRI, escape_json(s["value"])).when(~inside, escape_json(F.concat(F.lit("_:"), s["value"])))
    head = F.coalesce(F.concat(F.lit('"@id":'), name), F.lit(""))
    return F.concat(F.lit("{"), head, F.when((head != "") & (props != ""), ",").otherwise(""), props, F.lit("}"))


FORMS = {
    "rdfxml": Form(_xml_prop, _xml_body, _xml_node, f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{schema.RDF}">\n', "\n", "\n</rdf:RDF>\n"),
    "jsonld": Form(_json_prop, _json_body, _json_node, "[", ",\n", "]\n"),
}


def texts(quads: DataFrame, form: str, *keys: str) -> DataFrame:
    """(keys, s, text, _error) of every node that stands by itself; keys tell graphs apart."""
    own, keys = FORMS[form], list(keys)
    name = lambda t: F.concat(F.col(f"{t}.kind").cast("string"), F.lit(" "), F.col(f"{t}.value"))
    edges = quads.where("g is null") if "g" in quads.columns else quads
    edges = edges.groupBy(*keys, "s", "p", "o").agg(F.min("pos").alias("pos"))  # a graph is a set
    edges = saved(edges.select(*keys, "pos", "s", F.col("p.value").alias("p"), "o", name("s").alias("from"), F.when(F.col("o.kind") == schema.BLANK, name("o")).alias("to")), "edges")
    refs = edges.where("to is not null").groupBy(*keys, F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("from").alias("within"))
    inner = saved(refs.where((F.col("n") == 1) & (F.col("within") != F.col("node"))).select(*keys, "node", "within"), "inner")
    nodes = edges.groupBy(*keys, F.col("from").alias("node")).agg(F.first("s").alias("s"))
    level = saved(nodes.join(inner, [*keys, "node"], "left_anti").select(*keys, "node"), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = saved(inner.join(level.withColumnRenamed("node", "within"), [*keys, "within"]).select(*keys, "node"), "level")
    reached = levels[0] if levels else nodes.limit(0).select(*keys, "node")
    for more in levels[1:]:
        reached = reached.unionByName(more)
    # circles: nodes that stand by themselves after all, and so do not stand in others
    alone = saved(nodes.join(reached, [*keys, "node"], "left_anti").select(*keys, "node"), "circles")
    inside, out = None, None
    for depth in range(len(levels) - 1, -1, -1):
        inside = _folded(edges, levels[depth], inside, own, keys, depth > 0)
    parts = [x for x in (inside, _folded(edges, alone, None, own, keys, False)) if x is not None]
    for x in parts:
        out = x if out is None else out.unionByName(x)
    out = out.where(F.col("s").isNotNull()).select(*keys, "s", "text")
    return out.withColumn("_error", F.when(F.col("text").isNull(), F.lit(f"not representable in {form}")))


def _folded(edges: DataFrame, nodes: DataFrame, inside: DataFrame | None, form: Form, keys: list[str], nested: bool) -> DataFrame:
    """(keys, node, s, text) of one level, from the texts of the next."""
    rows = nodes.join(edges.withColumnRenamed("from", "node"), [*keys, "node"], "left")
    if inside is None:
        rows = rows.withColumns({"inner": F.lit(None).cast("string"), "holds": F.lit(False)})
    else:
        below = inside.select(*[F.col(k).alias(f"i_{k}") for k in keys], F.col("node").alias("i_node"), F.col("text").alias("inner"))
        same = F.col("to") == F.col("i_node")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"i_{k}"))
        rows = rows.join(below, same, "left").withColumn("holds", F.col("i_node").isNotNull())
    prop = F.when(F.col("p").isNull(), F.lit("")).when(~F.col("holds") | F.col("inner").isNotNull(), form.prop(F.col("p"), F.col("o"), F.col("inner")))
    rows = rows.select(*keys, "node", "s", F.coalesce("pos", F.lit(0)).alias("pos"), "p", prop.alias("prop"))
    made = rows.groupBy(*keys, "node").agg(F.first("s", ignorenulls=True).alias("s"), F.array_sort(F.collect_list(F.struct("pos", "p", "prop"))).alias("props"))
    bad = F.exists("props", lambda x: x["prop"].isNull())
    blank = F.struct(F.lit(schema.BLANK).cast("tinyint").alias("kind"), F.lit("").alias("value"), F.lit("").alias("lang"), F.lit("").alias("datatype"))
    text = F.when(~bad, form.node(F.coalesce("s", blank), F.lit(nested), form.body(F.col("props"))))
    return saved(made.select(*keys, "node", "s", text.alias("text")), "texts")


def save(quads: DataFrame, path: str, form: str) -> None:
    """Whole files of a graph's nodes; nodes that cannot be written are errors."""
    from biblioflow.sources import convert

    made, own = saved(texts(quads, form), "documents"), FORMS[form]
    bad = made.where("_error is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['s']['value']}: {bad[0]['_error']}")
    convert.save_texts(made.select("text"), path, own.head, own.separator, own.tail, ".rdf" if form == "rdfxml" else ".jsonld")
