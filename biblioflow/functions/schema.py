"""Row types: bibliographic records, RDF terms and quads, thesaurus concepts."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

SUBFIELD = "struct<code:string,value:string>"
FIELD = f"struct<tag:string,ind1:string,ind2:string,value:string,subfields:array<{SUBFIELD}>>"
FIELDS = f"array<{FIELD}>"
RECORD = f"leader string, fields {FIELDS}"
TERM = "struct<kind:tinyint,value:string,lang:string,datatype:string>"
QUAD = f"pos bigint, s {TERM}, p {TERM}, o {TERM}, g {TERM}"
IRI, BLANK, LITERAL = 0, 1, 2
DEFAULT_LEADER = "00000nam a2200000   4500"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SKOS = "http://www.w3.org/2004/02/skos/core#"


def record_type() -> StructType:
    return _parse_datatype_string(RECORD)
