"""Files of statements read in many blocks against one reading of the whole document."""

import random

import pytest

from biblioflow.sources import documents, statements

TURTLE = (
    '# a comment with "quotes" and \'\n@prefix ex: <http://e/> .\n@base <http://b/x/> .\nPREFIX o: <http://o#>\n'
    "ex:a ex:p \"one. two\" , 'x' ; ex:q 1.5, 2 . ex:b a ex:C .\n"
    'ex:c ex:p """long\ntext with . and @prefix ex: <http://wrong/> .\n# no comment "" here \\\\""" ; ex:l ( 1 ( 2 ) "c" ) .\n'
    "@prefix ex: <http://second/> .\n<rel#x> ex:p [ ex:q <../up> ; ex:r [] ] .\nex:d o:p '''single \"long\" . '''@en-GB.\n_:n ex:p _:m .\n[] ex:p ex:last .\n"
)
XML = """<?xml version="1.0"?><!-- > --><!DOCTYPE rdf:RDF [ <!ENTITY e "http://e/"> ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/" ex:odd="a > b" xml:lang="en">
<ex:C rdf:about="&e;a"><ex:p>one &gt; two > three</ex:p><ex:q rdf:resource="http://r/"/></ex:C><!-- <ex:C> -->
<rdf:Description rdf:about='u"v'><ex:p xml:lang="fr"><![CDATA[ <ex:C> ]]></ex:p><ex:n><ex:D><ex:p>deep</ex:p></ex:D></ex:n></rdf:Description>
<ex:E rdf:nodeID="k" ex:att="x > y"/>
<?pi <ex:C> ?><ex:F><ex:p rdf:parseType="Resource"><ex:q>1</ex:q></ex:p></ex:F>
</rdf:RDF>
"""


def shown(rows):
    """Triples in order, blank labels by first mention."""
    names, out = {}, []
    for r in rows:
        if r["_error"]:
            out.append("error")
            continue
        out.append(tuple((t["kind"], names.setdefault(t["value"], len(names)) if t["kind"] == 1 else t["value"], t["lang"], t["datatype"]) for t in (r["s"], r["p"], r["o"])))
    return out


def whole(spark, text, form):
    return shown(documents.parsed(spark.createDataFrame([("d", text)], "_source string, content string"), form).orderBy("pos").collect())


def alone(text, form):
    keys = ("kind", "value", "lang", "datatype")
    parse = documents.PARSERS[form]
    return shown([{"_error": None, **{k: dict(zip(keys, t)) for k, t in zip("spo", x)}} for x in parse(text)])


@pytest.fixture
def blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("form", ["turtle", "rdfxml"])
def test_blocks_read_as_one(spark, tmp_path, blocks, form):
    text = TURTLE if form == "turtle" else XML
    files = {"a": text, "b": text.rstrip(), "c": "", "d": text.replace("\n", "\r\n")}
    if form == "rdfxml":
        files |= {"e": XML.split("\n")[1].replace("rdf:RDF", "ex:C").replace("ex:odd", "ex:att") + "<ex:p>v</ex:p><ex:q>w</ex:q></ex:C>", "f": '<ex:C xmlns:ex="http://e/"/>'}
    else:
        files |= {"e": "<http://a> <http://b> <http://c> .", "f": "PREFIX ex: <http://e/> ex:a ex:b ex:c ."}
    for name, own in files.items():
        (tmp_path / f"{name}.ttl").write_bytes(own.encode())
    for size in ("40", "190", "1000000"):
        blocks(size)
        rows = statements.read(spark, str(tmp_path), form).collect()
        for name, own in files.items():
            got = sorted((r for r in rows if r["_source"].endswith(f"{name}.ttl")), key=lambda r: r["pos"])
            assert shown(got) == (alone(own.lstrip("\ufeff"), form) if own else []), (size, name)
            assert len({r["pos"] for r in got}) == len(got)


def test_bad_statements_are_rows(spark, tmp_path, blocks):
    (tmp_path / "x.ttl").write_text('@prefix ex: <http://e/> .\nex:a ex:p "open .\nex:b ex:p ex:c .\nex:d no:p ex:e .\nex:f ex:p ex:g .\n')
    blocks("30")
    rows = statements.read(spark, str(tmp_path), "turtle").orderBy("pos").collect()
    assert [bool(r["_error"]) for r in rows] == [True, False, True, False] and rows[3]["s"]["value"] == "http://e/f"
    assert statements.read(spark, str(tmp_path), "turtle", skip_malformed=True).count() == 2


def test_transition_maps_compose(spark):
    rng = random.Random(4)
    for scan, states, alphabet in ((statements.scan_turtle, 3, ['"""', "'''", '"a"', "# x", ". ", "\\", "\n", "<a#b>"]), (statements.scan_xml, 7, ["<a>", "</a>", "<!--", "-->", "<![CDATA[", "]]>", '<a b="', '">', "<?x", "?>", "x > y", "/>"])):
        for _ in range(200):
            pieces = ["".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(6)]
            pieces = [(p.replace("\n", " ") + "\n" if states == 3 else p.replace(">", "") + ">").encode() for p in pieces]
            for k in range(states):
                state, depth = k, 0
                for p in pieces:
                    state, delta, _ = scan(p, state, depth)
                    depth += delta
                    assert 0 <= state < states


JSON = """[{"@id": "http://a", "http://e/p": [{"@value": "one }, {\\\\"two\\\\": \\\\\\\\"}, "x", "] }"]},
{"@context": {"e": "http://e/"}, "@id": "_:k", "e:n": {"e:p": "in", "e:n": {"e:l": {"@list": ["a", {"@id": "_:k"}]}}}},{"@id":"http://b","http://e/p":[3,true]},
{"http://e/p": ["alone ,", "{"]}, {"@id": "http://c"} ]
""".replace("\\\\", "\\")


def test_json_ld_blocks_read_as_one(spark, tmp_path, blocks):
    files = {"a": JSON, "b": JSON.strip(), "c": "[]", "d": "﻿" + JSON.replace("\n", "\r\n"), "e": '{"@context": {"e": "http://e/"}, "@graph": ' + JSON + "}", "f": '{"@id": "http://a", "http://e/p": "v"}\n', "g": JSON.replace("\n", "")}
    for name, own in files.items():
        (tmp_path / f"{name}.jsonld").write_bytes(own.encode())
    for size in ("40", "190", "1000000"):
        blocks(size)
        rows = statements.read(spark, str(tmp_path), "jsonld").collect()
        for name, own in files.items():
            got = sorted((r for r in rows if r["_source"].endswith(f"{name}.jsonld")), key=lambda r: r["pos"])
            assert shown(got) == alone(own.removeprefix("﻿"), "jsonld"), (size, name)
            assert len({r["pos"] for r in got}) == len(got)


def test_broken_json_ld_is_an_error(spark, tmp_path, blocks):
    bad = ['[{"a:b": 1}, {"a:b": 2}', '[{"a:b": 1},', '[{"a:b": 1', '{"a:b": 1', '{"a:b": "1', '[{"a:b": 1}] ]', '{"a:b": 1} {"a:b": 2}', '[{"a:b": 1} {"a:b": 2}]', '[{"a:b": 1}, ]', '["a"]', "[,]", '[{"a:b": 1}, "a"]', "3"]
    for k, own in enumerate(bad):
        (tmp_path / f"{k:02}.jsonld").write_text(own)
    for size in ("5", "1000000"):
        blocks(size)
        rows = statements.read(spark, str(tmp_path), "jsonld").where("_error is not null").collect()
        assert sorted({r["_source"][-9:-7] for r in rows}) == [f"{k:02}" for k in range(len(bad))]


def test_a_large_json_ld_file_loses_no_node(spark, tmp_path):
    nodes = [f'{{"@id":"http://a/{k}","http://e/p":["{"x" * (3 << 20)}"]}}' for k in range(6)]
    (tmp_path / "x.jsonld").write_text("[" + ",\n".join(nodes) + "]\n")  # over 16 MiB
    rows = documents.read(spark, str(tmp_path), "jsonld").selectExpr("s.value as s", "length(o.value) as n", "_error").collect()
    assert sorted((r["s"], r["n"]) for r in rows) == [(f"http://a/{k}", 3 << 20) for k in range(6)]
