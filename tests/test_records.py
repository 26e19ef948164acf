"""Record functions and codecs on small rows."""

import pytest
from pyspark.sql import functions as F

from biblioflow.functions import marc, schema, text
from biblioflow.operators import rdf
from biblioflow.sources import codecs, iso2709


def L():  # noqa: N802
    return F.col("leader")


def FS():  # noqa: N802
    return F.col("fields")



def control(tag, value):
    return (tag, "", "", value, [])


def data(tag, *subs, ind=("1", " ")):
    return (tag, *ind, "", [tuple(s) for s in subs])


@pytest.fixture(scope="module")
def rec(spark):
    def make(*fields, leader=schema.DEFAULT_LEADER):
        return spark.createDataFrame([(leader, list(fields))], schema.RECORD)

    return make


def one(df, *cols):
    return df.select(*cols).first()


def test_trim_isbd(spark):
    df = spark.createDataFrame([("a /",), ("a / ",), ("a :;",), ("/\n",), ("",), ("  ",)], "s string")
    assert [r[0] for r in df.select(text.trim_isbd(F.col("s"))).collect()] == ["a", "a", "a :", "/\n", "", ""]


def test_present_empty_subfield_ends_the_search(rec):
    df = rec(data("245", ("b", "x")), data("245", ("a", "")), data("245", ("a", "y")))
    assert one(df, marc.subfield_value(FS(), "245", "a"))[0] == ""
    assert one(df, marc.subfield_values(FS(), "245", "a"))[0] == ["", "y"]


def test_control_tags_are_compared_as_text(rec):
    df = rec(control("001", "x"), data("010", ("a", "y")))
    assert one(df, marc.control_field(FS(), "001"))[0] == "x"
    assert one(df, marc.control_field(FS(), "010"))[0] == ""


def test_linkage_keeps_the_last_script(rec):
    df = rec(data("880", ("6", "245-01/(N/$1/r")), data("245", ("6", "880-01")), data("246", ("6", "880-1")))
    got = one(df, F.transform(FS(), marc.link))[0]
    assert tuple(got[0]) == ("245", "01", "$1", True) and got[2] is None


def test_insert_goes_before_the_first_greater_tag(rec):
    new = marc.make_data("300", " ", " ", marc.subfield("a", "n"))
    tags = lambda *t: [x["tag"] for x in one(rec(*[data(k, ("a", "x")) for k in t]), marc.insert_field(FS(), new))[0]]
    assert tags("100", "300", "500") == ["100", "300", "300", "500"]
    assert tags("500", "100") == ["300", "500", "100"]
    assert tags() == ["300"]


def test_mnemonic_escapes(rec):
    df = rec(control("001", "a$b{c}&d"), data("245", ("a", "{dollar}")))
    line = one(df, codecs.to_mrk(L(), FS()))[0]
    assert "=001  a{dollar}b{lcub}c{rcub}{amp}d\n" in line and "$a{lcub}dollar{rcub}" in line


def test_iso2709_lengths_are_bytes(rec):
    df = rec(control("001", "é"), data("245", ("a", "漢字")))
    raw = one(df, codecs.to_iso2709(L(), FS()))[0].encode()
    assert int(raw[:5]) == len(raw)
    leader, fields, lossy = iso2709.decode_record(raw)
    assert fields[1]["subfields"] == [{"code": "a", "value": "漢字"}] and not lossy
    assert one(rec(control("001", "a\x1eb")), codecs.iso_error(FS()))[0] == "delimiter"


def test_bad_documents_set_error(spark):
    df = spark.createDataFrame([("<record><controlfield tag='245'>x</controlfield></record>",), ("<a",)], "x string")
    assert all(r["_error"] for r in codecs.from_marcxml(df, "x").collect())
    assert codecs.from_marcjson(spark.createDataFrame([("{",)], "x string"), "x").first()["_error"]


def test_ntriples_terms(spark):
    lines = ['<http://a> <http://b> "x\\"y\\n"@en .', '_:n <http://b> "1"^^<http://t> .', "# note", "<http://a> <http://b> <http://c> <http://g> .", '"l" <http://b> <http://c> .']
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, value string")
    got = {r["pos"]: r for r in rdf.parse_nquads(df).collect()}
    assert got[0]["o"]["value"] == 'x"y\n' and got[0]["o"]["lang"] == "en"
    assert got[1]["s"]["kind"] == schema.BLANK and got[1]["o"]["datatype"] == "http://t"
    assert 2 not in got and got[3]["g"]["value"] == "http://g" and got[4]["_error"]


def test_canonical_form_ignores_labels_and_order(spark):
    def graph(a, b, order):
        rows = [f"_:{a} <http://p> _:{b} .", f'_:{b} <http://q> "x" .']
        return rdf.parse_nquads(spark.createDataFrame(list(enumerate(rows[::order])), "pos long, value string")).drop("_error")

    lines = lambda q: sorted(r[0] for r in rdf.canonical(q).collect())
    assert lines(graph("x", "y", 1)) == lines(graph("k", "j", -1))


def test_unimarc_to_marc21(rec):
    from biblioflow.operators import unimarc

    df = rec(
        control("001", "id\x88"), data("100", ("a", "20240131d2023    k  y0fre")), data("101", ("a", "fre")), data("200", ("a", "T\x88it "), ("e", "sub"), ("f", "who")),
        data("606", ("a", "x"), ("y", "place"), ("z", "time")), data("700", ("a", "Hugo"), ("b", "Victor"), ("4", "070"), ind=(" ", "1")), data("215", ("a", "3 p."), ("d", "24 cm")),
    )
    leader, fields = unimarc.to_marc21(L(), FS())
    got = {f["tag"]: f for f in one(df, fields)[0]}
    assert got["001"]["value"] == "id" and got["008"]["value"] == "240131s2023    " + "   " + "|" * 17 + "fre  "
    subs = lambda t: [tuple(s) for s in got[t]["subfields"]]
    assert subs("245") == [("a", "Tit"), ("b", "sub"), ("c", "who")] and subs("650") == [("a", "x"), ("z", "place"), ("y", "time")]
    assert subs("100") == [("a", "Hugo, Victor"), ("4", "070")] and subs("300") == [("a", "3 p."), ("c", "24 cm")]
    assert one(df, unimarc.title(FS()))[0] == "Tit sub" and one(df, unimarc.authors(FS()))[0] == ["Hugo, Victor"]


def test_search_tree(rec):
    from biblioflow.operators.search import term

    q = (term("author", 'mel"ville') & term("title", "moby dick")) - term("bath.x", "y")
    assert q.cql() == '((dc.author = "mel\\"ville") and (dc.title = "moby dick")) not (bath.x = "y")' and term("any", "a").cql() == '"a"'
    assert term("title", "mob*").wanted() == (["mob"], True, False) and term("title", "mob\\*").wanted() == (["mob"], False, False) and term("title", "a b").wanted()[2]
    df = rec(data("245", ("a", "Moby Dick; or, the whale")), data("100", ("a", "Melville, H.")))
    hit = lambda x: one(df, x.predicate(FS()))[0]
    assert hit(term("title", "moby dick")) and not hit(term("title", "dick moby")) and hit(term("title", "wha*")) and not hit(term("title", "wha"))
    assert hit(term("author", "melville") | term("title", "x")) and not hit(term("any", "whale") - term("any", "melville"))
    assert hit(term("title", "moby dick or the whale").whole_field()) and not hit(term("title", "moby").whole_field())


def test_postings_find_what_predicates_hold(spark, sf_dir):
    from biblioflow.operators.search import found, postings, term
    from biblioflow.plans import projection

    own = projection.records(spark, sf_dir).where("_pos < 80").cache()
    queries = {
        "word": term("title", "the and").word(), "turned": term("title", "the and"), "phrase": term("any", "and the"), "stem": term("any", "an th*").word(), "whole": term("author", "src1").whole_field(),
        "id": term("id", "doc7"), "tree": (term("subject", "France") | term("any", "in the")) - (term("author", "src*") & term("title", "th*")), "whole stem": term("author", "guild of s*").whole_field(),
    }
    got = {(r["query"], r["_pos"]) for r in found(postings(own, "_pos"), "_pos", queries).collect()}
    want = {(n, r["_pos"]) for n, q in queries.items() for r in own.where(q.predicate(FS())).select("_pos").collect()}
    assert got == want and len({n for n, _ in got}) > 5
    with pytest.raises(ValueError):
        term("title", "*").wanted()


def test_works_with_many_instances(spark, sf_dir):
    """A Work whose Instances are hundreds of records is read back as so many records, each with its own Instance and the Work's fields."""
    from biblioflow.operators import bibframe, bibframe_reverse
    from biblioflow.plans import projection

    own = projection.records(spark, sf_dir).where("_pos < 3").select("_pos", "leader", "fields").collect()
    fields = [f for f in own[1]["fields"] if f["tag"] not in ("520", "001")]
    many = [(k, "w" if k else None, own[1]["leader"], [("001", "", "", f"n{k}", []), *[tuple(f) for f in fields]]) for k in range(300)]
    df = spark.createDataFrame(many, f"_pos long, work string, leader string, fields {schema.FIELDS}")
    made = bibframe.statements(df, work="work").withColumn("doc", F.lit("d"))
    works = made.where((F.col("p.value") == schema.RDF + "type") & (F.col("o.value") == bibframe.BF + "Work") & F.startswith("s.value", F.lit("#n")))
    assert {r["s"]["value"] for r in works.collect()} == {"#n0Work", "#n1Work"}
    got = bibframe_reverse.records_of_graph(made, "doc").collect()
    assert len(got) == 300 and sum(r["work"] == "0 #n1Work" for r in got) == 299
    alone = {r["_pos"]: r for r in bibframe_reverse.records(bibframe.statements(df)).collect()}
    for r in got:
        k = int(r["instance"].removeprefix("0 #n").removesuffix("Instance"))
        assert r["fields"] == alone[k]["fields"] and r["leader"] == alone[k]["leader"]


def test_item_information(spark):
    from biblioflow.operators import circulation as c

    reply = "18030001" + "20240131    120000" + "AB123|AJTitle|AB456|CF2|AY1AZF000\r"
    got = spark.createDataFrame([(reply,), ("98Y",)], "m string").select(c.item_information(F.col("m")).alias("i"), c.checksum(F.lit("abc"))).collect()
    i = got[0]["i"]
    assert (i["status_label"], i["item_id"], i["title"], i["hold_queue_length"]) == ("available", "123", "Title", "2") and "AY" not in i["fields"]
    assert got[1]["i"] is None and got[0][1] == f"{-sum(b'abc') % 65536:04X}"


def test_streamed_records_are_counted(spark, tmp_path):
    from biblioflow.streaming import records as stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.mrk").write_text("=LDR  00000nam a2200000   4500\n=001  a\n=245  10$aT\n\n=LDR  00000nam a2200000   4500\n=001  b\n\n")
    stream.drain(stream.mrk(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert dict(map(tuple, stream.tag_counts(rows).collect())) == {"records": 6, "001": 6, "245": 3}
    assert stream.invalid(rows).count() == 0


def test_rdf_xml_and_json_ld(spark):
    from biblioflow.sources import documents

    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">'
    xml = head + '<e:Work rdf:about="http://w" e:k="v"><e:t xml:lang="en">T</e:t><e:i rdf:resource="http://i"/><e:n><e:Note><e:l>x</e:l></e:Note></e:n><e:b rdf:nodeID="q"/><e:p rdf:parseType="Resource"><e:z>1</e:z></e:p></e:Work></rdf:RDF>'
    made = {"@context": {"e": "http://e/", "link": {"@id": "e:link", "@type": "@id"}, "@vocab": "http://v/"}, "@id": "http://w", "@type": "e:Work", "name": ["a", {"@value": "b", "@language": "fr"}], "link": "e:x", "n": 3, "l": {"@list": ["p", "q"]}, "o": {"@id": "_:k", "name": "c"}}
    import json

    def read(text, form):
        rows = documents.parsed(spark.createDataFrame([("d", text)], "_source string, content string"), form).orderBy("pos").collect()
        assert not any(r["_error"] for r in rows)
        return [(r["s"]["value"], r["p"]["value"].rsplit("/", 1)[1].rsplit("#", 1)[-1], r["o"]["value"]) for r in rows]

    got = read(xml, "rdfxml")
    assert got[0] == ("http://w", "type", "http://e/Work") and ("http://w", "k", "v") in got and ("http://w", "t", "T") in got and ("http://w", "i", "http://i") in got
    assert ("http://w", "b", "xq") in got and [x for x in got if x[1] == "l"][0][2] == "x" and [x for x in got if x[1] == "z"][0][2] == "1"
    got = read(json.dumps(made), "jsonld")
    assert ("http://w", "type", "http://e/Work") in got and ("http://w", "link", "http://e/x") in got and ("http://w", "n", "3") in got and ("uk", "name", "c") in got
    assert [x[2] for x in got if x[1] == "first"] == ["p", "q"] and len([x for x in got if x[1] == "rest"]) == 2
    bad = documents.parsed(spark.createDataFrame([("d", "<a"), ("e", None)], "_source string, content string"), "rdfxml")
    assert all(r["_error"] for r in bad.collect())


def test_turtle(spark):
    from biblioflow.sources import documents

    text = '''@prefix e: <http://e/> . # a comment
@base <http://b/x/> .
PREFIX o: <http://o#>
e:a a e:T ; e:p "x"@en, 'y'^^o:d , """long "q" \\\\n s""" ; e:n 1, -2.5, 3e4 , true ; .
<rel> e:l ( 1 [ e:z _:q.1 ] ) . [ e:k e:v\\\\,w ] . e:c.d e:w () .'''.replace("\\\\", "\\")
    got = [tuple(x[k][1] for k in range(3)) + (x[2][2] or x[2][3].rsplit("#")[-1],) for x in documents.turtle(text)]
    assert ("http://e/a", "http://e/p", "x", "en") in got and ("http://e/a", "http://e/p", "y", "http://o#d"[9:]) in got
    assert ("http://e/a", "http://e/p", 'long "q" \n s', "string") in got and [x[3] for x in got if x[1] == "http://e/n"] == ["integer", "decimal", "double", "boolean"]
    assert ("g1", "http://e/z", "uq.1", "") in got and ("http://b/x/rel", "http://e/l", "g2", "") in got and ("g4", "http://e/k", "http://e/v,w", "") in got
    assert ("http://e/c.d", "http://e/w", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "") in got
    bad = ["e:a e:b e:c .", "<a> <b> .", '"x" <b> <c> .', "<a> <b> <c>", "<a> .", '<a> <b> "x', None]
    rows = documents.parsed(spark.createDataFrame(list(enumerate(bad)), "_source string, content string"), "turtle").where("_error is not null")
    assert rows.count() == len(bad) - 1  # a null document is an empty one


def test_labels_are_numbered_by_hash(spark):
    hashes = spark.range(500).selectExpr("cast(id as string) as label", "sha2(cast(id as string), 256) as hash")
    got = {r["label"]: r["new"] for r in rdf.labels(hashes).collect()}
    import hashlib

    want = sorted(map(str, range(500)), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert got == {x: f"c14n{k}" for k, x in enumerate(want)}
    assert rdf.ties(hashes.unionByName(hashes.limit(1))).count() == 1


def test_bibframe_relations_and_carriers(spark):
    from biblioflow.functions import schema
    from biblioflow.operators import bibframe

    def f(tag, i1, i2, *subs):
        return (tag, i1, i2, "", [tuple(x) for x in subs])

    fields = [
        ("001", "", "", "n1", []), ("007", "", "", "co", []), ("007", "", "", "cr", []), ("008", "", "", "240131s2000    xxu     o           eng d", []),
        f("490", "1", " ", ("a", "Tales ;"), ("v", "3")), f("490", "0", " ", ("a", "Other")), f("780", "0", "0", ("t", "Old paper"), ("x", "1234-5678")),
        f("785", "0", "9", ("a", "Club.")), f("787", "0", " ", ("w", "x")), f("830", " ", "0", ("a", "Tales"), ("v", "3")), f("810", "2", " ", ("a", "Guild"), ("t", "Books")),
    ]
    df = spark.createDataFrame([(1, "00000nam a2200000   4500", fields)], f"_pos int, leader string, fields {schema.FIELDS}")
    st = [(r["s"]["value"], r["p"]["value"].split("/")[-1].split("#")[-1], r["o"]["value"]) for r in bibframe.statements(df).collect()]
    objects = lambda p: sorted(x[2].split("/")[-1] for x in st if x[1] == p)
    assert objects("relationship") == ["continuationof", "series", "series", "series", "series", "succeededby"]
    assert objects("carrier") == ["cd", "cr"] and objects("media") == ["c"] and objects("seriesEnumeration") == ["3", "3"]
    assert objects("status") == ["t", "t", "tr"] and len([x for x in st if x[2].endswith("/Status")]) == 2
    assert {"Tales", "Other", "Old paper", "Books"} <= set(objects("mainTitle")) and "1234-5678" in objects("value")
    assert "7800 0$tOld paper$x1234-5678".replace("0 0", "00") in objects("label") and "830 0$aTales$v3" in objects("label")
    hub = next(x[0] for x in st if x[1] == "type" and x[2].endswith("/Hub"))
    assert (hub, "type", bibframe.BF + "Series") in st and any(x[2] == hub and x[1] == "associatedResource" for x in st)
    from biblioflow.operators import bibframe_reverse

    made = bibframe_reverse.records(bibframe.statements(df)).first()["fields"]
    shown = [f"{x['tag']} {x['ind1']}{x['ind2']} {x['value']}" + "".join(f"${y['code']}{y['value']}" for y in x["subfields"]) for x in made]
    want = ["007  co", "007  cr", "337    $bc$2rdamedia", "338    $bcd$2rdacarrier", "338    $bcr$2rdacarrier", "490 1  $aTales$v3", "490 0  $aOther", "780 00 $tOld paper$x1234-5678", "785 09 $aClub.", "810 2  $aGuild$tBooks", "830  0 $aTales$v3"]
    assert sorted(want) == sorted(x for x in shown if x[:3] not in ("001", "005", "245", "260")), shown
    back = df.select(F.explode("fields").alias("f")).where("f.tag > '009'").select(bibframe.parse_marc_key(bibframe.marc_key(F.col("f"))).alias("back"), "f").collect()
    assert all(r["back"] == r["f"] for r in back) and spark.range(1).select(bibframe.parse_marc_key(F.lit("245 ")).alias("x")).first()["x"] is None


def test_nquads_escapes_of_any_code_point(spark):
    line = r"""<http://h/\u00e9\U0001F600> <http://h/p> "\u00E9\U0001f600 \\u0041 \b\f\'\"\n\uD800" ."""
    row = rdf.parse_nquads(spark.createDataFrame([(1, line)], "pos long, value string")).first()
    assert row["_error"] is None and row["s"]["value"] == "http://h/é😀"
    assert row["o"]["value"] == "é😀 \\u0041 \b\f'\"\n\ufffd"


def test_keep_tags_of_every_record(spark):
    from biblioflow.plans import registry

    assert registry.QUERIES["p16_keep_tags_all"](spark, "/root/testdata/sf0.01").count() == 1000


def test_records_of_a_graph_are_worked_out_once(spark):
    from biblioflow.operators import bibframe_reverse
    from biblioflow.plans.records import surviving

    statements = spark.createDataFrame([], f"_pos long, pos long, s {schema.TERM}, p {schema.TERM}, o {schema.TERM}")
    plan = surviving(bibframe_reverse.records(statements))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
