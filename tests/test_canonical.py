"""Canonical names of blank nodes, and the lines of N-Quads, on small graphs."""

import random

import pytest

from biblioflow.operators import canon, rdf

LINES = [
    *[f"_:r{i} <http://e/next> _:r{(i + 1) % 6} ." for i in range(6)],  # a ring: all nodes alike
    "_:p <http://e/knows> _:q .", "_:q <http://e/knows> _:p .", "_:p <http://e/tag> \"x\" .", "_:q <http://e/tag> \"x\" .",
    "_:u <http://e/tag> \"only\" .", "_:u <http://e/has> _:v .", "_:w <http://e/tag> \"a\" _:g .", "_:x <http://e/tag> \"a\" _:h .", "_:g <http://e/is> <http://e/G> .", "_:h <http://e/is> <http://e/G> .",
    *[f"_:a{i} <http://e/next> _:a{i + 1} ." for i in range(3)], *[f"_:b{i} <http://e/next> _:b{i + 1} ." for i in range(3)],  # equal chains
    "<http://e/s> <http://e/p> \"caf\\u00E9\\b\\u007F\"@fr .",
]


def lines_of(spark, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "pos long, value string")
    return [r["line"] for r in rdf.canonical(rdf.parse_nquads(frame)).collect()]


def test_canonical_lines_do_not_depend_on_names_or_order(spark):
    first, rng = lines_of(spark, LINES), random.Random(3)
    assert first == sorted(first) and len(first) == len(LINES)
    for _ in range(1):
        names = [w for line in LINES for w in line.split() if w.startswith("_:")]
        new = dict(zip(sorted(set(names)), rng.sample([f"_:z{k}" for k in range(99)], len(set(names)))))
        again = [" ".join(new.get(w, w) for w in line.split(" ")) for line in LINES]
        rng.shuffle(again)
        assert lines_of(spark, again) == first


def test_a_pair_is_named_by_its_n_degree_hash(spark):
    """Two nodes that know each other, worked out by hand: equal first-degree hashes, equal n-degree hashes."""
    lines = ["_:p <http://e/k> _:q .", "_:q <http://e/k> _:p ."]
    part = canon.Part({"p": "h", "q": "h"}, {}, {"p": [("<http://e/k>", "o", "q"), ("<http://e/k>", "s", "q")], "q": [("<http://e/k>", "o", "p"), ("<http://e/k>", "s", "p")]})
    (h, digest, nodes), *rest = list(part.settled())
    assert h == "h" and len(nodes) == 2 and not rest and len(digest) == 64
    assert lines_of(spark, lines) == ["_:c14n0 <http://e/k> _:c14n1 .", "_:c14n1 <http://e/k> _:c14n0 ."]


def test_work_beyond_the_budget_is_an_error(spark):
    lines = [f"_:n{i} <http://e/p> _:n{j} ." for i in range(11) for j in range(11) if i != j]
    with pytest.raises(ValueError):
        lines_of(spark, lines)


def test_canonical_escapes(spark):
    frame = spark.createDataFrame([(0, '<http://e/s> <http://e/p> "\\b\\f\\u0001\\u007F\\t\\U0001F600" .')], "pos long, value string")
    assert lines_of(spark, [frame.first()["value"]]) == ['<http://e/s> <http://e/p> "\\b\\f\\u0001\\u007F\\t\U0001F600" .']


def test_statements_of_odd_lines(spark):
    long = "x\\n\\u00e9" * 150_000  # over a megabyte, with escapes
    rows = [
        (0, f'<http://e/s> <http://e/p> "{long}"@en-GB <http://e/g> .'), (1, '_:a.b <http://e/p> <> .'), (2, '_:a <http://e/p> "" .'), (3, '<s><p>"o"^^<http://e/\\u0041>.'),
        (4, '"no" <p> <o> .'), (5, '<s> <p> "open'), (6, '  # comment'), (7, '   '), (8, '<s> <p> _:end. # more'), (9, '<s> <p> "two\nlines" .'), (10, '<s> _:p <o> .'),
    ]
    got = {r["pos"]: r for r in rdf.parse_nquads(spark.createDataFrame(rows, "pos long, value string")).collect()}
    assert got[0]["o"]["value"] == "x\né" * 150_000 and got[0]["o"]["lang"] == "en-GB" and got[0]["g"]["value"] == "http://e/g"
    assert got[1]["s"]["value"] == "a.b" and got[1]["o"]["kind"] != got[2]["o"]["kind"] and got[1]["o"]["value"] == got[2]["o"]["value"] == ""
    assert got[3]["o"]["datatype"] == "http://e/A" and got[8]["o"]["value"] == "end" and got[8]["g"] is None
    assert {p for p in got if got[p]["_error"]} == {4, 5, 9, 10} and 6 not in got and 7 not in got


def test_empty_canonical(spark):
    assert lines_of(spark, ["# nothing"]) == []
