"""The driver's tables as bibliographic records and graphs, said once and rendered for Spark and for DuckDB.

A field is (tag, ind1, ind2, condition, content): content is an SQL expression (control field) or a list of
(code, expression, condition). All expressions are the common dialect of both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANG = "CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' ELSE 'spa' END"
LEADER = (
    "CASE doc_id % 4 WHEN 0 THEN '00000nam a2200000   4500' WHEN 1 THEN '00000nas  2200000   4500' "
    "WHEN 2 THEN '00000nem a2200000   4500' ELSE '00000ngm a2200000   4500' END"
)
_FORM = "CASE doc_id % 7 WHEN 0 THEN 'd' WHEN 1 THEN 'f' ELSE ' ' END"
_ID = "CAST(doc_id AS VARCHAR(20))"
_YEAR = "CAST(1900 + doc_id % 120 AS VARCHAR(20))"
_LINE = "split_part(text, chr(10), 1)"


def _word(n: int) -> str:
    return f"split_part(text, ' ', {n})"


BIB: list[tuple[str, str, str, str, str | list[tuple[str, str, str]]]] = [
    ("001", "", "", "", f"'doc' || {_ID}"),
    ("003", "", "", "doc_id % 2 = 0", "'XxYzA'"),
    ("005", "", "", "", "'20240131120000.0'"),
    ("007", "", "", "doc_id % 11 = 0", "'fb'"),
    ("008", "", "", "doc_id % 13 <> 0", f"'240131s' || {_YEAR} || '    xxu' || '     ' || {_FORM} || '     ' || {_FORM} || '     ' || {LANG} || ' d'"),
    ("008", "", "", "doc_id % 13 = 0", "'240131s'"),
    ("020", " ", " ", "", [("a", f"'978' || lpad({_ID}, 10, '0') || CASE WHEN doc_id % 2 = 0 THEN ' :' ELSE '' END", ""), ("z", f"'979' || lpad({_ID}, 10, '0')", "doc_id % 5 = 1")]),
    ("022", " ", " ", "doc_id % 4 = 1", [("a", f"'1234-' || lpad(CAST(doc_id % 10000 AS VARCHAR(20)), 4, '0')", "")]),
    ("041", "0", " ", "doc_id % 6 = 0", [("a", f"{LANG} || 'lat'", ""), ("h", "'grc'", "")]),
    ("100", "1", " ", "doc_id % 3 <> 0", [("a", f"source || ', ' || {_word(1)} || ','", ""), ("e", "'author.'", "")]),
    ("110", "2", " ", "doc_id % 3 = 0", [("a", "source || ' society.'", "")]),
    ("245", "1", "0", "", [("6", "'880-01'", "doc_id % 5 = 0"), ("a", f"{_LINE} || CASE doc_id % 3 WHEN 0 THEN ' /' WHEN 1 THEN ' : ' ELSE '' END", ""), ("b", f"{_word(2)} || ' /'", "doc_id % 3 = 1"), ("c", "source || '.'", "")]),
    ("246", "3", "1", "doc_id % 10 = 3", [("a", f"{_word(5)} || ' title'", "")]),
    ("250", " ", " ", "doc_id % 4 = 0", [("a", "'2nd ed. ;'", "")]),
    ("260", " ", " ", "doc_id % 2 = 0", [("a", "'Paris :'", ""), ("b", "source || ' Press,'", ""), ("c", f"'c' || {_YEAR} || '.'", "")]),
    ("264", " ", "1", "doc_id % 2 = 1", [("a", "'Berlin ;'", ""), ("b", "source || ' Verlag,'", ""), ("c", f"{_YEAR} || '.'", "")]),
    ("264", " ", "4", "doc_id % 8 = 1", [("c", f"'copyright ' || {_YEAR}", "")]),
    ("300", " ", " ", "", [("a", "CAST(n_chars AS VARCHAR(20)) || ' p. ;'", ""), ("c", "'24 cm.'", "doc_id % 2 = 0")]),
    ("341", "0", " ", "doc_id % 9 = 0", [("a", "'textual'", ""), ("b", "'largePrint'", ""), ("d", "'captions'", "doc_id % 2 = 0")]),
    ("490", "1", " ", "doc_id % 7 = 2", [("a", "'Series of ' || source || ' ;'", ""), ("v", "CAST(doc_id % 50 AS VARCHAR(20))", "")]),
    ("500", " ", " ", "doc_id % 5 = 2", [("a", f"'Note ' || {_word(3)}", "")]),
    ("506", " ", " ", "doc_id % 17 = 0", [("a", "'Restricted & closed <here>.'", "")]),
    ("520", " ", " ", "", [("a", "text", "")]),
    ("532", "1", " ", "doc_id % 9 = 3", [("a", "'Tagged ' || lang", "")]),
    ("650", " ", "0", "", [("a", f"{_word(3)} || ' '", ""), ("x", _word(4), "doc_id % 2 = 1"), ("z", "'France'", "doc_id % 4 = 2")]),
    ("650", " ", "7", "doc_id % 3 = 1", [("a", f"{_word(6)} || '.'", ""), ("2", "'fast'", "")]),
    ("651", " ", "0", "doc_id % 6 = 5", [("a", "'Lyon'", ""), ("v", "'Maps'", "")]),
    ("700", "1", " ", "doc_id % 4 = 3", [("a", f"{_word(7)} || ', A.,'", ""), ("4", "'aut'", "")]),
    ("710", "2", " ", "doc_id % 8 = 2", [("a", "'Guild of ' || source", "")]),
    ("856", "4", "0", "", [("u", f"'http://example.org/' || {_ID}", ""), ("z", "'open'", "doc_id % 2 = 0")]),
    ("880", "1", "0", "doc_id % 5 = 0", [("6", "'245-01/(N/r'", ""), ("a", f"'alt ' || {_word(1)} || ' /'", "")]),
]


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR(20)", "STRING")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_pos, leader, fields: one record for each document."""
    out = []
    for tag, i1, i2, when, content in BIB:
        if isinstance(content, str):
            made = f"named_struct('tag','{tag}','ind1','','ind2','','value',{content},'subfields',cast(array() as array<struct<code:string,value:string>>))"
        else:
            subs = ", ".join(f"CASE WHEN {c or 'true'} THEN named_struct('code','{k}','value',{v}) END" for k, v, c in content)
            made = f"named_struct('tag','{tag}','ind1','{i1}','ind2','{i2}','value','','subfields',filter(array({subs}), x -> x is not null))"
        out.append(f"CASE WHEN {when or 'true'} THEN {made} END")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("_pos"),
        F.expr(LEADER).alias("leader"),
        F.expr(_spark(f"filter(array({', '.join(out)}), f -> f is not null)")).alias("fields"),
    )


def _duck() -> str:
    rows = []
    for k, (tag, i1, i2, when, content) in enumerate(BIB):
        if isinstance(content, str):
            rows.append(f"SELECT doc_id AS _pos, {k} AS k, '{tag}' AS tag, '' AS ind1, '' AS ind2, CAST(NULL AS VARCHAR) AS code, 0 AS j, {content} AS v FROM documents WHERE {when or 'true'}")
            continue
        for j, (code, v, c) in enumerate(content):
            rows.append(f"SELECT doc_id, {k}, '{tag}', '{i1}', '{i2}', '{code}', {j}, {v} FROM documents WHERE {when or 'true'} AND {c or 'true'}")
    return " UNION ALL ".join(rows)


#: rec(_pos, leader) and fld(_pos, i, tag, ind1, ind2, code, j, v), one row for each subfield; i and j count from 0 in the record and the field.
CTE = f"""rec AS (SELECT doc_id AS _pos, {LEADER} AS leader FROM documents),
raw_fld AS ({_duck()}),
fld AS (SELECT _pos, dense_rank() OVER (PARTITION BY _pos ORDER BY k) - 1 AS i, tag, ind1, ind2, code,
  row_number() OVER (PARTITION BY _pos, k ORDER BY j) - 1 AS j, v FROM raw_fld)"""
