"""Registered queries over the bibliographic projection, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions import marc, text
from biblioflow.operators import crosswalk
from biblioflow.plans.projection import CTE, records
from biblioflow.sources import codecs
from biblioflow.sources.iso2709 import decode as decode_iso2709

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def L():  # noqa: N802
    return F.col("leader")


def FS():  # noqa: N802
    return F.col("fields")


def query(name: str, sql: str | None = None, cte: bool = True):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(records(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {CTE}\n{sql}" if cte else sql
        return f

    return add


_TRIM = "rtrim(regexp_replace(rtrim({v}, ' '), '[/:;,]$', ''), ' ')"


def _t(v: str) -> str:
    return _TRIM.format(v=v)


def _first(tag: str, code: str) -> str:
    """SQL for the first subfield of a record in its fields with that tag."""
    return f"coalesce((SELECT arg_min(v, i * 100 + j) FROM fld f WHERE f._pos = r._pos AND tag = '{tag}' AND code = '{code}'), '')"


def _control(tag: str) -> str:
    return f"coalesce((SELECT arg_min(v, i) FROM fld f WHERE f._pos = r._pos AND tag = '{tag}' AND code IS NULL), '')"


@query(
    "p_title_profile",
    f"""SELECT substr(leader, 7, 2) AS kind, right({_t('v')}, 1) AS ending, count(*) AS n
    FROM rec JOIN fld USING (_pos) WHERE tag = '245' AND code = 'a' GROUP BY ALL""",
)
def title_profile(df):
    title = text.trim_isbd(marc.subfield_value(FS(), "245", "a"))
    return df.select(F.substring("leader", 7, 2).alias("kind"), F.substring(title, -1, 1).alias("ending")).groupBy("kind", "ending").agg(F.count(F.lit(1)).alias("n"))


@query("p1_control_field", f"SELECT _pos, {_control('001')} AS c001, {_control('003')} AS c003, {_control('008')} AS c008 FROM rec r")
def control_fields(df):
    return df.select("_pos", *[marc.control_field(FS(), t).alias(f"c{t}") for t in ("001", "003", "008")])


@query("p2_data_fields", "SELECT DISTINCT _pos, i, tag, ind1, ind2 FROM fld WHERE tag IN ('650', '651', '856')")
def data_fields(df):
    rows = df.select("_pos", F.posexplode("fields").alias("i", "f")).where(F.col("f.tag").isin("650", "651", "856"))
    return rows.select("_pos", F.col("i").cast("long").alias("i"), "f.tag", "f.ind1", "f.ind2")


@query("p3_first_subfield", f"SELECT _pos, {_first('245', 'a')} AS title, {_first('650', 'x')} AS topic, {_first('020', 'z')} AS bad_isbn FROM rec r")
def first_subfield(df):
    return df.select("_pos", marc.subfield_value(FS(), "245", "a").alias("title"), marc.subfield_value(FS(), "650", "x").alias("topic"), marc.subfield_value(FS(), "020", "z").alias("bad_isbn"))


@query("p4_all_subfields", "SELECT _pos, row_number() OVER (PARTITION BY _pos ORDER BY i, j) - 1 AS n, v AS value FROM fld WHERE tag = '650' AND code = 'a'")
def all_subfields(df):
    return df.select("_pos", F.posexplode(marc.subfield_values(FS(), "650", "a")).alias("n", "value")).withColumn("n", F.col("n").cast("long"))


@query("p5_field_subfields", "SELECT _pos, i, coalesce(max(CASE WHEN code = 'a' THEN v END), '') AS a, coalesce(string_agg(v, '|' ORDER BY j), '') AS every FROM fld WHERE tag = '650' GROUP BY _pos, i")
def field_subfields(df):
    rows = df.select("_pos", F.posexplode("fields").alias("i", "f")).where(F.col("f.tag") == "650")
    return rows.select("_pos", F.col("i").cast("long").alias("i"), marc.value(F.col("f"), "a").alias("a"), F.array_join(F.transform("f.subfields", lambda s: s["value"]), "|").alias("every"))


@query("p6_indicators", "SELECT DISTINCT _pos, i, tag < '010' AS control, ind1, ind2 FROM fld")
def indicators(df):
    rows = df.select("_pos", F.posexplode("fields").alias("i", "f"))
    return rows.select("_pos", F.col("i").cast("long").alias("i"), marc.is_control(F.col("f")).alias("control"), "f.ind1", "f.ind2")


@query("p7_leader", "SELECT _pos, substr(leader, 6, 1) AS status, substr(leader, 7, 1) AS type, substr(leader, 8, 1) AS level, substr(leader, 10, 1) = 'a' AS unicode, CAST(substr(leader, 1, 5) AS INT) AS length, CAST(substr(leader, 13, 5) AS INT) AS base FROM rec")
def leaders(df):
    return df.select(
        "_pos", marc.record_status(L()).alias("status"), marc.record_type(L()).alias("type"), marc.bib_level(L()).alias("level"), marc.is_unicode(L()).alias("unicode"),
        marc.record_length(L()).alias("length"), marc.base_address(L()).alias("base"),
    )


_C008 = f"(SELECT r._pos, leader, CASE WHEN length({_control('008')}) >= 18 THEN {_control('008')} ELSE '' END AS c FROM rec r)"
_AT = "CASE WHEN length(c) >= {b} THEN substr(c, {a} + 1, {b} - {a}) ELSE '' END"
_FORM = f"CASE WHEN substr(leader, 7, 1) IN ('e','f','g','k','o','r') THEN {_AT.format(a=29, b=30)} ELSE {_AT.format(a=23, b=24)} END"


@query("p8_fixed_008", f"SELECT _pos, {', '.join(f'{_AT.format(a=a, b=b)} AS {k}' for k, (a, b) in marc.POSITIONS.items())}, {_FORM} AS form_of_item, {_FORM} = 'd' AS large_print, {_FORM} = 'f' AS braille FROM {_C008}")
def fixed_008(df):
    return df.select("_pos", marc.control_008(L(), FS()).alias("c")).select("_pos", "c.*")


def _agg(tag: str, codes: str, order: str = "i, j") -> str:
    return f"coalesce((SELECT string_agg(v, '|' ORDER BY {order}) FROM fld f WHERE f._pos = r._pos AND tag = '{tag}' AND code IN ({codes})), '')"


@query(
    "p9_accessibility",
    f"""SELECT r._pos, {_FORM} = 'd' AS large_print, {_FORM} = 'f' AS braille, left({_control('007')}, 1) = 'f' AS tactile, {_agg('341', "'a'")} AS modes,
    {_agg('341', "'b','c','d','e'", 'i, code, j')} AS features, {_agg('532', "'a'")} AS notes FROM rec r JOIN {_C008.replace('SELECT r._pos, leader,', 'SELECT r._pos,')} c ON c._pos = r._pos""",
)
def accessibility(df):
    a = df.select("_pos", marc.accessibility(L(), FS()).alias("a"))
    join = lambda k: F.array_join(f"a.{k}", "|")
    return a.select("_pos", "a.large_print", "a.braille", "a.tactile", join("access_modes").alias("modes"), join("features").alias("features"), join("notes").alias("notes"))


@query("p10_linkage", "SELECT _pos, i, substr(v, 1, 3) AS tag, substr(v, 5, 2) AS occurrence, CASE WHEN v LIKE '%/(N%' THEN '(N' ELSE '' END AS script, CASE WHEN v LIKE '%/(N%' THEN 'Cyrillic' ELSE '' END AS script_name, v LIKE '%/r' AS rtl FROM fld WHERE code = '6'")
def linkage(df):
    rows = df.select("_pos", F.posexplode("fields").alias("i", "f")).select("_pos", F.col("i").cast("long").alias("i"), marc.link(F.col("f")).alias("l")).where("l is not null")
    return rows.select("_pos", "i", "l.tag", "l.occurrence", "l.script", marc.script_name(F.col("l.script")).alias("script_name"), "l.rtl")


def _tags(column):
    return F.array_join(F.transform(column, lambda f: f["tag"]), " ")


_TAGS = "(SELECT DISTINCT _pos, i, tag FROM fld)"


@query(
    "p11_edits",
    f"""SELECT _pos, string_agg(tag, ' ' ORDER BY i) || ' 999' AS added,
    trim(coalesce(string_agg(tag, ' ' ORDER BY i) FILTER (WHERE tag <= '500'), '') || ' 500 ' || coalesce(string_agg(tag, ' ' ORDER BY i) FILTER (WHERE tag > '500'), '')) AS inserted,
    CASE WHEN bool_or(tag = '250') THEN string_agg(tag, ' ' ORDER BY i) ELSE string_agg(tag, ' ' ORDER BY i) || ' 250' END AS replaced,
    coalesce(string_agg(tag, ' ' ORDER BY i) FILTER (WHERE tag NOT IN ('650', '856')), '') AS removed FROM {_TAGS} GROUP BY _pos""",
)
def edits(df):
    new = lambda t: marc.make_data(t, " ", " ", marc.subfield("a", "new"))
    return df.select(
        "_pos", _tags(marc.add_field(FS(), new("999"))).alias("added"), _tags(marc.insert_field(FS(), new("500"))).alias("inserted"),
        _tags(marc.replace_field(FS(), new("250"))).alias("replaced"), _tags(marc.remove_fields(FS(), "650", "856")).alias("removed"),
    )


@query("p16_keep_tags", f"SELECT _pos, string_agg(tag, ' ' ORDER BY i) AS tags FROM {_TAGS} WHERE tag IN ('245', '650', '856') GROUP BY _pos ORDER BY _pos LIMIT 500")
def keep_tags(df):
    """Only some tags of the first 500 records (the limit is the operator's own)."""
    return df.select("_pos", _tags(marc.keep_fields(FS(), "245", "650", "856")).alias("tags")).orderBy("_pos").limit(500)


@query("p16_keep_tags_all", f"SELECT _pos, string_agg(tag, ' ' ORDER BY i) AS tags FROM {_TAGS} WHERE tag IN ('245', '650', '856') GROUP BY _pos")
def keep_tags_all(df):
    """Only some tags of every record."""
    return df.select("_pos", _tags(marc.keep_fields(FS(), "245", "650", "856")).alias("tags"))


@query(
    "f2_validate",
    """SELECT _pos, CASE _pos % 6 WHEN 1 THEN 'leader is 3 bytes, want 24' WHEN 2 THEN 'field tag 24 is not 3 bytes' WHEN 3 THEN 'data field 999 has no subfields'
    WHEN 4 THEN 'control field 009 has subfields' WHEN 5 THEN 'data field 998 has a raw value' ELSE '' END AS error FROM rec""",
)
def validate(df):
    k = F.col("_pos") % 6
    bad = F.when(k == 2, marc.make_data("24", " ", " ", marc.subfield("a", "x"))).when(k == 3, marc.make_data("999", " ", " "))
    bad = bad.when(k == 4, marc.make_data("009", " ", " ", marc.subfield("a", "x"))).when(k == 5, marc.make_control("998", "x"))
    own = df.select("_pos", F.when(k == 1, "bad").otherwise(L()).alias("leader"), F.when(bad.isNotNull(), marc.add_field(FS(), bad)).otherwise(FS()).alias("fields"))
    return own.select("_pos", F.coalesce(marc.validate(L(), FS()), F.lit("")).alias("error"))


@query("f3_validate_totals", "SELECT count(*) AS records, count(*) FILTER (WHERE _pos % 3 = 1) AS invalid FROM rec")
def validate_totals(df):
    error = marc.validate(F.when(F.col("_pos") % 3 == 1, "short").otherwise(L()), FS())
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(error.isNotNull()).alias("invalid"))


_ALT = "coalesce((SELECT min(v) FROM fld f WHERE f._pos = r._pos AND tag = '880' AND code = 'a'), '')"


@query("j1_alternate_graphic", "SELECT a._pos, a.i, b.tag AS partner FROM fld a JOIN fld b ON a._pos = b._pos AND a.code = '6' AND b.code = '6' AND a.tag <> b.tag AND substr(a.v, 1, 3) = b.tag AND substr(a.v, 5, 2) = substr(b.v, 5, 2)")
def alternates(df):
    partners = F.transform(FS(), lambda f: marc.alternate_graphic(FS(), f)["tag"])
    return df.select("_pos", F.posexplode(partners).alias("i", "partner")).where("partner is not null").withColumn("i", F.col("i").cast("long"))


@query("j2_vernacular", f"SELECT _pos, {_ALT} AS title FROM rec r")
def vernaculars(df):
    return df.select("_pos", marc.vernacular(FS(), "245", "a").alias("title"))


@query(
    "a1_stats",
    f"""SELECT 'records' AS what, '' AS key, count(*) AS n FROM rec UNION ALL SELECT 'unicode', '', count(*) FROM rec WHERE substr(leader, 10, 1) = 'a'
    UNION ALL SELECT 'type', replace(substr(leader, 7, 1), ' ', '#'), count(*) FROM rec GROUP BY ALL UNION ALL SELECT 'level', replace(substr(leader, 8, 1), ' ', '#'), count(*) FROM rec GROUP BY ALL
    UNION ALL SELECT 'tag', tag, count(*) FROM {_TAGS} GROUP BY ALL""",
)
def stats(df):
    keys = F.concat(
        F.array(F.struct(F.lit("records").alias("what"), F.lit("").alias("key"))),
        F.when(marc.is_unicode(L()), F.array(F.struct(F.lit("unicode").alias("what"), F.lit("").alias("key")))).otherwise(F.array().cast("array<struct<what:string,key:string>>")),
        F.array(F.struct(F.lit("type").alias("what"), F.replace(marc.record_type(L()), F.lit(" "), F.lit("#")).alias("key")), F.struct(F.lit("level").alias("what"), F.replace(marc.bib_level(L()), F.lit(" "), F.lit("#")).alias("key"))),
        F.transform(FS(), lambda f: F.struct(F.lit("tag").alias("what"), f["tag"].alias("key"))),
    )
    return df.select(F.explode(keys).alias("k")).groupBy("k.what", "k.key").agg(F.count(F.lit(1)).alias("n"))


@query("t_trim_year_subject", f"SELECT _pos, {_t(_first('245', 'a'))} AS title, regexp_extract({_first('260', 'c')}, '[0-9][0-9][0-9][0-9]', 0) AS year FROM rec r")
def trims(df):
    return df.select("_pos", text.trim_isbd(marc.subfield_value(FS(), "245", "a")).alias("title"), text.year(marc.subfield_value(FS(), "260", "c")).alias("year"))


_SUBJ = "(SELECT _pos, i, string_agg(rtrim(v, ' '), '--' ORDER BY j) FILTER (WHERE code IN ('a','x','y','z','v') AND rtrim(v, ' ') <> '') AS v FROM fld WHERE tag IN ('600','610','611','630','650','651','653','655') GROUP BY _pos, i)"


def _join(tag: str, codes: str) -> str:
    return f"(SELECT _pos, i, string_agg({_t('v')}, ' ' ORDER BY j) FILTER (WHERE code IN ({codes}) AND {_t('v')} <> '') AS v FROM fld WHERE tag = '{tag}' GROUP BY _pos, i)"


def _each(tags: str, code: str, trim: bool = True) -> str:
    """First subfield with the code of each field."""
    v = _t("v") if trim else "v"
    return f"(SELECT _pos, i, {v} AS v FROM (SELECT _pos, i, arg_min(v, j) AS v FROM fld WHERE tag IN ({tags}) AND code = '{code}' GROUP BY _pos, i))"


_DCMI = "CASE substr(leader, 7, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in crosswalk.DCMI_TYPES.items()) + " ELSE 'Text' END"
_LANG8 = f"CASE WHEN length({_control('008')}) >= 38 THEN substr({_control('008')}, 36, 3) ELSE '' END"
_DC_PARTS = {
    "title": _join("245", "'a','b'"), "creator": _each("'100','110','111'", "a"), "subject": _SUBJ, "description": _each("'500','505','520','521','545','550'", "a", False),
    "publisher": _each("'260','264'", "b"), "contributor": _each("'700','710','711'", "a"), "date": _each("'260','264'", "c"), "format": _join("300", "'a','c'"),
    "identifier": f"(SELECT _pos, i * 100 + j AS i, {_t('v')} AS v FROM fld WHERE tag IN ('020','022','024') AND code = 'a' OR tag = '856' AND code = 'u')",
    "rights": _each("'506','540'", "a", False), "type": f"(SELECT _pos, 0 AS i, {_DCMI} AS v FROM rec)",
    "language": f"""(SELECT _pos, 0 AS i, lang8 AS v FROM (SELECT r._pos, {_LANG8} AS lang8 FROM rec r) WHERE lang8 <> '' AND NOT EXISTS (SELECT 1 FROM fld f WHERE f._pos = _pos AND f.tag = '041' AND f.code = 'a' AND substr(f.v, 1, 3) = lang8)
      UNION ALL SELECT _pos, k, substr(v, 3 * k - 2, 3) FROM fld, (SELECT unnest([1, 2]) AS k) WHERE tag = '041' AND code = 'a')""",
}
_DC_PARTS["language"] = _DC_PARTS["language"].replace("WHERE f._pos = _pos", "WHERE f._pos = l._pos").replace("AS lang8 FROM rec r)", "AS lang8 FROM rec r) l").replace("SELECT _pos, 0 AS i, lang8", "SELECT l._pos, 0 AS i, lang8")


@query("x1_dublin_core", " UNION ALL ".join(f"SELECT _pos, '{k}' AS element, row_number() OVER (PARTITION BY _pos ORDER BY i) - 1 AS n, v AS value FROM {sql} WHERE v <> ''" for k, sql in _DC_PARTS.items()))
def dublin_core(df):
    dc = df.select("_pos", crosswalk.dublin_core(L(), FS()).alias("dc"))

    def element(name):
        return F.transform(f"dc.{name}", lambda v, i: F.struct(F.lit(name).alias("element"), i.cast("long").alias("n"), v.alias("value")))

    rows = F.flatten(F.array(*[element(k) for k in crosswalk.DC_ELEMENTS]))
    return dc.select("_pos", F.explode(rows).alias("x")).select("_pos", "x.*")


def _pick(sql: str, how: str = "arg_min") -> str:
    return f"coalesce((SELECT {how}(v, i) FROM {sql} x WHERE x._pos = r._pos AND v <> ''), '')"


_DATE = _pick(_each("'260','264'", "c"))
_CIT = f"""SELECT r._pos, CASE WHEN substr(leader, 7, 2) IN ('as') THEN 'JOUR' WHEN substr(leader, 7, 1) = 'a' THEN 'BOOK' WHEN substr(leader, 7, 1) = 'e' THEN 'MAP' ELSE 'VIDEO' END AS ris_type,
  CASE WHEN substr(leader, 7, 2) IN ('as') THEN 'article' WHEN substr(leader, 7, 1) = 'a' THEN 'book' ELSE 'misc' END AS bib_type,
  {_pick(_join('245', "'a','b'"), 'arg_max')} AS title, {_pick(_each("'250'", 'a'), 'arg_max')} AS edition, {_pick(_each("'260','264'", 'a'))} AS place,
  {_pick(_each("'260','264'", 'b'))} AS publisher, {_DATE} AS date, regexp_extract({_DATE}, '[0-9][0-9][0-9][0-9]', 0) AS year, {_pick(_each("'520'", 'a', False))} AS abstract,
  coalesce((SELECT string_agg(v, '|' ORDER BY i) FROM {_each("'100','110','111','700','710','711'", 'a')} x WHERE x._pos = r._pos AND v <> ''), '') AS authors, {_LANG8} AS language FROM rec r"""


@query("x3_citation", _CIT)
def citation(df):
    c = df.select("_pos", crosswalk.citation(L(), FS()).alias("c"))
    keep = ("ris_type", "bib_type", "title", "edition", "place", "publisher", "date", "year", "abstract", "language")
    return c.select("_pos", *[f"c.{k}" for k in keep], F.array_join(F.transform("c.authors", lambda a: a["name"]), "|").alias("authors"))


_KEY = "lower(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"


@query(
    "x4_cite_key",
    f"""SELECT _pos, {_KEY.format(v="split_part(split_part(authors, '|', 1), ',', 1)")} || year ||
    coalesce(list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda w: {_KEY.format(v='w')}), lambda w: w <> '')[1], '') AS cite_key FROM ({_CIT})""",
)
def cite_key(df):
    return df.select("_pos", crosswalk.cite_key(crosswalk.citation(L(), FS())).alias("cite_key"))


@query("k8_ris")
def ris(df):
    return df.select("_pos", crosswalk.ris(crosswalk.citation(L(), FS())).alias("ris"))


_MNEM = "replace(replace(replace(replace(replace(replace({v}, '{{', chr(1)), '}}', chr(2)), '$', '{{dollar}}'), '&', '{{amp}}'), chr(1), '{{lcub}}'), chr(2), '{{rcub}}')"


def _m(v: str) -> str:
    return _MNEM.format(v=v)


_MRK = f"""SELECT r._pos, '=LDR  ' || leader || chr(10) || string_agg(line, '' ORDER BY i) AS mrk FROM rec r JOIN (
  SELECT _pos, i, '=' || any_value(tag) || '  ' || CASE WHEN any_value(tag) < '010' THEN any_value({_m('v')})
    ELSE replace(any_value(ind1), ' ', '\\') || replace(any_value(ind2), ' ', '\\') || string_agg('$' || code || {_m('v')}, '' ORDER BY j) END || chr(10) AS line FROM fld GROUP BY _pos, i) USING (_pos) GROUP BY r._pos, leader"""


@query("k5_mrk_encode", _MRK)
def mrk(df):
    return df.select("_pos", codecs.to_mrk(L(), FS()).alias("mrk"))


_SAME = "SELECT _pos, true AS same FROM rec"


def _clean():
    """Fields without line breaks, which mnemonic lines cannot carry."""
    value = lambda s: s.withField("value", F.regexp_replace(s["value"], "[\r\n]", " "))
    return F.transform(FS(), lambda f: f.withField("subfields", F.transform(f["subfields"], value)))


@query("s6_mrk_roundtrip", _SAME)
def mrk_roundtrip(df):
    own = df.select("_pos", L(), _clean().alias("fields"))
    text_ = own.select("_pos", L(), FS(), codecs.to_mrk(L(), FS()).alias("mrk"))
    leader, fields, _ = codecs.mrk_fields(F.col("mrk"))
    return text_.select("_pos", ((leader == L()) & (fields == FS())).alias("same"))


_BYTES = """(SELECT _pos, i, any_value(tag) AS tag, CASE WHEN any_value(tag) < '010' THEN any_value(v)
    ELSE any_value(ind1) || any_value(ind2) || string_agg(chr(31) || code || v, '' ORDER BY j) END || chr(30) AS t FROM fld GROUP BY _pos, i)"""
_ISO = f"""SELECT r._pos, CASE WHEN max(strlen(t)) > 9999 THEN 'field length' WHEN 26 + 12 * count(*) + sum(strlen(t)) > 99999 THEN 'record length' ELSE '' END AS error,
  lpad(CAST(26 + 12 * count(*) + sum(strlen(t)) AS VARCHAR), 5, '0') || substr(leader, 6, 4) || 'a22' || lpad(CAST(25 + 12 * count(*) AS VARCHAR), 5, '0') || substr(leader, 18, 3) || '4500' ||
  string_agg(tag || lpad(CAST(strlen(t) AS VARCHAR), 4, '0') || lpad(CAST(s AS VARCHAR), 5, '0'), '' ORDER BY i) || chr(30) || string_agg(t, '' ORDER BY i) || chr(29) AS iso
  FROM rec r JOIN (SELECT *, coalesce(sum(strlen(t)) OVER (PARTITION BY _pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {_BYTES}) USING (_pos) GROUP BY r._pos, leader"""


def _iso(df):
    """Each record's ISO 2709 form; a record that the format cannot hold gets an error and an empty form."""
    error = codecs.iso_error(FS())
    return df.withColumn("error", F.coalesce(error, F.lit(""))).withColumn("iso", F.when(F.col("error") == "", codecs.to_iso2709(L(), FS())).otherwise(""))


@query("k1_iso2709_encode", f"SELECT _pos, error, CASE WHEN error = '' THEN iso ELSE '' END AS iso FROM ({_ISO})")
def iso2709(df):
    return _iso(df).select("_pos", "error", "iso")


@query("s2_iso2709_roundtrip", f"SELECT _pos, error, error = '' AS same FROM ({_ISO})")
def iso_roundtrip(df):
    own = _iso(df).select("_pos", "error", FS().alias("before"), "iso")
    back = decode_iso2709(own.where("error = ''"), "iso").select("_pos", "error", (FS() == F.col("before")).alias("same"))
    return back.unionByName(own.where("error <> ''").select("_pos", "error", F.lit(False).alias("same")))


@query("s4_marcxml_roundtrip", _SAME)
def xml_roundtrip(df):
    own = df.select("_pos", L().alias("l"), FS().alias("before"), codecs.to_marcxml(L(), FS()).alias("xml"))
    return codecs.from_marcxml(own, "xml").select("_pos", ((FS() == F.col("before")) & (L() == F.col("l"))).alias("same"))


@query("s5_marcjson_roundtrip", _SAME)
def json_roundtrip(df):
    own = df.select("_pos", L().alias("l"), FS().alias("before"), codecs.to_marcjson(L(), FS()).alias("json"))
    return codecs.from_marcjson(own, "json").select("_pos", ((FS() == F.col("before")) & (L() == F.col("l"))).alias("same"))


def _x(v: str) -> str:
    return f"""replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


_PAIR = "(SELECT unnest(['iso2709', 'marcjson', 'marcxml', 'mrk']) AS source) a, (SELECT unnest(['iso2709', 'marcjson', 'marcxml', 'mrk']) AS target) b"


@query(
    "x14_convert",
    f"""SELECT source, target, count(*) AS records, count(*) FILTER (WHERE error = '' OR (source <> 'iso2709' AND target <> 'iso2709')) AS same FROM ({_ISO}), {_PAIR} GROUP BY ALL""",
)
def convert_all(df):
    """Each record's text in each format, read back and written in each format, against what it is written as at first. A record
    that ISO 2709 cannot hold has no text to compare."""
    from biblioflow.sources import convert

    # lengths and sizes in a leader are those of the ISO 2709 form alone
    plain = F.concat(F.lit("00000"), F.substring(L(), 6, 4), F.lit("a2200000"), F.substring(L(), 18, 3), F.lit("4500"))
    own, out = df.select("_pos", plain.alias("leader"), _clean().alias("fields")), None
    for name in convert.BOTH_WAYS:
        own = own.withColumn(name, F.when(F.coalesce(codecs.iso_error(FS()), F.lit("")) == "", codecs.to_iso2709(L(), FS())) if name == "iso2709" else convert.FORMATS[name].write(L(), FS()))
    for source in convert.BOTH_WAYS:
        rows = own.select(*[F.col(n).alias(f"to_{n}") for n in convert.BOTH_WAYS], F.coalesce(F.col(source), F.lit("")).alias("raw"))
        read = convert.decode(rows, "raw", source).withColumn("leader", plain)
        pairs = [F.struct(F.lit(n).alias("target"), F.coalesce(convert.FORMATS[n].write(L(), FS()) == F.col(f"to_{n}"), F.lit(False)).alias("same")) for n in convert.BOTH_WAYS]
        found = read.select(F.lit(source).alias("source"), F.explode(F.array(*pairs)).alias("x")).groupBy("source", "x.target")
        found = found.agg(F.count(F.lit(1)).alias("records"), F.count_if("x.same").alias("same"))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "k3_marcxml_encode",
    f"""SELECT r._pos, '<record><leader>' || leader || '</leader>' || string_agg(x, '' ORDER BY i) || '</record>' AS xml FROM rec r JOIN (
    SELECT _pos, i, CASE WHEN any_value(tag) < '010' THEN '<controlfield tag="' || any_value(tag) || '">' || any_value({_x('v')}) || '</controlfield>'
    ELSE '<datafield tag="' || any_value(tag) || '" ind1="' || any_value(ind1) || '" ind2="' || any_value(ind2) || '">' || string_agg('<subfield code="' || code || '">' || {_x('v')} || '</subfield>', '' ORDER BY j) || '</datafield>' END AS x
    FROM fld GROUP BY _pos, i) USING (_pos) GROUP BY r._pos, leader""",
)
def marcxml(df):
    return df.select("_pos", codecs.to_marcxml(L(), FS()).alias("xml"))


@query(
    "k4_marcjson_encode",
    """SELECT r._pos, '{"leader":' || CAST(to_json(leader) AS VARCHAR) || ',"fields":[' || string_agg(x, ',' ORDER BY i) || ']}' AS json FROM rec r JOIN (
    SELECT _pos, i, '{"' || any_value(tag) || '":' || CASE WHEN any_value(tag) < '010' THEN any_value(CAST(to_json(v) AS VARCHAR))
    ELSE '{"subfields":[' || string_agg('{"' || code || '":' || CAST(to_json(v) AS VARCHAR) || '}', ',' ORDER BY j) || '],"ind1":"' || any_value(ind1) || '","ind2":"' || any_value(ind2) || '"}' END || '}' AS x
    FROM fld GROUP BY _pos, i) USING (_pos) GROUP BY r._pos, leader""",
)
def marcjson(df):
    return df.select("_pos", codecs.to_marcjson(L(), FS()).alias("json"))


@query("f10_mnemonic_guard", "SELECT _pos, CASE WHEN bool_or(contains(v, chr(10)) OR contains(v, chr(13))) THEN 'line break' ELSE '' END AS error FROM fld GROUP BY _pos")
def mnemonic_guard(df):
    return df.select("_pos", F.coalesce(codecs.mrk_error(L(), FS()), F.lit("")).alias("error"))


@query("s21_sniff", "SELECT f.* FROM (SELECT unnest(['iso2709', 'marcjson', 'marcxml', 'mrk']) AS format) f, (SELECT count(*) AS n FROM rec) WHERE n > 0".replace("SELECT f.* FROM", "SELECT f.format, n AS n FROM"))
def sniffed(df):
    texts = F.array(codecs.to_mrk(L(), FS()), codecs.to_iso2709(L(), FS()), codecs.to_marcxml(L(), FS()), codecs.to_marcjson(L(), FS()))
    return df.select(F.explode(texts).alias("t")).groupBy(codecs.sniff(F.col("t")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


_ST = "CASE substr(leader, 7, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in crosswalk.SCHEMA_TYPES.items()) + " ELSE 'CreativeWork' END"
_B47 = "CASE {v} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in crosswalk.BCP47.items()) + " ELSE {v} END"
_ABOUT = _SUBJ.replace(",'655'", "")


def _all(sql: str) -> str:
    return f"coalesce((SELECT string_agg(v, '|' ORDER BY i) FROM {sql} x WHERE x._pos = r._pos AND v <> ''), '')"


_YEARS = f"(SELECT _pos, i, regexp_extract(v, '[0-9][0-9][0-9][0-9]', 0) AS v FROM {_each("'260','264'", 'c')})"
_LANGS = f"""(SELECT _pos, min(i) AS i, v FROM (SELECT _pos, k AS i, {_B47.format(v='substr(v, 3 * k - 2, 3)')} AS v FROM fld, (SELECT unnest([1, 2]) AS k) WHERE tag = '041' AND code = 'a'
  UNION ALL SELECT _pos, 9, {_B47.format(v='l8')} FROM (SELECT _pos, CASE WHEN length(v) >= 38 THEN substr(v, 36, 3) ELSE '' END AS l8
    FROM (SELECT _pos, arg_min(v, i) AS v FROM fld WHERE tag = '008' AND code IS NULL GROUP BY _pos)) WHERE l8 <> '') GROUP BY _pos, v)"""


@query(
    "x5_schema_org",
    f"""SELECT r._pos, {_ST} AS type, {_pick(_join('245', "'a','b'"), 'arg_max')} AS name, {_all(_each("'100','110','111'", 'a'))} AS author, {_all(_each("'700','710','711'", 'a'))} AS contributor,
    {_pick(_each("'260','264'", 'b'))} AS publisher, {_pick(_YEARS)} AS published, {_all(_ABOUT)} AS about, {_all(_LANGS)} AS languages, {_agg('341', "'a'")} AS access_mode,
    {_agg('532', "'a'")} AS summary FROM rec r""",
)
def schema_org(df):
    b = df.select("_pos", crosswalk.schema_org(L(), FS()).alias("b"))
    names = lambda c: F.array_join(F.transform(c, lambda a: a["name"]), "|")
    return b.select(
        "_pos", "b.type", "b.name", names("b.author").alias("author"), names("b.contributor").alias("contributor"), "b.publisher", F.col("b.datePublished").alias("published"),
        F.array_join("b.about", "|").alias("about"), F.array_join("b.inLanguage", "|").alias("languages"), F.array_join("b.accessMode", "|").alias("access_mode"),
        F.col("b.accessibilitySummary").alias("summary"),
    )


_MT = "CASE substr(leader, 7, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in crosswalk.MODS_TYPES.items()) + " ELSE 'text' END"
_BEST = """(SELECT _pos, i, CASE WHEN tag = '260' THEN 2 WHEN ind2 = '1' THEN 3 ELSE 1 END AS rank FROM fld WHERE tag IN ('260', '264') AND ind2 <> '4'
  QUALIFY row_number() OVER (PARTITION BY _pos ORDER BY CASE WHEN tag = '260' THEN 2 WHEN ind2 = '1' THEN 3 ELSE 1 END DESC, i, j) = 1)"""


def _best(code: str) -> str:
    return f"coalesce((SELECT any_value({_t('f.v')}) FROM {_BEST} b JOIN fld f ON f._pos = b._pos AND f.i = b.i WHERE f._pos = r._pos AND f.code = '{code}'), '')"


_MLANG = f"""(SELECT _pos, min(i) AS i, v FROM (SELECT _pos, k AS i, substr(v, 3 * k - 2, 3) AS v FROM fld, (SELECT unnest([1, 2]) AS k) WHERE tag = '041' AND code = 'a'
  UNION ALL SELECT r._pos, 0, {_LANG8} FROM rec r) WHERE v <> '' GROUP BY _pos, v)"""


@query(
    "x2_mods",
    f"""SELECT r._pos, {_MT} AS type_of_resource, {_pick(_each("'245'", 'a'))} AS title, {_all(_each("'100','110','111','700','710','711'", 'a'))} AS names, {_best('a')} AS places, {_best('b')} AS publisher,
    {_best('c')} AS date_issued, {_pick("(SELECT _pos, i, " + _t('v') + " AS v FROM fld WHERE tag = '264' AND ind2 = '4' AND code = 'c')")} AS copyright_date,
    {_pick(_each("'250'", 'a'), 'arg_max')} AS edition, {_all(_MLANG)} AS languages, {_pick(_join('300', "'a','c'"))} AS extent,
    {_all("(SELECT _pos, i * 100 + j AS i, rtrim(v, ' ') AS v FROM fld WHERE tag = '650' AND code IN ('a', 'x'))")} AS topics,
    {_all(_DC_PARTS['identifier'])} AS identifiers, {_control('001')} AS record_id FROM rec r""",
)
def mods(df):
    m = df.select("_pos", crosswalk.mods(L(), FS()).alias("m"))
    return m.select(
        "_pos", "m.type_of_resource", F.col("m.titles")[0]["title"].alias("title"), F.array_join(F.transform("m.names", lambda n: n["name"]), "|").alias("names"),
        F.array_join("m.places", "|").alias("places"), "m.publisher", "m.date_issued", "m.copyright_date", "m.edition", F.array_join("m.languages", "|").alias("languages"), "m.extent",
        F.array_join(F.flatten(F.transform("m.subjects", lambda s: s["topic"])), "|").alias("topics"), F.array_join(F.transform("m.identifiers", lambda x: x["value"]), "|").alias("identifiers"), "m.record_id",
    )


@query("k8_bibtex")
def bibtex(df):
    return df.select("_pos", crosswalk.bibtex(crosswalk.citation(L(), FS())).alias("bibtex"))


_BF = "http://id.loc.gov/ontologies/bibframe/"
_FIRST_PROV = "(SELECT _pos, i, tag, ind2, coalesce(max(CASE WHEN code = 'a' THEN v END), '') AS a, coalesce(max(CASE WHEN code = 'b' THEN v END), '') AS b FROM fld WHERE tag IN ('260', '264') AND ind2 <> '4' GROUP BY ALL)"


@query(
    "x8_bibframe_statements",
    f"""SELECT _pos, predicate, value FROM (
    SELECT _pos, 'mainTitle' AS predicate, {_t('v')} AS value FROM fld, (SELECT unnest([1, 2]) AS twice) WHERE tag = '245' AND code = 'a'
    UNION ALL SELECT _pos, 'mainTitle', {_t('v')} FROM fld WHERE tag = '246' AND code = 'a'
    UNION ALL SELECT _pos, CASE code WHEN 'a' THEN 'mainTitle' ELSE 'seriesEnumeration' END, {_t('v')} FROM fld WHERE tag = '490'
    UNION ALL SELECT _pos, 'responsibilityStatement', {_t('v')} FROM fld WHERE tag = '245' AND code = 'c'
    UNION ALL SELECT _pos, 'editionStatement', {_t('v')} FROM fld WHERE tag = '250' AND code = 'a'
    UNION ALL SELECT _pos, 'simplePlace', {_t('a')} FROM {_FIRST_PROV} UNION ALL SELECT _pos, 'simpleAgent', {_t('b')} FROM {_FIRST_PROV}
    UNION ALL SELECT r._pos, 'code', {_LANG8} FROM rec r UNION ALL SELECT _pos, 'code', c FROM (SELECT r._pos, {_LANG8} AS l8, unnest([substr(v, 1, 3), 'lat']) AS c FROM rec r JOIN fld f ON f._pos = r._pos AND tag = '041' AND code = 'a') WHERE c <> l8
    UNION ALL SELECT _pos, 'code', 'grc' FROM fld WHERE tag = '041' AND code = 'h'
    UNION ALL SELECT _pos, 'value', {_t('v')} FROM fld WHERE tag IN ('020', '022') AND code IN ('a', 'z') UNION ALL SELECT _pos, 'value', v FROM fld WHERE tag = '001'
    UNION ALL SELECT _pos, 'dimensions', {_t('v')} FROM fld WHERE tag = '300' AND code = 'c') WHERE value <> ''""",
)
def bibframe_statements(df):
    from biblioflow.operators import bibframe, rdf

    keep = ("mainTitle", "responsibilityStatement", "editionStatement", "simplePlace", "simpleAgent", "code", "value", "dimensions", "seriesEnumeration")
    name = rdf.local_name(F.col("p.value"))
    return bibframe.statements(df).where(name.isin(*keep)).select("_pos", name.alias("predicate"), F.col("o.value").alias("value"))


@query("x8_bibframe_classes")
def bibframe_classes(df):
    """How often each class and predicate is used."""
    from biblioflow.operators import bibframe

    out = bibframe.statements(df)
    used = F.when(F.col("p.value").endswith("#type"), F.col("o.value")).otherwise(F.col("p.value"))
    return out.select(used.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_DC_ROWS = " UNION ALL ".join(
    f"SELECT _pos, {k} AS e, '{name}' AS element, i, v AS value FROM {_DC_PARTS[name]} WHERE v <> ''" for k, name in enumerate(crosswalk.DC_ELEMENTS)
)


@query(
    "k7_dublin_core_json",
    f"""SELECT _pos, '{{' || string_agg('"' || element || '":' || l, ',' ORDER BY e) || '}}' AS json FROM (
    SELECT _pos, e, element, '[' || string_agg(CAST(to_json(value) AS VARCHAR), ',' ORDER BY i) || ']' AS l FROM ({_DC_ROWS}) GROUP BY _pos, e, element) GROUP BY _pos""",
)
def dublin_core_json(df):
    from biblioflow.sources import writers

    return df.select("_pos", writers.dublin_core_json(crosswalk.dublin_core(L(), FS())).alias("json"))


@query(
    "k7_oai_dc",
    f"""SELECT _pos, '<oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">' || chr(10) ||
    string_agg('  <dc:' || element || '>' || {_x('value')} || '</dc:' || element || '>' || chr(10), '' ORDER BY e, i) || '</oai_dc:dc>' AS xml FROM ({_DC_ROWS}) GROUP BY _pos""",
)
def oai_dc(df):
    from biblioflow.sources import writers

    return df.select("_pos", writers.dublin_core_xml(crosswalk.dublin_core(L(), FS())).alias("xml"))


@query("k9_schema_org_json")
def schema_org_json(df):
    from biblioflow.sources import writers

    return df.select("_pos", writers.schema_org_json(crosswalk.schema_org(L(), FS())).alias("json"))


@query("k6_mods_xml")
def mods_xml(df):
    from biblioflow.sources import writers

    return df.select("_pos", writers.mods_xml(crosswalk.mods(L(), FS())).alias("xml"))


_FOLD = "' ' || trim(regexp_replace(lower({v}), '[^\\pL\\pN]+', ' ', 'g')) || ' '"
_IN_TITLE = f"EXISTS (SELECT 1 FROM fld f WHERE f._pos = r._pos AND f.tag IN ('245', '246') AND f.code IN ('a', 'b') AND contains({_FOLD.format(v='f.v')}, ' the'))"
_IN_SUBJECT = f"EXISTS (SELECT 1 FROM fld f WHERE f._pos = r._pos AND f.tag IN ('650', '651') AND f.code IN ('a','x','y','z','v') AND contains({_FOLD.format(v='f.v')}, ' france '))"
_BY_AUTHOR = f"EXISTS (SELECT 1 FROM fld f WHERE f._pos = r._pos AND f.tag IN ('100', '110', '700', '710') AND f.code = 'a' AND contains({_FOLD.format(v='f.v')}, ' src1 '))"


@query("f7_search", f"SELECT _pos FROM rec r WHERE ({_IN_TITLE} OR {_IN_SUBJECT}) AND NOT {_BY_AUTHOR}")
def search(df):
    """(title the* or subject france) and not author src1, as a predicate over local records."""
    from biblioflow.operators.search import term

    found = (term("title", "the*") | term("subject", "France")) - term("author", "src1")
    return df.where(found.predicate(FS())).select("_pos")


@query("f7_cql", """SELECT '((dc.title = "the*") or (dc.subject = "France")) not (dc.author = "src1")' AS cql""", cte=False)
def cql(df):
    from biblioflow.operators.search import term

    found = (term("title", "the*") | term("subject", "France")) - term("author", "src1")
    return df.limit(1).select(F.lit(found.cql()).alias("cql"))


def _has(tags: tuple, codes: str, words: str) -> str:
    own = " AND ".join((f"f.tag IN ({', '.join(map(repr, tags))})", f"f.code IN ({', '.join(map(repr, codes))})"))
    return f"EXISTS (SELECT 1 FROM fld f WHERE f._pos = r._pos AND {own} AND contains({_FOLD.format(v='f.v')}, '{words}'))"


_IN_TITLES, _IN_ABOUT = ((("245", "246"), "ab"), (("650", "651"), "axyzv"))
_ASKED = {
    "words": f"{_has(*_IN_TITLES, ' and ')} AND {_has(*_IN_TITLES, ' the ')}", "phrase": _has(*_IN_TITLES, " and the "), "stem": _has(*_IN_TITLES, " and th"),
    "tree": f"({_has(*_IN_ABOUT, ' the ')} OR {_has(*_IN_TITLES, ' and the ')}) AND NOT {_BY_AUTHOR}",
}


@query("f8_postings", " UNION ALL ".join(f"SELECT '{k}' AS query, _pos FROM rec r WHERE {v}" for k, v in _ASKED.items()))
def search_postings(df):
    """Words, a phrase, a stem and a tree, from one table of positional postings of all records."""
    from biblioflow.operators.search import found, postings, term

    both = term("title", "and the")
    queries = {"words": both.word(), "phrase": both, "stem": term("title", "and th*"), "tree": (term("subject", "the") | both.phrase()) - term("author", "src1")}
    return found(postings(df, "_pos", ("title", "author", "subject")), "_pos", queries)


@query("p22_graph_name", "SELECT _pos, '#doc' || _pos AS name FROM rec")
def graph_names(df):
    from biblioflow.operators import bibframe

    return df.select("_pos", F.concat(F.lit("#"), bibframe.base(FS(), F.col("_pos"))).alias("name"))


@query(
    "x10_bibframe_round_trip",
    f"""SELECT _pos, tag, code, value FROM (
    SELECT _pos, tag, code, {_t('v')} AS value FROM fld WHERE tag = '245' AND code IN ('a', 'b', 'c') UNION ALL SELECT _pos, tag, code, {_t('v')} FROM fld WHERE tag IN ('020', '022')
    UNION ALL SELECT _pos, tag, code, {_t('v')} FROM fld WHERE tag IN ('100', '110', '700', '710', '250') AND code = 'a' UNION ALL SELECT _pos, tag, code, rtrim(v, ' ') FROM fld WHERE tag = '520'
    UNION ALL SELECT _pos, tag, code, {_t('v')} FROM fld WHERE tag = '490'
    UNION ALL SELECT _pos, '001', '', v FROM fld WHERE tag = '001' UNION ALL SELECT _pos, tag, code, v FROM fld WHERE tag = '856' AND code = 'u') WHERE value <> ''""",
)
def bibframe_round_trip(df):
    """What survives the way to BIBFRAME and back, of the tags that should."""
    from biblioflow.operators import bibframe, bibframe_reverse

    return surviving(bibframe_reverse.records(bibframe.statements(df)))


def surviving(back):
    """The subfields of records that have come back, of the tags that should."""
    rows = back.select("_pos", F.explode_outer("fields").alias("f")).where(F.col("f.tag").isin("001", "020", "022", "100", "110", "245", "250", "490", "520", "700", "710", "856"))
    parts = F.when(F.col("f.tag") < "010", F.array(F.struct(F.lit("").alias("code"), F.col("f.value").alias("value")))).otherwise(F.col("f.subfields"))
    rows = rows.select("_pos", F.col("f.tag").alias("tag"), F.explode(parts).alias("s")).select("_pos", "tag", "s.code", "s.value")
    keep = F.when(F.col("tag").isin("100", "110", "700", "710"), F.col("code") == "a").when(F.col("tag") == "856", F.col("code") == "u").otherwise(True)
    return rows.where(keep)
