"""Crosswalks: a record in, a description in another vocabulary out. All are column expressions within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions import marc
from biblioflow.functions.text import ascii_key, byte_slice, each, escape_bibtex, nonempty, one_line, trim_isbd, trimmed, year

#: fixed values: tags read by the exporters
SUBJECT_TAGS = ("600", "610", "611", "630", "650", "651", "653", "655")
NAME_TAGS = ("100", "110", "111")
ADDED_TAGS = ("700", "710", "711")
#: fixed values: DCMI type by leader byte 6
DCMI_TYPES = {"e": "Image", "f": "Image", "k": "Image", "g": "MovingImage", "i": "Sound", "j": "Sound", "m": "Software", "o": "Collection", "p": "Collection", "r": "PhysicalObject"}


def _map(code: Column, table: dict[str, str], other: str | Column) -> Column:
    out = F.lit(other) if isinstance(other, str) else other
    for k, v in table.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def join_sub(field: Column, codes: str, sep: str = " ") -> Column:
    return F.array_join(trimmed(marc.values(field, codes)), sep)


def subject(field: Column) -> Column:
    """Heading and subdivisions in field order, joined by --."""
    return F.array_join(nonempty(F.transform(marc.values(field, "axyzv"), lambda v: F.rtrim(v))), "--")


def per_field(fields: Column, tags: tuple[str, ...], get) -> Column:
    """get(field) of every field with one of the tags, without the empty ones."""
    return nonempty(F.transform(marc.data_fields(fields, *tags), lambda f: get(f)))


def all_trimmed(fields: Column, tags: tuple[str, ...], code: str) -> Column:
    return F.flatten(F.transform(marc.data_fields(fields, *tags), lambda f: trimmed(marc.values(f, code))))


def language_008(fields: Column) -> Column:
    lang = F.trim(byte_slice(marc.control_field(fields, "008"), 35, 38))
    return F.when(F.octet_length(lang) == 3, lang).otherwise("")


def chunks(code: Column) -> Column:
    """The three-letter codes that a language subfield strings together."""
    n = F.floor(F.octet_length(code) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(code, (k - 1) * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def dublin_core(leader: Column, fields: Column) -> Column:
    """The fifteen elements (those a record can fill) as arrays."""
    a = lambda f: trim_isbd(marc.value(f, "a"))
    raw = lambda f: marc.value(f, "a")
    langs = F.flatten(F.transform(all_trimmed(fields, ("041",), "a"), chunks))
    fixed = language_008(fields)
    own = F.when((fixed != "") & ~F.array_contains(langs, fixed), F.concat(F.array(fixed), langs)).otherwise(langs)
    identifier = F.flatten(
        F.transform(
            marc.data_fields(fields, "020", "022", "024", "856"),
            lambda f: F.when(f["tag"] == "856", trimmed(marc.values(f, "u"))).otherwise(trimmed(marc.values(f, "a"))),
        )
    )
    return F.struct(
        per_field(fields, ("245",), lambda f: join_sub(f, "ab")).alias("title"),
        per_field(fields, NAME_TAGS, a).alias("creator"),
        per_field(fields, SUBJECT_TAGS, subject).alias("subject"),
        per_field(fields, ("500", "505", "520", "521", "545", "550"), raw).alias("description"),
        per_field(fields, ("260", "264"), lambda f: trim_isbd(marc.value(f, "b"))).alias("publisher"),
        per_field(fields, ADDED_TAGS, a).alias("contributor"),
        per_field(fields, ("260", "264"), lambda f: trim_isbd(marc.value(f, "c"))).alias("date"),
        F.array(_map(marc.record_type(leader), DCMI_TYPES, "Text")).alias("type"),
        per_field(fields, ("300",), lambda f: join_sub(f, "ac")).alias("format"),
        identifier.alias("identifier"), own.alias("language"),
        per_field(fields, ("506", "540"), raw).alias("rights"),
    )


DC_ELEMENTS = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "language", "rights")


def _kinds(leader: Column) -> tuple[Column, Column]:
    """RIS and BibTeX types by leader bytes 6 and 7 (fixed values)."""
    kind, level = marc.record_type(leader), marc.bib_level(leader)
    text, serial, part = kind.isin("a", "t"), level.isin("s", "b"), level == "a"
    ris = F.when(text & serial, "JOUR").when(text & part, "CHAP").when(text, "BOOK")
    for codes, name in (("cd", "MUSIC"), ("ef", "MAP"), ("g", "VIDEO"), ("ij", "SOUND"), ("m", "COMP")):
        ris = ris.when(kind.isin(*codes), name)
    bib = F.when(text & serial, "article").when(text & part, "inbook").when(text, "book").otherwise("misc")
    return ris.otherwise("GEN"), bib


def _last(fields: Column, tag: str, get) -> Column:
    """get() of the last field with that tag, even if empty."""
    return F.coalesce(get(F.try_element_at(marc.data_fields(fields, tag), F.lit(-1))), F.lit(""))


def _first_filled(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def citation(leader: Column, fields: Column) -> Column:
    ris, bib = _kinds(leader)
    a = lambda f: trim_isbd(marc.value(f, "a"))
    imprint = ("260", "264")
    date = _first_filled(per_field(fields, imprint, lambda f: trim_isbd(marc.value(f, "c"))))
    raw = marc.control_field(fields, "008")
    names = F.transform(
        F.filter(marc.data_fields(fields, *NAME_TAGS, *ADDED_TAGS), lambda f: a(f) != ""),
        lambda f: F.struct(a(f).alias("name"), (~f["tag"].isin("100", "700")).alias("corporate")),
    )
    return F.struct(
        ris.alias("ris_type"), bib.alias("bib_type"),
        _last(fields, "245", lambda f: join_sub(f, "ab")).alias("title"), names.alias("authors"),
        _last(fields, "250", a).alias("edition"),
        _first_filled(per_field(fields, imprint, a)).alias("place"),
        _first_filled(per_field(fields, imprint, lambda f: trim_isbd(marc.value(f, "b")))).alias("publisher"),
        date.alias("date"), F.when(year(date) != "", year(date)).otherwise(year(byte_slice(raw, 7, 11))).alias("year"),
        all_trimmed(fields, ("020",), "a").alias("isbn"), all_trimmed(fields, ("022",), "a").alias("issn"),
        per_field(fields, SUBJECT_TAGS, subject).alias("keywords"),
        _first_filled(per_field(fields, ("520",), lambda f: marc.value(f, "a"))).alias("abstract"),
        all_trimmed(fields, ("856",), "u").alias("url"), language_008(fields).alias("language"),
    )


def cite_key(entry: Column) -> Column:
    surname = ascii_key(F.substring_index(F.coalesce(F.get(entry["authors"], F.lit(0))["name"], F.lit("")), ",", 1))
    words = nonempty(F.transform(F.split(entry["title"], r"\s+"), ascii_key))
    key = F.concat(surname, entry["year"], F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    return F.when(key == "", "ref").otherwise(key)


def ris(entry: Column) -> Column:
    """The RIS text of a citation."""
    one = lambda tag, v: F.when(v != "", F.concat(F.lit(f"{tag}  - "), one_line(v), F.lit("\n"))).otherwise("")
    many = lambda tag, vs: each(vs, lambda v: one(tag, v))
    e = entry
    return F.concat(
        one("TY", e["ris_type"]), one("TI", e["title"]), many("AU", F.transform(e["authors"], lambda x: x["name"])), one("PY", e["year"]),
        one("DA", e["date"]), one("ET", e["edition"]), one("PB", e["publisher"]), one("CY", e["place"]), many("SN", e["isbn"]), many("SN", e["issn"]),
        many("KW", e["keywords"]), one("LA", e["language"]), one("AB", e["abstract"]), many("UR", e["url"]), F.lit("ER  - \n"),
    )


#: fixed values: ISO 639-2 to BCP 47
BCP47 = {
    "eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "chi": "zh", "zho": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "heb": "he",
    "gre": "el", "ell": "el", "lat": "la", "dut": "nl", "nld": "nl", "swe": "sv", "nor": "no", "dan": "da", "fin": "fi", "pol": "pl", "ukr": "uk", "tur": "tr", "vie": "vi", "tha": "th", "hin": "hi",
}


def bcp47(code: Column) -> Column:
    return _map(code, BCP47, code)


def concept_subjects(fields: Column) -> Column:
    """tag and heading of every subject field, in order."""
    return F.transform(marc.data_fields(fields, *SUBJECT_TAGS), lambda f: F.struct(f["tag"].alias("tag"), subject(f).alias("heading")))


def bibtex_value(name: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"  {name} = {{"), escape_bibtex(value), F.lit("},\n"))).otherwise("")


# schema.org

#: fixed values: schema.org types by leader byte 6
SCHEMA_TYPES = {"a": "Book", "t": "Book", "c": "MusicComposition", "d": "MusicComposition", "e": "Map", "f": "Map", "g": "Movie", "i": "AudioObject", "j": "MusicRecording", "k": "ImageObject", "m": "SoftwareApplication"}


def _agents(fields: Column, tags: tuple[str, ...]) -> Column:
    name = lambda f: trim_isbd(marc.value(f, "a"))
    return F.transform(
        F.filter(marc.data_fields(fields, *tags), lambda f: name(f) != ""),
        lambda f: F.struct(F.when(f["tag"].substr(2, 2) == "00", "Person").otherwise("Organization").alias("type"), name(f).alias("name")),
    )


def schema_org(leader: Column, fields: Column) -> Column:
    """A creative work; languages of 041 come before the one of 008, each once."""
    fixed, access = marc.control_008(leader, fields), marc.accessibility(leader, fields)
    imprint = ("260", "264")
    date = _first_filled(per_field(fields, imprint, lambda f: year(trim_isbd(marc.value(f, "c")))))
    codes = F.concat(F.flatten(F.transform(marc.subfield_values(fields, "041", "a"), chunks)), F.array(F.trim(fixed["language"])))
    languages = F.array_distinct(F.transform(F.filter(codes, lambda c: F.octet_length(F.trim(c)) == 3), lambda c: bcp47(F.trim(c))))
    features = F.concat(*[F.when(on, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for on, name in (
        (access["large_print"], "largePrint"), (access["braille"], "braille"), (access["tactile"] & ~access["braille"], "tactileObject"))])
    subjects = tuple(t for t in SUBJECT_TAGS if t != "655")
    return F.struct(
        _map(marc.record_type(leader), SCHEMA_TYPES, "CreativeWork").alias("type"), _last(fields, "245", lambda f: join_sub(f, "ab")).alias("name"),
        _agents(fields, NAME_TAGS).alias("author"), _agents(fields, ADDED_TAGS).alias("contributor"),
        _last(fields, "250", lambda f: trim_isbd(marc.value(f, "a"))).alias("bookEdition"),
        _first_filled(per_field(fields, imprint, lambda f: trim_isbd(marc.value(f, "b")))).alias("publisher"),
        F.when(date != "", date).otherwise(year(fixed["date1"])).alias("datePublished"), languages.alias("inLanguage"),
        all_trimmed(fields, ("020",), "a").alias("isbn"), all_trimmed(fields, ("022",), "a").alias("issn"),
        per_field(fields, subjects, subject).alias("about"), per_field(fields, ("655",), lambda f: trim_isbd(marc.value(f, "a"))).alias("genre"),
        F.rtrim(_first_filled(per_field(fields, ("520",), lambda f: F.rtrim(marc.value(f, "a"))))).alias("description"),
        all_trimmed(fields, ("856",), "u").alias("url"), access["access_modes"].alias("accessMode"), features.alias("accessibilityFeature"),
        F.array_join(access["notes"], " ").alias("accessibilitySummary"),
    )


# MODS

#: fixed values: typeOfResource by leader byte 6
MODS_TYPES = {"a": "text", "t": "text", "c": "notated music", "d": "notated music", "e": "cartographic", "f": "cartographic", "g": "moving image", "i": "sound recording-nonmusical", "j": "sound recording-musical", "k": "still image", "m": "software, multimedia", "o": "mixed material", "p": "mixed material", "r": "three dimensional object"}
#: fixed values: subject authority by second indicator
AUTHORITIES = {"0": "lcsh", "1": "lcshac", "2": "mesh"}


def publication_rank(field: Column) -> Column:
    """How well a 260 or 264 field states a publication; 0 never does."""
    return F.when(field["tag"] == "260", 2).when(field["ind2"] == "1", 3).when(field["ind2"] == "4", 0).otherwise(1)


def mods_title(field: Column) -> Column:
    uniform = field["tag"] != "245"
    get = lambda c: F.when(uniform, "").otherwise(trim_isbd(marc.value(field, c)))
    return F.struct(
        F.when(uniform, "uniform").otherwise("").alias("type"), trim_isbd(marc.value(field, "a")).alias("title"),
        get("b").alias("sub_title"), get("n").alias("part_number"), get("p").alias("part_name"),
    )


def mods_name(field: Column) -> Column:
    kind = _map(field["tag"].substr(2, 2), {"00": "personal", "10": "corporate", "11": "conference"}, "")
    role = F.when(marc.value(field, "e") != "", marc.value(field, "e")).otherwise(marc.value(field, "4"))
    return F.struct(kind.alias("type"), trim_isbd(marc.value(field, "a")).alias("name"), F.regexp_replace(marc.value(field, "d"), r"[, ]+\z", "").alias("date"), trim_isbd(role).alias("role"))


def mods_subject(field: Column) -> Column:
    """topic, geographic, temporal and genre parts of a subject; names of 600-611 go to name."""
    tag, none = field["tag"], F.array().cast("array<string>")
    part = lambda codes: nonempty(F.transform(marc.values(field, codes), lambda v: F.rtrim(v)))
    head = nonempty(F.array(trim_isbd(marc.value(field, "a"))))
    return F.struct(
        _map(field["ind2"], AUTHORITIES, "").alias("authority"), F.when(tag == "650", part("ax")).otherwise(none).alias("topic"),
        F.when(tag == "650", part("z")).when(tag == "651", head).otherwise(none).alias("geographic"), F.when(tag == "650", part("y")).otherwise(none).alias("temporal"),
        F.when(tag == "650", part("v")).when(tag == "655", head).otherwise(none).alias("genre"), F.when(tag.isin("600", "610", "611"), head).otherwise(none).alias("name"),
    )


def mods(leader: Column, fields: Column) -> Column:
    imprint = marc.data_fields(fields, "260", "264")
    ranked = F.transform(imprint, lambda f, i: F.struct(publication_rank(f).alias("rank"), (-i).alias("at"), f.alias("field")))
    best = F.array_max(F.filter(ranked, lambda x: x["rank"] > 0))["field"]
    copyright_ = _first_filled(nonempty(F.transform(F.filter(imprint, lambda f: f["ind2"] == "4"), lambda f: trim_isbd(marc.value(f, "c")))))
    raw = marc.control_field(fields, "008")
    date8 = F.regexp_replace(byte_slice(raw, 7, 11), r"[ |]+\z", "")
    issued = F.coalesce(trim_isbd(marc.value(best, "c")), F.lit(""))
    codes = F.concat(F.array(F.trim(byte_slice(raw, 35, 38))), F.flatten(F.transform(marc.subfield_values(fields, "041", "a"), chunks)))
    ids = F.transform(
        F.filter(fields, lambda f: f["tag"].isin("020", "022", "024", "856")),
        lambda f: F.transform(
            trimmed(F.when(f["tag"] == "856", marc.values(f, "u")).otherwise(marc.values(f, "a"))),
            lambda v: F.struct(_map(f["tag"], {"020": "isbn", "022": "issn", "024": "other", "856": "uri"}, "").alias("type"), v.alias("value")),
        ),
    )
    titles = F.filter(F.transform(marc.data_fields(fields, "245", "130", "240"), mods_title), lambda t: F.concat(t["title"], t["sub_title"], t["part_number"], t["part_name"]) != "")
    extent = lambda f: F.array_join(nonempty(F.array(*[trim_isbd(marc.value(f, c)) for c in "abce"])), " ")
    subjects = F.filter(
        F.transform(marc.data_fields(fields, "600", "610", "611", "650", "651", "655"), mods_subject),
        lambda s: F.size(s["topic"]) + F.size(s["geographic"]) + F.size(s["temporal"]) + F.size(s["genre"]) + F.size(s["name"]) > 0,
    )
    notes = F.transform(
        F.filter(marc.data_fields(fields, "500", "520"), lambda f: marc.value(f, "a") != ""),
        lambda f: F.struct(F.when(f["tag"] == "520", "summary").otherwise("").alias("type"), marc.value(f, "a").alias("value")),
    )
    return F.struct(
        _map(marc.record_type(leader), MODS_TYPES, "text").alias("type_of_resource"), titles.alias("titles"),
        F.filter(F.transform(marc.data_fields(fields, *NAME_TAGS, *ADDED_TAGS), mods_name), lambda n: n["name"] != "").alias("names"),
        F.coalesce(trimmed(marc.values(best, "a")), F.array().cast("array<string>")).alias("places"), F.coalesce(trim_isbd(marc.value(best, "b")), F.lit("")).alias("publisher"),
        F.when(issued != "", issued).when(date8 != "0000", date8).otherwise("").alias("date_issued"), copyright_.alias("copyright_date"),
        _last(fields, "250", lambda f: trim_isbd(marc.value(f, "a"))).alias("edition"),
        F.array_distinct(F.filter(codes, lambda c: F.octet_length(F.trim(c)) == 3)).alias("languages"),
        _first_filled(per_field(fields, ("300",), extent)).alias("extent"), notes.alias("notes"), subjects.alias("subjects"),
        F.flatten(ids).alias("identifiers"), marc.control_field(fields, "001").alias("record_id"),
    )


def bibtex(entry: Column) -> Column:
    """The BibTeX text of a citation."""
    e = entry
    people = F.array_join(F.transform(e["authors"], lambda a: F.when(a["corporate"], F.concat(F.lit("{"), escape_bibtex(a["name"]), F.lit("}"))).otherwise(escape_bibtex(a["name"]))), " and ")
    author = F.when(F.size(e["authors"]) > 0, F.concat(F.lit("  author = {"), people, F.lit("},\n"))).otherwise("")
    many = lambda name, vs: bibtex_value(name, F.array_join(vs, ", "))
    return F.concat(
        F.lit("@"), e["bib_type"], F.lit("{"), cite_key(e), F.lit(",\n"), author, bibtex_value("title", e["title"]), bibtex_value("year", e["year"]),
        bibtex_value("edition", e["edition"]), bibtex_value("publisher", e["publisher"]), bibtex_value("address", e["place"]), many("isbn", e["isbn"]), many("issn", e["issn"]),
        many("keywords", e["keywords"]), bibtex_value("language", e["language"]), bibtex_value("abstract", e["abstract"]), bibtex_value("url", F.array_join(e["url"], " ")), F.lit("}\n"),
    )
