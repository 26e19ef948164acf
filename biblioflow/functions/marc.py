"""Column functions over bibliographic records: leader STRING, fields ARRAY<FIELD>, in document order.

Absent values are empty strings, never null. Everything works inside the row: no function shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions import schema
from biblioflow.functions.text import byte_at, byte_slice



def is_control(field: Column) -> Column:
    return field["tag"] < "010"


def control_field(fields: Column, tag: str) -> Column:
    """The raw value of the first control field with that tag."""
    found = F.filter(fields, lambda f: (f["tag"] == tag) & (f["tag"] < "010"))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def data_fields(fields: Column, *tags: str) -> Column:
    return F.filter(fields, lambda f: f["tag"].isin(*tags) & (f["tag"] >= "010"))


def values(field: Column, codes: str) -> Column:
    """Values of a field's subfields with any of the codes, in field order."""
    own = F.filter(field["subfields"], lambda s: s["code"].isin(*codes))
    return F.transform(own, lambda s: s["value"])


def value(field: Column, code: str) -> Column:
    return F.coalesce(F.get(values(field, code), F.lit(0)), F.lit(""))


def subfield_values(fields: Column, tag: str, code: str) -> Column:
    return F.flatten(F.transform(data_fields(fields, tag), lambda f: values(f, code)))


def subfield_value(fields: Column, tag: str, code: str) -> Column:
    """The first such subfield of the record; an empty one that is present ends the search."""
    return F.coalesce(F.get(subfield_values(fields, tag, code), F.lit(0)), F.lit(""))


# leader and 008


def record_status(leader: Column) -> Column:
    return byte_at(leader, 5)


def record_type(leader: Column) -> Column:
    return byte_at(leader, 6)


def bib_level(leader: Column) -> Column:
    return byte_at(leader, 7)


def encoding(leader: Column) -> Column:
    return byte_at(leader, 9)


def is_unicode(leader: Column) -> Column:
    return encoding(leader) == "a"


def _number(leader: Column, start: int, end: int) -> Column:
    part = byte_slice(leader, start, end)
    return F.when(part.rlike(r"^[0-9]+\z"), part.cast("int")).otherwise(0)


def record_length(leader: Column) -> Column:
    return _number(leader, 0, 5)


def base_address(leader: Column) -> Column:
    return _number(leader, 12, 17)


#: name -> byte range in 008
POSITIONS = {"date_entered": (0, 6), "date_type": (6, 7), "date1": (7, 11), "date2": (11, 15), "place": (15, 18), "language": (35, 38), "cataloging_source": (39, 40)}


def control_008(leader: Column, fields: Column) -> Column:
    """The fixed elements as a struct; all empty if 008 is shorter than 18 bytes. Maps and visual material have their form of item at 29."""
    raw = control_field(fields, "008")
    raw = F.when(F.octet_length(raw) >= 18, raw).otherwise("")
    form = F.when(record_type(leader).isin("e", "f", "g", "k", "o", "r"), byte_at(raw, 29)).otherwise(byte_at(raw, 23))
    parts = [byte_slice(raw, a, b).alias(k) for k, (a, b) in POSITIONS.items()]
    return F.struct(*parts, form.alias("form_of_item"), (form == "d").alias("large_print"), (form == "f").alias("braille"))


def accessibility(leader: Column, fields: Column) -> Column:
    fixed = control_008(leader, fields)
    own = F.filter(fields, lambda f: f["tag"] == "341")
    features = F.flatten(F.transform(own, lambda f: F.concat(*[values(f, c) for c in "bcde"])))
    tactile = F.exists(fields, lambda f: (f["tag"] == "007") & f["value"].startswith("f"))
    modes, notes = subfield_values(fields, "341", "a"), subfield_values(fields, "532", "a")
    return F.struct(
        fixed["large_print"].alias("large_print"), fixed["braille"].alias("braille"), tactile.alias("tactile"),
        modes.alias("access_modes"), features.alias("features"), notes.alias("notes"),
        (~fixed["large_print"] & ~fixed["braille"] & ~tactile & (F.size(modes) + F.size(features) + F.size(notes) == 0)).alias("empty"),
    )


# linkage of alternate scripts

#: fixed values: script identification codes
SCRIPTS = {"(3": "Arabic", "(B": "Latin", "$1": "CJK", "(N": "Cyrillic", "(S": "Greek", "(2": "Hebrew"}


def link(field: Column) -> Column:
    """tag, occurrence, script, rtl of subfield 6; null if there is none or it is malformed."""
    raw = F.get(values(field, "6"), F.lit(0))
    parts = F.split(raw, "/", -1)
    scripts = F.filter(F.slice(parts, 2, 1000), lambda p: p.rlike(r"(?s)^[($].+\z"))
    made = F.struct(
        F.substring(raw, 1, 3).alias("tag"), F.substring(raw, 5, 2).alias("occurrence"),
        F.coalesce(F.try_element_at(scripts, F.lit(-1)), F.lit("")).alias("script"),
        F.array_contains(F.slice(parts, 2, 1000), "r").alias("rtl"),
    )
    return F.when(parts[0].rlike(r"(?s)^[^/]{3}-[0-9]{2}\z"), made)


def script_name(script: Column) -> Column:
    out = F.lit("")
    for code, name in SCRIPTS.items():
        out = F.when(script == code, name).otherwise(out)
    return out


def is_linked(linkage: Column) -> Column:
    return linkage.isNotNull() & ~linkage["occurrence"].isin("", "00")


def alternate_graphic(fields: Column, field: Column) -> Column:
    """The first field that subfield 6 ties the given one to, in either direction, or null."""
    own = link(field)
    partners = F.filter(
        fields,
        lambda g: F.when(field["tag"] == "880", (g["tag"] == own["tag"]) & (link(g)["tag"] == "880")).otherwise((g["tag"] == "880") & (link(g)["tag"] == field["tag"]))
        & (link(g)["occurrence"] == own["occurrence"]),
    )
    return F.when(is_linked(own), F.get(partners, F.lit(0)))


def vernacular(fields: Column, tag: str, code: str) -> Column:
    """The subfield in the original script, of the first field with that tag that has a partner."""
    partners = F.transform(F.filter(fields, lambda f: f["tag"] == tag), lambda f: alternate_graphic(fields, f))
    first = F.get(F.filter(partners, lambda g: g.isNotNull()), F.lit(0))
    return F.when(first.isNull(), "").otherwise(value(first, code))


# construction and edits


def subfield(code: str, text: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("value"))


def make_control(tag: str, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(tag).alias("tag"), F.lit("").alias("ind1"), F.lit("").alias("ind2"), text.alias("value"), F.expr(f"cast(array() as array<{schema.SUBFIELD}>)").alias("subfields"))


def make_data(tag: str, ind1: str, ind2: str, *subfields: Column) -> Column:
    own = F.array(*subfields) if subfields else F.expr(f"cast(array() as array<{schema.SUBFIELD}>)")
    return F.struct(F.lit(tag).alias("tag"), F.lit(ind1).alias("ind1"), F.lit(ind2).alias("ind2"), F.lit("").alias("value"), own.alias("subfields"))


def add_field(fields: Column, field: Column) -> Column:
    return F.array_append(fields, field)


def insert_field(fields: Column, field: Column) -> Column:
    """Before the first field with a greater tag."""
    flags = F.transform(fields, lambda f: f["tag"] > field["tag"])
    at = F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0))
    at = F.when(at == 0, F.size(fields) + 1).otherwise(at).cast("int")
    return F.concat(F.slice(fields, F.lit(1), at - 1), F.array(field), F.slice(fields, at, F.size(fields) + 1))


def replace_field(fields: Column, field: Column) -> Column:
    """In the place of the first field with its tag, or at the end."""
    at = F.array_position(F.transform(fields, lambda f: f["tag"]), field["tag"])
    return F.when(at == 0, F.array_append(fields, field)).otherwise(F.transform(fields, lambda f, i: F.when(i + 1 == at, field).otherwise(f)))


def remove_fields(fields: Column, *tags: str) -> Column:
    return F.filter(fields, lambda f: ~f["tag"].isin(*tags))


def keep_fields(fields: Column, *tags: str) -> Column:
    return F.filter(fields, lambda f: f["tag"].isin(*tags))


def validate(leader: Column, fields: Column) -> Column:
    """The first structural error of a record, or null."""
    def wrong(f: Column) -> Column:
        control, subs = is_control(f), F.size(f["subfields"])
        return (
            F.when(F.octet_length(f["tag"]) != 3, F.concat(F.lit("field tag "), f["tag"], F.lit(" is not 3 bytes")))
            .when(control & (subs > 0), F.concat(F.lit("control field "), f["tag"], F.lit(" has subfields")))
            .when(~control & (f["value"] != ""), F.concat(F.lit("data field "), f["tag"], F.lit(" has a raw value")))
            .when(~control & (subs == 0), F.concat(F.lit("data field "), f["tag"], F.lit(" has no subfields")))
        )

    errors = F.filter(F.transform(fields, wrong), lambda e: e.isNotNull())
    size = F.octet_length(leader)
    return F.when(size != 24, F.concat(F.lit("leader is "), size.cast("string"), F.lit(" bytes, want 24"))).otherwise(F.get(errors, F.lit(0)))
