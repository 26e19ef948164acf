"""SIP2 item information: messages as columns in, parsed replies out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions.text import once

#: fixed values: circulation status codes
STATUS = {
    "01": "other", "02": "on order", "03": "available", "04": "charged", "05": "charged; not to be recalled until earliest recall date", "06": "in process", "07": "recalled",
    "08": "waiting on hold shelf", "09": "waiting to be re-shelved", "10": "in transit between library locations", "11": "claimed returned", "12": "lost", "13": "missing",
}


def checksum(message: Column) -> Column:
    """The negated byte sum modulo 2**16 of an ASCII message, as four hexadecimal digits."""
    total = F.aggregate(F.split(message, ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.lpad(F.hex(F.pmod(-total, F.lit(65536))), 4, "0")


def with_checksum(message: Column) -> Column:
    own = F.concat(message, F.lit("AY0AZ"))
    return F.concat(own, checksum(own))


def item_request(institution: Column, item: Column, date: Column) -> Column:
    """A 17 message without its checksum; date has 18 characters."""
    return F.concat(F.lit("17"), date, F.lit("AO"), institution, F.lit("|AB"), item, F.lit("|AC|"))


def variable_fields(rest: Column) -> Column:
    """Two-letter fields of a reply; the first of equal ones counts, sequence and checksum are left out."""
    parts = F.filter(F.split(F.regexp_replace(rest, "[\r\n]+$", ""), r"\|"), lambda p: (F.length(p) >= 2) & ~F.substring(p, 1, 2).isin("AY", "AZ"))
    pairs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 2).alias("key"), F.substring(p, F.lit(3), F.length(p)).alias("value")))
    first = lambda own, keys: F.filter(own, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.map_from_entries(once(pairs, lambda own: once(F.transform(own, lambda x: x["key"]), lambda keys: first(own, keys))))


def item_information(reply: Column) -> Column:
    """The parts of an 18 message; null if it is another one."""
    fields = lambda r: variable_fields(F.substring(r, F.lit(27), F.length(r)))
    return once(reply, lambda r: F.when(r.startswith("18"), once(fields(r), lambda found: _item_parts(r, found))))


def _item_parts(reply: Column, found: Column) -> Column:
    get = lambda k: F.coalesce(F.try_element_at(found, F.lit(k)), F.lit(""))
    status, label = F.substring(reply, 3, 2), F.lit("")
    for k, v in STATUS.items():
        label = F.when(status == k, v).otherwise(label)
    return F.struct(
        status.alias("circulation_status"), label.alias("status_label"), F.substring(reply, 5, 2).alias("security_marker"), F.substring(reply, 7, 2).alias("fee_type"),
        F.substring(reply, 9, 18).alias("transaction_date"), get("AB").alias("item_id"), get("AJ").alias("title"), get("AH").alias("due_date"), get("AP").alias("current_location"),
        get("AQ").alias("permanent_location"), get("CS").alias("call_number"), get("CF").alias("hold_queue_length"), found.alias("fields"),
    )
