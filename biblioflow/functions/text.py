"""String functions that several crosswalks and writers share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_isbd(s: Column) -> Column:
    """Trailing spaces go, then one ISBD mark (/ : ; ,), then spaces again."""
    return F.rtrim(F.regexp_replace(F.rtrim(s), r"[/:;,]\z", ""))


def year(s: Column) -> Column:
    """The first four digits in a row, or an empty string."""
    return F.regexp_extract(s, "[0-9]{4}", 0)


def nonempty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def trimmed(values: Column) -> Column:
    return nonempty(F.transform(values, trim_isbd))


def byte_slice(s: Column, start: int, end: int) -> Column:
    """Bytes start to end of a fixed-position value, or an empty string if it is too short (such values are ASCII)."""
    return F.when(F.octet_length(s) >= end, F.substring(s, start + 1, end - start)).otherwise("")


def byte_at(s: Column, i: int) -> Column:
    return byte_slice(s, i, i + 1)


def nested(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_xml(s: Column) -> Column:
    return nested(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_json(s: Column) -> Column:
    """A JSON string with its quotes; control characters as lower-case \\u00xx, the slash as it is."""
    return F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]\z", "")


def one_line(s: Column) -> Column:
    return F.regexp_replace(s, "[\n\r]", " ")


def escape_bibtex(s: Column) -> Column:
    """Marks that mean something to BibTeX; the backslash first goes to a control mark that no other rule touches."""
    s = F.replace(one_line(s), F.lit("\\"), F.lit("\x01"))
    s = F.regexp_replace(s, r"([{}&%$#_])", r"\\$1")
    return nested(s, [("\x01", "\\textbackslash{}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")])


def ascii_key(s: Column) -> Column:
    return F.translate(F.regexp_replace(s, "[^A-Za-z0-9]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(parts: list[Column]) -> Column:
    return F.concat(*parts)


def each(values: Column, line: Callable[[Column], Column]) -> Column:
    """line(v) of every value, one after the other."""
    return F.array_join(F.transform(values, line), "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once, however often f uses it: a bound variable, where a column would be put in again each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
