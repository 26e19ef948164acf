"""Turtle, RDF/XML and JSON-LD files of any size, read by many tasks a file.

Spark's text reader deals a file out in blocks of whole pieces (lines, or what ends in ">" or ","). Where a block begins in the grammar, in a long
string, a comment, an attribute or so many elements deep, is not known to it. So each block is first run through a small
automaton from every state it might begin in, which gives its transition map: the state it ends in, and how much deeper, for each.
The maps of a file are composed in order, a prefix scan over one short row a block, and say how each block begins. Then the blocks are cut
into statements: at the stops of Turtle, behind the elements right below the root of RDF/XML, or behind the objects of a JSON-LD array. A statement that goes on in the next block, or over
several, is put together from its parts. What statements depend on from before them, prefixes and base, the root's start tag, or whether there is an array,
is folded in order from the statements that set it, and handed to each block.

A statement's triples have ``pos`` from the byte at which it starts, so order is the file's. Labels of blank nodes without one hold
that place. A malformed statement is one row with _error, and reading goes on behind it. A document whose root is a node itself and not rdf:RDF
is one statement, and so is a JSON-LD document that is one object. Files end where they end: a last statement without its stop is read as the grammar allows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.functions.schema import BLANK, RDF, TERM
from biblioflow.sources import documents
from biblioflow.sources.iso2709 import steady

# automata: a piece, the state it is met in, and the depth -> the state behind it, the change of depth, and the ends of statements in it

_MARKS = re.compile(rb'#[^\n]*|<[^>\s"{}|^`]*>|"""|\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\\.|\.', re.S)
_CLOSING = (None, re.compile(rb'\\.|"""', re.S), re.compile(rb"\\.|'''", re.S))
_FOLLOWERS = b" \t\r\n#<@[("


def scan_turtle(piece: bytes, state: int, depth: int) -> tuple[int, int, list[int]]:
    """States: 0 between tokens, 1 and 2 in a long string. No other token goes over the end of a line."""
    at, cuts = 0, []
    while at < len(piece):
        if state:
            for m in _CLOSING[state].finditer(piece, at):
                if len(m[0]) == 3:
                    state, at = 0, m.end()
                    break
            else:
                return state, 0, cuts
            continue
        for m in _MARKS.finditer(piece, at):
            token = m[0]
            if token == b"." and (m.end() == len(piece) or piece[m.end()] in _FOLLOWERS):
                cuts.append(m.end())
            elif token in (b'"""', b"'''"):
                state, at = (1 if token == b'"""' else 2), m.end()
                break
        else:
            break
    return state, 0, cuts


_QUOTED = re.compile(rb"[\"']")


def scan_xml(piece: bytes, state: int, depth: int) -> tuple[int, int, list[int]]:
    """States: 0 text, 1 comment, 2 CDATA, 3 instruction, 4 and 5 in an attribute, 6 in a document type. Pieces end in ">"."""
    if state in (1, 2, 3, 6):
        done = piece.endswith((b"", b"-->", b"]]>", b"?>")[state]) if state < 4 else re.search(rb"\]\s*>\Z", piece)
        return (0 if done else state), 0, []
    at = 0
    if state == 0:
        at = piece.find(b"<")
        if at < 0:
            return 0, 0, []
        own = piece[at:]
        for k, (start, end) in enumerate(((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>")), 1):
            if own.startswith(start):
                return (0 if own.endswith(end) and len(own) >= len(start) + len(end) else k), 0, []
        if own.startswith(b"<!"):
            return (6 if b"[" in own and not re.search(rb"\]\s*>\Z", own) else 0), 0, []
        if own.startswith(b"</"):
            return 0, -1, [len(piece)] if depth == 2 else []
    else:
        at = piece.find(b'"' if state == 4 else b"'") + 1
        if not at:
            return state, 0, []
    while m := _QUOTED.search(piece, at):
        end = piece.find(m[0], m.end())
        if end < 0:
            return (4 if m[0] == b'"' else 5), 0, []
        at = end + 1
    if not piece.endswith(b">"):
        return 0, 0, []  # the file breaks off
    if piece.endswith(b"/>"):
        return 0, 0, [len(piece)] if depth == 1 else []
    return 0, 1, [len(piece)] if depth == 0 else []


_JSON = re.compile(rb'"(?:[^"\\]|\\.)*+"|["{}]', re.S)
_JSON_CLOSING = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)


def scan_json(piece: bytes, state: int, depth: int) -> tuple[int, int, list[int]]:
    """States: 0 between strings, 1 in a string. The depth is that of objects; an outermost one ends a statement."""
    at, delta, cuts = 0, 0, []
    if state:
        if not (m := _JSON_CLOSING.match(piece)):
            return 1, 0, []
        at = m.end()
    for m in _JSON.finditer(piece, at):
        token = m[0]
        if token == b"{":
            delta += 1
        elif token == b"}":
            delta -= 1
            if depth + delta == 0:
                cuts.append(m.end())
        elif token == b'"':
            return 1, delta, cuts
    return 0, delta, cuts


@dataclass(frozen=True)
class Grammar:
    separator: str
    states: int
    scan: Callable[[bytes, int, int], tuple[int, int, list[int]]]


GRAMMARS = {"turtle": Grammar("\n", 3, scan_turtle), "rdfxml": Grammar(">", 7, scan_xml), "jsonld": Grammar(",", 2, scan_json)}


def _pieces(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    steady(spark)
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", grammar.separator).text(path)
    return text.select(meta["file_path"].alias("_source"), meta["file_block_start"].alias("_block"), F.col("value").cast("binary").alias("piece"))


def _blocks(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple[tuple | None, bytes]]:
    """(key, piece) of each piece; key holds its file and block, and the columns behind the piece."""
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(3 + extra)]
        for k, piece in enumerate(cols[2]):
            yield tuple(c[k] for c in (*cols[:2], *cols[3:])), piece


def transitions(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """(_source, _block, size, ends, deeper): of each block its bytes, and by entry state the state it ends in and its change of depth."""
    end = grammar.separator.encode()

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, size, ends, deeper = None, 0, [], []

        def made() -> pa.RecordBatch:
            cols = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([size], pa.int64())]
            cols += [pa.array([ends], pa.list_(pa.int32())), pa.array([deeper], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["_source", "_block", "size", "ends", "deeper"])

        for own, piece in _blocks(batches):
            if own != key:
                if key is not None:
                    yield made()
                key, size, ends, deeper = own, 0, list(range(grammar.states)), [0] * grammar.states
            size += len(piece) + 1
            if grammar.states == 3 and b'"""' not in piece and b"'''" not in piece:
                continue
            known: dict[int, tuple[int, int]] = {}
            for k in range(grammar.states):
                at = ends[k]
                if at not in known:
                    known[at] = grammar.scan(piece + end, at, -1)[:2]
                ends[k], deeper[k] = known[at][0], deeper[k] + known[at][1]
        if key is not None:
            yield made()

    return pieces.mapInArrow(run, "_source string, _block long, size long, ends array<int>, deeper array<long>")


def begun(maps: DataFrame) -> DataFrame:
    """(_source, _block, state, depth, at): how each block begins, and at which byte, by composing the maps before it."""

    def scanned(rows: pd.DataFrame) -> pd.DataFrame:
        state, depth, at, out = 0, 0, 0, []
        for r in rows.sort_values("_block").itertuples(index=False):
            out.append((r[0], r[1], state, depth, at))
            state, depth, at = int(r.ends[state]), depth + int(r.deeper[state]), at + r.size
        return pd.DataFrame(out, columns=["_source", "_block", "state", "depth", "at"])

    return maps.groupBy("_source").applyInPandas(scanned, "_source string, _block long, state int, depth long, at long")


def _cut(grammar: Grammar, key: tuple, held: dict, piece: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, statement) of each statement that ends in a piece; held is the block's walk so far."""
    own = piece + grammar.separator.encode()
    state, delta, cuts = grammar.scan(own, held["state"], held["depth"])
    last = 0
    for cut in cuts:
        held["text"] += own[last:cut]
        yield held["at"], bytes(held["text"])
        held["at"] += len(held["text"])
        held["text"] = bytearray()
        last = cut
    held["text"] += own[last:]
    held["state"], held["depth"] = state, held["depth"] + delta


def _walk(grammar: Grammar, batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[tuple, str, int, bytes]]:
    """(key, kind, place, text) of each block's parts: first ends at its first cut, last follows its last one, whole ones are between; a block
    without a cut is a middle. The key's first columns behind file and block are state, depth and at."""
    key, held, cut = None, {}, False

    def closed() -> tuple[tuple, str, int, bytes]:
        return key, "last" if cut else "middle", held["at"], bytes(held["text"])

    for own, piece in _blocks(batches, extra):
        if key is None or own[:2] != key[:2]:
            if key is not None:
                yield closed()
            key, cut = own, False
            if own[2] is None:
                raise ValueError(f"the blocks of {own[0]} are not those of the first pass")
            held = {"state": own[2], "depth": own[3], "at": own[4], "text": bytearray()}
        for at, text in _cut(grammar, key, held, piece):
            yield key, "whole" if cut else "first", at, text
            cut = True
    if key is not None:
        yield closed()


_SPACE = re.compile(rb"(?:\s+|#[^\n]*)*")
_DIRECTIVE = re.compile(rb"@(?:prefix|base)\b|(?:prefix|base)\b", re.I)


def _sets(form: str, place: int, text: bytes) -> bool:
    """Whether later statements depend on a statement."""
    return place == 0 if form in ("rdfxml", "jsonld") else bool(_DIRECTIVE.match(text, _SPACE.match(text).end()))


PART = "_source string, _block long, kind string, at long, text binary"


def parts(walked: DataFrame, form: str) -> DataFrame:
    """The parts at the borders of blocks, and the whole statements that later ones depend on (kind sets)."""
    grammar = GRAMMARS[form]

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = []

        def made() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split(" ")[0] for x in PART.split(", ")])

        for key, kind, at, text in _walk(grammar, batches, 3):
            if kind != "whole" or _sets(form, at, text):
                rows.append((key[0], key[1], "sets" if kind == "whole" else kind, at, text))
            if len(rows) >= 200:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return walked.mapInArrow(run, PART)


def joined(borders: DataFrame) -> DataFrame:
    """(_source, at, text) of the statements that lie over borders of blocks, and of the first and last of each file."""
    order = F.struct("_block", F.when(F.col("kind") == "last", 1).otherwise(0).alias("late"))
    before = Window.partitionBy("_source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = borders.where("kind <> 'sets'").withColumn("order", order)
    rows = rows.withColumn("group", F.coalesce(F.sum(F.when(F.col("kind") == "first", 1).otherwise(0)).over(before), F.lit(0)))
    rows = rows.groupBy("_source", "group").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("order", "text"))).alias("parts"))
    return rows.select("_source", "at", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["text"])), "")).alias("text"))


# what statements depend on


class Turtle:
    """Prefixes and base at a place of a document."""

    def __init__(self, known: str | None):
        self.prefixes, self.base = json.loads(known) if known else ({}, "")

    def dump(self) -> str:
        return json.dumps([self.prefixes, self.base])

    def learn(self, text: bytes) -> None:
        try:
            for _ in self.parse(text, "", True):
                pass
        except ValueError:
            pass  # read again, and reported, with its statements

    def parse(self, text: bytes, label: str, only_directives: bool = False) -> Iterator[documents.Triple]:
        scope = documents.Scope(self.prefixes, self.base, label)
        try:
            yield from documents.turtle(text.decode("utf-8", "replace"), scope, only_directives)
        finally:
            self.base = scope.base


class Xml:
    """The start tag of the root, and what stands before it."""

    def __init__(self, known: str | None):
        self.head = json.loads(known) if known else ""
        self.close = ""
        if self.head:
            name = re.findall(r"<([^\s!?/>]+)", re.sub(r"<!--.*?-->|<\?.*?\?>", "", self.head, flags=re.S))
            self.close = f"</{name[-1]}>" if name else ""

    def dump(self) -> str:
        return json.dumps(self.head)

    def learn(self, text: bytes) -> None:
        if not self.head:
            self.__init__(json.dumps(text.decode("utf-8", "replace").lstrip("﻿")))

    def _closed(self, text: str) -> bool:
        return re.search(r"</([^<>\s]*)\s*>\s*\Z", text)[1] == self.close[2:-1]

    def single(self) -> bool:
        """Whether the root is a node, and the document so one statement."""
        try:
            return ET.fromstring(self.head + self.close).tag != f"{{{RDF}}}RDF"
        except ET.ParseError:
            return False

    def parse(self, text: bytes, label: str) -> Iterator[documents.Triple]:
        made = re.sub(r"(>\s*)>\Z", r"\1", text.decode("utf-8", "replace"))  # a file's last piece has no ">" of its own
        if re.fullmatch(r"\s*(?:</[^<>]*>)?\s*", made):
            return
        made += "" if re.search(r"</[^<>]*>\s*\Z", made) and self._closed(made) else self.close
        for triple in documents.rdf_xml(self.head + made):
            yield tuple((k, label + v, a, b) if k == BLANK and v[:1] == "g" else (k, v, a, b) for k, v, a, b in triple)


class Json:
    """Whether a document is an array of nodes, each a statement. What its first statement is read with is not known yet."""

    def __init__(self, known: str | None):
        self.array: bool | None = json.loads(known) if known else None

    def dump(self) -> str:
        return json.dumps(self.array)

    def learn(self, text: bytes) -> None:
        self.array = self._text(text).startswith("[")

    @staticmethod
    def _text(text: bytes) -> str:
        return text.decode("utf-8", "replace").removeprefix("﻿").strip()

    def parse(self, text: bytes, label: str) -> Iterator[documents.Triple]:
        own, first = self._text(text), self.array is None
        array = own.startswith("[") if first else self.array
        own = own[1:].lstrip() if first and array else own
        if not own.endswith("}"):  # behind the last object; a file's last piece has no "," of its own
            own = own.removesuffix(",").rstrip()
            if array and not own.endswith("]"):
                raise ValueError("an array without its end")
            own = own[:-1].rstrip() if array else own
            if not own and (array or not first):
                return
        if not first:
            if not array or not own.startswith(","):
                raise ValueError(f"unexpected {own[:20]!r}")
            own = own[1:].lstrip()
        if not own:
            raise ValueError("no value")
        for triple in documents.json_ld(f"[{own}]"):
            yield tuple((k, label + v, a, b) if k == BLANK and v[:1] == "g" else (k, v, a, b) for k, v, a, b in triple)


SCOPES = {"turtle": Turtle, "rdfxml": Xml, "jsonld": Json}


#: At one place a statement that starts there comes first, then what it sets; a block that starts there is behind it.
_STATEMENT, _SET, _BLOCK = 0, 1, 2


def scopes(setting: DataFrame, statements: DataFrame, blocks: DataFrame, form: str) -> DataFrame:
    """(_source, at, turn, scope): what holds at each statement and block, folded in order from the statements that set it."""
    kind, none = SCOPES[form], F.lit(None).cast("binary").alias("text")
    rows = setting.select("_source", "at", F.lit(_SET).alias("turn"), "text")
    for asked, turn in ((statements, _STATEMENT), (blocks, _BLOCK)):
        rows = rows.unionByName(asked.select("_source", "at", F.lit(turn).alias("turn"), none))

    def folded(own: pd.DataFrame) -> pd.DataFrame:
        now, out, made = kind(None), [], None
        for source, at, turn, text in own.sort_values(["at", "turn"])[["_source", "at", "turn", "text"]].itertuples(index=False):
            if turn == _SET:
                now.learn(bytes(text))
                made = None
            else:
                made = now.dump() if made is None else made
                out.append((source, at, turn, made))
        return pd.DataFrame(out, columns=["_source", "at", "turn", "scope"])

    return rows.groupBy("_source").applyInPandas(folded, "_source string, at long, turn int, scope string").distinct()


_TERM = pa.struct([("kind", pa.int8()), ("value", pa.string()), ("lang", pa.string()), ("datatype", pa.string())])
QUADS = f"_source string, pos long, s {TERM}, p {TERM}, o {TERM}, _error string"


class _Rows:
    """Triples of statements, gathered to batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, scope: Turtle | Xml | Json, source: str, at: int, text: bytes) -> None:
        n, keys = 0, ("kind", "value", "lang", "datatype")
        begin = len(self.rows)
        try:
            for triple in scope.parse(text, f"g{at}x"):
                self.rows.append((source, at + n, *[dict(zip(keys, t)) for t in triple], None))
                n += 1
        except (ValueError, KeyError, TypeError, AttributeError, ET.ParseError, RecursionError) as e:
            del self.rows[begin:]
            self.rows.append((source, at, None, None, None, str(e)[:200] or type(e).__name__))

    def full(self) -> bool:
        return len(self.rows) >= 2000

    def batch(self) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), _TERM, _TERM, _TERM, pa.string())
        cols = list(zip(*self.rows)) or [()] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_source", "pos", "s", "p", "o", "_error"])


def read(spark: SparkSession, path: str, form: str, skip_malformed: bool = False) -> DataFrame:
    """(_source, pos, s, p, o, _error) of the statements of Turtle, RDF/XML or JSON-LD files, in the order of pos within each file."""
    from biblioflow.functions.shared import saved

    grammar, kind = GRAMMARS[form], SCOPES[form]
    cut = _pieces(spark, path, grammar)
    starts = saved(begun(transitions(cut, grammar)), "block-starts")

    def walked(table: DataFrame) -> DataFrame:
        # one row a block; a broadcast keeps the pieces in their order. A block that is not known is found by _walk
        own = F.broadcast(table.withColumnsRenamed({"_source": "b_source", "_block": "b_block"}))
        rest = [c for c in table.columns if c not in ("_source", "_block")]
        return cut.join(own, (cut["_source"] == own["b_source"]) & (cut["_block"] == own["b_block"]), "left").select(*cut.columns, *rest)

    borders = saved(parts(walked(starts), form), "block-parts")
    over = saved(joined(borders), "statements-over-blocks")
    sets = F.udf(lambda at, text: _sets(form, at, bytes(text)), "boolean")
    setting = borders.where("kind = 'sets'").select("_source", "at", "text").unionByName(over.where(sets("at", "text")))
    known = saved(scopes(setting, over, starts, form), "scopes")
    table = starts.join(known.where(F.col("turn") == _BLOCK), ["_source", "at"]).select("_source", "_block", "state", "depth", "at", "scope")

    def of_blocks(batches) -> Iterator[pa.RecordBatch]:
        rows, scope, block = _Rows(), None, None
        for key, part, at, text in _walk(grammar, batches, 4):
            if block != key[:2]:
                block, scope = key[:2], kind(key[5])
            if part == "whole" and not (isinstance(scope, Xml) and scope.single()):
                rows.add(scope, key[0], at, text)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    def of_statements(batches) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            for source, at, text, scope in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = kind(scope)
                if isinstance(own, Xml) and (at == 0 or own.single()):
                    continue
                rows.add(own, source, at, text)
            yield rows.batch()

    found = walked(table).mapInArrow(of_blocks, QUADS)
    found = found.unionByName(over.join(known.where(F.col("turn") == _STATEMENT), ["_source", "at"]).select("_source", "at", "text", "scope").mapInArrow(of_statements, QUADS))
    if form == "rdfxml":
        found = found.unionByName(_single_nodes(spark, path, known))
    return found.where("_error is null") if skip_malformed else found


def _single_nodes(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Documents whose root is a node, or that have one element or none, read whole."""
    single = F.udf(lambda scope: Xml(scope).single(), "boolean")
    files = known.where(F.col("turn") == _STATEMENT).groupBy("_source").agg(F.max_by("scope", "at").alias("scope"), F.max("at").alias("last")).where((F.col("last") == 0) | single("scope")).select("_source")
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata")["file_path"].alias("_source"), F.col("value").alias("content"))
    return documents.parsed(text.join(files, "_source", "left_semi"), "rdfxml", None)
