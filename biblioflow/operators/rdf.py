"""RDF terms, graphs and datasets as DataFrames: quads(pos, s, p, o, g), document order in pos, g null in the default graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.functions import schema
from biblioflow.functions.text import nested


def iri(value: Column | str) -> Column:
    return _term(schema.IRI, value, "", "")


def blank(label: Column | str) -> Column:
    return _term(schema.BLANK, label, "", "")


def literal(value: Column | str, lang: str = "", datatype: str = "") -> Column:
    """Without a datatype: rdf:langString if there is a language, else xsd:string."""
    return _term(schema.LITERAL, value, lang, datatype or (schema.RDF + "langString" if lang else schema.XSD + "string"))


def _term(kind: int, value: Column | str, lang: str, datatype: str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), value.alias("value"), F.lit(lang).alias("lang"), F.lit(datatype).alias("datatype"))


def is_iri(t: Column) -> Column:
    return t["kind"] == schema.IRI


def is_blank(t: Column) -> Column:
    return t["kind"] == schema.BLANK


def is_literal(t: Column) -> Column:
    return t["kind"] == schema.LITERAL


def local_name(value: Column) -> Column:
    """What follows the last #, or else the last slash."""
    return F.when(value.contains("#"), F.substring_index(value, "#", -1)).otherwise(F.substring_index(value, "/", -1))


def last_segment(value: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(value, r"[/#]+\z", ""), r"([^/#]*)\z", 1)


# graph queries


def dedupe(quads: DataFrame) -> DataFrame:
    """The first of equal statements, in document order."""
    return quads.groupBy("s", "p", "o", "g").agg(F.min("pos").alias("pos")).select("pos", "s", "p", "o", "g")


def has_graph(quads: DataFrame, g: Column) -> DataFrame:
    """One row: whether any statement is in the graph."""
    return in_graph(quads, g).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def is_empty(quads: DataFrame) -> DataFrame:
    """One row: whether there is no statement."""
    return quads.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def sole_value(quads: DataFrame, *keys: str) -> DataFrame:
    """(s, p, o) where all statements of a subject and predicate have one object."""
    keys = keys or ("s", "p")
    return quads.groupBy(*keys).agg(F.min_by("o", "pos").alias("o"), F.count_distinct("o").alias("n")).where("n = 1").drop("n")


def in_graph(quads: DataFrame, g: Column) -> DataFrame:
    return quads.where(F.col("g").eqNullSafe(g))


def graph_sizes(quads: DataFrame) -> DataFrame:
    """Graphs in first-seen order, with their statement counts."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def objects(quads: DataFrame, *keys: str) -> DataFrame:
    """Distinct objects of each (s, p), numbered in document order."""
    keys = keys or ("s", "p")
    first = quads.groupBy(*keys, "o").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)


def objects_with_repeats(quads: DataFrame) -> DataFrame:
    """(s, p, objects): all objects of each (s, p) in document order, repeats included."""
    rows = quads.groupBy("s", "p").agg(F.array_sort(F.collect_list(F.struct("pos", "o"))).alias("rows"))
    return rows.select("s", "p", F.transform("rows", lambda x: x["o"]).alias("objects"))


def first_object(quads: DataFrame) -> DataFrame:
    return quads.groupBy("s", "p").agg(F.min_by("o", "pos").alias("o"))


def first_literal(quads: DataFrame) -> DataFrame:
    return first_object(quads.where(is_literal(F.col("o"))))


def subjects_of_type(quads: DataFrame, type_iri: str) -> DataFrame:
    own = quads.where((F.col("p.value") == schema.RDF + "type") & (F.col("o.value") == type_iri) & is_iri(F.col("o")))
    return own.groupBy("s").agg(F.min("pos").alias("pos"))


def lists(quads: DataFrame) -> DataFrame:
    """(head, items, _error) of every RDF list: its terms in order, of any length. Every cell finds its head and its place by pointer jumping
    over the links before it, in as many rounds as the logarithm of the longest list. _error, and no items: a cell of the list has several
    firsts or rests, or none (fork), is the rest of several cells (shared; its own list, from there on, has that error), the list does not
    end in nil (open), or runs in a circle (circle; its head is the circle's least cell)."""
    from biblioflow.functions.shared import saved

    nil = F.struct(F.lit(schema.IRI).cast("tinyint").alias("kind"), F.lit(schema.RDF + "nil").alias("value"), F.lit("").alias("lang"), F.lit("").alias("datatype"))
    of = lambda name: quads.where(F.col("p.value") == schema.RDF + name).groupBy("s").agg(F.count_distinct("o").alias(f"{name}s"), F.min("o").alias(name))
    cells = of("rest").join(of("first"), "s", "full")
    fork = (F.coalesce("rests", F.lit(0)) != 1) | (F.coalesce("firsts", F.lit(0)) != 1)
    cells = saved(cells.select(F.col("s").alias("cell"), "first", F.when(~fork, F.col("rest")).alias("rest"), fork.alias("fork")), "list-cells")
    before = cells.where(F.col("rest") != nil).groupBy(F.col("rest").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("before"))
    # a cell that several lists lead to begins a list of its own
    now = cells.select("cell").join(before, "cell", "left").select(
        "cell", F.when(F.col("n") == 1, F.col("before")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("place"), F.when(F.col("n") == 1, F.col("before")).otherwise(F.col("cell")).alias("head"),
        (F.coalesce("n", F.lit(0)) > 1).alias("shared"), F.least("cell", F.coalesce("before", "cell")).alias("low"),
    )
    now = saved(now, "list-links")
    most, reach = now.count(), 1
    while reach < most and not now.where("to is not null").isEmpty():
        far = now.select(F.col("cell").alias("f_cell"), F.col("to").alias("f_to"), F.col("place").alias("f_place"), F.col("head").alias("f_head"), F.col("low").alias("f_low"))
        step = now.join(far, F.col("to") == F.col("f_cell"), "left")
        now = saved(step.select("cell", F.col("f_to").alias("to"), (F.col("place") + F.coalesce("f_place", F.lit(0))).alias("place"), F.coalesce("f_head", "head").alias("head"), "shared", F.least("low", F.coalesce("f_low", "low")).alias("low")), "list-links")
        reach *= 2
    rows = now.join(cells, "cell")
    head = F.when(F.col("to").isNotNull(), F.col("low")).otherwise(F.col("head"))
    found = rows.withColumn("head", head).groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("place", "first"))).alias("rows"), F.max(F.col("to").isNotNull()).alias("circle"), F.max("fork").alias("fork"),
        F.max((F.col("place") == 0) & F.col("shared")).alias("shared"), F.max_by("rest", "place").alias("last"),
    )
    # a list that leads into a shared cell is shared too
    ends = found.where(F.col("shared")).select(F.col("head").alias("into"))
    found = found.join(ends, F.col("last") == F.col("into"), "left")
    error = F.when(F.col("circle"), "circle").when(F.col("fork"), "fork").when(F.col("shared") | F.col("into").isNotNull(), "shared").when(F.coalesce(F.col("last") != nil, F.lit(True)), "open")
    return found.select("head", F.when(error.isNull(), F.transform("rows", lambda r: r["first"])).alias("items"), error.alias("_error"))


# N-Triples and N-Quads


def _escape_iri(s: Column) -> Column:
    marks = "<>\"{}|^`\\" + " "
    return nested(s, [("\\", "\\u005C")] + [(c, f"\\u{ord(c):04X}") for c in marks if c != "\\"])


def _escape_literal(s: Column) -> Column:
    return nested(s, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def _escape_canonical(s: Column) -> Column:
    """The escapes of canonical N-Quads: named ones for \\b \\t \\n \\f \\r, and \\u00XX for other control characters and U+007F."""
    others = [chr(c) for c in (*range(32), 127) if chr(c) not in "\b\t\n\f\r"]
    marks = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    plain = nested(s, marks)
    return F.when(s.rlike(r"[\x00-\x1f\x7f]"), nested(plain, [(c, f"\\u{ord(c):04X}") for c in others])).otherwise(plain)


def term_text(t: Column, label: Column | None = None, canonical: bool = False) -> Column:
    escape = _escape_canonical if canonical else _escape_literal
    value = F.concat(F.lit('"'), escape(t["value"]), F.lit('"'))
    typed = F.when(t["lang"] != "", F.concat(value, F.lit("@"), t["lang"])).when(t["datatype"].isin("", schema.XSD + "string"), value)
    typed = typed.otherwise(F.concat(value, F.lit("^^<"), _escape_iri(t["datatype"]), F.lit(">")))
    return F.when(is_iri(t), F.concat(F.lit("<"), _escape_iri(t["value"]), F.lit(">"))).when(is_blank(t), F.concat(F.lit("_:"), t["value"] if label is None else label)).otherwise(typed)


def to_nquads(quads: DataFrame, canonical: bool = False) -> DataFrame:
    """pos and the line of each statement; blank labels as they are."""
    c = F.col
    graph = F.when(c("g").isNull(), "").otherwise(F.concat(term_text(c("g")), F.lit(" ")))
    terms = [term_text(c(n), None, canonical) for n in ("s", "p", "o")]
    return quads.select("pos", F.concat(*[x for t in terms for x in (t, F.lit(" "))], graph, F.lit(".")).alias("line"))


#: Statements in a range of document order, in which blank nodes are numbered together.
RANGE = 1 << 20


def renumber_blanks(quads: DataFrame, scope: str | None = None) -> DataFrame:
    """Blank labels b1, b2, ... by first mention (subject, predicate, object, graph of each statement in order), for each scope column."""
    keys = [scope] if scope else []
    mentions = None
    for k, name in enumerate(("s", "p", "o", "g")):
        own = quads.where(is_blank(F.col(name))).select(*keys, F.col(f"{name}.value").alias("label"), (F.col("pos") * 4 + k).alias("at"))
        mentions = own if mentions is None else mentions.unionByName(own)
    firsts = mentions.groupBy(*keys, "label").agg(F.min("at").alias("at")).withColumn("range", F.floor(F.col("at") / (4 * RANGE)))
    # nodes are numbered within ranges of document order; only the ranges' sizes are summed in one task a scope
    sizes = firsts.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("at"))
    names = firsts.withColumn("within", within).join(starts, [*keys, "range"])
    names = names.select(*keys, "label", F.concat(F.lit("b"), (F.col("before") + F.col("within")).cast("string")).alias("new"))
    return relabelled(quads, names, keys, ("s", "p", "o", "g"))


def relabelled(quads: DataFrame, names: DataFrame, keys: list[str], terms: tuple[str, ...]) -> DataFrame:
    """quads whose blank nodes take the names of (keys, label, new); others keep theirs."""
    for name in terms:
        own = names.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("label").alias("_label"), F.col("new").alias("_new"))
        same = F.when(is_blank(F.col(name)), F.col(f"{name}.value")) == F.col("_label")
        for k in keys:
            same &= F.col(k) == F.col(f"_{k}")
        new = F.when(F.col("_new").isNotNull(), F.col(name).withField("value", F.col("_new"))).otherwise(F.col(name))
        quads = quads.join(own, same, "left").withColumn(name, new).select(*quads.columns)
    return quads


#: Repeats are possessive, and so loops in the matcher: a literal may be of any length.
_IRI_RE = r"<[^>]*+>"
_BLANK_RE = r"_:[^\s<>\".]++(?:\.++[^\s<>\".]++)*+"
_LITERAL_RE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z]++(?:-[A-Za-z0-9]++)*+|\^\^<[^>]*+>)?+'
_LINE_RE = rf"\A\s*+({_IRI_RE}|{_BLANK_RE})\s*+({_IRI_RE})\s*+({_IRI_RE}|{_BLANK_RE}|{_LITERAL_RE})\s*+({_IRI_RE}|{_BLANK_RE})?+"


_TOKEN_RE = r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\)"


def _unescape(s: Column) -> Column:
    """Backslash escapes of one character and every \\uXXXX and \\UXXXXXXXX; other escaped characters stand for themselves."""

    def plain(t: Column) -> Column:
        code = F.conv(F.substring(t, 3, 8), 16, 10).cast("long")
        bad = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.when(bad, "FFFD").otherwise(F.substring(t, 3, 8)), 8, "0")), "UTF-32")
        out = F.when((F.length(t) < 2) | ~t.startswith("\\"), t).when(F.length(t) > 2, point)
        for mark, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")):
            out = out.when(t == F.lit(f"\\{mark}"), char)
        return out.otherwise(F.substring(t, 2, 1))

    tokens = F.regexp_extract_all(s, F.lit(_TOKEN_RE), F.lit(1))
    return F.when(F.contains(s, F.lit("\\")), F.array_join(F.transform(tokens, plain), "")).otherwise(s)


def parse_nquads(lines: DataFrame, line: str = "value", pos: str = "pos") -> DataFrame:
    """quads, with _error where a line is malformed; blank lines and comments are left out."""
    text = F.trim(F.regexp_replace(F.col(line), r"[\r\n]+\z", ""))
    rows = lines.where(~F.col(line).rlike(r"\A\s*+(?:#|\z)"))
    # the line is matched once; a line feed, which no statement holds, parts what was found
    found = F.when(text.contains("\n"), F.lit(None)).otherwise(F.split(F.regexp_replace(text, rf"(?s){_LINE_RE}.*+\z", "$1\n$2\n$3\n$4"), "\n", -1))
    rows = rows.select("*", found.alias("_found"))
    ok = F.coalesce(F.size("_found") == 4, F.lit(False))

    def term(x: Column) -> Column:
        suffix = F.substring_index(x, '"', -1)
        value = _unescape(F.substring(x, F.lit(2), F.length(x) - F.length(suffix) - 2))
        kind = F.when(suffix.startswith("@"), schema.RDF + "langString").when(suffix.startswith("^^<"), _unescape(F.substring(suffix, F.lit(4), F.length(suffix) - 4)))
        text = F.struct(
            F.lit(schema.LITERAL).cast("tinyint").alias("kind"), value.alias("value"),
            F.when(suffix.startswith("@"), F.substring(suffix, F.lit(2), F.length(suffix))).otherwise("").alias("lang"), kind.otherwise(schema.XSD + "string").alias("datatype"),
        )
        named = F.when(x.startswith("_:"), blank(F.substring(x, F.lit(3), F.length(x)))).otherwise(iri(_unescape(F.substring(x, F.lit(2), F.length(x) - 2))))
        return F.when(x.startswith('"'), text).otherwise(named)

    part = lambda k: F.get("_found", F.lit(k))
    return rows.select(
        F.col(pos).alias("pos"), *[F.when(ok, term(part(k))).alias(n) for k, n in enumerate(("s", "p", "o"))],
        F.when(ok & (part(3) != ""), term(part(3))).alias("g"), F.when(~ok, F.concat(F.lit("malformed line "), F.col(line))).alias("_error"),
    )


def read_nquads(spark: SparkSession, path: str, skip_malformed: bool = False) -> DataFrame:
    """quads of N-Triples or N-Quads files; pos orders the lines within a file."""
    text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"), F.input_file_name().alias("_source"))
    quads = parse_nquads(text)
    return quads.where("_error is null") if skip_malformed else quads


def labels(hashes: DataFrame) -> DataFrame:
    """(label, hash) with `new`, c14n<n> by hash. Nodes are numbered within buckets of the hash's first three hex digits; only the
    4,096 bucket sizes are summed in one task, whatever the number of nodes."""
    own = hashes.withColumn("bucket", F.substring("hash", 1, 3))
    sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("hash")) - 1
    return own.withColumn("within", within).join(F.broadcast(starts), "bucket").select("label", "hash", F.concat(F.lit("c14n"), (F.col("before") + F.col("within")).cast("string")).alias("new"))


def ties(hashes: DataFrame) -> DataFrame:
    """(hash, n) of first-degree hashes that several blank nodes have."""
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def canonical(quads: DataFrame) -> DataFrame:
    """RDFC-1.0: the distinct canonical lines, sorted, with blank nodes as c14n<n>. Nodes whose first-degree hash is their own are
    numbered by it; the others by the n-degree hashes of the parts of the graph that they make (``operators.canon``). Raises
    ValueError where a part is beyond its budgets."""
    from biblioflow.functions.shared import saved
    from biblioflow.operators import canon

    quads = saved(quads.select("pos", "s", "p", "o", "g"), "quads")
    hashes = saved(first_degree(quads), "first-degree")
    many = ties(hashes).select("hash")
    named = labels(hashes.join(many, "hash", "left_anti"))
    if not many.isEmpty():
        named = named.select("label", "new").unionByName(canon.tied(quads, hashes, many, named))
    out = relabelled(quads, named.select("label", "new"), [], ("s", "o", "g"))
    return to_nquads(out, canonical=True).select("line").distinct().orderBy("line")


def first_degree(quads: DataFrame) -> DataFrame:
    """(label, hash) of every blank node: SHA-256 of its sorted statements, itself as _:a and other blanks as _:z."""
    c = F.col
    own = quads.where(is_blank(c("s")) | is_blank(c("o")) | is_blank(c("g"))).withColumn(
        "label", F.explode(F.array_distinct(F.filter(F.array(*[F.when(is_blank(c(n)), c(f"{n}.value")) for n in ("s", "o", "g")]), lambda x: x.isNotNull())))
    )
    mark = lambda n: F.when(c(f"{n}.value") == c("label"), "a").otherwise("z")
    graph = F.when(c("g").isNull(), "").otherwise(F.concat(term_text(c("g"), mark("g")), F.lit(" ")))
    term = lambda n: term_text(c(n), None if n == "p" else mark(n), canonical=True)
    line = F.concat(*[x for n in ("s", "p", "o") for x in (term(n), F.lit(" "))], graph, F.lit(".\n"))
    return own.select("label", line.alias("line")).groupBy("label").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("hash"))


# thesauri


def concepts(quads: DataFrame) -> DataFrame:
    """One row for each skos:Concept: labels, notes, scheme and resolved references, in document order; sorted lists carry pos."""
    sk = schema.SKOS
    types = subjects_of_type(quads, sk + "Concept").select("s", F.col("pos").alias("at"))
    own = quads.join(types, "s")

    def texts(p: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("p.value") == sk + p, F.struct("pos", F.col("o.value").alias("text"), F.col("o.lang").alias("lang")))))

    def refs(p: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("p.value") == sk + p, F.struct("pos", F.col("o.value").alias("uri")))))

    out = own.groupBy("s").agg(
        F.min("at").alias("pos"), F.min_by(F.when(F.col("p.value") == sk + "inScheme", F.col("o.value")), F.when(F.col("p.value") == sk + "inScheme", F.col("pos"))).alias("scheme"),
        F.min_by(F.when(F.col("p.value") == sk + "notation", F.col("o.value")), F.when(F.col("p.value") == sk + "notation", F.col("pos"))).alias("notation"),
        texts("prefLabel").alias("pref"), texts("altLabel").alias("alt"), texts("scopeNote").alias("notes"),
        refs("broader").alias("broader"), refs("narrower").alias("narrower"), refs("related").alias("related"),
    )
    uri = F.col("s.value")
    return out.select(uri.alias("uri"), F.coalesce("notation", last_segment(uri)).alias("id"), F.coalesce("scheme", F.lit("")).alias("scheme"), "pos", "pref", "alt", "notes", "broader", "narrower", "related")


def english_first(labels: Column) -> Column:
    """The first label in English (en or en-*), else the first one."""
    english = F.filter(labels, lambda x: (x["lang"] == "en") | x["lang"].startswith("en-"))
    return F.coalesce(F.get(english, F.lit(0))["text"], F.get(labels, F.lit(0))["text"], F.lit(""))


def resolve(thesaurus: DataFrame, kind: str) -> DataFrame:
    """(uri, n, target, target_id, target_label) of one kind of reference; targets that are not concepts keep their last segment."""
    refs = thesaurus.select("uri", F.posexplode(kind).alias("n", "ref")).select("uri", "n", F.col("ref.uri").alias("target"))
    known = thesaurus.select(F.col("uri").alias("target"), F.col("id").alias("_id"), english_first(F.col("pref")).alias("_label"))
    joined = refs.join(known, "target", "left")
    return joined.select("uri", "n", "target", F.coalesce("_id", last_segment(F.col("target"))).alias("target_id"), F.coalesce("_label", last_segment(F.col("target"))).alias("target_label"))


def tally(thesaurus: DataFrame) -> DataFrame:
    """(what, key, n): concepts by the base of their IRI and by scheme, preferred labels by language."""
    entry = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    base = F.regexp_replace("uri", "[^/]*$", "")
    keys = F.concat(
        F.array(entry("base", F.when(base == "", F.col("uri")).otherwise(base)), entry("scheme", F.col("scheme"))), F.transform("pref", lambda x: entry("language", x["lang"]))
    )
    rows = thesaurus.select(F.explode(keys).alias("k")).where((F.col("k.key") != "") | (F.col("k.what") == "base"))
    return rows.groupBy("k.what", "k.key").agg(F.count(F.lit(1)).alias("n"))


def report(thesaurus: DataFrame) -> DataFrame:
    """(uri, id, text): each concept as lines of text, with its labels and references; read in order of id."""
    refs = None
    for k, kind in enumerate(("broader", "narrower", "related")):
        own = resolve(thesaurus, kind).select(F.col("uri").alias("_uri"), F.lit(k).alias("k"), "n", "target_id", "target_label")
        refs = own if refs is None else refs.unionByName(own)
    name = F.concat(F.when(F.col("target_label") == "", F.col("target_id")).otherwise(F.col("target_label")), F.lit(" ("), F.col("target_id"), F.lit(")"))
    lists = refs.groupBy("_uri").agg(F.array_sort(F.collect_list(F.struct("k", "n", name.alias("name")))).alias("refs"))  # a concept's own references

    def line(k: int, kind: str) -> Column:
        names = F.transform(F.filter("refs", lambda x: x["k"] == k), lambda x: x["name"])
        return F.when(F.size(names) > 0, F.concat(F.lit(f"  {kind}: "), F.array_join(names, ", "), F.lit("\n"))).otherwise("")

    english = F.get(F.filter("pref", lambda x: (x["lang"] == "en") | x["lang"].startswith("en-")), F.lit(0))["lang"]
    lang = F.coalesce(english, F.get("pref", F.lit(0))["lang"], F.lit(""))
    mark = lambda v: F.when(v == "", "").otherwise(F.concat(F.lit(" ["), v, F.lit("]")))
    others = F.array_join(F.transform("alt", lambda x: F.concat(x["text"], mark(x["lang"]))), ", ")
    said = lambda head, v: F.when(v == "", "").otherwise(F.concat(F.lit(head), v, F.lit("\n")))
    text = F.concat(
        F.col("id"), F.lit("  "), english_first(F.col("pref")), mark(lang), F.lit("\n"), said("  uri: ", F.col("uri")), said("  alt: ", others),
        line(0, "broader"), line(1, "narrower"), line(2, "related"),
    )
    return thesaurus.join(lists, F.col("uri") == F.col("_uri"), "left").select("uri", "id", text.alias("text"))


AUTHORITY_LEADER = "00000nz  a2200000n  4500"


def authority(thesaurus: DataFrame) -> DataFrame:
    """uri, leader, fields: an authority record for each concept. The heading is the English label, or else the first; every
    label that is not English and every other label is a see-from tracing, so a heading that fell back is traced too."""
    from biblioflow.functions import marc

    uri, c = F.col("uri"), F.col
    none = F.expr(f"cast(array() as {schema.FIELDS})")
    filled = lambda tag, i1, subs, when: F.when(when, F.array(marc.make_data(tag, i1, " ", *subs))).otherwise(none)
    english = lambda x: (x["lang"] == "en") | x["lang"].startswith("en-")

    def trace(x: Column) -> Column:
        subs = F.filter(F.array(marc.subfield("a", x["text"]), marc.subfield("9", x["lang"])), lambda s: (s["code"] == "a") | (s["value"] != ""))
        return marc.make_data("450", " ", " ").withField("subfields", subs)

    def see_also(kind: str, mark: str) -> DataFrame:
        refs = resolve(thesaurus, kind)
        head = [marc.subfield("w", mark)] if mark else []
        field = marc.make_data("550", " ", " ", *head, marc.subfield("a", F.when(c("target_label") != "", c("target_label")).otherwise(c("target_id"))), marc.subfield("0", c("target")))
        return refs.select(c("uri").alias("_uri"), F.struct(F.lit({"broader": 0, "narrower": 1, "related": 2}[kind]).alias("k"), "n", field.alias("f")).alias("x"))

    traced = see_also("broader", "g").unionByName(see_also("narrower", "h")).unionByName(see_also("related", ""))
    traced = traced.groupBy("_uri").agg(F.array_sort(F.collect_list("x")).alias("also"))  # a concept's own references
    labels = F.concat(F.filter("pref", lambda x: ~english(x)), c("alt"))
    fields = F.concat(
        F.when(c("id") != "", F.array(marc.make_control("001", c("id")))).otherwise(none),
        filled("024", "7", [marc.subfield("a", uri), marc.subfield("2", "uri")], uri != ""),
        filled("150", " ", [marc.subfield("a", english_first(c("pref")))], english_first(c("pref")) != ""),
        F.transform(F.filter(labels, lambda x: x["text"] != ""), trace),
        F.coalesce(F.transform("also", lambda x: x["f"]), none),
        F.transform(F.filter("notes", lambda x: x["text"] != ""), lambda x: marc.make_data("680", " ", " ", marc.subfield("i", x["text"]))),
    )
    return thesaurus.join(traced, uri == c("_uri"), "left").select("uri", F.lit(AUTHORITY_LEADER).alias("leader"), fields.alias("fields"))


PROV = "http://www.w3.org/ns/prov#"


def provenance(rows: DataFrame, graph: Column, source: Column, agent: Column, generated_at: Column) -> DataFrame:
    """pos, s, p, o: PROV-O statements about a graph of each row; null terms and empty times are left out."""
    st = lambda p, o: F.struct(graph.alias("s"), iri(p).alias("p"), o.alias("o"))
    made = F.array(
        st(schema.RDF + "type", iri(PROV + "Entity")), F.when(source.isNotNull(), st(PROV + "wasDerivedFrom", source)), F.when(agent.isNotNull(), st(PROV + "wasAttributedTo", agent)),
        F.when(generated_at != "", st(PROV + "generatedAtTime", literal(generated_at, "", schema.XSD + "dateTime"))),
    )
    return rows.select(F.posexplode(F.filter(made, lambda x: x.isNotNull())).alias("pos", "t")).select("pos", "t.*")


def _compact(value: Column, prefixes: dict[str, str]) -> Column:
    """A prefixed name under the longest namespace that leaves a plain local name, or null."""
    out = F.lit(None).cast("string")
    for label, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), x[0])):
        local = F.substring(value, F.lit(len(ns) + 1), F.length(value))
        good = value.startswith(ns) & local.rlike(r"^[A-Za-z0-9_.\-]*[A-Za-z0-9_\-]\z")
        out = F.when(good, F.concat(F.lit(f"{label}:"), local)).otherwise(out)
    return out


def turtle_term(t: Column, prefixes: dict[str, str], predicate: bool = False) -> Column:
    plain = term_text(t)
    named = F.coalesce(_compact(t["value"], prefixes), plain)
    if predicate:
        named = F.when(t["value"] == schema.RDF + "type", "a").otherwise(named)
    typed = is_literal(t) & (t["lang"] == "") & ~t["datatype"].isin("", schema.XSD + "string")
    text = F.concat(F.lit('"'), _escape_literal(t["value"]), F.lit('"^^'), F.coalesce(_compact(t["datatype"], prefixes), F.concat(F.lit("<"), _escape_iri(t["datatype"]), F.lit(">"))))
    return F.when(is_iri(t), named).when(typed, text).otherwise(plain)


def to_turtle(quads: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """pos, text: one block for each subject in first-seen order; objects of a predicate stand together. Written after turtle_header()."""
    by_p = quads.groupBy("s", "p").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", turtle_term(F.col("o"), prefixes).alias("t")))).alias("os"))
    said = F.concat(turtle_term(F.col("p"), prefixes, True), F.lit(" "), F.array_join(F.transform("os", lambda x: x["t"]), ", "))
    by_s = by_p.groupBy("s").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))).alias("ps"))
    return by_s.select("pos", F.concat(turtle_term(F.col("s"), prefixes), F.lit(" "), F.array_join(F.transform("ps", lambda x: x["t"]), " ;\n    "), F.lit(" .\n")).alias("text"))


def turtle_header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {k}: <{prefixes[k]}> .\n" for k in sorted(prefixes)) + ("\n" if prefixes else "")
