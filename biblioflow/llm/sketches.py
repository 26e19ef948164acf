"""Document fingerprints by a threshold-scaled sketch of word shingles.

A sketch keeps every distinct shingle hash below 2**64 / scale, and the least one in any case. Whether a hash is kept depends
on nothing but the hash (and on there being none below), so sketches of parts of a text merge into that of the whole, and
the containment of a short text in a very long one can be estimated from the two sketches alone. All texts are sketched at
one scale; sketches of different scales are compared and merged at the coarser one.

As a string a sketch is "scale:base64 of the sorted hashes as little-endian unsigned 64-bit integers".

The query also pairs each document with the next one by ascending doc_id. Documents are dealt into ranges of ids, cut where
the bytes before them pass a multiple of a fixed size, the first document of each range also to the range before it, and
each range is streamed in order, so a document only ever waits for one other.

Nulls: a null text is empty (no shingle; two empty sketches are alike by 1, an empty and another by 0); a null doc_id
comes first. Rows of equal doc_id come in the order of a hash of their text; repeated rows stay as rows, one after the other. A lone document is its own next one. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import byte_cuts, cut_number, read, shingles, word_hashes, words

SHINGLE = 5
SCALE = 2


def sketch(text: str | None, k: int = SHINGLE, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """(scale, sorted distinct hashes below 2**64 / scale, or the least one)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, row = words(buf, np.array([0, len(buf)]))
    hashes, _ = shingles(word_hashes(buf, starts, ends), row, k)
    return scale, np.unique(_below(hashes, scale))


def _below(hashes: np.ndarray, scale: int) -> np.ndarray:
    kept = hashes[hashes < np.uint64((1 << 64) // scale)] if scale > 1 else hashes
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of two texts' shingles together."""
    scale = max(a[0], b[0])
    return scale, _below(np.union1d(a[1], b[1]), scale)


def _common(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, int, int]:
    scale = max(a[0], b[0])
    x, y = _below(a[1], scale), _below(b[1], scale)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    both, x, y = _common(a, b)
    if x + y == 0:
        return float(len(a[1]) == len(b[1]) == 0)
    return both / (x + y - both)


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of a's shingles that b has."""
    both, x, _ = _common(a, b)
    return both / x if x else float(len(a[1]) == 0)


def to_text(s: tuple[int, np.ndarray]) -> str:
    return f"{s[0]}:{base64.b64encode(s[1].astype('<u8').tobytes()).decode()}"


def from_text(s: str) -> tuple[int, np.ndarray]:
    scale, _, data = s.partition(":")
    return int(scale), np.frombuffer(base64.b64decode(data), "<u8")


def fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            prints = [to_text(sketch(t, k, scale)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """(part, spare, key, doc_id, text) in ranges of ascending doc_id, sorted within partitions. The row after a range's
    last one, which is the first row of the next range (of all, for the last), is there too, with spare = 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sizes = rows.select("key", "mark", F.octet_length("text").cast("long").alias("size"))
    cuts = byte_cuts(sizes, range_bytes)
    least = sizes.agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), F.coalesce("key", F.lit(0)).alias("key"), "mark"))).first()[0]
    last, cols = len(cuts), ["part", "spare", "key", "doc_id", "text", "mark"]
    own = rows.select(cut_number(cuts, F.col("key"), F.col("mark")).alias("part"), F.lit(0).alias("spare"), "key", F.col("key").alias("doc_id"), "text", "mark")
    if least is None:
        return own.select(cols[:-1])
    firsts = [(last, *least), *((k, *c) for k, c in enumerate(cuts))]  # one row a range
    small = docs.sparkSession.createDataFrame([(p, k if some else None, m) for p, some, k, m in firsts], "part int, f_key long, f_mark long")
    same = F.col("key").eqNullSafe(F.col("f_key")) & (F.col("mark") == F.col("f_mark"))
    spare = rows.join(F.broadcast(small), same).select("part", F.lit(1).alias("spare"), "key", F.col("key").alias("doc_id"), "text", "mark")
    both = own.unionByName(spare).repartitionById(last + 1, F.col("part"))
    return both.sortWithinPartitions("part", "spare", "key", "mark").select(cols[:-1])


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_edited double"
)


def edits(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every row and of its edited text (see edited_text), and how alike they and the next row's are."""
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    kinds = [types[x.split(" ")[1]] for x in _SCHEMA.split(", ")]

    def row(doc_id, text, own, following, next_own):
        new = edited_text(text, following)
        other = own if new == text else sketch(new, k, scale)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, to_text(own), to_text(other), likeness(own, other), likeness(own, next_own), containment(own, other)

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for part, spare, doc_id, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                own = sketch(text, k, scale)
                if held is not None and held[0] == part:
                    out.append(row(*held[1:], text, own))
                held = None if spare else (part, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return with_next(docs).mapInArrow(run, _SCHEMA)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(read(spark, sf_dir, "documents"))
