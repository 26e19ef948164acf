"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Characters are lower-cased, everything that is not a letter is taken as one space, and n-grams of 1 to 4 characters are
hashed to ``WIDTH`` features. Document frequencies are counted over all documents of the training fold. The classifier
is trained by follow-the-regularised-leader with an elastic net (which leaves most weights at zero) on at most
``SAMPLE`` training documents, taken by the order of a hash of doc_id; a part of the fold that it does not train on
calibrates the temperature of its probabilities. Nothing but text and the language of training rows is read.

Nulls: a text that is null or has no letter is `und` with score 1; rows with a null language train nothing; a null
doc_id keeps its row. Repeated rows get equal results; ties go to the language that sorts first. Without training rows
every text is `und` with score 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import fold, mix, read

SAMPLE = 6_000
WIDTH = 1 << 14
NGRAMS = (1, 2, 3, 4)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.01
EPOCHS = 2
UNKNOWN = "und"
_LETTERS = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def ngrams(text: str | None) -> np.ndarray | None:
    """The counts of the hashed n-grams of a text, or None if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate(([np.uint64(32)], code, [np.uint64(32)])).astype(np.uint64)
    out, h = np.zeros(WIDTH, np.int64), np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in NGRAMS:
            out += np.bincount((mix(h + np.uint64(n)) >> np.uint64(50)).astype(np.int64), minlength=WIDTH)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a document: (1 + log tf) * idf, of length one."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / (np.sqrt((x**2).sum()) or 1.0)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all rows have each feature, and how many rows have any; every task sends one row of each at most."""

    def run(batches):
        total = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngrams(text)
                if counts is not None:
                    total[:WIDTH] += counts > 0
                    total[WIDTH] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(WIDTH + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out[:WIDTH], int(out[WIDTH])


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = weighted(counts, self.idf)
        return x @ self.weights[at] + self.weights[WIDTH]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngrams(text)
        if counts is None:
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.languages[k], float(p[k] / p.sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 3) -> np.ndarray:
    """Weights (WIDTH + 1, classes); the last row is the bias, which is not regularised."""
    z, n, w = (np.zeros((WIDTH + 1, classes)) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, WIDTH), np.append(x, 1.0)
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
            shrunk[-1] = z[WIDTH]
            now = -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
            w[at] = now
            s = x @ now
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g**2
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * now
            n[at] = grown
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    shrunk[WIDTH] = z[WIDTH]
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.5), np.log(10), 60)):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: the training rows (doc_id, text, lang)."""
    docs = docs.where("lang is not null").select(F.col("doc_id").cast("long"), "text", "lang")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    own = docs.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(own.select("doc_id").distinct()), "doc_id")  # at most `sample` ids

    def run(batches):
        for batch in batches:
            found = [ngrams(t) for t in batch.column(1).to_pylist()]
            pairs = [(np.zeros(0, np.int64), np.zeros(0)) if c is None else weighted(c, idf) for c in found]
            cols = [batch.column(0), pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32()))]
            cols += [pa.array([x.astype(np.float32) for _, x in pairs], pa.list_(pa.float32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "x", "lang"])

    table = rows.mapInArrow(run, "doc_id long, at array<int>, x array<float>, lang string").toArrow()
    ids, langs = table["doc_id"].to_pylist(), table["lang"].to_pylist()
    ats, xs = table["at"].combine_chunks(), table["x"].combine_chunks()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, langs[i]))
    languages = sorted(set(langs))
    known = {k: i for i, k in enumerate(languages)}
    data = [(ats[i].values.to_numpy(), xs[i].values.to_numpy(zero_copy_only=False).astype(np.float64), known[langs[i]], ids[i]) for i in order if len(ats[i])]
    if not data:
        return Model([], idf, np.zeros((WIDTH + 1, 0)), 1.0)
    apart = [k % 10 == 0 and len(data) >= 50 for k in range(len(data))]
    weights = train_ftrl([d[:3] for d, a in zip(data, apart) if not a], len(languages))
    held = [d for d, a in zip(data, apart) if a]
    temperature = 1.0
    if held:
        logits = np.array([x @ weights[at] + weights[WIDTH] for at, x, _, _ in held])
        temperature = calibrate(logits, np.array([y for _, _, y, _ in held]))
    return Model(languages, idf, weights, temperature)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predictions(docs, fit(docs.where(fold(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
