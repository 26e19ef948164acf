"""Toxicity by weak supervision.

Voters look at a document's words: one for each word of a small lexicon, one for each word or word beginning mined from
the labelled training rows, and patterns (a document in which no such voter speaks is voted clean, shouting is a hint).
A generative label model estimates by expectation-maximisation how often each voter speaks on toxic and on clean
documents; voters that stay correlated within a class share their say. The given label is one more voter, of fixed
accuracy. A sparse linear classifier over words and word beginnings is then trained on the posterior labels, and alone
scores every document.

The label model and the classifier are fitted on at most ``SAMPLE`` labelled rows, taken by the order of a hash of
doc_id; nothing but doc_id, text and the label of training rows is read. Every whole text is scored.

Nulls: a null text is empty and gets the score of no evidence; rows with a null label or doc_id train nothing; a null
doc_id keeps its row. Repeated rows get equal scores. Without training rows the lexicon alone decides. An empty table
gives an empty result. Extra columns are ignored by ``scores`` and kept by ``reject``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import _BYTE, mix, powers, fold, read, text_blocks

SAMPLE = 8_000
THRESHOLD = 0.3
MINED = 200
GOLD_ACCURACY = 0.97
EPOCHS = 20
L1 = 1.5e-3
#: What a lexicon word weighs before training, and stays at where training has not seen it.
PRIOR = 4.0
LEXICON = (
    "idiot idiots stupid dumb moron morons loser losers trash garbage scum clown pathetic worthless disgusting ugly hate "
    "jerk fool imbecile vermin filth dumm trottel abschaum versager idiota estúpido basura payaso patético inútil "
    "stupide imbécile ordure minable crétin"
).split()
PREFIXES = (5,)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each letter run, lower-cased, and of its beginnings of PREFIXES bytes; hashes are 32 bits wide."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    inside = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    up, down = powers(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * up[: len(buf)], out=total[1:])
    rows, out = [row], [_hash(total, down, starts, ends, 0)]
    for p in PREFIXES:
        some = ends - starts > p
        rows.append(row[some])
        out.append(_hash(total, down, starts[some], starts[some] + p, p))
    return np.concatenate(rows), np.concatenate(out)


def _hash(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    return (mix((total[ends] - total[starts]) * down[starts] + np.uint64(kind)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def word_feature(word: str) -> int:
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(tokens(buf, np.array([0, len(buf)]))[1][0])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, shouts, found): the distinct features of each document."""

    def run(batches):
        for batch in batches:
            shouts, lists = [], []
            for i, j, buf, off in text_blocks(batch.column(0), batch.column(2)):
                row, h = tokens(buf, off)
                key = np.unique(row << 32 | h.view(np.uint32).astype(np.int64))
                ends = np.cumsum(np.bincount(key >> 32, minlength=j - i))
                h = (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                lists += [h[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
                upper = np.r_[0, np.cumsum((buf >= 65) & (buf <= 90))][off]
                shouts += (np.diff(upper) > 0.5 * np.maximum(np.diff(off), 1)).tolist()
            cols = [batch.column(0), batch.column(1), pa.array(shouts, pa.bool_()), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "shouts", "found"])

    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, shouts boolean, found array<int>")


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of toxic for each row of a boolean vote matrix; gold: the given labels, voters of fixed accuracy."""
    n, m = votes.shape
    v = votes.astype(np.float64)
    say = np.where(gold == 1, GOLD_ACCURACY, 1 - GOLD_ACCURACY)
    post, share = say.copy(), np.ones(m)
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        on = (v.T @ post + 0.5) / (post.sum() + 1)
        off = (v.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        if step % 10 == 9:  # what is left of the correlations within the classes
            centred = v - np.outer(post, on) - np.outer(1 - post, off)
            spread = np.sqrt((centred**2).mean(0)) + 1e-9
            corr = np.clip((centred.T @ centred) / n / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        odds = np.log(prior / (1 - prior)) + np.log(say / (1 - say))
        odds = odds + v @ (share * np.log(on / off)) + (1 - v) @ (share * np.log((1 - on) / (1 - off)))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def train_linear(row: np.ndarray, col: np.ndarray, soft: np.ndarray, start: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic weights by adaptive gradients with soft thresholding, from the weights of start; row is ascending."""
    n, width = len(soft), len(start)
    w, bias, energy, bias_energy = start.copy(), float(np.log(max(soft.mean(), 1e-3) / max(1 - soft.mean(), 1e-3))), np.full(width, 1e-2), 1.0
    ends = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            rows = order[i : i + 128]
            size = ends[rows + 1] - ends[rows]
            at = np.repeat(ends[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            cols, local = col[at], np.repeat(np.arange(len(rows)), size)
            z = bias + np.bincount(local, w[cols], len(rows))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[rows]
            used, inverse = np.unique(cols, return_inverse=True)
            grad = np.bincount(inverse, g[local], len(used)) / len(rows)
            energy[used] += grad**2
            rate = 0.5 / np.sqrt(energy[used])
            moved = w[used] - rate * grad
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            bias_energy += g.mean() ** 2
            bias -= 0.1 * g.mean() / np.sqrt(bias_energy)
    return w, bias


class Model:
    """Weights of features; those without one count nothing."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys.view(np.uint32) >> 12] = True

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        row, h = tokens(buf, off)
        some = self.bits[h.view(np.uint32) >> 12]
        row, h = row[some], h[some]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        pairs = np.unique(row[hit] * len(self.keys) + at[hit])
        z = self.bias + np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows among the first ``sample`` by hash; labels: (doc_id, toxic)."""
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(rows), "doc_id")  # at most `sample` rows

    def run(batches):  # one task gets the features of at most `sample` rows, so that the driver holds the model alone
        got = list(batches)
        if got:
            m = train(pa.Table.from_batches(got))
            yield pa.RecordBatch.from_arrays([pa.array(m.keys), pa.array(m.weights), pa.array(np.full(len(m.keys), m.bias))], ["key", "weight", "bias"])

    out = features(known).repartition(1).mapInArrow(run, "key int, weight double, bias double").toArrow()
    if not out.num_rows:
        return train(None)
    return Model(out["key"].to_numpy(), out["weight"].to_numpy(), float(out["bias"][0].as_py()))


def train(table: pa.Table | None) -> Model:
    """The model of a table of features(), or what the lexicon alone says if it has no row or only one label."""
    lexicon = np.array(sorted({word_feature(w) for w in LEXICON}), np.int32)
    gold = np.zeros(0, np.int64) if table is None else table["toxic"].to_numpy().astype(np.int64)
    if not len(gold) or gold.min() == gold.max():
        return Model(lexicon, np.full(len(lexicon), PRIOR), -3.0)
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")  # rows may come in any order
    found = table["found"].combine_chunks().take(pa.array(order))
    gold, shouts = gold[order], table["shouts"].to_numpy()[order]
    row = np.repeat(np.arange(len(gold), dtype=np.int32), np.diff(found.offsets.to_numpy()))
    values = found.flatten().to_numpy()
    del table, found
    keys, count = np.unique(values, return_counts=True)
    some = count > 1  # a feature of one document alone tells nothing about others
    keys, count = keys[some], count[some]
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0)).astype(np.int32)
    own = keys[at] == values if len(keys) else np.zeros(len(values), bool)
    row, col = row[own], at[own]
    del values, at, own
    toxic = np.bincount(col, gold[row], len(keys))
    rate = np.log((toxic + 0.1) / (gold.sum() + 1)) - np.log((count - toxic + 0.1) / (len(gold) - gold.sum() + 1))
    good = np.flatnonzero((toxic >= max(3, 0.002 * gold.sum())) & (rate > 3))
    mined = good[np.argsort(-(rate * np.sqrt(toxic))[good], kind="stable")][:MINED]
    voters = np.unique(np.r_[np.flatnonzero(np.isin(keys, lexicon)), mined])
    place = np.full(len(keys), -1, np.int32)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(gold), len(voters) + 2), bool)
    own = place[col] >= 0
    votes[row[own], place[col[own]]] = True
    votes[:, -2] = ~votes[:, : len(voters)].any(1)
    votes[:, -1] = shouts
    soft = label_model(votes, gold)
    listed = np.isin(keys, lexicon)
    often = np.flatnonzero((count >= 5) | listed)
    narrow = np.full(len(keys), -1, np.int32)
    narrow[often] = np.arange(len(often))
    use = narrow[col] >= 0
    w, bias = train_linear(row[use], narrow[col[use]], soft, np.where(listed[often], PRIOR, 0.0))
    some = np.flatnonzero(w)
    model_keys, weights = keys[often[some]], w[some]
    unseen = lexicon[~np.isin(lexicon, keys)]
    return Model(np.r_[model_keys, unseen], np.r_[weights, np.full(len(unseen), PRIOR)], bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        for batch in batches:
            found = [model.score(buf, off) for _, _, buf, off in text_blocks(batch.column(0), batch.column(1))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; all columns stay, and nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [model.score(buf, off) for _, _, buf, off in text_blocks(batch.column(0), batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(found) < threshold)) if found else batch

    return docs.mapInArrow(run, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").cast("long"), "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, training(read(spark, sf_dir, "labels")))
    out = scores(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
