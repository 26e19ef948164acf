"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit verification.

A CGK walk reads a string through random bits shared by all strings (at step j it emits the current character and goes
on to the next one if bit (j, character) says so), which turns edit distance into Hamming distance. Sampling a few
emitted positions gives an LSH key; several walks give the recall. Walks start at every word of every benchmark item with
``ROOM`` characters left and at every word of every document. Each meeting says where the whole item would lie; the
document's window of the item's size there (with room for the edits allowed) is verified by the exact edit distance, in
code points, of the item to the closest substring. A document is contaminated by an item if that distance is at most
(1 - similarity) of its length.

Keys are sampled from the first ``STEPS`` steps of the walk over such a window. At one edit in five characters the walks
of a whole window are soon apart for good (Hamming distance grows with the square of the edits), while some word of
it has only a few characters touched behind it; that is why walks start at every word and not at the item's first alone.
After the first samples of a walk only places that some item shares them with go on, so most places end early.

Texts are compared with A-Z lower-cased and white space taken as one space. The items are a stated query set: they are
held against all documents in blocks of at most ``BLOCK_CHARS`` characters, which tasks index themselves, without a
shuffle. Items that have no word with ``ROOM`` bytes left allow one edit at most, and are searched for as exact phrases.

Nulls: null texts are empty and match nothing; empty items are ignored; a null doc_id keeps its row. Repeated rows give
repeated matches. An empty table on either side gives no match. Extra columns are ignored by ``matches`` and kept by
``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import read, text_blocks, words

STEPS = 24
WALKS = 5
SAMPLED = 12  # positions of each walk
GATE = 5  # of these are looked at first
ROOM = 10  # bytes an item must have left where a walk starts
PLACES = 12  # an item must be met at one word of a window, and at one more for each so many words, up to MEETINGS
MEETINGS = 3
SIMILARITY = 0.8
BLOCK_CHARS = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(7)
_BITS = _RNG.integers(0, 2, (WALKS, STEPS, 256), dtype=np.int32)
_BITS[:, :, 0] = 0  # the end of a text is never passed
_PICKS = [np.sort(_RNG.choice(STEPS, SAMPLED, replace=False)).tolist() for _ in range(WALKS)]
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_GATE_BITS = 22


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space, a zero after the last of each row; with each word's place there, its row, and its number in the row."""
    starts, ends, row = words(buf, off)
    n = len(starts)
    size = ends - starts
    to = np.r_[0, np.cumsum(size + 1)[:-1]] if n else np.zeros(0, np.int64)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
    if n:
        shift = np.repeat(to - starts, size)
        where = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        out[where + shift] = _LOWER[buf[where]]
        last = np.r_[first[1:] - 1, n - 1]
        out[to[last] + size[last]] = 0
    number = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) if n else row
    return out, to, row, number


def walked(text: np.ndarray, at: np.ndarray, walk: int, gate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, gate, key) of a walk from the given places of a normal text; with a gate only those that pass it go on."""
    place, key, picks, which = at.astype(np.int32), np.zeros(len(at), np.uint64), _PICKS[walk], np.arange(len(at))
    first = None
    for step in range(picks[-1] + 1):
        char = text.take(place)
        if step in picks:
            key += char
            key *= _MULTIPLY
            if step == picks[GATE - 1]:
                first = (key >> np.uint64(64 - _GATE_BITS)).astype(np.int64)
                if gate is not None:
                    which = np.flatnonzero(gate.take(first))
                    place, key, char = place[which], key[which], char[which]
        place += _BITS[walk, step].take(char)
    return which, first, key


def edit_distance_within(item: str, text: str) -> int:
    """The least edit distance of item to a substring of text, by bit-parallel columns."""
    if item in text:
        return 0
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        hp = down | ~(xh | up) & full
        hm = up & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = hp << 1 & full
        hm = hm << 1 & full
        up = hm | ~(xv | hp) & full
        down = hp & xv
        if score < best:
            best = score
    return best


def _points(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point that each byte belongs to, and the first byte of each."""
    begins = text & 0xC0 != 0x80
    return np.cumsum(begins) - 1, np.flatnonzero(begins)


def closest(masks: np.ndarray, which: np.ndarray, size: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least edit distance of each pattern to a substring of its text, for many patterns of up to 64 characters at a
    time. masks[which] has a word for each of 256 characters, with a bit for each of its places in the pattern."""
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down, top = np.full(len(size), full), np.zeros(len(size), np.uint64), one << (size - 1).astype(np.uint64)
    score = size.astype(np.int64)
    best, masks, row = score.copy(), masks.ravel(), which.astype(np.int64) << 8
    for j in range(texts.shape[1]):
        eq = masks.take(row + texts[:, j])
        xh = (((eq & up) + up) ^ up) | eq
        hp, hm = down | ~(xh | up), up & xh
        score += ((hp & top) != 0).astype(np.int64) - ((hm & top) != 0)
        np.minimum(best, score, out=best)
        hp, hm, xv = hp << one, hm << one, eq | down
        up, down = hm | ~(xv | hp), hp & xv
    return best


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, rows: list[tuple[int | None, str]], similarity: float):
        self.ids, self.texts, self.goals, self.most = [], [], [], []
        phrases: dict[str, list[int]] = {}
        parts, places, base = [], [], 0
        for item_id, text in rows:
            buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            out, to, _, _ = normal(buf, np.array([0, len(buf)]))
            if not len(to):
                continue
            k, goal = len(self.ids), bytes(out[:-1]).decode("utf-8", "surrogatepass")
            self.ids.append(item_id)
            self.texts.append(bytes(out[:-1]))
            self.goals.append(goal)
            self.most.append(int((1 - similarity) * len(goal) + 1e-9))
            code, _ = _points(out[:-1])
            at = to[to + ROOM <= len(out) - 1]
            if len(at):
                places.append(np.c_[np.full(len(at), k), code[at], at + base])
                parts.append(out)
                base += len(out)
            else:
                phrases.setdefault(goal, []).append(k)
        self.phrases, self.tree = phrases, None
        if phrases:
            import ahocorasick

            self.tree = ahocorasick.Automaton()
            for phrase in phrases:
                self.tree.add_word(f" {phrase} ", phrase)
            self.tree.make_automaton()
        # equal parts of at most 64 code points: if an item is within its edits, some part is within its share of them
        self.size = np.array(list(map(len, self.goals)), np.int64)
        self.parts = -(-self.size // 64)
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        self.tables, self.places = [], np.concatenate(places) if places else np.zeros((0, 3), np.int64)
        self.needed = np.minimum(1 + np.bincount(self.places[:, 0], minlength=len(self.ids)) // PLACES, MEETINGS)
        for walk in range(WALKS if places else 0):
            _, first, key = walked(np.concatenate(parts), self.places[:, 2], walk)
            gate = np.zeros(1 << _GATE_BITS, bool)
            gate[first] = True
            order, full = np.argsort(key, kind="stable"), np.zeros(1 << _GATE_BITS, bool)
            full[(key >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
            self.tables.append((gate, full, key[order], order))

    def candidates(self, text: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(start, item, code point where the item would start) of walks at the given places that meet a walk of an item."""
        out = []
        for walk, (gate, full, index, order) in enumerate(self.tables):
            some, _, key = walked(text, at, walk, gate)
            met = np.flatnonzero(full.take((key >> np.uint64(64 - _GATE_BITS)).astype(np.int64)))
            some, key = some[met], key[met]
            lo, hi = np.searchsorted(index, key, "left"), np.searchsorted(index, key, "right")
            met = np.flatnonzero(hi > lo)
            lo, n, some = lo[met], (hi - lo)[met], some[met]
            which = order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            start = np.repeat(some, n)
            out.append(np.c_[start, self.places[which, 0], code[at[start]] - self.places[which, 1]])
        return np.concatenate(out)

    def windows(self, text: np.ndarray, at: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, from, to): where an item may lie, as a window of its size with room for the edits allowed.

        Starts a few places apart are one window, if the item was met there at as many words as it needs."""
        code, byte = _points(text)
        c = self.candidates(text, at, code)
        if not len(c):
            return []
        # one key for each (item, document, start >> 5), and the word that was met
        part, least = np.searchsorted(begin, c[:, 0], "right") - 1, int(c[:, 2].min()) >> 5
        key = (c[:, 1] * len(begin) + part) * ((len(text) >> 5) + 2 - least) + (c[:, 2] >> 5) - least
        order = np.lexsort((c[:, 0], key))
        key, word, item, part, start = key[order], c[order, 0], c[order, 1], part[order], c[order, 2]
        new = np.r_[True, key[1:] != key[:-1]]
        words = np.cumsum(new | np.r_[True, word[1:] != word[:-1]])
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(key)] - 1
        met = words[last] - words[first] + 1
        near = np.r_[False, key[first][1:] == key[first][:-1] + 1]  # the windows beside count too
        met += np.where(near, np.r_[0, met[:-1]], 0) + np.where(np.r_[near[1:], False], np.r_[met[1:], 0], 0)
        some = met >= self.needed[item[first]]
        first, last = first[some], last[some]
        part, item = part[first], item[first]
        room = np.array(self.most)[item]
        x = np.maximum(code[low[part]], start[first] - room)
        y = np.minimum(code[high[part]], start[last] + self.size[item] + room)
        some = self.close(text, item, start[first], start[last], x, y)
        return list(zip(*(v[some].tolist() for v in (part, item, byte[x], byte[y]))))

    def mask(self, item: int, part: int, begin: int, end: int) -> np.ndarray:
        if (item, part) not in self.masks:
            bits = [0] * 256
            for n, ch in enumerate(self.goals[item][begin:end]):
                bits[ord(ch) & 255] |= 1 << n
            self.masks[item, part] = np.array(bits, np.uint64)
        return self.masks[item, part]

    def close(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, last: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which windows hold some part of their item within its share of the edits (code points are compared by 8 bits)."""
        points = np.frombuffer(bytes(text).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint8)
        found, parts, most = np.zeros(len(item), bool), self.parts[item], np.array(self.most)[item]
        for k in range(int(parts.max(initial=0))):
            open_ = np.flatnonzero((parts > k) & ~found)
            for i in range(0, len(open_), 2048):
                own = open_[i : i + 2048]
                items, which = np.unique(item[own], return_inverse=True)
                cuts = [(self.size[t] * k // self.parts[t], self.size[t] * (k + 1) // self.parts[t]) for t in items]
                masks = np.stack([self.mask(t, k, *c) for t, c in zip(items.tolist(), cuts)])
                cut = np.array(cuts, np.int64)[which]
                begin = np.maximum(x[own], start[own] + cut[:, 0] - most[own])
                end = np.minimum(y[own], last[own] + cut[:, 1] + most[own])
                width = int((end - begin).max())
                # what a shorter window would read beyond its end is read from its last place again
                at = np.minimum(begin[:, None] + np.arange(width), np.maximum(end, begin + 1)[:, None] - 1)
                d = closest(masks, which, cut[:, 1] - cut[:, 0], points[np.minimum(at, len(points) - 1)].astype(np.int64))
                found[own] = d <= most[own] // parts[own]
        return found

    def find(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, distance, similarity), one for each row and item it is contaminated by."""
        text, to, row, _ = normal(buf, off)
        if not len(to):
            return
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        low, high, of = to[begin], np.r_[to[begin[1:]], len(text)] - 1, row[begin]
        best: dict[tuple[int, int], int] = {}
        if self.tables:
            known: dict[tuple[int, bytes], int] = {}
            for p, item, x, y in self.windows(text, to, begin, low, high):
                if best.get((p, item)) != 0:
                    window = bytes(text[x:y])
                    d = known.get((item, window))
                    if d is None:
                        d = known[item, window] = edit_distance_within(self.goals[item], window.decode("utf-8", "surrogatepass"))
                    if d <= self.most[item]:
                        best[p, item] = min(d, best.get((p, item), d))
        if self.tree:
            for p in range(len(begin)):
                whole = f" {bytes(text[low[p] : high[p]]).decode('utf-8', 'surrogatepass')} "
                for _, phrase in self.tree.iter(whole):
                    for item in self.phrases[phrase]:
                        best[p, item] = 0
        for (p, item), d in sorted(best.items()):
            yield int(of[p]), item, d, 1 - d / len(self.goals[item])


_BUILT: dict[str, Items] = {}


def indexed(name: str, rows: list[tuple[int | None, str]], similarity: float) -> Items:
    """The index of a block, built once in a worker, which keeps the last one only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(rows, similarity)
    return _BUILT[name]


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[tuple[str, list[tuple[int | None, str]]]]:
    """The items in blocks of a fixed size, each with a name; what the driver sends to tasks is the texts alone."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= most:
            yield uuid.uuid4().hex, rows
            rows, size = [], 0
    if rows:
        yield uuid.uuid4().hex, rows


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, distance, similarity) of every document and item that contaminates it."""
    schema = "doc_id long, item_id long, distance int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for name, rows in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, name=name, sent=sent):
            items = indexed(name, sent.value, similarity)
            for batch in batches:
                ids, found = batch.column(0), []
                for i, _, buf, off in text_blocks(ids, batch.column(1)):
                    found += [(ids[i + r].as_py(), items.ids[k], d, s) for r, k, d, s in items.find(buf, off)]
                cols = list(zip(*found)) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "distance", "similarity"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the contaminated rows; all columns stay, and nothing is shuffled."""
    at = docs.columns.index("text")
    for name, rows in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, name=name, sent=sent):
            items = indexed(name, sent.value, similarity)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, buf, off in text_blocks(batch.column(0), batch.column(at)):
                    for r, *_ in items.find(buf, off):
                        keep[i + r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
