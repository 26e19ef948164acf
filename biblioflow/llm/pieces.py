"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

Texts fall into segments no piece of the vocabulary can span: a run of the space mark with what follows it, cut again
between characters that stand side by side in no piece. The distinct segments of a batch that are not known yet lie in one
flat symbol array; every round looks up the rank of all neighbouring pairs, takes the least of each segment, merges all its
places there at once in all segments (of overlapping ones the leftmost) and compacts, until no pair is left. That is the
order of merges of the sentencepiece library, best score first, then the leftmost, as long as a merge makes no pair of its
own rank or a better one. Which merges might is read from the vocabulary (in public ones those of white space and a few
others); of these only the leftmost place is merged in a round.

Nulls: a null text is empty, with no ids; a null doc_id keeps its row. Repeated rows stay as rows. An empty table gives
an empty result. Extra columns are ignored by ``encode`` and the query.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import read

MARK = "▁"
#: Segments a worker remembers before it starts anew.
KNOWN = 600_000
_NONE = np.int64(1) << 60
#: Texts that a normalizer, had the model one, would change.
_PROBES = ["  a  b ", "ﬁ ½ Ａ①", "e\u0301 é ẛ", "\t\n\r\x0b x\u3000y\u00a0z", "\u200b\ufeff\u00ad", "ｶﾞ", "İIıß", " "]


class Encoder:
    """The merges of one sentencepiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        normal = [i for i in range(self.size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): i for i in normal}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = sorted({m.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        longer = [p for p in self.pieces if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("this model has pieces that go on after a space")
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int64)  # of each code point
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        one = lambda p: self.pieces.get(p, self.size + ord(p) if len(p) == 1 else None)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for p in longer:
            i = self.pieces[p]
            for k in range(1, len(p)):
                a, b = one(p[:k]), one(p[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = (rank[m.get_score(i)], i)
        self.bits = max(10, (4 * len(self.merge)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)  # rank * 2**21 + symbol
        for (a, b), (r, i) in self.merge.items():
            key = a << 21 | b
            at = ((key * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - self.bits)
            while self.keys[at] != -1:
                at = (at + 1) % (1 << self.bits)
            self.keys[at], self.values[at] = key, r << 21 | i
        inner = {c for p in longer for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        cut = f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        # where runs of marks of every length up to some are pieces, all of one score, a long run is taken from its left in such lengths
        runs = {len(p): m.get_score(i) for p, i in self.pieces.items() if len(p) > 1 and not p.strip(MARK)}
        if runs and max(runs) == len(runs) + 1 and len(set(runs.values())) == 1:
            cut = f"{MARK}{{{max(runs)}}}(?={MARK}{{{2 * max(runs)}}})|{cut}"
        self.segments = re.compile(cut).findall
        self.shown = [str(i) for i in range(self.size)]
        self.known: dict[str, bytes] = {}  # the ids of a segment, as 32-bit integers
        self.beside = np.zeros(1 << 20, bool)
        codes = np.array([(ord(a), ord(b)) for p in longer for a, b in zip(p, p[1:])], np.int64).reshape(-1, 2)
        self.beside[self._pair(codes[:, 0], codes[:, 1])] = True
        self.slow = self._disorderly()
        if self.encode(_PROBES) != m.encode(_PROBES):
            raise ValueError("this model normalizes texts in a way that is not built")

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 9) & 0xFFFFF

    def _disorderly(self) -> np.ndarray:
        """Which ranks have a merge of a and b to ab that may open a pair (ab, x) or (x, ab) of its own rank or a better one,
        where there is no pair (b, x) or (x, a) of better rank than ab, which would have been merged before."""
        first: dict[int, list[tuple[int, int]]] = {}
        second: dict[int, list[tuple[int, int]]] = {}
        for (a, b), (r, _) in self.merge.items():
            first.setdefault(a, []).append((b, r))
            second.setdefault(b, []).append((a, r))
        none, slow = (1 << 40, 0), np.zeros(self.size + 1, bool)
        for (a, b), (r, new) in self.merge.items():
            opened = [self.merge.get((b, x), none)[0] for x, q in first.get(new, ()) if q <= r]
            opened += [self.merge.get((x, a), none)[0] for x, q in second.get(new, ()) if q <= r]
            slow[r] |= any(q >= r for q in opened)
        return slow

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank * 2**21 + merged symbol of each pair; _NONE if they don't merge."""
        key = left << 21 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == key, self.values[at], _NONE)
        left_ = np.flatnonzero((have != key) & (have != -1))
        while len(left_):
            at[left_] = (at[left_] + 1) & ((1 << self.bits) - 1)
            have = self.keys[at[left_]]
            hit = have == key[left_]
            out[left_[hit]] = self.values[at[left_[hit]]]
            left_ = left_[~hit & (have != -1)]
        return out

    def merged(self, segments: list[str]) -> tuple[np.ndarray, list[int]]:
        """The symbols that all segments end in, one after the other, and where each ends."""
        text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        owner = np.repeat(np.arange(len(segments)), size)
        wide = text.astype(np.int64)
        cut = np.r_[True, (owner[1:] != owner[:-1]) | ~self.beside[self._pair(wide[:-1], wide[1:])]][: len(text)]
        sym, of, owner = self.symbol[text], np.cumsum(cut) - 1, owner[cut]
        done_sym, done_of = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            if len(sym) > 1:
                rank[:-1] = np.where(of[1:] == of[:-1], self.pairs(sym[:-1], sym[1:]), _NONE)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank >> 21, first)
            over = np.repeat(best == _NONE >> 21, count)
            if over.any():
                done_sym.append(sym[over])
                done_of.append(of[over])
                live = ~over
                sym, of, rank = sym[live], of[live], rank[live]
                count, best = count[best != _NONE >> 21], best[best != _NONE >> 21]
                if not len(sym):
                    break
            at = np.flatnonzero(rank >> 21 == np.repeat(best, count))
            # every other place of a run of overlapping ones; the first of a segment alone where more might be out of order
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            once = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0
            at = at[once & (~self.slow[rank[at] >> 21] | np.r_[True, of[at][1:] != of[at][:-1]])]
            sym[at] = rank[at] & ((1 << 21) - 1)
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, of = sym[keep], of[keep]
        sym, of = np.concatenate(done_sym), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return sym[order], np.cumsum(np.bincount(owner[of], minlength=len(segments))).tolist()

    def packed(self, syms: list[int]) -> bytes:
        ids = [i for x in syms for i in ([x] if x < self.size else [self.bytes[b] for b in chr(x - self.size).encode("utf-8", "surrogatepass")])]
        return np.array(ids, "<i4").tobytes()

    def learn(self, segments: set[str]) -> None:
        if len(self.known) + len(segments) > KNOWN:
            self.known.clear()
        short = [s for s in segments if s]
        if not short:
            return
        sym, ends = self.merged(short)
        raw, starts = sym.astype("<i4").tobytes(), [0, *ends]
        self.known.update((s, raw[4 * a : 4 * b]) for s, a, b in zip(short, starts, ends))
        unknown = np.unique(np.searchsorted(np.array(ends), np.flatnonzero(sym >= self.size), side="right"))
        for k in unknown.tolist():
            self.known[short[k]] = self.packed(sym[starts[k] : ends[k]].tolist())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.segments((MARK + t.replace(" ", MARK)) if t else "") for t in texts]
        every = set(chain.from_iterable(split))
        new = every.difference(self.known)
        if new:
            self.learn(every if len(self.known) + len(new) > KNOWN else new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), "<i4").tolist() for s in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and the text that the model decodes them to."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            ids = e.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(e.model.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode()'s rows as counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for ids in e.encode(batch.column(1).to_pylist()):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(e.shown.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256((e.model.decode(ids) if ids else "").encode("utf-8", "surrogatepass")).hexdigest())
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
