"""Token ids in files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block of ``BLOCK`` ids begins with the list of its distinct ids; within it an id is its place in that list. Three
models predict the next one: order 2 and order 1 name the id that last followed the two ids, or the one id, before (how
sure they are grows with their hits), and order 0 is a distribution over all ids of the block by how often each has come
so far. Adaptive probabilities, a pair for each state of the two orders together (how sure each is, and whether they name the same
id), mix them: they say how much of the range goes to either order's id; order 0 divides the rest. The range
coder keeps 48 bits and carries. All of it is integer arithmetic (one division is done in doubles, which are exact at
these sizes), so any machine decodes what any other wrote.

Blocks are coded up to ``LANES`` at a time, step by step in numpy arrays; the order-0 distribution is drawn anew at steps
that grow apart by half. Every block starts from nothing, and has its sizes and the CRC32 of its ids beside it,
so a damaged block is known and loses no other.

A file is "IDF3", then groups of (document ids, their id counts, blocks), each with its sizes before it. Documents are
range-partitioned and sorted by doc_id; a file holds one range. It is written under a temporary name and renamed when
whole; the manifest lists the files that count, each with the number of its range, which orders them.

Nulls: a null text is empty, with the end id alone; rows with a null doc_id come first. Rows with equal doc_id come in the
order of a hash of their text, repeated rows one after the other, and may be split over files. An empty table gives no files
and an empty result. Extra columns are ignored. Ids must be below 65536.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioflow.llm.common import new_path, read, text_blocks
from biblioflow.llm.warc import Store

LANES = 4096
BLOCK = 4096
#: Bits of the share that each order's id gets, of the order-0 distribution, and of the table of pairs of ids.
_KIND, _SLOT, _PAIRS = 12, 13, 11
_TOTAL = _KIND + _SLOT
#: What an id's coming adds to its weight of one.
_STEP = 3
#: Blocks whose lists are made at once.
_LISTS = 64
_M48, _LEAST = (1 << 48) - 1, 1 << 32
MANIFEST = "file string, part int, documents long, ids long, bytes long"
#: Files whose ids are summed in one window; the sums of such runs of files are one row each.
_RUN = 4096


class _Model:
    """What all lanes predict; sizes: the number of distinct ids of each."""

    def __init__(self, sizes: np.ndarray, inverse: bool):
        n, total, lane = len(sizes), int(sizes.sum()), np.arange(len(sizes))
        self.sizes, self.inverse, self.next, self.drawn_to = sizes, inverse, 0, 0
        self.base = np.cumsum(sizes) - sizes
        self.counts, self.own = np.ones(total, np.int32), (np.arange(total) - np.repeat(self.base, sizes)).astype(np.uint16)
        # beside an id's part of order 0 lies what last followed it, so that one look finds both
        halves = np.zeros(2 * total, np.int32)
        low = 0 if sys.byteorder == "little" else 1
        self.record, self.drawn, self.after1, self.after2 = halves.view(np.int64), halves[low::2], halves[1 - low :: 2], np.zeros(n << _PAIRS, np.uint16)
        self.share = np.full(n << 5, 0x20002000, np.uint32)
        self.pairs, self.slots, self.sures = lane << _PAIRS, lane << _SLOT, lane << 5
        self.held, self.before = np.zeros((2, n), np.uint16), np.zeros(n, np.uint16)
        self.at1, self.at2 = self.base, self.pairs

    def draw(self, steps: np.ndarray, step: int) -> None:
        """The order-0 distribution of all that came before a step."""
        if step > self.drawn_to:
            self.counts += (_STEP * np.bincount((steps[self.drawn_to : step] + self.base).ravel(), minlength=len(self.counts))).astype(np.int32)
        times = (((1 << _SLOT) - self.sizes) << 15) // np.add.reduceat(self.counts, self.base)
        freq = 1 + (self.counts * np.repeat(times.astype(np.int32), self.sizes) >> 15)
        freq[self.base + self.sizes - 1] += (1 << _SLOT) - np.add.reduceat(freq, self.base)
        start = np.cumsum(freq, dtype=np.int32) - freq & (1 << _SLOT) - 1
        self.drawn[:] = start << _SLOT + 1 | freq
        if self.inverse:
            self.symbol = np.repeat(self.own, freq)
        self.drawn_to, self.next = step, step + max(64, step >> 1)

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bounds of the shares of the order-2 and order-1 ids, and what a slot of order 0 is worth."""
        self.held[0] = self.after2.take(self.at2)
        self.ids, self.sure = self.held >> 2, self.held & 3
        self.at = self.sures + ((self.sure[0] << 3) + (self.sure[1] << 1) + (self.ids[0] == self.ids[1]))
        self.shares = self.share.take(self.at)
        shares = self.shares.astype(np.int64)
        # every share is at least one: those of 16 bits stay in 31 to 65503
        first = shares >> 20
        both = first + (((1 << _KIND) - 1 - first) * (shares & 0xFFFF) >> 16) + 1
        return first << _SLOT, both << _SLOT, (1 << _KIND) - both

    def learn(self, own: np.ndarray, end2: np.ndarray, end1: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the part of the range that each lane's id has; the model goes on to the next step."""
        place, same = self.base + own, self.ids == own
        is2, is1 = same[0], same[1] > same[0]
        # a hit is surer by one, a miss less sure by one, and what is not sure gives way
        held = np.where(same, self.held + (self.sure < 3), np.where(self.sure > 1, self.held - 1, own << 2 | 1))
        self.after2[self.at2], self.after1[self.at1] = held
        self.share[self.at] = self.shares - (self.shares >> 5 & 0x07FF07FF) + is2 * np.uint32(2046 << 16) + is1 * np.uint32(2046)
        record = self.record.take(place)
        self.held[1] = record >> 32
        drawn = record & 0xFFFFFFFF
        begin, size = end1 + rest * (drawn >> _SLOT + 1), rest * (drawn & (1 << _SLOT + 1) - 1)
        named = (is2 | is1).nonzero()[0]
        if len(named):
            two, end = is2[named], end2[named]
            begin[named] = np.where(two, 0, end)
            size[named] = np.where(two, end, end1[named] - end)
        self.at1, self.at2 = place, self.pairs + (own * 40503 + self.before >> 16 - _PAIRS)
        self.before = own * 30011
        return begin, size


def _listed(ids: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of distinct ids of each block, their lists, and the ids as places in them, one column a block.

    A list is written as the gaps between its ids, a byte each; longer gaps follow as 16-bit integers."""
    lanes = -(-len(ids) // BLOCK)
    seen, place = np.zeros(_LISTS << 16, bool), np.zeros(_LISTS << 16, np.uint16)
    sizes, lists, sheet = [], [], np.zeros((lanes, BLOCK), np.uint16)
    for k in range(0, lanes, _LISTS):
        own = ids[k * BLOCK : (k + _LISTS) * BLOCK].astype(np.int32)
        own += (np.arange(len(own), dtype=np.int32) // BLOCK) << 16
        seen[own] = True
        eights = np.flatnonzero(seen.view(np.uint64))
        row, column = seen.reshape(-1, 8)[eights].nonzero()
        known = (eights[row] << 3) + column
        seen[known] = False
        size = np.bincount(known >> 16)
        first = np.cumsum(size) - size
        place[known] = np.arange(len(known)) - np.repeat(first, size)
        sheet[k : k + len(size)].reshape(-1)[: len(own)] = place.take(own)
        gaps = np.diff(known & 0xFFFF, prepend=0)
        gaps[first] = known[first] & 0xFFFF
        short, wide = np.minimum(gaps, 255).astype(np.uint8).tobytes(), gaps >= 255
        large, wide = gaps[wide].astype("<u2").tobytes(), 2 * np.r_[0, np.cumsum(wide)]
        for a, b in zip(first.tolist(), (first + size).tolist()):
            lists.append(short[a:b] + large[wide[a] : wide[b]])
        sizes.append(size)
    sizes = np.concatenate(sizes)
    # the last block is filled up with its first id, which is coded and dropped again
    return sizes, lists, np.ascontiguousarray(sheet[:, : BLOCK if lanes > 1 else len(ids)].T)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Up to LANES * BLOCK ids as blocks: count and lanes; CRC32, bytes, coded words and distinct ids of each; the blocks."""
    count = len(ids)
    if not count:
        return struct.pack("<II", 0, 0)
    if int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    sizes, lists, steps = _listed(ids)
    lanes = len(sizes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _M48, np.int64)
    out = np.zeros((2 * BLOCK + 8) * lanes, np.uint32)  # a row for each word of all lanes: lanes go on at about the same rate
    at, model = np.arange(lanes), _Model(sizes, False)
    for step in range(len(steps)):
        if step == model.next or not step:
            model.draw(steps, step)
        begin, size = model.learn(steps[step], *model.look())
        part = span >> _TOTAL
        low += part * begin
        span = part * size
        over = (low > _M48).nonzero()[0]
        if len(over):  # a word may hold a carry until all is written
            low[over] &= _M48
            out[at[over] - lanes] += np.uint32(1)
        small = (span < _LEAST).nonzero()[0]
        while len(small):
            where, bits, wide = at[small], low[small], span[small] << 16
            out[where] = bits >> 32
            at[small] = where + lanes
            low[small], span[small] = (bits << 16) & _M48, wide
            small = small[wide < _LEAST]
    for shift in (32, 16, 0):
        out[at] = (low >> shift) & 0xFFFF
        at += lanes
    used = at // lanes
    out = out[: int(used.max()) * lanes]
    carry = np.flatnonzero(out > 0xFFFF)
    while len(carry):
        out[carry] &= np.uint32(0xFFFF)
        carry -= lanes
        out[carry] += np.uint32(1)
        carry = carry[out[carry] > 0xFFFF]
    out = np.ascontiguousarray(out.astype("<u2").reshape(-1, lanes).T)
    blocks = [known + row[:n].tobytes() for known, row, n in zip(lists, out, used.tolist())]
    crcs = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, count, BLOCK)]
    heads = [np.array(x, "<u4").tobytes() for x in (crcs, list(map(len, blocks)), used, sizes)]
    return b"".join([struct.pack("<II", count, lanes), *heads, *blocks])


def decode_blocks(data: bytes) -> np.ndarray:
    count, lanes = struct.unpack_from("<II", data)
    if not count:
        return np.zeros(0, np.uint32)
    if lanes != -(-count // BLOCK):
        raise ValueError("damaged block header")
    crcs, size, used, sizes = np.frombuffer(data, "<u4", 4 * lanes, 8).reshape(4, lanes).astype(np.int64)
    ends = 8 + 16 * lanes + np.cumsum(size)
    lists, words = [], np.zeros((lanes, int(used.max()) + 1), np.uint16)
    for k, b in enumerate(ends.tolist()):
        block = data[b - int(size[k]) : b]
        gaps = np.frombuffer(block, np.uint8, int(sizes[k])).astype(np.int64)
        wide = np.flatnonzero(gaps == 255)
        if len(block) != len(gaps) + 2 * (len(wide) + int(used[k])):
            raise ValueError(f"block {k} is damaged")
        gaps[wide] = np.frombuffer(block, "<u2", len(wide), len(gaps))
        lists.append(np.cumsum(gaps))
        words[k, : int(used[k])] = np.frombuffer(block, "<u2", int(used[k]), len(gaps) + 2 * len(wide))
    words = np.ascontiguousarray(words.T)
    code = words[0].astype(np.int64) << 32 | words[1].astype(np.int64) << 16 | words[2]
    words, at = words.ravel(), np.arange(lanes) + 3 * lanes
    span, steps, model = np.full(lanes, _M48, np.int64), np.zeros((BLOCK if lanes > 1 else count, lanes), np.uint16), _Model(sizes, True)
    for step in range(len(steps)):
        if step == model.next or not step:
            model.draw(steps, step)
        end2, end1, rest = model.look()
        part = span >> _TOTAL
        # quotients are below 2**26 and dividends below 2**48, so the doubles' floors are exact
        value = np.minimum((code / part).astype(np.int64), (1 << _TOTAL) - 1)
        slot = (np.maximum(value - end1, 0) / rest).astype(np.int64) + model.slots
        own = np.where(value < end1, np.where(value < end2, model.ids[0], model.ids[1]), model.symbol.take(slot))
        begin, size = model.learn(own, end2, end1, rest)
        steps[step] = own
        code -= part * begin
        span = part * size
        small = (span < _LEAST).nonzero()[0]
        while len(small):
            where, wide = at[small], span[small] << 16
            code[small] = code[small] << 16 | words.take(where, mode="clip")
            at[small], span[small] = where + lanes, wide
            small = small[wide < _LEAST]
    ids = np.zeros(lanes * BLOCK, "<u4")
    for k, (known, own) in enumerate(zip(lists, np.ascontiguousarray(steps.T))):
        ids[k * BLOCK : k * BLOCK + len(own)] = known[own]
        if zlib.crc32(ids[k * BLOCK : min(count, (k + 1) * BLOCK)].tobytes()) != crcs[k]:
            raise ValueError(f"block {k} is damaged")
    return ids[:count]


class WordIds:
    """Encodes by the tokenizers library and remembers what each unit of text gave.

    A unit is a run of letters, digits or other marks; apostrophes, bars and all that is not ASCII stay with what they touch.
    The library's normalizer, its pattern and its added tokens never look past a unit, so the ids of a text are those of its
    units. Units are cut and counted in arrays, and only those not yet known are encoded. One of printable Latin letters and marks is lower-cased
    and cut by the tokenizer's own pattern, and its words are given to the library's BPE model. Others go through the whole library,
    as all do if the tokenizer's parts are not those this rests on, or the two ways differ on any single character."""

    #: Units remembered from block to block.
    KNOWN = 1_000_000
    #: UTF-8 bytes of the texts encoded at once, and of those cut at once.
    BLOCK_BYTES, CUT_BYTES = 16 << 20, 1 << 20
    #: Words given to the library at once.
    WORDS = 8192
    SPACE = r"\t\n\x0b\x0c\r\x20"
    OTHER = re.compile(rf"[^!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f\u2010-\u2027\u20ac{SPACE}]|<\|")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.mark = self.tokenizer.encode("\x00", add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("this vocabulary has no id of its own for the separator")
        parts = json.loads(self.tokenizer.to_str())
        before = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.latin = (
            before == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and parts["post_processor"] is None
            and parts["model"].get("end_of_word_suffix") == "</w>" and all(re.fullmatch(r"<\|[A-Za-z]+\|>", x["content"]) for x in parts["added_tokens"])
        )
        if self.latin:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            self.last = np.zeros(1 + max(parts["model"]["vocab"].values()), bool)
            self.last[[i for x, i in parts["model"]["vocab"].items() if x.endswith("</w>")]] = True
            every = [chr(c) for c in range(0x2100) if not self.OTHER.match(chr(c))]
            kinds = {k: "".join(re.escape(c) for c in every if unicodedata.category(c)[0] == k) for k in "LN"}
            pattern = cuts[0]["pattern"]["Regex"].replace(r"\s", self.SPACE)
            for k, c in kinds.items():
                pattern = pattern.replace(rf"[\p{{{k}}}]", f"[{c}]").replace(rf"\p{{{k}}}", c)
            self.cut = re.compile(pattern).findall
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
            others = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
            self.letters = "".join(chr(32 if b == 32 else others.get(b, b)) for b in range(256))  # no word holds a space
            tries = [*every, *(f"a{c}B1" for c in every), *(f"{c}'s{c}" for c in every)]
            self.latin = self.of_latin(tries) == [self.ids(x) for x in tries]
        # parts that are not known are cut at spaces and line feeds alone
        self.spaces = b" \t\n\x0b\x0c\r" if self.latin else b" \n"
        self.kinds = _KINDS if self.latin else np.where(np.isin(np.arange(256), list(self.spaces)), _SPACE, np.uint8(7))

    def forget(self) -> None:
        self.known, self.known_ids = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of the pattern; the id of a word's end is none of those before it."""
        found = {}
        for i in range(0, len(words), self.WORDS):
            some = words[i : i + self.WORDS]
            shown = codecs.charmap_decode(" ".join(some).encode(), "strict", self.letters)[0]
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the ends of words are not unique")
            raw, b = ids.tobytes(), (4 * ends).tolist()
            found.update((w, raw[x:y]) for w, x, y in zip(some, [0, *b], b))
        return found

    def of_latin(self, units: list[str]) -> list[bytes]:
        words = [[u] if u.isascii() and u.isalpha() else self.cut(u) for u in map(str.lower, units)]
        found = self.of_words(list({w for x in words for w in x}))
        return [found[x[0]] if len(x) == 1 else b"".join([found[w] for w in x]) for x in words]

    def of_others(self, units: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for i in range(0, len(units), 4096):
            some = units[i : i + 4096]
            if any("\x00" in u for u in some):
                found += map(self.ids, some)
                continue
            ids = np.frombuffer(self.ids(" \x00 ".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some) - 1:
                raise ValueError("the separator is not unique")
            raw, starts, ends = ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            found += [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]
        return found

    def learn(self, units: list[str]) -> list[bytes]:
        latin = [self.latin and (u.isascii() and u.isalpha() or not self.OTHER.search(u)) for u in units]
        own = iter(self.of_latin([u for u, x in zip(units, latin) if x]) if any(latin) else ())
        others = iter(self.of_others([u for u, x in zip(units, latin) if not x]))
        return [next(own if x else others) for x in latin]

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of some texts one after the other, and how many there are before the end of each text."""
        data, sizes, ends, before = [], [], [], 0
        for _, _, buf, off in text_blocks(None, texts, self.CUT_BYTES):
            kind = self.kinds[buf]
            cut = np.ones(len(buf) + 1, bool)
            cut[1:-1] = kind[1:] & kind[:-1] == 0
            cut[off] = True
            at = np.flatnonzero(cut)
            word = kind[at[:-1]] != _SPACE
            sizes.append(np.diff(at)[word].astype(np.int32))
            seen = np.r_[0, np.cumsum(word)]
            ends.append(before + seen[np.searchsorted(at, off[1:])])
            before += len(sizes[-1])
            raw = buf.tobytes()
            if self.latin and b"<|" not in raw:
                # not before what may be a combining mark: only small letters have composed forms with some
                capital = (buf - np.uint8(65) < 26) & (np.r_[buf[1:], np.uint8(0)] < 128)
                raw = (buf | capital.view(np.uint8) << np.uint8(5)).tobytes()
            data.append(raw.translate(None, self.spaces))
        offs = np.zeros(before + 1, np.int64)
        np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int32)]), out=offs[1:])
        found = pa.Array.from_buffers(pa.large_binary(), before, [None, pa.py_buffer(offs), pa.py_buffer(b"".join(data))])
        return found, np.concatenate(ends or [np.zeros(0, np.int64)])

    def flat(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and how many each has."""
        units, ends = self.units(texts)
        coded = units.dictionary_encode()
        own, there = coded.dictionary, pc.index_in(coded.dictionary, value_set=self.known)
        new = own.filter(there.is_null())
        own_ids = pa.array(self.learn([u.decode() for u in new.to_pylist()]), pa.large_binary())
        place = there.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.where(place < 0, len(self.known) - 1 + np.cumsum(place < 0), place)
        every, ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.known_ids, own_ids])
        del units
        found = ids.take(pa.array(place).take(coded.indices))
        if len(every) > self.KNOWN:  # what this block had is what the next will have most of
            every, ids = own, ids.take(pa.array(place))
        self.known, self.known_ids = every, ids
        _, offs, data = found.buffers()
        ends = np.frombuffer(offs, np.int64, len(found) + 1)[ends] >> 2
        flat = np.frombuffer(data, "<u4", int(ends[-1]) if len(ends) else 0) if data is not None else np.zeros(0, "<u4")
        return np.insert(flat, ends, np.uint32(end)), np.diff(ends, prepend=0) + 1

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        ids, counts = self.flat(pa.array(texts, pa.large_string()), end)
        return np.split(ids, np.cumsum(counts)[:-1])


#: Kinds of bytes: two neighbours of kinds with no bit in common are cut apart.
_SPACE = np.uint8(8)
_KINDS = np.full(256, 4, np.uint8)
_KINDS[[ord("'"), ord("|"), *range(128, 256)]] = 7
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[48:58] = 2
_KINDS[[0x20, 9, 10, 11, 12, 13]] = _SPACE


_TOKENIZERS: dict[str, WordIds] = {}


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, range_bytes: int = 32 << 20) -> DataFrame:
    """Writes the ids of all texts, each with the end id, in ascending doc_id order; returns the manifest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(1, -(-total // range_bytes)))
    # rows of equal doc_id and text are alike, so that any of them may go to either of two files
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split(" ")[0] for x in MANIFEST.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordIds(tokenizer)
        store, file, name = Store(folder), None, f"{uuid.uuid4().hex}.ids"
        docs_, total_, size, keys, counts, lists, held, texts, waiting = 0, 0, 0, [], [], [], 0, [], 0

        def encode() -> None:
            nonlocal docs_, total_, held, waiting
            ids, n = _TOKENIZERS[tokenizer].flat(pa.concat_arrays(texts), end)
            lists.append(ids.astype(np.uint16) if len(ids) and int(ids.max()) < 1 << 16 else ids)
            counts.append(n)
            docs_, total_, held, waiting = docs_ + len(n), total_ + len(ids), held + len(ids), 0
            texts.clear()

        def flush() -> None:
            nonlocal held, size
            ids = np.concatenate(lists)
            lists.clear()
            group = LANES * BLOCK
            done = [encode_blocks(ids[a : a + group]) for a in range(0, len(ids), group)]
            doc_ids = pa.concat_arrays(keys)
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            head = doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + known + np.concatenate(counts).astype("<u4").tobytes()
            body = b"".join(struct.pack("<I", len(d)) + d for d in done)
            chunk = struct.pack("<IIQ", len(doc_ids), len(done), len(body)) + head + body
            file.write(chunk)
            size, held = size + len(chunk), 0
            keys.clear()
            counts.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                file = store.create(f".{name}.tmp")
                file.write(b"IDF3")
            keys.append(batch.column(0))
            texts.append(batch.column(1).cast(pa.large_string()))
            waiting += texts[-1].nbytes
            if waiting >= WordIds.BLOCK_BYTES:
                encode()
            if held >= LANES * BLOCK:
                flush()
        if file is None:
            return
        if texts:
            encode()
        if keys:
            flush()
        file.close()
        store.commit(f".{name}.tmp", name)
        row = (name, TaskContext.get().partitionId(), docs_, total_, size + 4)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def documents(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file, in its order."""
    if stream.read(4) != b"IDF3":
        raise ValueError("not a file of ids")
    while head := stream.read(16):
        n, groups, _ = struct.unpack("<IIQ", head)
        keys = np.frombuffer(stream.read(8 * n), "<i8").tolist()
        known = stream.read(n)
        ends = np.cumsum(np.frombuffer(stream.read(4 * n), "<u4").astype(np.int64))
        parts = [decode_blocks(stream.read(struct.unpack("<I", stream.read(4))[0])) for _ in range(groups)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        for k, (key, b) in enumerate(zip(keys, ends.tolist())):
            yield key if known[k] else None, ids[int(ends[k - 1]) if k else 0 : b]


def starts(manifest: DataFrame) -> DataFrame:
    """(file, start): the number of ids in the files of all ranges before a file's, summed in runs of files."""
    files = manifest.select("file", "part", "ids", F.floor(F.col("part") / _RUN).alias("run"))
    sums = files.groupBy("run").agg(F.sum("ids").alias("ids"))
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("run", earlier(Window.orderBy("run")).alias("before"))
    inside = files.select("file", "run", earlier(Window.partitionBy("run").orderBy("part")).alias("inside"))
    return inside.join(before, "run").select("file", (F.col("inside") + F.col("before")).alias("start"))


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files that a manifest lists."""

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                with store.open(name) as stream:
                    for key, ids in documents(stream):
                        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts(manifest).repartition(max(1, manifest.count()), F.xxhash64("file"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "ids")
    manifest = write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_back(manifest, folder)
