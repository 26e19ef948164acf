"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprints of 64 bits take a majority vote of XXH64 over word shingles. Two fingerprints within ``max_bits`` of
each other must lie within t_i of each other in some part i of the bits, whenever the thresholds t_i (-1: part
unused) add up to max_bits - parts + 1. So each fingerprint is filed once under its bits of every part and looked up
under all keys within t_i of it, and each pair met is verified on all bits: no link is lost, whatever the plan.

The plan only decides the cost. Correlated bits are grouped into the same part, and the thresholds are allocated by
dynamic programming over the probes they cost and the candidate pairs they are estimated to meet (from a bounded
sample). Equal fingerprints are one node. Before all pairs are met, ever denser leader samples are linked and
merged, and later rounds only meet nodes of different groups, so a large group of near copies gives about as many
links as it has members, times a constant, and not the square.

The pipeline's stage asks for the Jaccard similarity of the shingle sets itself, at which a sixth to a seventh of all bits differ. Its
fingerprints have four words, and tables by a few bits each name the pairs, whose exact similarity is then computed. Within a table's
group finer tables and the comparison of all bits run in arrays, so a fingerprint is shuffled once a table, whatever the input's size.
Fingerprints name nearly all pairs, and a last round names the rest: two sets of that similarity share one of the first shingles of both,
in one order of all shingles (a fifth of a set and one more, rare ones first), so sets that share none need no comparison.

Nulls: a null text counts as empty (fingerprint zero, linked like any other); a null doc_id keeps its row and gets
the component of its fingerprint, which is the least doc_id that is not null, and null if there is none. Repeated rows
stay as rows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import mix, read, saved
from biblioflow.llm.graph import components
from biblioflow.llm.repeats import bloom, holds

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Fingerprints that the plan is estimated from.
PLAN_SAMPLE = 2048
#: A probe is a shuffled row; a candidate pair is compared in the join and costs a tenth of that.
PROBE_COST = 10
#: One in so many fingerprints leads in each round; the last round has all.
LEADERS = (4096, 64, 1)
#: The pipeline's stage: the least Jaccard similarity of near copies, as a fraction.
SHARE = (4, 5)
#: Words of its fingerprints, the bits that may differ in a pair that is held against its sets, and in the first two words.
WORDS, APART, HALF = 4, 64, 44
#: Tables of fingerprints, each by so many bits of the first two words; runs of about RUN rows in these by bits of the other two.
TABLES, FILED, RUN = 16, 6, 256
#: The rounds before the last: tables of each, and the first rows of a run that the others are held against.
FIRST_TABLES, FIRST_ROWS, FIRST_ROUNDS = 4, 16, 3
#: The share of bits that are alike at a similarity of SHARE, in sets of one size.
_AGREE = 1 - math.acos(8 / 9) / math.pi
#: One in so many texts is read for the shingles that go last in the order of all; of those that so many of its sets hold, so many at most.
COMMON_SAMPLE, COMMON_SETS, COMMON = 64, 3, 1 << 16
#: Words of the parity sketch that is held beside each set.
PARITY = 8
_WIDE, _ODD = [f"f{k}" for k in range(WORDS)], [f"o{k}" for k in range(PARITY)]
_TIMES, _PLUS = np.random.default_rng(11).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 1500:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_bytes(text: str | None, k: int) -> list[bytes]:
    """Space-joined runs of k lower-cased words; fewer words: the whole sequence; none: no shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    m = max(1, len(w) - k + 1)
    return [joined[a:b] for a, b in zip(starts[:m].tolist(), ends[min(k, len(w)) - 1 :].tolist())]


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, f0, f1, ...) with one 64-bit fingerprint (as a signed long) for each seed."""
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = [[] for _ in seeds]
            for text in batch.column(1).to_pylist():
                pieces = shingle_bytes(text, shingle)
                for to, seed in zip(out, seeds):
                    to.append(majority(np.fromiter((digest(p, seed) for p in pieces), np.uint64, len(pieces))))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the columns of a sample into parts of even width, correlated ones together."""
    width = bits.shape[1]
    spread = bits - bits.mean(0)
    norm = np.sqrt((spread**2).sum(0))
    norm[norm == 0] = 1
    like = np.abs((spread / norm).T @ (spread / norm))
    free, out = list(range(width)), []
    for p in range(parts):
        size = (width - sum(map(len, out))) // (parts - p)
        part = [free.pop(0)]
        while len(part) < size:
            best = max(free, key=lambda b: (like[b, part].mean(), -b))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each part, that add up to total at the least summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (sum_, chosen) in best.items():
            for t, c in part.items():
                if (now := sum_ + c) < step.get(have + t, (math.inf, []))[0]:
                    step[have + t] = (now, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def plan(sample: np.ndarray, count: int, max_bits: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) of each part that is probed, at the least estimated cost over 1 to max_bits + 1 parts."""
    if len(sample) < 2:
        sample = np.arange(2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    pairs, found = count * (count - 1) / 2, (math.inf, [])
    for parts in range(2, max_bits + 2):
        groups, costs, total = group_bits(bits, parts), [], max_bits - parts + 1
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            own = sample & mask
            near = np.zeros(len(group) + 1)
            for i in range(0, len(own), 256):
                near += np.bincount(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]).ravel(), minlength=len(group) + 1)
            near[0] -= len(own)
            seen = np.maximum(near / 2, 0).cumsum() / (len(own) * (len(own) - 1) / 2)
            even = np.array([ball(len(group), t) for t in range(len(group) + 1)]) / 2.0 ** len(group)
            rate = np.maximum(seen, even)
            costs.append({-1: 0.0} | {t: PROBE_COST * count * (1 + ball(len(group), t)) + pairs * rate[t] for t in range(min(3, len(group)) + 1)})
        price, chosen = allocate(costs, total)
        if price < found[0]:
            found = (price, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    out = []
    for group, t in found[1]:
        flips = [sum(1 << b for b in c) for r in range(t + 1) for c in itertools.combinations(group, r)]
        out.append((sum(1 << b for b in group), flips))
    return out


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _number(x: int) -> str:
    return f"{_long(x)}L" if _long(x) != -(1 << 63) else "(-9223372036854775807L - 1L)"


def _probe(nodes: DataFrame, parts: list[tuple[int, list[int]]], leaders: int, near: Column) -> DataFrame:
    """Pairs of group labels that some verified pair of fingerprints of two groups links. All parts are probed in one join."""
    left = nodes if leaders == 1 else nodes.where(F.pmod(F.xxhash64("f0"), F.lit(leaders)) == 0)
    ways = [f"named_struct('part',{k},'mask',{_number(m)},'flip',{_number(f)})" for k, (m, flips) in enumerate(parts) for f in flips]
    filed = [f"named_struct('part',{k},'mask',{_number(m)})" for k, (m, _) in enumerate(parts)]
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns], F.explode(F.expr(f"array({','.join(ways)})")).alias("way"))
    a = a.select("*", F.col("way.part").alias("part"), F.col("a_f0").bitwiseAND(F.col("way.mask")).bitwiseXOR(F.col("way.flip")).alias("key")).drop("way")
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns], F.explode(F.expr(f"array({','.join(filed)})")).alias("way"))
    b = b.select("*", F.col("way.part").alias("part"), F.col("b_f0").bitwiseAND(F.col("way.mask")).alias("key")).drop("way")
    apart = F.col("a_f0").bitwiseXOR(F.col("b_f0"))
    # with all nodes on both sides a pair is met both ways, and one way is enough
    new = near & (F.col("a_label") < F.col("b_label") if leaders == 1 else F.col("a_label") != F.col("b_label"))
    for k, (mask, flips) in enumerate(parts[:-1]):  # met in an earlier part already
        radius = max(f.bit_count() for f in flips)
        new &= (F.col("part") <= k) | (F.bit_count(apart.bitwiseAND(F.lit(_long(mask)))) > radius)
    return a.join(b, ["part", "key"]).where(new).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def near_groups(prints: DataFrame, max_bits: int = 4, check: tuple[str, int] | None = None, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """Distinct fingerprints of (doc_id, f0[, f1]) -> (f0[, f1], label): label is the least doc_id that links of at most
    max_bits differing bits of f0 reach, or null if all of theirs are null. check=("f1", n) also asks for at most n differing
    bits in f0 and f1 together."""
    own = [c for c in prints.columns if c != "doc_id"]
    # while groups grow they go by a fingerprint of theirs, which is never null
    name = F.col("f0") if own == ["f0"] else F.xxhash64(*own)
    first = saved(prints.groupBy(*own).agg(F.min("doc_id").alias("first")).withColumn("label", name), "nodes")
    nodes = first.select(*own, "label")
    count = nodes.count()
    sample = np.array([r[0] for r in nodes.select("f0").orderBy(F.xxhash64("f0"), "f0").limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, count, max_bits)
    apart = F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0")))
    near = apart <= max_bits
    if check:
        near &= apart + F.bit_count(F.col(f"a_{check[0]}").bitwiseXOR(F.col(f"b_{check[0]}"))) <= check[1]
    for every in leaders:
        links = saved(_probe(nodes, parts, every, near), "links")
        if links.isEmpty():
            continue
        merged = components(links).withColumnRenamed("id", "label")
        nodes = saved(nodes.join(merged, "label", "left").select(*own, F.coalesce("component", "label").alias("label")), "nodes")
    both = saved(nodes.join(first.drop("label"), own), "nodes")
    least = saved(both.groupBy("label").agg(F.min("first").alias("least")), "least")
    return both.join(least, "label").select(*own, F.col("least").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    groups = near_groups(prints, max_bits)
    return prints.join(groups, "f0").select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("label").alias("component_id")
    )


def wide_print(own: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set of shingle hashes in WORDS words of 64 bits, each from hash functions of its own."""
    return np.array([majority(mix(own * t + p)) for t, p in zip(_TIMES, _PLUS)], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    pieces = shingle_bytes(text, shingle)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in pieces), np.uint64, len(pieces)))


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each class of shingle hashes: whether the set has an odd number of them. The bits in which two sets' sketches
    differ are never more than the shingles that only one of them has."""
    odd = np.bincount((mix(own) >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _set_id(own: np.ndarray) -> int:
    return _long(xxhash.xxh3_64_intdigest(own.tobytes()))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingle hashes that many texts of a sample hold. They only go last in an order that loses no pair, whatever it is."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["token"])

    some = docs.select("text").where(F.pmod(_text_hash(), F.lit(COMMON_SAMPLE)) == 0).distinct().mapInArrow(run, "token long")
    often = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_SETS).orderBy(F.desc("n"), "token").limit(COMMON)
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def first_shingles(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all. Sets with a similarity of SHARE have that share of either set in common, and so
    one of what is left and one more."""
    times, of = SHARE
    late = np.zeros(len(own), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    return own[np.lexsort((mix(own), late))[: len(own) - -(-times * len(own) // of) + 1]]


def wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, other, id, n, f0, ..., o0, ..., rare) of every row: hashes of the text and of the other columns, then a hash of the
    text's shingle set, the set's size, the words of its fingerprint, its parities and its first shingles."""
    names = ["id", "n", *_WIDE, *_ODD]
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(3).to_pylist()]
            bits = np.array([np.r_[wide_print(x).view(np.int64), parities(x)] for x in sets], np.int64).reshape(len(sets), WORDS + PARITY)
            cols = [pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, bits.T.copy())]
            rare = pa.array([first_shingles(x, sent.value).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols, rare], ["doc_id", "mark", "other", *names, "rare"])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "mark", "other", *names)) + ", rare array<long>"
    return docs.select(*_identity(docs), "text").mapInArrow(run, schema)


def _identity(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id, and hashes of the text and of the other columns (maps, which have no hash, left out)."""
    other = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    return [F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("mark"), (F.xxhash64(*other) if other else F.lit(0).cast("long")).alias("other")]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, own) of the texts whose hash is wanted, and of a few others: the distinct shingle hashes. Texts that a Bloom filter of the
    wanted ones does not hold are not shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("hash").alias("key")), 1 << 24))

    def held(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(sent.value, batch.column(1).to_numpy())))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            cols = [pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "own"])

    some = docs.select("text", _text_hash().alias("hash")).mapInArrow(held, "text string, hash long").dropDuplicates(["hash"])
    return some.select("text").mapInArrow(run, "id long, own array<long>").dropDuplicates(["id"])


class _Group:
    """Rows that one table files together, by ascending id, and the pairs of them that may be near copies."""

    def __init__(self, rows: dict[str, np.ndarray], table: int):
        self.table = table
        self.id, self.n, self.label = rows["id"], rows["n"], rows["label"]
        self.words, self.odd = [rows[c].view(np.uint64) for c in _WIDE], [rows[c].view(np.uint64) for c in _ODD]

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, differing bits) of the pairs whose fingerprints differ in APART bits at most, unless sizes or parities rule out a
        similarity of SHARE: that leaves at most a ninth of both sizes together on one side alone, and parities differ in no more."""
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in self.words)
        some = (apart <= APART) & (self.label[i] != self.label[j])
        i, j, apart, (times, of) = i[some], j[some], apart[some], SHARE
        n, m = self.n[i], self.n[j]
        alone = sum((np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in self.odd), np.zeros(len(i), np.int64))
        some = (of * np.minimum(n, m) >= times * np.maximum(n, m)) & ((of + times) * alone <= (of - times) * (n + m))
        return i[some], j[some], apart[some]

    def runs(self, fine: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by that many more bits of their fingerprints, others in each table, the longest runs first, and the runs' lengths."""
        masks = np.zeros(128, np.uint64)
        masks[np.random.default_rng((self.table, fine)).permutation(128)[:bits]] = 1
        low, high = ((masks[k : k + 64] << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64) for k in (0, 64))
        key = mix((self.words[-2] & low) * _TIMES[0] + mix((self.words[-1] & high) + _PLUS[0]))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        length = np.diff(np.r_[start, len(key)])
        by = np.argsort(-length, kind="stable")
        length, start = length[by], start[by]
        return order[np.repeat(start - np.cumsum(length) + length, length) + np.arange(len(key))], length

    def fine_tables(self) -> tuple[int, int]:
        """Tables and bits that split the group into runs of about RUN rows."""
        bits = max(0, math.ceil(math.log2(len(self.id) / RUN)))
        return (1 if not bits else math.ceil(math.log(0.15) / math.log1p(-(_AGREE**bits)))), bits

    def to_leaders(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each row with the nearest of the first rows of its run."""
        order, length = self.runs(0, self.fine_tables()[1])
        start, place = np.repeat(np.cumsum(length) - length, length), np.arange(len(order))
        found = []
        for k in range(FIRST_ROWS):
            at = np.flatnonzero(place - start > k)
            found.append(self.near(order[start[at] + k], order[at]))
        i, j, apart = map(np.concatenate, zip(*found))
        by = np.lexsort((i, apart, j))
        by = by[np.r_[True, j[by][1:] != j[by][:-1]]] if len(by) else by
        yield i[by], j[by], apart[by]

    def all_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of each run of each finer table; in a long run most of which has one label, all that are not within it."""
        tables, bits = self.fine_tables()
        for fine in range(tables):
            order, length = self.runs(fine, bits)
            ends, long_ = np.cumsum(length), 0
            for m in length[length > 4 * RUN].tolist():
                own = order[ends[long_] - m : ends[long_]]
                labels, place, count = np.unique(self.label[own], return_inverse=True, return_counts=True)
                if 2 * count.max() < m:
                    break
                for k in own[place != count.argmax()].tolist():
                    yield self.near(np.minimum(own, k), np.maximum(own, k))
                long_ += 1
            order, length = order[ends[long_ - 1] if long_ else 0 :], length[long_:]
            run, ends = np.repeat(np.arange(len(length)), length), np.cumsum(length)
            a, b, label = self.words[0][order], self.words[1][order], self.label[order]
            for d in range(1, int(length.max()) if len(length) else 1):
                m = ends[np.searchsorted(-length, -d) - 1]  # rows of runs longer than d
                apart = np.bitwise_count(a[d:m] ^ a[: m - d]) + np.bitwise_count(b[d:m] ^ b[: m - d])
                at = np.flatnonzero((apart <= HALF) & (run[d:m] == run[: m - d]) & (label[d:m] != label[: m - d]))
                if len(at):
                    yield self.near(order[at], order[at + d])


def _met(nodes: DataFrame, tables: range, leaders: bool) -> DataFrame:
    """(a, b, apart): pairs of ids of different labels, the greater first, that some of the tables files together and that may be near copies."""
    cols = ["id", "n", "label", *_WIDE, *_ODD]
    each = 64 // FILED
    keys = [F.shiftrightunsigned(_WIDE[t // each], t % each * FILED).bitwiseAND((1 << FILED) - 1) + F.lit(t << FILED) for t in tables]
    filed = nodes.select(*cols, F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key", "id")

    def pairs(rows: list[list[np.ndarray]], key: int) -> Iterator[pa.RecordBatch]:
        own = _Group(dict(zip(cols, map(np.concatenate, zip(*rows)))), int(key) >> FILED)
        for i, j, apart in own.to_leaders() if leaders else own.all_pairs():
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(own.id[j]), pa.array(own.id[i]), pa.array(apart)], ["a", "b", "apart"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not len(now[-1]):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(now[-1])) + 1).tolist(), len(now[-1])]
            for a, b in zip(cuts, cuts[1:]):
                if held and now[-1][a] != key:
                    yield from pairs(held, key)
                    held = []
                key = now[-1][a]
                held.append([c[a:b] for c in now[:-1]])
        if held:
            yield from pairs(held, key)

    return filed.select(*cols, "key").mapInArrow(run, "a long, b long, apart long")


def _whole_groups(batches) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, cut between its values only."""
    held = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        held.append(now)
        if now[0][0] != now[0][-1]:
            rows = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield [c[:cut] for c in rows]
            held = [[c[cut:] for c in rows]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _sharing(nodes: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b): all pairs of ids of different labels, the greater first, that share one of their first shingles, unless sizes, the places of
    that shingle or parities rule out a similarity of SHARE."""
    times, of = SHARE

    def several(batches):
        for token, id_, label, place in _whole_groups(batches):
            start = _starts(token)
            some = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
            some = np.repeat(some, np.diff(np.r_[start, len(token)]))
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, id_, place)], ["token", "id", "place"])

    def pairs(batches):
        for token, n, id_, place, label, *odd in _whole_groups(batches):
            odd, start = [w.view(np.uint64) for w in odd], _starts(token)
            ends = np.repeat(np.r_[start[1:], len(token)], np.diff(np.r_[start, len(token)]))
            i, d = np.arange(len(token)), 0
            while len(i):
                d += 1
                i = i[i + d < ends[i]]
                i = i[of * n[i] >= times * n[i + d]]  # sizes ascend: what is too large for a set stays so
                j = i + d
                # at the first shingle that both have, what comes from there on holds all they have in common
                most = np.minimum(n[i] - place[i], n[j] - place[j])
                at = np.flatnonzero((label[i] != label[j]) & ((times + of) * most >= times * (n[i] + n[j])))
                a, b = i[at], j[at]
                alone = sum((np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in odd), np.zeros(len(a), np.int64))
                some = (of + times) * alone <= (of - times) * (n[a] + n[b])
                if some.any():
                    a, b = id_[a[some]], id_[b[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    filed = rare.join(nodes.select("id", "label"), "id").select("id", "label", F.posexplode("rare").alias("place", "token"))
    filed = filed.select("token", "id", "label", F.col("place").cast("long").alias("place")).repartition("token").sortWithinPartitions("token")
    shared = saved(filed.mapInArrow(several, "token long, id long, place long"), "shared")
    cols = ["token", "n", "id", "place", "label", *_ODD]
    both = shared.join(nodes.select("id", "n", "label", *_ODD), "id").select(*cols).repartition("token").sortWithinPartitions("token", "n", "id")
    return both.mapInArrow(pairs, "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have a Jaccard similarity of SHARE or more, by their labels."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "hash"), "id")
    sets = saved(_sets(docs, wanted, shingle), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("a_own")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("own").alias("b_own")), "b")
    common, (times, of) = F.size(F.array_intersect("a_own", "b_own")), SHARE
    links = both.where(of * common >= times * (F.size("a_own") + F.size("b_own") - common)).select("a", "b")
    for side in "ab":
        links = links.join(nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label")), side)
    return saved(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "links")


def similar_groups(docs: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """(id, label) of the shingle sets of wide_prints(): label is the least id that links of a Jaccard similarity of SHARE or more
    reach. Sets meet by their fingerprints, and every met pair is held against its exact similarity. The first rounds hold each set
    against the nearest of the first ones filed with it only, which merges large groups; the next meets all sets whose labels differ still,
    and the last all that share a first shingle, which no pair of that similarity lacks."""
    held = ["n", *_WIDE, *_ODD]
    nodes = prints.groupBy("id").agg(*[F.first(c).alias(c) for c in held], F.min("mark").alias("hash"))
    nodes = saved(nodes.withColumn("label", F.col("id")), "nodes")
    rare = saved(prints.groupBy("id").agg(F.first("rare").alias("rare")), "rare")
    rounds = [(range(k * FIRST_TABLES, (k + 1) * FIRST_TABLES), True) for k in range(FIRST_ROUNDS)]
    for tables, leaders in [*rounds, (range(TABLES), False), (None, False)]:
        pairs = _met(nodes, tables, leaders) if tables else _sharing(nodes, rare)
        if leaders:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")
        pairs = saved(pairs.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            continue
        merged = components(_links(docs, nodes, pairs, shingle)).withColumnRenamed("id", "label")
        nodes = saved(nodes.join(merged, "label", "left").select("id", "hash", *held, F.coalesce("component", "label").alias("label")), "nodes")
    return nodes.select("id", "label")


def one_of_each_group(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The first document of each group of near copies, by doc_id (null after all others), then by hashes of the text and of
    the other columns; all columns stay, and repeated rows are one. Texts without words are copies of each other.

    Near copies have a Jaccard similarity of SHARE or more of their sets of shingles (of five words). Most meet by their SimHash fingerprints,
    the others by a shingle that such a pair must share, and each pair met is held to its exact similarity: no link is lost."""
    prints = saved(wide_prints(docs, shingle), "prints")
    groups = similar_groups(docs, prints, shingle)
    row = ["doc_id", "mark", "other"]
    own = prints.select(*row, "id").join(groups, "id").select(*row, "label")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *row)).alias("first")
    # no null among the keys: the join and what takes repeated rows out then share one shuffle of the texts
    keys = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__doc_id"), F.col("mark").alias("__mark"), F.col("other").alias("__other")]
    keep = saved(own.groupBy("label").agg(first).select("first.*").select(*keys), "keep")
    named = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    own = [c.alias(f"__own_{n}") for c, n in zip(_identity(docs), row)]
    rows = docs.select(*named, *own)
    rows = rows.select(*[f"__c{k}" for k in range(len(named))], F.col("__own_doc_id").isNull().alias("__none"), F.coalesce("__own_doc_id", F.lit(0)).alias("__doc_id"), F.col("__own_mark").alias("__mark"), F.col("__own_other").alias("__other"))
    names = ["__none", "__doc_id", "__mark", "__other"]
    kept = rows.join(keep, names, "left_semi").dropDuplicates(names)
    return kept.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
