"""N-degree hashes of RDFC-1.0: names for blank nodes that share their first-degree hash.

What a node's n-degree hash depends on is the part of the graph reached from it over nodes that share their hash with others.
So these parts are found first, by links between such nodes, and each is settled by itself in one group; a part's place among all
is that of its least first-degree hash, then of its n-degree hash, and its names follow those before it.

A part whose permutations go beyond ``MOST_WORK`` steps is an error: the algorithm's cost grows with the factorial of like neighbours.
A part is one group, as the algorithm needs all of it; every round of linking is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.shared import saved
from biblioflow.operators import rdf

MOST_WORK = 1 << 18
_SIDES = (("s", "s"), ("o", "o"), ("g", "g"))


def parts(links: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(label, part): part is the least label that links (a, b) reach. Every round takes the least part beside a node, then that part's own."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now, before = nodes.select("label", F.col("label").alias("part")), None
    for _ in range(rounds):
        beside = both.join(now, F.col("b") == F.col("label")).groupBy("a").agg(F.min("part").alias("near"))
        step = saved(now.join(beside, F.col("label") == F.col("a"), "left").select("label", F.least("part", "near").alias("part")), "parts")
        up = step.select(F.col("label").alias("up"), F.col("part").alias("top"))
        now = saved(step.join(up, F.col("part") == F.col("up"), "left").select("label", F.least("part", "top").alias("part")), "parts")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("label", "part").cast("decimal(38,0)"))).first()
        if mark == before:
            return now
        before = mark
    raise ValueError(f"the parts did not settle in {rounds} rounds")


class _Issuer:
    def __init__(self, prefix: str, given: dict[str, str] | None = None):
        self.prefix, self.given = prefix, dict(given or {})

    def copy(self) -> _Issuer:
        return _Issuer(self.prefix, self.given)

    def name(self, node: str) -> str:
        return self.given.setdefault(node, f"{self.prefix}{len(self.given)}")


class Part:
    """The statements around the tied nodes of one part: for each node its neighbours as (predicate, side, neighbour)."""

    def __init__(self, first: dict[str, str], names: dict[str, str], beside: dict[str, list[tuple[str, str, str]]]):
        self.first, self.names, self.beside, self.work = first, names, beside, 0

    def related(self, node: str, predicate: str, side: str, issuer: _Issuer) -> str:
        if node in self.names:
            shown = f"_:{self.names[node]}"
        else:
            shown = f"_:{issuer.given[node]}" if node in issuer.given else self.first[node]
        return hashlib.sha256(f"{side}{'' if side == 'g' else predicate}{shown}".encode()).hexdigest()

    def n_degree(self, node: str, issuer: _Issuer) -> tuple[str, _Issuer]:
        groups: dict[str, list[str]] = {}
        for predicate, side, other in self.beside.get(node, ()):
            groups.setdefault(self.related(other, predicate, side, issuer), []).append(other)
        said = []
        for key in sorted(groups):
            said.append(key)
            best, best_issuer = None, issuer
            for order in set(itertools.permutations(groups[key])) if len(groups[key]) < 8 else itertools.permutations(groups[key]):
                self.work += 1
                if self.work > MOST_WORK:
                    raise ValueError("too much work")
                own, path, again = issuer.copy(), "", []
                for other in order:
                    if other in self.names:
                        path += f"_:{self.names[other]}"
                        continue
                    if other not in own.given:
                        again.append(other)
                    path += f"_:{own.name(other)}"
                    if best is not None and len(path) >= len(best) and path > best:
                        break
                else:
                    for other in again:
                        deeper, own = self.n_degree(other, own)
                        path += f"_:{own.name(other)}<{deeper}>"
                        if best is not None and len(path) >= len(best) and path > best:
                            break
                    else:
                        if best is None or path < best:
                            best, best_issuer = path, own
            said.append(best)
            issuer = best_issuer
        return hashlib.sha256("".join(said).encode()).hexdigest(), issuer

    def settled(self) -> Iterator[tuple[str, str, list[str]]]:
        """(first-degree hash, n-degree hash, nodes in the order of their names) until every node has its name."""
        done: set[str] = set()
        for h in sorted(set(self.first.values())):
            found = []
            for node in (n for n, own in self.first.items() if own == h and n not in done):
                issuer = _Issuer("b")
                issuer.name(node)
                found.append((*self.n_degree(node, issuer), node))
            for digest, issuer, _ in sorted(found, key=lambda x: (x[0], x[2])):
                new = [n for n in issuer.given if n not in done]
                done.update(new)
                if new:
                    yield h, digest, new


def tied(quads: DataFrame, hashes: DataFrame, many: DataFrame, named: DataFrame) -> DataFrame:
    """(label, new) of the nodes whose first-degree hash is among ``many``; named: (label, new) of all others."""
    nodes = saved(hashes.join(many, "hash", "left_semi"), "tied")
    label = lambda n: F.when(rdf.is_blank(F.col(n)), F.col(f"{n}.value"))
    rows = quads.where(label("s").isNotNull() | label("o").isNotNull() | label("g").isNotNull())
    # the graph of a dataset of a statement counts too, so equal statements are one
    rows = rows.select(label("s").alias("s"), F.concat(F.lit("<"), F.col("p.value"), F.lit(">")).alias("p"), label("o").alias("o"), label("g").alias("g"), F.xxhash64("s", "p", "o", "g").alias("id"))
    rows = saved(rows.distinct(), "tied-statements")
    pairs = None
    for a, _ in _SIDES:
        for b, side in _SIDES:
            if a != b:
                own = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                own = own.select(F.col(a).alias("label"), "p", F.lit(side).alias("side"), F.col(b).alias("other"))
                pairs = own if pairs is None else pairs.unionByName(own)
    links = pairs.select(F.col("label").alias("a"), F.col("other").alias("b")).distinct()
    keys = nodes.select(F.col("label").alias("k"))
    links = links.join(keys, F.col("a") == F.col("k"), "left_semi").join(keys, F.col("b") == F.col("k"), "left_semi")
    part = parts(links, nodes).join(nodes, "label")
    given = named.select(F.col("label").alias("other"), F.col("new").alias("given"))
    around = saved(part.join(pairs, "label", "left").join(given, "other", "left").select("part", "label", "hash", "p", "side", "other", "given"), "around")
    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        first = dict(zip(frame["label"], frame["hash"]))
        names = {o: g for o, g in zip(frame["other"], frame["given"]) if isinstance(g, str)}
        beside: dict[str, list[tuple[str, str, str]]] = {}
        for node, p, side, other in zip(frame["label"], frame["p"], frame["side"], frame["other"]):
            if isinstance(other, str):
                beside.setdefault(node, []).append((p, side, other))
        try:
            out = [(h, digest, k, n, None) for h, digest, nodes_ in Part(first, names, beside).settled() for k, n in enumerate(nodes_)]
        except ValueError as e:
            out = [(None, None, 0, frame["part"].iloc[0], str(e))]
        return pd.DataFrame(out, columns=["hash", "digest", "k", "label", "error"]).assign(part=frame["part"].iloc[0])

    found = saved(around.groupBy("part").applyInPandas(settle, "hash string, digest string, k int, label string, error string, part string"), "settled")
    bad = found.where("error is not null").limit(1).collect()
    if bad:
        raise ValueError(f"the part of _:{bad[0]['label']} takes over {MOST_WORK} permutations")
    # names go on from the last of the others, by hash, then by n-degree hash; like parts are equal in either order
    order = ["hash", "digest", "part", "k"]
    own = found.withColumn("bucket", F.substring("hash", 1, 3))
    starts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("bucket", before.alias("before"))  # at most 4,096 rows
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    others = F.lit(named.count())
    own = own.withColumn("within", within).join(F.broadcast(starts), "bucket")
    return own.select("label", F.concat(F.lit("c14n"), (others + F.col("before") + F.col("within")).cast("string")).alias("new"))
