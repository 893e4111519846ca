"""All links among the classes of crowded regions, found exactly and without a row a pair.

A region is what classes share LEAST minima of a tree; it is crowded if it holds more classes than a class has
neighbours in tree order. Crowded regions that share a class make up a crowd, and every two classes of a crowd are
compared on their full sets. Classes are dealt in buckets by set size, so that only sets of one bucket or of two
adjoining ones can be as similar as asked; buckets are dealt in parts of bounded size by hash. Each two parts that can
hold a link are compared in one group, which gives the number of links of each class and the edges of a
spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, settled
from .components import components

#: A part has about so many shingles and classes at most (one class at least).
PART_SHINGLES, PART_CLASSES = 400_000, 1000
#: A shingle of more classes than this counts in a matrix product, others by their postings; so many of a product's columns at a time.
FREQUENT, COLUMNS = 64, 2048


def crowds(regions: DataFrame, most: int) -> DataFrame:
    """id, crowd (its least id) of the classes in regions with more than `most` classes. regions: id, region."""
    large = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") > most)
    near = regions.join(hinted(settled(large.select("region", "first"))), "region")
    return settled(components(near.select(F.col("first").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("crowd")))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `left` shares with each of `right`."""
    p, q = len(left), len(right)
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(p + q), [len(s) for s in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(begin, len(values)))
    frequent, column = np.repeat(count > FREQUENT, count), np.repeat(np.cumsum(count > FREQUENT) - 1, count)
    out = np.zeros(p * q, np.int64)
    for low in range(0, int((count > FREQUENT).sum()), COLUMNS):
        part = frequent & (column >= low) & (column < low + COLUMNS)
        held = np.zeros((p + q, COLUMNS), np.float32)
        held[row[part], column[part] - low] = 1
        out += (held[:p] @ held[p:].T).astype(np.int64).ravel()
    values, row = values[~frequent], row[~frequent]
    for lag in range(1, FREQUENT):
        here = np.flatnonzero(values[lag:] == values[:-lag])
        if not len(here):
            break
        i, j = row[here], row[here + lag]
        both = (i < p) & (j >= p)
        out += np.bincount(i[both] * q + j[both] - p, minlength=p * q)
    return out.reshape(p, q)


def _forest(linked: np.ndarray) -> list[tuple[int, int, bool]]:
    """(row, other, whether the other is a row): for each connected part of a bipartite graph its first row with the rest."""
    rows, cols, out = ~linked.any(axis=1), np.zeros(linked.shape[1], bool), []
    for root in range(len(linked)):
        if rows[root]:
            continue
        rows[root] = True
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & ~cols)
            cols[new] = True
            front = np.flatnonzero(linked[:, new].any(axis=1) & ~rows)
            rows[front] = True
            out += [(root, int(c), False) for c in new] + [(root, int(r), True) for r in front]
    return out


def _compared(frame: pd.DataFrame, same: bool, percent: int) -> pd.DataFrame:
    """The links of one group: a, b, n: n links of a (b is null); an edge of a forest (n is null); or a link by itself (n is 0)."""
    frame = frame.sort_values("id", kind="stable")
    x, y = frame[frame.left], frame[frame.left] if same else frame[~frame.left]
    none = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
    if not len(x) or not len(y):
        return none
    left, right = ([np.frombuffer(s, np.uint64) for s in side["set"]] for side in (x, y))
    shared = shared_counts(left, right)
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    xs, ys = x.id.to_numpy(), y.id.to_numpy()
    linked = (shared > 0) & (100 * shared >= percent * (sizes - shared)) & (xs[:, None] != ys)
    odd = linked & (x.many.to_numpy()[:, None] | y.many.to_numpy())
    linked &= ~odd
    i, j = np.nonzero(odd)
    alone = np.unique(np.stack([np.minimum(xs[i], ys[j]), np.maximum(xs[i], ys[j])]), axis=1)
    degrees = [(xs, linked.sum(axis=1))] + ([] if same else [(ys, linked.sum(axis=0))])
    found = [pd.DataFrame({"a": ids[n > 0], "b": None, "n": n[n > 0]}) for ids, n in degrees]
    edges = [(xs[r], xs[o] if is_row else ys[o]) for r, o, is_row in _forest(linked)]
    found += [pd.DataFrame(edges, columns=["a", "b"]).assign(n=None), pd.DataFrame({"a": alone[0], "b": alone[1], "n": 0})]
    found = [f.astype("Int64") for f in found if len(f)]
    return pd.concat(found) if found else none


def crowd_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b, n as of _compared. sets: id, crowd, many (whether the id has other sets too), n (its size), set (its sorted hashes as bytes)."""
    width = max(-math.log(percent / 100), 0.01) * (1 + 1e-9)
    sized = sets.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    largest = F.exp((F.col("s") + 1) * width)
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(PART_CLASSES)), PART_SHINGLES / largest))
    counted = sized.groupBy("crowd", "s").agg(F.count(F.lit(1)).alias("classes")).select("crowd", F.struct("s", F.ceil(F.col("classes") / room).cast("int").alias("parts")).alias("x"))
    parts = settled(counted.groupBy("crowd").agg(F.map_from_entries(F.collect_list("x")).alias("parts")))
    dealt = sized.join(hinted(parts), "crowd").withColumn("i", F.pmod(F.xxhash64("id", "set"), F.col("parts")[F.col("s")]).cast("int"))
    s, i = F.col("s"), F.col("i")

    def against(bucket: Column, meet) -> Column:
        n = F.coalesce(F.col("parts")[bucket], F.lit(0))
        return F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda j: F.struct(*[c.alias(name) for c, name in zip(meet(j), ("s1", "p1", "s2", "p2", "left"))]))

    groups = F.concat(
        against(s, lambda j: (s, F.least(i, j), s, F.greatest(i, j), i <= j)),
        against(s + 1, lambda j: (s, i, s + 1, j, F.lit(True))),
        against(s - 1, lambda j: (s - 1, j, s, i, F.lit(False))),
    )
    met = dealt.select("crowd", "id", "many", "set", F.explode(groups).alias("x")).select("crowd", "id", "many", "set", "x.*")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _compared(frame, key[1:3] == key[3:5], percent)

    return settled(met.groupBy("crowd", "s1", "p1", "s2", "p2").applyInPandas(compare, "a long, b long, n long"))
