"""Near-duplicate groups by an LSH forest of MinHash signatures.

1. Every text becomes its set of distinct k-word shingles. Texts with equal sets form one class, whose least
   doc_id stands for it from here on, so that copies never meet in pairs.
2. A signature has TREES x DEPTH minima. Each tree sorts all classes by its own DEPTH minima (range partitioned, so
   that a crowded region spreads over many tasks). A class's candidates are its nearest neighbours in that order,
   whose common prefix is the longest there is, and the first classes of its regions of each depth. A region is a
   common prefix of at least LEAST minima: sparse regions are searched at that depth, crowded ones as deep as
   needed to tell their classes apart. That leaves no pair out of a region that has no more classes than a class has
   neighbours and one; classes of larger regions are compared each with each (crowds.py), on their full sets, in blocks.
3. Candidates are confirmed on their full shingle sets: 100 x intersection >= percent x union.
4. Confirmed links make up components.

Defined results: a text that is null or has no word has no shingle and is linked with nothing; fewer than k words
make one shingle; rows that share a doc_id are one node, rows without
one together are another, after all others; ties go to the least doc_id; an empty table gives an
empty table; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hinted, number_of, settled
from .components import components
from .crowds import crowd_links, crowds
from .shingles import batches, mixed, numbers, shingle_sets

TREES, DEPTH, LEAST, NEIGHBOURS, PART = 12, 6, 3, 3, 500
_H = [f"h{i}" for i in range(DEPTH)]


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a hash of the set in two parts) and sig (the minima) of each text."""
    n_minima = TREES * DEPTH
    add, times = numbers(3, n_minima), numbers(4, n_minima) | np.uint64(1)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.text.fillna("").tolist()
            for part in batches(texts):
                hashes, at = shingle_sets(texts[part], k)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                sig = np.zeros((len(sizes), n_minima), np.uint32)
                sums = np.zeros((len(sizes), 2), np.int64)
                if len(some):
                    begin = at[:-1][some]
                    for j in range(n_minima):
                        sig[some, j] = np.minimum.reduceat(((hashes ^ add[j]) * times[j] >> np.uint64(32)).astype(np.uint32), begin)
                    sums[some, 0] = np.add.reduceat(hashes, begin).view(np.int64)
                    sums[some, 1] = np.bitwise_xor.reduceat(mixed(hashes), begin).view(np.int64)
                yield pd.DataFrame({"doc_id": frame.doc_id.iloc[part].values, "n_shingles": sizes, "set_a": sums[:, 0], "set_b": sums[:, 1], "sig": list(sig.view(np.int32))})

    return docs.select(number_of(F.col("doc_id")).alias("doc_id"), "text").mapInPandas(sign, "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>")


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates among rows in tree order; also the rows at both ends, whose neighbours may be in other partitions."""
    kept, first = None, True
    for frame in frames:
        if not len(frame):
            continue
        rows = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        ids, keys = rows.id.to_numpy(), rows[["tree", *_H]].to_numpy()
        n, pairs = len(rows), []
        same = np.zeros((n, DEPTH + 1), bool)  # whether a row shares the first columns with the one before
        if n > 1:
            same[1:] = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
        for depth in range(LEAST, DEPTH + 1):
            head = np.maximum.accumulate(np.where(same[:, depth], 0, np.arange(n)))
            pairs.append(np.stack([head, np.arange(n)]))
        run = pairs[0][0]
        for lag in range(1, NEIGHBOURS + 1):
            here = np.arange(lag, n)
            here = here[run[here] <= here - lag]
            pairs.append(np.stack([here - lag, here]))
        left, right = np.concatenate(pairs, axis=1)
        a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
        found = np.unique(np.stack([a, b])[:, a != b], axis=1)
        yield pd.DataFrame({"a": found[0], "b": found[1]}).assign(tree=None, id=None, **dict.fromkeys(_H))
        if first:
            yield rows.head(NEIGHBOURS).assign(a=None, b=None)
        first = False
        keep = sorted({*(int(p[0][-1]) for p in pairs[: DEPTH + 1 - LEAST]), *range(max(0, n - NEIGHBOURS), n)})
        kept = rows.iloc[keep].reset_index(drop=True)
    if kept is not None:
        yield kept.assign(a=None, b=None)


def candidates(classes: DataFrame) -> DataFrame:
    """a < b: the candidate pairs of all trees. classes: doc_id, sig."""
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), *[F.get("sig", t * DEPTH + j).alias(h) for j, h in enumerate(_H)]),
    )
    rows = classes.select(F.col("doc_id").alias("id"), F.explode(trees).alias("x")).select("id", "x.*")
    order = ["tree", *_H, "id"]
    schema = "a long, b long, tree int, id long, " + ", ".join(f"{h} int" for h in _H)
    near = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours, schema))
    ends = near.where("a IS NULL").select(*order).distinct()  # a few rows a partition
    across = ends.coalesce(1).sortWithinPartitions(*order).mapInPandas(_neighbours, schema)
    return settled(near.unionByName(across).where("a IS NOT NULL").select("a", "b").distinct())


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are as similar as asked."""
    named = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = settled(docs.select(number_of(F.col("doc_id")).alias("id"), "text").join(hinted(settled(named)), "id", "left_semi"))
    # A region's first class meets all others as `a`: its pairs are dealt in parts of about PART, and its text goes to each part once.
    parts = settled(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    right = pairs.join(hinted(parts), "a").select("a", "b", part.alias("part")).join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    left = texts.join(hinted(parts.withColumnRenamed("a", "id")), "id")
    left = left.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = right.join(left, ["a", "part"])

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left, right = frame.ta.fillna("").tolist(), frame.tb.fillna("").tolist()
            good = np.zeros(len(frame), bool)
            for part in batches([x + y for x, y in zip(left, right)]):
                (x, at), (y, to) = shingle_sets(left[part], k), shingle_sets(right[part], k)
                for i in range(len(at) - 1):
                    p, q = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    good[part.start + i] = shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared)
            yield frame.loc[good, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long").distinct()


def _regions(classes: DataFrame) -> DataFrame:
    """id, region: a hash of the first LEAST minima of each tree."""
    heads = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, *[F.get("sig", t * DEPTH + j) for j in range(LEAST)]))
    return classes.select(F.col("doc_id").alias("id"), F.explode(heads).alias("region"))


def _crowd_sets(docs: DataFrame, crowd: DataFrame, k: int) -> DataFrame:
    """id, crowd, many, n and set of all texts of the ids of crowd."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.text.tolist()
            for part in batches(texts):
                hashes, at = shingle_sets(texts[part], k)
                own = [hashes[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield frame.iloc[part][["id", "crowd"]].assign(n=np.diff(at), set=own)

    texts = docs.where("text IS NOT NULL").select(number_of(F.col("doc_id")).alias("id"), "text").join(hinted(crowd), "id").dropDuplicates(["id", "text"])
    sets = settled(texts.mapInPandas(hashed, "id long, crowd long, n long, set binary").where("n > 0"))
    many = settled(sets.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("many")))
    return sets.join(hinted(many), "id", "left").withColumn("many", F.coalesce("many", F.lit(False)))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("class_id")).unionAll(links.select("b")).withColumn("n", F.lit(1).cast("long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with an equal set), n_links (of its class), component_id, kept."""
    rows = settled(signed(docs, k))
    full = rows.where("n_shingles > 0")
    classes = settled(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("set_a", "set_b", "n_shingles", "x.*"))
    crowd = crowds(_regions(classes), NEIGHBOURS + 1)
    pairs = candidates(classes)
    if crowd.isEmpty():
        links = settled(confirmed(pairs, docs, k, percent))
        edges, ends = links, _ends(links)
    else:
        sets = _crowd_sets(docs, crowd, k)
        done = settled(sets.where("NOT many").select("id", "crowd"))  # what is compared in full needs no candidates
        for side in ("a", "b"):
            pairs = pairs.join(hinted(done.select(F.col("id").alias(side), F.col("crowd").alias(f"of_{side}"))), side, "left")
        pairs = settled(pairs.where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b"))
        found = crowd_links(sets, percent)
        links = settled(confirmed(pairs, docs, k, percent).unionByName(found.where("n = 0").select("a", "b")).distinct())
        edges = links.unionByName(found.where("n IS NULL").select("a", "b"))
        ends = _ends(links).unionByName(found.where("b IS NULL").select(F.col("a").alias("class_id"), "n"))
    groups = components(edges).select(F.col("node").alias("class_id"), "component")
    degrees = ends.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    named = classes.select("set_a", "set_b", "n_shingles", F.col("doc_id").alias("class_id")).join(groups, "class_id", "left").join(degrees, "class_id", "left")
    out = rows.drop("sig").join(hinted(settled(named), 200_000), ["set_a", "set_b", "n_shingles"], "left")
    own = F.coalesce("class_id", "doc_id")
    component = F.coalesce("component", own)
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        known(F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        known(own).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        known(component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )
