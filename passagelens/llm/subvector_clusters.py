"""Exact k-means over integers on dictionary-encoded vectors.

Vectors are kept in pages of bounded size, like the pages of a column file: a page holds, for each block of neighbouring dimensions, the
distinct subvectors of its vectors and, for each vector, the code of its own. Nothing is lost. A round computes the squared distance of each distinct
subvector to the same block of each centroid, once a page, and adds these up by code. Blocks start one dimension wide and are joined to twice
the width wherever that makes a round cheaper: repeated vectors and coarse values give wide blocks, fine values narrow ones. A dictionary
never outgrows its page, so that no round joins, broadcasts or shuffles anything but centroids and sums, whatever the number of distinct subvectors is.

Each round returns, a task, the exact sums and counts of each cluster (a row a cluster); the new centroids are their floored quotients.

Defined results: vectors that are null, of another length, or that hold a null or a number that is not finite, are left out. Rows that repeat
a vec_id are vectors of their own. Start vectors are those of least sha256 of `salt:vec_id`; rows of one vec_id among them go by
their components, rows without a vec_id come last. With fewer vectors than clusters there are as many clusters as vectors; an empty table gives an
empty table. Columns besides vec_id and embedding are ignored, whatever their names. A component of 2^17 or more, whose distances would not fit
into a long, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Vectors of a page.
PAGE = 16_384
#: Scaled components below this have exact distances: 64 squares of sums of two stay below 2^63.
LEAST_OVERFLOW = 1 << 27


def kept_vectors(table: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and x, the components times scale, rounded down, of the vectors that count."""
    value = F.col("embedding").cast("array<double>")
    odd = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~odd
    whole = F.transform(value, lambda v: F.when(F.abs(v) < LEAST_OVERFLOW / scale, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))))
    return table.where(good).select("vec_id", whole.alias("x"))


def starts(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k start vectors, a row each."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64)


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block and each row's code."""
    distinct, codes = np.unique(block, axis=0, return_inverse=True) if block.shape[1] > 1 else np.unique(block[:, 0], return_inverse=True)
    return distinct.reshape(len(distinct), -1), codes.ravel()


def encoded_page(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of each block of a page.

    A round costs a product for each number in a dictionary and an addition for each code: two neighbours of one width become
    one block if that lowers the sum.
    """
    blocks = [(at, *dictionary(x[:, at : at + 1])) for at in range(x.shape[1])]
    joined = True
    while joined:
        joined, out, i = False, [], 0
        while i < len(blocks):
            at, words, codes = blocks[i]
            other = blocks[i + 1] if i + 1 < len(blocks) else None
            if other is not None and words.shape[1] == other[1].shape[1]:
                width = words.shape[1]
                pair, both = np.unique(codes.astype(np.int64) * len(other[1]) + other[2], return_inverse=True)
                if len(pair) * 2 * width < (len(words) + len(other[1])) * width + len(x):
                    merged = np.concatenate([words[pair // len(other[1])], other[1][pair % len(other[1])]], axis=1)
                    out.append((at, merged, both.ravel()))
                    joined, i = True, i + 2
                    continue
            out.append(blocks[i])
            i += 1
        blocks = out
    return blocks


_CODES = (np.uint8, np.uint16, np.uint32)
_PAGES = "vec_ids array<long>, first array<int>, width array<int>, entries array<int>, words binary, codes array<binary>"


def pages(vectors: DataFrame, page: int = PAGE) -> DataFrame:
    """Pages of dictionary-encoded vectors (vec_id, x)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(ids: list, rows: list) -> pd.DataFrame:
            blocks = encoded_page(np.array(rows, np.int32))
            codes = [c.astype(next(t for t in _CODES if len(w) - 1 <= np.iinfo(t).max)).tobytes() for _, w, c in blocks]
            own = {"first": [b[0] for b in blocks], "width": [b[1].shape[1] for b in blocks], "entries": [len(b[1]) for b in blocks]}
            return pd.DataFrame({"vec_ids": [ids], **{name: [v] for name, v in own.items()}, "words": [b"".join(b[1].astype("<i4").tobytes() for b in blocks)], "codes": [codes]})

        ids, rows = [], []
        for frame in frames:
            ids += [None if pd.isna(v) else int(v) for v in frame.vec_id.tolist()]
            rows += frame.x.tolist()
            while len(rows) >= page:
                yield packed(ids[:page], rows[:page])
                ids, rows = ids[page:], rows[page:]
        if rows:
            yield packed(ids, rows)

    return vectors.mapInPandas(pack, _PAGES)


def _unpacked(row) -> list[tuple[int, np.ndarray, np.ndarray]]:
    words, at, out = np.frombuffer(row.words, "<i4"), 0, []
    for first, width, entries, codes in zip(row.first, row.width, row.entries, row.codes):
        kind = next(t for t in _CODES if entries - 1 <= np.iinfo(t).max)
        out.append((first, words[at : at + width * entries].reshape(entries, width).astype(np.int64), np.frombuffer(codes, kind)))
        at += width * entries
    return out


def _assigned(blocks: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector of a page (the first of equal ones) and its squared distance."""
    total = np.zeros((len(blocks[0][2]), len(centroids)), np.int64)
    for first, words, codes in blocks:
        gap = words[:, None, :] - centroids[None, :, first : first + words.shape[1]]
        total += (gap * gap).sum(axis=2)[codes]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(total)), nearest]


def _sums(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that is not empty: its vectors, the sum of their distances, and their sum."""
    k, dim = centroids.shape

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                blocks = _unpacked(row)
                nearest, distance = _assigned(blocks, centroids)
                n += np.bincount(nearest, minlength=k)
                np.add.at(far, nearest, distance)
                for first, words, codes in blocks:  # how often each subvector stands in each cluster
                    often = np.bincount(codes.astype(np.int64) * k + nearest, minlength=k * len(words)).reshape(len(words), k)
                    total[:, first : first + words.shape[1]] += often.T @ words
        yield pd.DataFrame({"cluster": np.arange(k), "n": n, "far": far, "total": list(total)})

    each = packed.mapInPandas(add, "cluster int, n long, far long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]
    rows = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *totals).where("n > 0").collect()  # a row a cluster
    return {r.cluster: (r.n, r.far, [r[f"s{i}"] for i in range(dim)]) for r in rows}


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3", page: int = PAGE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that counts, and the final centroids."""
    vectors = kept_vectors(table, dim, scale)
    packed = settled(pages(vectors, page))
    centroids = starts(vectors, k, salt).reshape(-1, dim)
    spark = table.sparkSession
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns), centroids
    for _ in range(rounds):
        for c, (n, _far, total) in _sums(packed, centroids).items():
            centroids[c] = [s // n for s in total]
    far = {c: own[1] for c, own in _sums(packed, centroids).items()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                nearest, distance = _assigned(_unpacked(row), centroids)
                ids = pd.array([None if pd.isna(v) else int(v) for v in row.vec_ids], "Int64")
                yield pd.DataFrame({"vec_id": ids, "cluster": nearest, "distance": distance, "cluster_inertia": [far[c] for c in nearest.tolist()], "inertia": sum(far.values()), "centroid_sha256": [digest[c] for c in nearest.tolist()]})

    return packed.mapInPandas(assign, columns), centroids
