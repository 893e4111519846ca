"""BM25 over chunks that are spans of a document's sentences, cut in many ways at once, without a row a chunk.

A document is one row: its sentences' sizes, which of the questions' terms they hold, and its spans under each way of cutting, each of which is a corpus by itself.
It is read twice: for how many chunks of each corpus hold a term, and for the scores. Chunks exist in a task for the documents of one batch only,
and a task keeps the k best of each corpus and question, and sends these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled, small_batches
from .retrieval import asked_terms, ranked

#: Rankings (a question in a corpus), and numbers of a corpus and a term, that a task may hold; scores that it makes at a time; places of a document's chunks.
RANKINGS, NUMBERS, CELLS, PLACES = 65_536, 4_000_000, 1 << 21, 1 << 24


def span_lists(docs: DataFrame, terms: Column, spans: list[Column]) -> DataFrame:
    """docs with sizes, terms, n_spans, a, b: flat arrays of a document's sentences (arrays of hashed terms) and of its spans under each way of cutting."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    cuts = F.array(*[F.coalesce(x, none) for x in spans])
    side = lambda name: F.flatten(F.transform("_cuts", lambda x: F.transform(x, lambda y: y[name])))
    once = docs.withColumns({"_cuts": cuts, "_terms": F.coalesce(terms, F.array().cast("array<array<bigint>>"))})
    out = once.withColumns({"sizes": F.transform("_terms", F.size), "terms": F.flatten("_terms"), "n_spans": F.transform("_cuts", F.size), "a": side("a"), "b": side("b")})
    return out.drop("_cuts", "_terms")


def _list(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin, and the values, of a column of arrays."""
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(first - before, sizes)


def _only_wanted(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """docs with `held`, the numbers of the wanted terms in the order of the text, and `at`, their sentences, in place of `terms`."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            (start, sizes), (first, terms) = _list(batch, "sizes"), _list(batch, "terms")
            sentence = np.repeat(_ranges(np.zeros(len(batch), np.int64), np.diff(start)), sizes[start[0] : start[-1]])
            terms = terms[first[0] : first[-1]]
            number = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
            there = known[number] == terms if len(known) else np.zeros(len(terms), bool)
            cut = pa.array(np.append(0, np.cumsum(there))[first - first[0]].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[there].astype(np.int32))) for x in (number, sentence)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("no", "sizes", "n_spans", "a", "b")), *lists], ["no", "sizes", "n_spans", "a", "b", "held", "at"])

    return docs.mapInArrow(find, "no long, sizes array<int>, n_spans array<int>, a array<int>, b array<int>, held array<int>, at array<int>")


def _chunks(batch: pa.RecordBatch, n_terms: int) -> Iterator[tuple]:
    """For each corpus: the chunks' ids, terms in all and sentences, and chunk, term and count where a chunk holds a wanted term, by chunk and term."""
    no = batch.column("no").to_numpy()
    (start, sizes), (first, held), (_, at) = _list(batch, "sizes"), _list(batch, "held"), _list(batch, "at")
    (span, a), (_, b), (row, n_spans) = _list(batch, "a"), _list(batch, "b"), _list(batch, "n_spans")
    length = np.append(0, np.cumsum(sizes, dtype=np.int64))
    place = np.repeat(start[:-1], np.diff(first)) + at[first[0] : first[-1]]
    occurs = first[0] + np.searchsorted(place, np.arange(len(sizes) + 1))  # the first wanted term at or behind each sentence
    n_spans = n_spans[row[0] : row[-1]].reshape(len(no), -1).astype(np.int64)
    begin = span[:-1, None] + np.cumsum(n_spans, axis=1) - n_spans
    for corpus in range(n_spans.shape[1]):
        n = n_spans[:, corpus]
        own, doc = _ranges(begin[:, corpus], n), np.repeat(np.arange(len(no)), n)
        ids = no[doc] * PLACES + _ranges(np.zeros(len(no), np.int64), n)
        lo, hi = start[doc] + a[own], start[doc] + b[own]
        many = occurs[hi] - occurs[lo]
        pairs, tf = np.unique(np.repeat(np.arange(len(own)), many) * n_terms + held[_ranges(occurs[lo], many)], return_counts=True)
        yield corpus, ids, length[hi] - length[lo], hi - lo, pairs // n_terms, pairs % n_terms, tf


def _counted(own: DataFrame, n_corpora: int, n_terms: int) -> np.ndarray:
    """A row a corpus: chunks, terms and sentences of its chunks, then how many chunks hold each wanted term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_corpora, 3 + n_terms), np.int64)
        for batch in batches:
            for corpus, ids, dl, sentences, _, term, _ in _chunks(batch, n_terms):
                total[corpus, :3] += len(ids), dl.sum(), sentences.sum()
                total[corpus, 3:] += np.bincount(term, minlength=n_terms)
        corpus, number = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(corpus.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(total[corpus, number])], ["corpus", "number", "n"])

    found = own.mapInArrow(count, "corpus int, number int, n long").groupBy("corpus", "number").agg(F.sum("n").alias("n")).toPandas()  # at most NUMBERS, and 3 a corpus
    out = np.zeros((n_corpora, 3 + n_terms))
    out[found.corpus, found.number] = found.n
    return out


class _Best:
    """The k best chunks of each of n questions; ties by id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row a chunk, a column a question."""
        row, query = np.nonzero(scores >= self.least - 1e-9)
        new, ids = np.round(scores[row, query], 9), ids[row]
        better = (new > self.least[query]) | ((new == self.least[query]) & (ids < self.last[query]))
        if not better.any():
            return
        query, ids, new = np.append(self.query, query[better]), np.append(self.ids, ids[better]), np.append(self.scores, new[better])
        order = np.lexsort((ids, -new, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.query, self.ids, self.scores = query[place < self.k], ids[kept], new[kept]
        full = place[place < self.k] == self.k - 1
        self.least[self.query[full]], self.last[self.query[full]] = self.scores[full], self.ids[full]


def span_top_k(docs: DataFrame, queries: DataFrame, k: int, n_corpora: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, np.ndarray] | None:
    """corpus, qid, rank, no, pos: what bm25_top_k gives over the chunks of each corpus by itself, a chunk's id being its document's number and its place there; and chunks,
    terms and sentences of each corpus. docs: no (numbers in the order of ties) and span_lists(); queries: qid, text.

    None if there are more questions or terms than a task can hold.
    """
    asked = asked_terms(queries)
    n_queries, n_terms = queries.select("qid").distinct().count(), asked.select("term").distinct().count()
    if n_queries * n_corpora > RANKINGS or n_terms * n_corpora > NUMBERS:
        return None
    listed = asked.toPandas()
    wanted, number = np.unique(listed.term.to_numpy(np.int64), return_inverse=True)
    qids = np.sort(queries.select("qid").distinct().toPandas().qid.to_numpy(np.int64))
    order = np.argsort(number, kind="stable")
    query, qtf = np.searchsorted(qids, listed.qid.to_numpy(np.int64))[order], listed.qtf.to_numpy(np.float64)[order]
    first = np.searchsorted(number[order], np.arange(n_terms + 1))
    own = settled(_only_wanted(docs, wanted))
    with small_batches(own.sparkSession):
        totals = _counted(own, n_corpora, n_terms)
    n, df = totals[:, :1], totals[:, 3:]
    shared = own.sparkSession.sparkContext.broadcast((np.log(1.0 + (n - df + 0.5) / (df + 0.5)), np.maximum(totals[:, 1] / np.maximum(n[:, 0], 1), 1e-9), query, qtf, first, qids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average, query, qtf, first, qids = shared.value
        found = [_Best(len(qids), k) for _ in range(n_corpora)]
        slab = max(1, CELLS // max(1, len(qids)))
        for batch in batches:
            for corpus, ids, dl, _, chunk, term, tf in _chunks(batch, n_terms):
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[chunk] / average[corpus]))
                for at in range(0, len(ids), slab):
                    part = slice(*np.searchsorted(chunk, (at, at + slab)))
                    many = first[term[part] + 1] - first[term[part]]
                    to = _ranges(first[term[part]], many)
                    weight = np.repeat(idf[corpus, term[part]], many) * qtf[to] * np.repeat(gain[part], many)
                    rows = ids[at : at + slab]
                    scores = np.bincount(np.repeat(chunk[part] - at, many) * len(qids) + query[to], weight, len(rows) * len(qids))
                    found[corpus].add(rows, scores.reshape(len(rows), len(qids)))
        for corpus, own in enumerate(found):
            columns = [np.full(len(own.ids), corpus, np.int32), qids[own.query], own.ids, own.scores]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["corpus", "qid", "id", "score"])

    found = settled(own.mapInArrow(best, "corpus int, qid long, id long, score double"))
    top = ranked(found, k, ["corpus", "qid"], [F.col("score").desc(), F.col("id")])
    return top.select("corpus", "qid", "rank", F.floor(F.col("id") / PLACES).alias("no"), (F.col("id") % PLACES).cast("int").alias("pos")), totals[:, :3]
