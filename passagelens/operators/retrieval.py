"""Rankers over chunks: BM25, exact inner product, rank fusion, reranking, and what is built on ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..sources.scratch import settled

#: A table of so many rows at most is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def ranked(scores: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits each group before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: So many queries are sent to all tasks, or held by one, at once; so many of them are scored at a time; chunks at a time.
QUERIES, BLOCK, ROWS = 16_384, 1024, 512


def _merged(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores, a row a query, of the k best of `best` and these; ties by id."""
    ids = np.broadcast_to(ids, scores.shape)
    if best is not None:
        ids, scores = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], scores], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _top_k(rows: DataFrame, blocks: list[tuple[np.ndarray, object]], score, k: int) -> DataFrame:
    """qid, chunk_id, score: the k best rows of each task for each query of the blocks (qids, what score needs of them).

    A task keeps k rows a query over all that it reads, and sends these alone.
    """
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list = [None] * len(shared.value)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                ids = part.chunk_id.to_numpy()
                ready = score(part)
                for i, (_, wanted) in enumerate(shared.value):
                    found[i] = _merged(found[i], ids, np.round(ready(wanted), 9), k)
        for (qids, _), held in zip(shared.value, found):
            if held is not None:
                yield pd.DataFrame({"qid": np.repeat(qids, held[0].shape[1]), "chunk_id": held[0].ravel(), "score": held[1].ravel()})

    return rows.mapInPandas(best, "qid long, chunk_id long, score double")


def _meeting(rows: DataFrame, queries: DataFrame, blocks_of, score, k: int, n: int, corpora: int = 1) -> DataFrame:
    """corpus, qid, chunk_id, score: the k best rows of each share of the rows for any number n of queries, without the driver.

    Rows and queries name their corpus, from 0. A corpus's queries are dealt in groups of about QUERIES, its rows in as many shares as give every core work. A
    group and a share meet in one partition, the queries first, so that a task holds one group's queries and k rows for each while the share's rows pass.
    """
    groups = -(-n // QUERIES)
    shares = max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // (groups * corpora)))
    per = groups * shares
    own, theirs = [c for c in queries.columns if c not in ("qid", "corpus")], [c for c in rows.columns if c not in ("chunk_id", "corpus")]
    first = F.col("corpus") * per + F.pmod(F.xxhash64("qid"), F.lit(groups)) * shares
    left = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda h: (first + h).cast("int"))).alias("cell"), F.lit(0).alias("side"), F.col("qid").alias("id"), *[F.col(c).alias(f"q_{c}") for c in own])
    share = F.col("corpus") * per + F.pmod(F.xxhash64("chunk_id"), F.lit(shares))
    right = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (g * shares + share).cast("int"))).alias("cell"), F.lit(1).alias("side"), F.col("chunk_id").alias("id"), *[F.col(c).alias(f"r_{c}") for c in theirs])
    both = left.unionByName(right, allowMissingColumns=True).repartition(per * corpora, "cell").sortWithinPartitions("cell", "side")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, waiting, blocks, found = None, [], None, []

        def results() -> Iterator[pd.DataFrame]:
            for (qids, _), held in zip(blocks or [], found):
                if held is not None:
                    yield pd.DataFrame({"corpus": cell // per, "qid": np.repeat(qids, held[0].shape[1]), "chunk_id": held[0].ravel(), "score": held[1].ravel()})

        for frame in frames:
            for number, part in frame.groupby("cell", sort=False):
                if number != cell:
                    yield from results()
                    cell, waiting, blocks, found = number, [], None, []
                asked, passing = part[part.side == 0], part[part.side == 1]
                if len(asked):
                    waiting.append(asked[["id", *(f"q_{c}" for c in own)]].set_axis(["qid", *own], axis=1))
                if not len(passing) or not waiting:
                    continue
                if blocks is None:
                    blocks = blocks_of(pd.concat(waiting, ignore_index=True))
                    found = [None] * len(blocks)
                for at in range(0, len(passing), ROWS):
                    now = passing.iloc[at : at + ROWS][["id", *(f"r_{c}" for c in theirs)]].set_axis(["chunk_id", *theirs], axis=1)
                    ids, ready = now.chunk_id.to_numpy(), score(now)
                    for i, (_, wanted) in enumerate(blocks):
                        found[i] = _merged(found[i], ids, np.round(ready(wanted), 9), k)
        yield from results()

    return both.mapInPandas(meet, "corpus int, qid long, chunk_id long, score double")


def _over_all(rows: DataFrame, queries: DataFrame, blocks_of, score, k: int) -> DataFrame:
    """qid, rank, chunk_id, score. Up to QUERIES queries go to all tasks, and the rows stay where they are; more of them meet the rows by a shuffle."""
    n = queries.count()
    if n <= QUERIES:
        found = _top_k(rows, blocks_of(queries.toPandas()), score, k)
    else:
        found = _meeting(rows.withColumn("corpus", F.lit(0)), queries.withColumn("corpus", F.lit(0)), blocks_of, score, k, n).drop("corpus")
    found = settled(found)  # in small batches: what a worker holds doesn't grow with its rows
    return ranked(found, k, ["qid"], [F.col("score").desc(), F.col("chunk_id")]).select("qid", "rank", "chunk_id", "score")


def counted_terms(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys (whole numbers), dl, terms and counts: how often each wanted term (a hash) stands in each row's `terms`."""
    n = wanted.count()
    known = np.sort(wanted.toPandas().term.to_numpy(np.int64)) if n <= 20 * BROADCAST_ROWS else None  # beyond that all terms stay
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # as flat arrays: no object a row
            lists = batch.column("terms")
            begin = lists.offsets.to_numpy()
            sizes = np.diff(begin).astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]]
            row = np.repeat(np.arange(len(sizes)), sizes)
            if (terms := shared.value) is not None:
                at = np.searchsorted(terms, flat)
                held = np.zeros(len(flat), bool) if not len(terms) else terms[np.minimum(at, len(terms) - 1)] == flat
                flat, row = flat[held], row[held]
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(flat))).astype(np.int32)
            cut = pa.array(np.searchsorted(row[first], np.arange(len(sizes) + 1)).astype(np.int32))
            columns = [pa.array(sizes), pa.ListArray.from_arrays(cut, pa.array(flat[first])), pa.ListArray.from_arrays(cut, pa.array(counts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], [*keys, "dl", "terms", "counts"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "terms").mapInArrow(count, f"{', '.join(f'{c} {kinds[c]}' for c in keys)}, dl long, terms array<long>, counts array<int>")


def hashed_terms(text: Column) -> Column:
    return F.transform(search_terms(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))


def term_counts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id, dl, terms and counts of the wanted terms (hashes) in chunks (chunk_id, text). One pass over the texts."""
    return counted_terms(chunks.select("chunk_id", hashed_terms(F.col("text")).alias("terms")), wanted, ["chunk_id"])


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, counted: DataFrame | None = None) -> DataFrame:
    """qid, rank, chunk_id, score. chunks: chunk_id, text; queries: qid, text.

    A term that a query repeats counts as often. Queries that share a term with fewer than k chunks are filled up with others by
    chunk_id. Texts are read once, for the counts of the queries' terms, from which document frequencies, lengths and scores follow;
    `counted` hands in the settled counts of an earlier search with the same terms. Scores never become a row a pair: each task adds them up for blocks of
    queries and keeps k a query.
    """
    terms = asked_terms(queries)
    counted = settled(term_counts(chunks, terms.select("term").distinct())) if counted is None else counted
    one = counted.withColumn("corpus", F.lit(0))
    every = settled(_weighted(one, terms, queries, [0]).drop("corpus"))
    average = one.agg(F.avg("dl")).first()[0] or 1.0
    return _over_all(counted.withColumn("average", F.lit(average)), every, *_bm25(k1, b), k)


def asked_terms(queries: DataFrame) -> DataFrame:
    """qid, term (a hash), qtf of queries (qid, text), settled."""
    asked = queries.select("qid", F.explode(hashed_terms(F.col("text"))).alias("term"))
    return settled(asked.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _weighted(counted: DataFrame, terms: DataFrame, queries: DataFrame, corpora: list[int]) -> DataFrame:
    """corpus, qid, terms and w (their weights) of each query in each corpus; null where a corpus has none of its terms."""
    sizes = counted.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    df = counted.select("corpus", F.explode("terms").alias("term")).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(sizes), "corpus")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    listed = terms.join(df, "term").select("corpus", "qid", "term", (idf * F.col("qtf")).alias("w")).groupBy("corpus", "qid").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w"))
    return queries.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, corpora))).alias("corpus")).join(listed, ["corpus", "qid"], "left")


def bm25_by_corpus(counted: DataFrame, queries: DataFrame, k: int, corpora: list[int], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """corpus, qid, rank, chunk_id, score: what bm25_top_k gives over each corpus by itself, in one search. counted: corpus, chunk_id, dl, terms,
    counts, as counted_terms makes them for the queries' terms; corpora: the numbers, from 0."""
    terms = asked_terms(queries)
    counted = settled(counted)
    average = F.greatest(F.avg("dl"), F.lit(1e-9))
    rows = counted.join(F.broadcast(counted.groupBy("corpus").agg(average.alias("average"))), "corpus")
    found = _meeting(rows, _weighted(counted, terms, queries, corpora), *_bm25(k1, b), k, max(1, queries.count()), len(corpora))
    return ranked(found, k, ["corpus", "qid"], [F.col("score").desc(), F.col("chunk_id")]).select("corpus", "qid", "rank", "chunk_id", "score")


def _bm25(k1: float, b: float) -> tuple:
    """How queries (qid, terms, w) become blocks, and rows (chunk_id, dl, terms, counts, average) scores of a block."""

    def blocks(frame: pd.DataFrame) -> list:
        out = []
        for at in range(0, len(frame), BLOCK):
            own = frame.iloc[at : at + BLOCK]
            sizes = [0 if t is None else len(t) for t in own.terms]
            flat = np.concatenate([*(t for t in own.terms if t is not None), np.zeros(0, np.int64)]).astype(np.int64)
            w = np.concatenate([*(x for x in own.w if x is not None), np.zeros(0)])
            order = np.argsort(flat, kind="stable")
            named, first = np.unique(flat[order], return_index=True)
            out.append((own.qid.to_numpy(), (len(own), named, np.append(first, len(flat)), np.repeat(np.arange(len(own)), sizes)[order], w[order])))
        return out

    def score(part: pd.DataFrame):
        sizes = part.terms.str.len().to_numpy(np.int64)
        term = np.concatenate([*part.terms, np.zeros(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([*part.counts, np.zeros(0)]).astype(np.float64)
        row = np.repeat(np.arange(len(part)), sizes)
        order = np.argsort(term, kind="stable")
        term, row = term[order], row[order]
        gain = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.repeat(part.dl.to_numpy() / part.average.to_numpy(), sizes))))[order]
        held, first = np.unique(term, return_index=True)
        last = np.append(first, len(term))

        def ready(wanted) -> np.ndarray:
            n_queries, named, begin, query, w = wanted
            scores = np.zeros((n_queries, len(part)))
            _, mine, theirs = np.intersect1d(held, named, assume_unique=True, return_indices=True)
            for i, j in zip(mine, theirs):
                here, there = slice(last[i], last[i + 1]), slice(begin[j], begin[j + 1])
                scores[np.ix_(query[there], row[here])] += np.outer(w[there], gain[here])
            return scores

        return ready

    return blocks, score


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, chunk_id, score by inner product, exactly. vectors: chunk_id, vec; queries: qid, vec.

    Every task keeps its own k best a query while the vectors pass.
    """

    def blocks(frame: pd.DataFrame) -> list:
        parts = (frame.iloc[at : at + BLOCK] for at in range(0, len(frame), BLOCK))
        return [(own.qid.to_numpy(), np.stack(own.vec.to_numpy()).astype(np.float64)) for own in parts]

    def score(part: pd.DataFrame):
        x = np.stack(part.vec.to_numpy()).astype(np.float64)
        return lambda wanted: wanted @ x.T

    return _over_all(vectors.select("chunk_id", "vec"), queries.select("qid", "vec"), blocks, score, k)


def rrf_fuse(lists: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """qid, rank, chunk_id, score: the sum of 1 / (rrf_k + rank) over the lists; ties by best rank, then chunk_id."""
    every = lists[0].select("qid", "chunk_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("qid", "chunk_id", "rank"))
    fused = every.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 10).alias("score"), F.min("rank").alias("best"))
    return ranked(fused, k, ["qid"], [F.col("score").desc(), F.col("best"), F.col("chunk_id")]).select("qid", "rank", "chunk_id", "score")


def reranked(pool: DataFrame, depths: list[int]) -> DataFrame:
    """qid, depth, rank, chunk_id: pools (qid, rank, chunk_id, pair_score) reordered at each depth; ties keep their order.

    The deepest pool is scored once, shallower ones are its heads.
    """
    heads = pool.select("qid", "chunk_id", "pair_score", F.col("rank").alias("dense_rank"), F.explode(F.array(*map(F.lit, depths))).alias("depth")).where(F.col("dense_rank") <= F.col("depth"))
    order = Window.partitionBy("qid", "depth").orderBy(F.col("pair_score").desc(), "dense_rank")
    return heads.withColumn("rank", F.row_number().over(order))


#: So many distinct answers are looked for at a time.
ANSWERS = 100_000
#: A task remembers what so many words hold.
WORDS, _NONE = 100_000, frozenset()


def _contexts(before: Column, word: Column, after: Column) -> list[Column]:
    """Keys of a word between two others: with the last characters of the one before and the first of the one after, two of each and one of each."""
    return [F.xxhash64(F.lit(m), word, F.right(before, F.lit(m)), F.left(after, F.lit(m))) for m in (2, 1)]


def answer_keys(pages: DataFrame, words: DataFrame) -> DataFrame:
    """qid, answer, word, key: each answer of three words or more (qid, answer, w: its words) under its rarest inner word on the pages, in its surroundings.

    The inner words, the second to the last but one, are whole words of any page that holds the answer. What stands beside one of them may be cut off
    at the answer's ends, so that the key has the nearest two characters on both sides, or the nearest one where a neighbour has no more.
    """
    inner = settled(words.where(F.size("w") >= 3).select("qid", "answer", "w", F.posexplode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("at", "word")))
    wanted = inner.select("word").distinct()
    often = pages.select(F.explode(F.split("page", " ")).alias("word")).join(hinted(settled(wanted)), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(hinted(settled(often)), "word", "left").groupBy("qid", "answer").agg(F.min_by(F.struct("w", "at", "word"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("x"))
    before, after = F.get("x.w", F.col("x.at")), F.get("x.w", F.col("x.at") + 2)
    two, one = _contexts(before, F.col("x.word"), after)
    return rarest.select("qid", "answer", F.col("x.word").alias("word"), F.when(F.least(F.length(before), F.length(after)) >= 2, two).otherwise(one).alias("key"))


def candidate_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, qid where the page has the answer's key at some place, once each."""
    rows = pages.select("doc_id", F.split("page", " ").alias("w")).where(F.size("w") >= 3)
    none = F.array(F.lit(None).cast("string"))
    beside = F.arrays_zip(F.concat(none, "w").alias("b"), F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w") - 1).alias("a"))
    places = rows.select("doc_id", F.inline(beside)).where("b IS NOT NULL AND a IS NOT NULL")
    held = places.join(hinted(settled(keys.select("word").distinct())), "word", "left_semi")  # a row a place only where an answer may be
    found = held.select("doc_id", F.explode(F.array(*_contexts(F.col("b"), F.col("word"), F.col("a")))).alias("key")).distinct()
    return found.join(hinted(settled(keys.select("qid", "key"))), "key").select("doc_id", "qid").distinct()


def hinted(df: DataFrame) -> DataFrame:
    """df, settled, marked for broadcasting if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def containing_documents(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, doc_id where the page holds the answer. pages: doc_id, page; answers: qid, answer; both normalised. An empty answer is held by none.

    Answers of three words or more meet pages on their rarest inner word in its surroundings, and only the pairs that do are compared. Shorter answers
    may lie within words: pages are read once for each group of at most about ANSWERS of them, all of which one automaton finds. Pages are made once and kept meanwhile;
    they stay where they are unless more pairs meet than are broadcast.
    """
    pages = settled(pages.select("doc_id", "page"))
    words = answers.where("answer <> ''").select("qid", "answer", F.split("answer", " ").alias("w"))
    keys = settled(answer_keys(pages, words))
    pairs = candidate_pages(pages, keys)
    found = pages.join(hinted(settled(pairs.join(keys.select("qid", "answer"), "qid"))), "doc_id").where(F.contains("page", F.col("answer"))).select("qid", "doc_id").distinct()

    short = settled(words.where(F.size("w") < 3).select("qid", "answer"))
    asked = settled(short.select("answer").distinct())
    n_groups = -(-asked.count() // ANSWERS)
    for group in range(n_groups):
        own = [r.answer for r in asked.where(F.pmod(F.xxhash64("answer"), F.lit(n_groups)) == group).collect()]
        found = found.unionByName(settled(_within(pages, own)).join(short, "answer").select("qid", "doc_id"))
    return found


def _within(pages: DataFrame, answers: list[str]) -> DataFrame:
    """doc_id, answer: which of the answers stand in each page, also within words.

    Answers without a blank lie within one word: a task looks each distinct word up once, and remembers WORDS of them."""
    shared = pages.sparkSession.sparkContext.broadcast(answers)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        inside, across = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, answer in enumerate(shared.value):
            (across if " " in answer else inside).add_word(answer, i)
        inside.make_automaton()
        across.make_automaton()
        known: dict[str, set[int]] = {}

        def of(page: str) -> set[int]:
            found = {i for _, i in across.iter(page)} if len(across) else set()
            for word in set(page.split(" ")) if len(inside) else ():
                if (own := known.get(word)) is None:
                    if len(known) >= WORDS:
                        known.clear()
                    own = known[word] = {i for _, i in inside.iter(word)} or _NONE
                found |= own
            return found

        for frame in frames:
            held = [(d, i) for d, p in zip(frame.doc_id, frame.page) if isinstance(p, str) for i in of(p)]
            if held:
                yield pd.DataFrame({"doc_id": [d for d, _ in held], "answer": [shared.value[i] for _, i in held]})

    return pages.select("doc_id", "page").mapInPandas(find, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, answer string")


def gold_pages(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, pos, answer, doc_id: all pages that hold a question's answer, which is the first of its candidates that any page holds.

    pages: doc_id, page; candidates: qid, pos, answer; both normalised, empty candidates left out.
    """
    asked = candidates.where("answer <> ''")
    distinct = asked.select("answer").distinct().withColumn("qid", F.xxhash64("answer"))
    found = settled(containing_documents(pages, distinct).withColumnRenamed("qid", "key"))
    held = asked.withColumn("key", F.xxhash64("answer"))
    first = held.join(found.select("key").distinct(), "key").groupBy("qid").agg(F.min(F.struct("pos", "answer", "key")).alias("x")).select("qid", "x.*")
    return first.join(found, "key").select("qid", "pos", "answer", "doc_id")


def term_overlap(left: Column, right: Column) -> Column:
    """A model-free pair score: shared terms over all terms."""
    a, b = F.array_distinct(search_terms(left)), F.array_distinct(search_terms(right))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0)), 9)


def hard_negatives(pool: DataFrame, wanted: int = 7) -> DataFrame:
    """Training groups from pools (qid, rank, chunk_id, hit): the best-ranked hit, and the first `wanted` candidates that
    are no hits; questions with no hit or with fewer negatives are dropped."""
    no_hit = F.row_number().over(Window.partitionBy("qid", "hit").orderBy("rank"))
    kept = pool.withColumn("nth", no_hit).where((F.col("hit") & (F.col("nth") == 1)) | (~F.col("hit") & (F.col("nth") <= wanted)))
    negatives = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("rank", "chunk_id"))))
    groups = kept.groupBy("qid").agg(F.max(F.when(F.col("hit"), F.struct("rank", "chunk_id"))).alias("pos"), negatives.alias("negs"))
    groups = groups.where(F.col("pos").isNotNull() & (F.size("negs") == wanted))
    return groups.select("qid", F.col("pos.chunk_id").alias("pos"), F.col("pos.rank").alias("pos_rank"), F.transform("negs", lambda x: x["chunk_id"]).alias("negs"), F.transform("negs", lambda x: x["rank"]).alias("neg_ranks"))


def mining_stats(pool: DataFrame, wanted: int = 7) -> DataFrame:
    """questions, kept, dropped_no_positive, dropped_too_few_negatives of pools that training groups are mined from."""
    each = pool.groupBy("qid").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    has = F.col("pos") > 0
    return each.agg(F.count(F.lit(1)).alias("questions"), F.count_if(has & (F.col("neg") >= wanted)).alias("kept"), F.count_if(~has).alias("dropped_no_positive"), F.count_if(has & (F.col("neg") < wanted)).alias("dropped_too_few_negatives"))


def one_query(chunks: DataFrame, text: str, k: int = 20, shown: int = 5, pair_score=None) -> DataFrame:
    """rank, chunk_id, dense_rank: the serving path of one question: a pool of k, reordered by pair_score(text, question) if there is one, `shown` of it."""
    asked = chunks.sparkSession.range(1).select(F.lit(0).cast("long").alias("qid"), F.lit(text).alias("text"))
    pool = bm25_top_k(chunks, asked, k)
    if pair_score is None:
        return pool.where(F.col("rank") <= shown).select("rank", "chunk_id", F.col("rank").alias("dense_rank"))
    scored = pool.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("pair_score", pair_score(F.col("text"), F.lit(text)))
    return reranked(scored, [k]).where(F.col("rank") <= shown).select("rank", "chunk_id", "dense_rank")


def first_hit_rank(lists: DataFrame) -> DataFrame:
    """qid, first_rank (0 without a hit) of ranked lists (qid, rank, hit)."""
    return lists.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0)).alias("first_rank"))


def merged_first_hit(base: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """qid, first_rank (0 without one) of the first hit when a frozen top list (qid, pos, score) takes in new chunks (qid, pos, score, hit).

    Base chunks are of other documents: they are never hits, and go before new ones of equal score.
    """
    both = base.select("qid", "pos", "score", F.lit(0).alias("is_new"), F.lit(False).alias("hit")).unionByName(new.select("qid", "pos", "score", F.lit(1).alias("is_new"), "hit"))
    return first_hit_rank(ranked(both, depth, ["qid"], [F.col("score").desc(), F.col("is_new"), F.col("pos")]))


def pair_key(*texts: Column) -> Column:
    """What identifies a scored pair in a score table."""
    return F.sha1(F.concat_ws("\x1f", *texts).cast("binary"))


def pending_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs (with pair_key) that no score is kept for yet, each once."""
    return pairs.dropDuplicates(["pair_key"]).join(scores.select("pair_key"), "pair_key", "left_anti")


def swapped(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with the rows of the updated documents replaced by theirs."""
    return base.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)


def pool_cost(pools: DataFrame, depths: list[int]) -> DataFrame:
    """depth, n_pairs: pairs to score up to each depth, of pools (qid, rank)."""
    sizes = pools.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.select("n", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return each.groupBy("depth").agg(F.sum(F.least("n", "depth")).alias("n_pairs"))


def first_contained(text: Column, candidates: Column) -> Column:
    """The first candidate that text holds, null without one."""
    return F.try_element_at(F.filter(candidates, lambda c: F.contains(text, c)), F.lit(1))
