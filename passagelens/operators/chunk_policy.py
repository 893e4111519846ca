"""A chunker trained on retrieval itself: sampled cuts are rewarded by where the answer's chunk ranks, against the cuts that the policy would make greedily.

The corpus stays frozen in a reference chunking: each question's best base chunks are searched once and kept. When some documents are cut anew, their
own chunks leave the kept lists, the new chunks are ranked for the questions of these documents alone, and the two lists are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..sources.scratch import settled
from .chunking import choices, sampled_spans, semantic_window, spans_to_texts, target_spans
from .metrics import reciprocal
from .retrieval import dense_top_k, merged_first_hit
from .sequence_model import SequenceModel, _arrays, _groups, _sigmoid, sequence_probs
from .training import Adam, State, run, tree_sum


@dataclass
class FrozenCorpus:
    """chunks: chunk_id, doc_id, vec; questions: qid, doc_id (the gold document), answer (normalised), vec; lists: qid, pos, chunk_id, doc_id, score, the
    best `kept` chunks of each question."""

    chunks: DataFrame
    questions: DataFrame
    lists: DataFrame
    depth: int
    kept: int


def freeze(chunks: DataFrame, questions: DataFrame, depth: int = 10, spare: int = 20) -> FrozenCorpus:
    """One search of all chunks. Lists are `spare` longer than what is looked at, so that they outlast the chunks that leave."""
    top = dense_top_k(chunks, questions, depth + spare).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    lists = settled(top.select("qid", F.col("rank").alias("pos"), "chunk_id", "doc_id", "score"))
    return FrozenCorpus(chunks, questions, lists, depth, depth + spare)


def swapped_lists(corpus: FrozenCorpus, updated: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, pos, chunk_id, score of the base chunks that count for the questions asked while the documents of `updated` (doc_id) are cut anew.

    A list that has lost too many of its chunks is searched again over the documents that stay; the others are read.
    """
    own = corpus.lists.join(asked.select("qid"), "qid", "left_semi")
    left = settled(own.join(updated, "doc_id", "left_anti").select("qid", "pos", "chunk_id", "score"))
    full = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == corpus.kept)
    short = full.join(left.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid", "left").where(F.coalesce("m", F.lit(0)) < corpus.depth)
    again = settled(asked.join(short.select("qid"), "qid", "left_semi").select("qid", "vec"))
    if again.isEmpty():
        return left
    found = dense_top_k(corpus.chunks.join(updated, "doc_id", "left_anti"), again, corpus.depth)
    return left.join(again.select("qid"), "qid", "left_anti").unionByName(found.select("qid", F.col("rank").alias("pos"), "chunk_id", "score"))


def rewards(corpus: FrozenCorpus, cut: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """doc_id, reward of documents cut anew (doc_id, chunks: texts): the mean over a document's questions of 1 / rank of the first of its chunks that holds
    the answer, within the depth; 0 beyond. Documents without questions have none, but their chunks compete."""
    cut = settled(cut.select("doc_id", F.posexplode("chunks").alias("at", "text")).withColumns({"vec": encode(F.col("text")), "chunk_id": F.monotonically_increasing_id()}))
    updated = cut.select("doc_id").distinct()
    asked = settled(corpus.questions.join(updated, "doc_id", "left_semi"))
    base = swapped_lists(corpus, updated, asked)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id", "at")
    new = dense_top_k(cut, asked, corpus.depth).join(cut.select("chunk_id", "at", "text", F.col("doc_id").alias("source")), "chunk_id").join(asked.select("qid", "doc_id", "answer"), "qid")
    hit = (F.col("source") == F.col("doc_id")) & F.contains(normalize_text(F.col("text")), F.col("answer"))
    ranked = new.withColumns({"pos": F.row_number().over(order), "hit": hit}).select("qid", "pos", "score", "hit")
    first = merged_first_hit(base, ranked, corpus.depth)
    each = asked.join(first, "qid", "left").withColumn("value", reciprocal(F.coalesce("first_rank", F.lit(0))))
    return each.groupBy("doc_id").agg(F.avg("value").alias("reward"))


def choice_gradient(z: np.ndarray, cuts: list[tuple[int, int, int]], advantage: float, entropy_share: float, temperature: float) -> tuple[float, np.ndarray, float]:
    """Loss, its gradient by logit, and the mean entropy of one document's cuts (first place, last place, chosen).

    The loss is -advantage times the summed log-probability of the choices, less entropy_share times the mean entropy of the windows that had a choice.
    """
    d, log_prob, entropies = np.zeros_like(z), 0.0, []
    open_ = [(lo, hi, at) for lo, hi, at in cuts if hi > lo]
    for lo, hi, at in open_:
        w = z[lo : hi + 1] / temperature
        log_p = w - w.max() - np.log(np.exp(w - w.max()).sum())
        p = np.exp(log_p)
        h = -(p * log_p).sum()
        log_prob += log_p[at - lo]
        entropies.append(h)
        step = -p
        step[at - lo] += 1
        d[lo : hi + 1] += (-advantage * step + entropy_share / len(open_) * p * (log_p + h)) / temperature
    h = float(np.mean(entropies)) if entropies else 0.0
    return -advantage * log_prob - entropy_share * h, d, h


def train_chunker(docs: DataFrame, corpus: FrozenCorpus, encode: Callable[[Column], Column], model: SequenceModel, start: np.ndarray, *, steps: int, rate: float, target: int = 6, overlap: int = 0, temperature: float = 1.0, entropy_share: float = 0.01, clip: float = 1.0, batches: int = 1, path: str | None = None) -> State:
    """docs: doc_id, sentences, vecs. Each step takes the documents of one batch, by a hash, that some question asks about: their logits, a greedy and a drawn
    cut, the rewards of both over the frozen corpus, and the gradient of the drawn cuts weighed by reward above the greedy one's.

    Draws follow from document and step. The log has reward_greedy, reward_sample, advantage, entropy and loss of the weights before each step.
    """
    spark, (least, most) = docs.sparkSession, semantic_window(target)
    answerable = docs.join(corpus.questions.select("doc_id").distinct(), "doc_id", "left_semi").where(F.size("sentences") >= 2)
    docs = settled(answerable.select("doc_id", "sentences", "vecs", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("bucket")), ["bucket"])
    n = F.size("sentences")

    def step(weights: np.ndarray, number: int) -> tuple[np.ndarray, dict[str, float]]:
        batch = sequence_probs(docs.where(F.col("bucket") == number % batches), model, weights)
        seed = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(number)))
        cut = settled(batch.withColumns({"greedy": target_spans(F.col("probs"), n, target, least, most, overlap), "drawn": sampled_spans(F.col("probs"), n, target, least, most, overlap, seed, temperature)}))
        got = {side: rewards(corpus, cut.select("doc_id", spans_to_texts(F.col("sentences"), F.col(side)).alias("chunks")), encode) for side in ("greedy", "drawn")}
        both = got["greedy"].withColumnRenamed("reward", "g").join(got["drawn"].withColumnRenamed("reward", "s"), "doc_id")
        rows = settled(cut.select("doc_id", "vecs", choices(F.col("drawn"), n, least, most).alias("cuts")).join(both, "doc_id"))

        def sums(frame: pd.DataFrame) -> np.ndarray:
            out = np.zeros(5 + model.size)
            vecs = _arrays(frame.vecs)
            for own in _groups(np.array([len(v) for v in vecs])):
                z, size, kept = model.forward(weights, [vecs[k] for k in own])
                dz = np.zeros_like(z)
                for lane, k in enumerate(own):
                    row = frame.iloc[k]
                    loss, d, h = choice_gradient(z[: size[lane] - 1, lane], [(c["lo"], c["hi"], c["chosen"]) for c in row.cuts], row.s - row.g, entropy_share, temperature)
                    dz[: size[lane] - 1, lane] = d
                    out[:5] += 1, loss, row.g, row.s, h
                out[5:] += model.backward(weights, kept, dz)
            return out

        t = tree_sum(rows, sums, 5 + model.size)
        m = max(t[0], 1.0)
        return t[5:] / m, {"loss": t[1] / m, "reward_greedy": t[2] / m, "reward_sample": t[3] / m, "advantage": (t[3] - t[2]) / m, "entropy": t[4] / m}

    adam = Adam(rate, clip=clip)
    state = (State.restored(spark, path, adam) if path else None) or State(start, adam, start)
    return run(state, step, steps, keep=(lambda s: s.keep(spark, path)) if path else None)


def policy_chunks(docs: DataFrame, model: SequenceModel, weights: np.ndarray, target: int = 6, overlap: int = 0) -> DataFrame:
    """doc_id, chunks: the texts of the policy's greedy cuts of documents (doc_id, sentences, vecs)."""
    least, most = semantic_window(target)
    spans = target_spans(F.col("probs"), F.size("sentences"), target, least, most, overlap)
    return sequence_probs(docs, model, weights).select("doc_id", spans_to_texts(F.col("sentences"), spans).alias("chunks"))
