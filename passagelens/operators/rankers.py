"""Trainers of a pair scorer on groups of candidates: listwise cross-entropy, and rewards of sampled rankings.

A row is a group: qid, x (the candidates' features, the positive's first) and held (whether it is for validation only). Each step is one pass in which
tasks send sums; held groups are ranked in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .training import Adam, State, run, tree_sum


class Scorer:
    """A linear score of features, or one of a hidden layer of tanh units; weights are one flat array."""

    def __init__(self, features: int, hidden: int = 0):
        self.features, self.hidden = features, hidden
        self.size = features if not hidden else hidden * (features + 2)

    def start(self, seed: int = 0) -> np.ndarray:
        return np.random.default_rng(seed).normal(0, 1 / np.sqrt(self.features), self.size) if self.hidden else np.zeros(self.size)

    def _parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, h = self.features, self.hidden
        return flat[: n * h].reshape(h, n), flat[n * h : n * h + h], flat[n * h + h :]

    def scores(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self.hidden:
            return x @ flat
        w, b, v = self._parts(flat)
        return np.tanh(x @ w.T + b) @ v

    def gradient(self, flat: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The weights' gradient, from that of the scores."""
        x, d = x.reshape(-1, self.features), d.ravel()
        if not self.hidden:
            return d @ x
        w, b, v = self._parts(flat)
        inner = np.tanh(x @ w.T + b)
        dz = d[:, None] * v * (1 - inner**2)
        return np.concatenate([(dz.T @ x).ravel(), dz.sum(axis=0), d @ inner])


def listwise(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each group (positive first), and its gradient by score."""
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    share = e / e.sum(axis=1, keepdims=True)
    loss = np.log(e.sum(axis=1)) + top[:, 0] - scores[:, 0]
    share[:, 0] -= 1
    return loss, share


def uniform(*keys: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that whole numbers decide, wherever and in whatever order they are drawn."""
    with np.errstate(over="ignore"):
        x = np.zeros((), np.uint64)
        for key in keys:
            x = (x ^ np.asarray(key).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def sampled_policy(scores: np.ndarray, noise: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient by score, mean reward and whether it is live, of each group, over rankings drawn by Plackett-Luce.

    noise: uniform numbers, groups by samples by candidates. A ranking's reward is the positive's reciprocal rank, its advantage what it has more than the
    mean of the group's others; the loss weighs with it the log-probability of the ranking as far as the positive.
    """
    z = scores / temperature
    order = np.argsort(-(z[:, None, :] - np.log(-np.log(noise))), axis=2, kind="stable")
    rank = (order == 0).argmax(axis=2) + 1
    reward = 1.0 / rank
    n = noise.shape[1]
    advantage = reward - (reward.sum(axis=1, keepdims=True) - reward) / (n - 1)
    placed = np.take_along_axis(np.broadcast_to(z[:, None, :], order.shape), order, axis=2)
    top = placed.max(axis=2, keepdims=True)
    left = np.cumsum(np.exp(placed - top)[:, :, ::-1], axis=2)[:, :, ::-1]  # what is not placed yet, at each place
    counts = np.arange(z.shape[1]) < rank[:, :, None]
    log_prob = (np.where(counts, placed - top - np.log(left), 0)).sum(axis=2)
    # A placed candidate loses its share at each place up to its own, as far as places count.
    taken = np.cumsum(np.where(counts, 1 / left, 0), axis=2) * np.exp(placed - top)
    by_place = counts - taken
    d = np.zeros_like(by_place)
    np.put_along_axis(d, order, by_place, axis=2)
    gradient = -(advantage[:, :, None] * d).mean(axis=1) / temperature
    return -(advantage * log_prob).mean(axis=1), gradient, reward.mean(axis=1), reward.max(axis=1) > reward.min(axis=1)


def first_rank(scores: np.ndarray) -> np.ndarray:
    """The positive's rank; equal scores don't count against it."""
    return 1 + (scores[:, 1:] > scores[:, :1]).sum(axis=1)


def _features(column: pd.Series) -> np.ndarray:
    return np.array([[np.asarray(f, float) for f in group] for group in column], float)


def train_ranker(groups: DataFrame, scorer: Scorer, *, steps: int, rate: float, method: str = "listwise", warmup: int = 0, decay: float = 0.0, clip: float = 1.0, batches: int = 1, samples: int = 8, temperature: float = 1.0, least_live: float = 0.0, seed: int = 0, start: np.ndarray | None = None, path: str | None = None) -> State:
    """Trains a scorer by `listwise` cross-entropy or as a `policy`, on groups of one width; others are left out by the caller.

    The log has, of the weights before each step: loss and greedy_rr (mean reciprocal rank of the positive) of the step's groups, held_rr of the
    held ones; a policy's reward and live (share of groups whose rankings disagree), below least_live of which it stops. With several batches
    a step reads one of them, by a hash of qid. A path makes the run resumable: it then has the same weights as one that was never interrupted.
    """
    if method not in ("listwise", "policy"):
        raise ValueError("method is listwise or policy")
    spark = groups.sparkSession
    bucket = F.when(F.col("held"), -1).otherwise(F.pmod(F.xxhash64("qid"), F.lit(batches))).cast("int")
    groups = settled(groups.select(F.xxhash64("qid").alias("key"), "x", "held", bucket.alias("bucket")), ["bucket"])

    def step(weights: np.ndarray, number: int) -> tuple[np.ndarray, dict[str, float]]:
        def sums(frame: pd.DataFrame) -> np.ndarray:
            out = np.zeros(7 + scorer.size)
            for held in (False, True):
                own = frame[frame.held.to_numpy(bool) == held]
                if not len(own):
                    continue
                x = _features(own.x)
                scores = scorer.scores(weights, x)
                greedy = (1.0 / first_rank(scores)).sum()
                if held:
                    out[5:7] += len(own), greedy
                    continue
                if method == "listwise":
                    loss, d = listwise(scores)
                    reward = live = np.zeros(len(own))
                else:
                    key = own.key.to_numpy(np.int64).view(np.uint64)[:, None, None]
                    at = np.arange(samples)[None, :, None] * scores.shape[1] + np.arange(scores.shape[1])[None, None, :]
                    loss, d, reward, live = sampled_policy(scores, uniform(np.array(seed), np.array(number), key, at), temperature)
                out[:5] += len(own), loss.sum(), greedy, reward.sum(), live.sum()
                out[7:] += scorer.gradient(weights, x, d)
            return out

        t = tree_sum(groups.where(F.col("bucket").isin(-1, number % batches)), sums, 7 + scorer.size)
        n = max(t[0], 1.0)
        figures = {"loss": t[1] / n, "greedy_rr": t[2] / n, "rate": adam.scheduled()} | ({"held_rr": t[6] / t[5]} if t[5] else {})
        return t[7:] / n, figures | ({"reward": t[3] / n, "live": t[4] / n} if method == "policy" else {})

    adam = Adam(rate, decay, clip, warmup, steps)
    first = scorer.start(seed) if start is None else start
    state = (State.restored(spark, path, adam) if path else None) or State(first, adam, first)
    enough = (lambda f: f["live"] < least_live) if method == "policy" else None
    return run(state, step, steps, enough=enough, keep=(lambda s: s.keep(spark, path)) if path else None)


def scored_groups(groups: DataFrame, scorer: Scorer, weights: np.ndarray) -> DataFrame:
    """qid, scores, rank (the positive's, greedily)."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = scorer.scores(weights, _features(frame.x)) if len(frame) else np.zeros((0, 1))
            yield pd.DataFrame({"qid": frame.qid, "scores": list(scores), "rank": first_rank(scores)})

    return groups.select("qid", "x").mapInPandas(score, f"qid {groups.schema['qid'].dataType.simpleString()}, scores array<double>, rank int")
