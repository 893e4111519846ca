"""Text quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are texts labelled 1; the unlabelled sample is drawn from all texts, whatever their label. With the
class prior p, loss l and score g the risk is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

where the second term estimates the negatives' risk and is kept from going below 0: while it does, steps go against
its gradient. Labels of 0 are not used. The prior is estimated from positives and unlabelled texts alone: a scorer is fitted to tell the
two apart on each half in turn, and on the other half the prior is at most the ratio of the unlabelled texts to the
positives above any score, since above it the unlabelled hold that share of all positives at least; the ratio that is least with its margin of error is taken.
The scorer is logistic, over shares of byte classes, of pairs of neighbouring classes, and of repeated words and lines, of the whole text.

The samples are bounded by MOST_POSITIVE and MOST_UNLABELLED rows, chosen by hash.

Defined results: null and empty texts have all features 0, and get a score like others; with no positive or no unlabelled text
every score is 0.5; rows that repeat a doc_id, or have none, are scored one by one; an empty table gives an empty table; columns of docs
named as the added ones are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns


MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
EPOCHS, RATE, DECAY = 400, 0.05, 1e-4

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",;:", "!?", "'\"", "|", "%$#&*@^~", "()[]{}<>", "-_/\\+=`"]
_CLASS = np.full(256, len(_GROUPS), np.int64)  # what is not listed
for _k, _g in enumerate(_GROUPS):
    _CLASS[[*_g.encode()]] = _k
_CLASS[128:] = len(_GROUPS) + 1  # parts of characters beyond ASCII
N_CLASSES = len(_GROUPS) + 2
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 5


def features(texts: list[str]) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for k, t in enumerate(texts):
        data = t.encode("utf-8")
        n = len(data)
        if n:
            kinds = _CLASS[np.frombuffer(data, np.uint8)]
            out[k, :N_CLASSES] = np.bincount(kinds, minlength=N_CLASSES) / n
            if n > 1:
                out[k, N_CLASSES:-5] = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES**2) / (n - 1)
            words, lines = t.split(), t.split("\n")
            seen = [x for x in lines if x]
            out[k, -5:] = (sum(map(str.__eq__, words, words[1:])) / max(len(words), 1), np.log1p(n) / 10, n / (len(words) + 1) / 10, len(set(words)) / max(len(words), 1), len(set(seen)) / max(len(seen), 1))
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-6, 6) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-z.astype(np.float64).clip(-60, 60)))


def _slope(x: np.ndarray, theta: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
    """The mean logistic loss of sign x score, and its gradient."""
    z = sign * (x @ theta[:-1] + theta[-1])
    pull = -sign / (1.0 + np.exp(z.clip(-60, 60)))
    return float(np.logaddexp(0, -z).mean()), np.append(pull @ x, pull.sum()) / len(x)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, theta: np.ndarray) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk, the gradient to step against, and whether the negatives' part had to be kept from below 0."""
    loss_up, up = _slope(positive, theta, 1.0)
    loss_p, down_p = _slope(positive, theta, -1.0)
    loss_u, down_u = _slope(unlabelled, theta, -1.0)
    negative = loss_u - prior * loss_p
    if negative < 0:
        return prior * loss_up, prior * down_p - down_u, True
    return prior * loss_up + negative, prior * up + down_u - prior * down_p, False


def _descended(gradient, n: int, decay: float = DECAY) -> np.ndarray:
    """Full-batch gradient steps with momentum-scaled rates (Adam) from zero."""
    theta, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, EPOCHS + 1):
        g = gradient(theta)
        g[:n] += decay * theta[:n]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    return mean, scale, *(((x - mean) / scale).clip(-6, 6).astype(np.float64) for x in (positive, unlabelled))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3, doubt: float = 0.05) -> float:
    """The share of positives among the unlabelled.

    A row's place is the share of the other half's positives that score below it. Above any place the unlabelled hold the prior's share of the positives
    there at least, so that the ratio of what lies above bounds the prior; the place whose ratio is least with its margin of error counts, of those that at least a
    share `least` of the positives reach. Ratios of few rows, which may be low by chance, have wide margins.
    """
    _, _, xp, xu = _scaled(positive, unlabelled)
    place_p, place_u = np.zeros(len(xp)), np.zeros(len(xu))
    if len(xp) < 2 or len(xu) < 2:
        return 0.5
    for half in (0, 1):
        theta = _descended(lambda t: _slope(xp[half::2], t, 1.0)[1] + _slope(xu[half::2], t, -1.0)[1], xp.shape[1], 100 * DECAY)
        p, u = (x[1 - half :: 2] @ theta[:-1] + theta[-1] for x in (xp, xu))
        known = np.sort(p)
        place_p[1 - half :: 2], place_u[1 - half :: 2] = (np.searchsorted(known, s, side="right") / len(known) for s in (p, u))
    levels = np.linspace(0, 1 - least, 71)
    above_p, above_u = (np.array([(place >= c).mean() for c in levels]) for place in (place_p, place_u))
    ratio = above_u / above_p
    margin = np.sqrt(np.log(2 / doubt) / 2) * (1 / np.sqrt(len(xu)) + ratio / np.sqrt(len(xp))) / above_p
    return float(np.clip(ratio[(ratio + margin).argmin()], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Minimises the non-negative risk."""
    mean, scale, xp, xu = _scaled(positive, unlabelled)
    theta = _descended(lambda t: risk(xp, xu, prior, t)[1], xp.shape[1])
    return Scorer(mean, scale, theta[:-1].astype(np.float32), float(theta[-1]))


def learn_quality(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs: doc_id, text; labels: doc_id, quality, of rows that may be learnt from."""

    def sample(ids: DataFrame, most: int) -> np.ndarray:
        chosen = ids.select(F.xxhash64("doc_id").alias("h"), "doc_id").distinct().orderBy("h", "doc_id").limit(most)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")

        def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"h": f.h, "x": list(features(f.text.fillna("").tolist()))})

        measures = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInPandas(measured, "h long, x array<float>")
        x = measures.orderBy("h").limit(most).toPandas().x  # ids may repeat, so that rows are bounded too
        return np.stack(x) if len(x) else np.zeros((0, N_FEATURES), np.float32)

    positive = sample(labels.where("quality = 1 AND doc_id IS NOT NULL"), MOST_POSITIVE)
    unlabelled = sample(docs.where("doc_id IS NOT NULL"), MOST_UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES, np.float32), 0.0)
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def scored(docs: DataFrame, scorer: Scorer, least: float = 0.7) -> DataFrame:
    """docs' columns with score and predicted; reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # some thousand numbers

    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            own = texts.fillna("").tolist()
            parts = [shared.value.scores(features(own[i : i + 2000])) for i in range(0, len(own), 2000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    judge = F.pandas_udf(score, "double")
    out = docs.select(kept_columns(docs, "score", "predicted").alias("own"), judge("text").alias("score"))
    return out.select("own.*", "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
