"""A recurrent boundary model: a bidirectional LSTM over a document's sentence vectors, with a linear head on neighbouring states.

Each task runs its documents forward and back in groups of like length; only sums of losses and gradients leave it. A row is a document:
vecs (its sentences' vectors in order) and labels (one fewer; 1 where a boundary follows). Documents of fewer than two sentences have no boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .training import Adam, State, run, tree_sum

#: Sentences, with the padding, that are run at once; longer documents go alone.
CELLS = 8_192


class SequenceModel:
    """Weights are one flat array, so that they can be summed, kept and stepped as one."""

    def __init__(self, dim: int, hidden: int):
        self.dim, self.hidden = dim, hidden
        self.shapes = [s for _ in range(2) for s in ((4 * hidden, dim), (4 * hidden, hidden), (4 * hidden,))] + [(4 * hidden,), (1,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def start(self, seed: int = 0) -> np.ndarray:
        bound = 1 / np.sqrt(self.hidden)
        return np.random.default_rng(seed).uniform(-bound, bound, self.size)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), self.shapes)]

    def _forward(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of one direction, and what going back needs."""
        time, batch, _ = x.shape
        given = x @ wx.T + b
        h, c = np.zeros((batch, self.hidden)), np.zeros((batch, self.hidden))
        states, tape = np.empty((time, batch, self.hidden)), []
        for t in range(time):
            z = given[t] + h @ wh.T
            i, f, g, o = np.split(z, 4, axis=1)
            i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            tape.append((h, before, i, f, g, o, squashed))
            h = o * squashed
            states[t] = h
        return states, tape

    def _back(self, x: np.ndarray, wh: np.ndarray, tape: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of wx, wh and b, from those of the states."""
        dwx, dwh, db = np.zeros((4 * self.hidden, self.dim)), np.zeros((4 * self.hidden, self.hidden)), np.zeros(4 * self.hidden)
        dh, dc = np.zeros_like(given[0]), np.zeros_like(given[0])
        for t in range(len(tape) - 1, -1, -1):
            h, before, i, f, g, o, squashed = tape[t]
            dh = dh + given[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g**2), dh * squashed * o * (1 - o)], axis=1)
            dwx += dz.T @ x[t]
            dwh += dz.T @ h
            db += dz.sum(axis=0)
            dh, dc = dz @ wh, dc * f
        return dwx, dwh, db

    def _padded(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (time, batch, dim), lengths, and where each document's sentences stand when read from its end."""
        size = np.array([len(d) for d in docs])
        x = np.zeros((size.max(), len(docs), self.dim))
        for k, d in enumerate(docs):
            x[: len(d), k] = d
        t = np.arange(len(x))[:, None]
        return x, size, np.where(t < size, size - 1 - t, t)

    def forward(self, flat: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Logits (boundary, document), the number of sentences of each document, and what going back needs; places beyond a document mean nothing."""
        x, size, turned = self._padded(docs)
        p, lane = self.parts(flat), np.arange(x.shape[1])
        ahead, tape = self._forward(x, *p[:3])
        reverse = x[turned, lane]
        back, tape_back = self._forward(reverse, *p[3:6])
        both = np.concatenate([ahead, back[turned, lane]], axis=2)
        pairs = np.concatenate([both[:-1], both[1:]], axis=2)
        return pairs @ p[6] + p[7], size, (x, reverse, turned, pairs, tape, tape_back)

    def backward(self, flat: np.ndarray, kept: tuple, dz: np.ndarray) -> np.ndarray:
        """The weights' gradient, from that of the logits; 0 at places beyond a document."""
        x, reverse, turned, pairs, tape, tape_back = kept
        p, lane, h = self.parts(flat), np.arange(x.shape[1]), self.hidden
        dpairs = dz[:, :, None] * p[6]
        dboth = np.zeros((*x.shape[:2], 2 * h))
        dboth[:-1] += dpairs[:, :, : 2 * h]
        dboth[1:] += dpairs[:, :, 2 * h :]
        ahead = self._back(x, p[1], tape, dboth[:, :, :h])
        back = self._back(reverse, p[4], tape_back, dboth[:, :, h:][turned, lane])
        own = [*ahead, *back, np.tensordot(dz, pairs, axes=([0, 1], [0, 1])), np.array([dz.sum()])]
        return np.concatenate([g.ravel() for g in own])

    def logits(self, flat: np.ndarray, docs: list[np.ndarray]) -> list[np.ndarray]:
        z, size, _ = self.forward(flat, docs)
        return [z[: n - 1, k] for k, n in enumerate(size)]

    def loss(self, flat: np.ndarray, docs: list[np.ndarray], labels: list[np.ndarray], weight: float, with_gradient: bool = True) -> np.ndarray:
        """Summed loss, boundaries, and the summed gradient (zeros if not wanted): cross-entropy in which a positive counts `weight` times."""
        z, _, kept = self.forward(flat, docs)
        y, mask = np.zeros_like(z), np.zeros_like(z)
        for k, own in enumerate(labels):
            y[: len(own), k], mask[: len(own), k] = own, 1
        total = (mask * (weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z))).sum()
        p = _sigmoid(z)
        dz = mask * (weight * y * (p - 1) + (1 - y) * p)
        return np.concatenate([[total, mask.sum()], self.backward(flat, kept, dz) if with_gradient else np.zeros(self.size)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of documents of two sentences or more, in groups of like length of about CELLS sentences with the padding."""
    group: list[int] = []
    for k in np.argsort(sizes, kind="stable"):
        if sizes[k] < 2:
            continue
        if group and (len(group) + 1) * sizes[k] > CELLS:
            yield np.array(group)
            group = []
        group.append(k)
    if group:
        yield np.array(group)


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.array([np.asarray(v, float) for v in rows]) if rows is not None and len(rows) else np.zeros((0, 0)) for rows in column]


def pos_weight(docs: DataFrame) -> float:
    """Negatives a positive of the labels; 1 where that is undefined."""
    pos = F.aggregate("labels", F.lit(0), lambda a, x: a + x)
    r = docs.agg(F.sum(pos).alias("pos"), F.sum(F.size("labels") - pos).alias("neg")).first()
    return float(r.neg / r.pos) if r.pos and r.neg else 1.0


def fit_sequences(docs: DataFrame, dim: int, hidden: int = 16, *, epochs: int = 60, rate: float = 0.02, patience: int = 3, least_gain: float = 1e-4, seed: int = 0, path: str | None = None) -> tuple[SequenceModel, State]:
    """docs: vecs, labels, held (whether a document is for validation). Each epoch is one pass over all of them: the gradient of the others' mean loss,
    and the held documents' mean loss, which decides when to stop and which weights are best (the others' where none is held). With a path, an interrupted run goes on
    from its last epoch."""
    model, spark = SequenceModel(dim, hidden), docs.sparkSession
    docs = settled(docs.where(F.size("vecs") >= 2).select("vecs", "labels", "held"))
    weight = pos_weight(docs.where("NOT held"))

    def epoch(weights: np.ndarray, _: int) -> tuple[np.ndarray, dict[str, float]]:
        def sums(frame: pd.DataFrame) -> np.ndarray:
            out = np.zeros(4 + model.size)
            vecs, labels, held = _arrays(frame.vecs), [np.asarray(y, float) for y in frame.labels], frame.held.to_numpy(bool)
            sizes = np.array([len(v) for v in vecs])
            for side in (False, True):
                for own in _groups(np.where(held == side, sizes, 0)):
                    got = model.loss(weights, [vecs[k] for k in own], [labels[k] for k in own], weight, with_gradient=not side)
                    out[2 * side : 2 * side + 2] += got[:2]
                    out[4:] += got[2:]
            return out

        total = tree_sum(docs, sums, 4 + model.size)
        train, val = total[0] / max(total[1], 1), total[2] / max(total[3], 1)
        return total[4:] / max(total[1], 1), {"train_loss": train, "val_loss": val, "watched": val if total[3] else train}

    adam = Adam(rate)
    state = (State.restored(spark, path, adam) if path else None) or State(model.start(seed), adam, model.start(seed))
    return model, run(state, epoch, epochs, patience=patience, least_gain=least_gain, keep=(lambda s: s.keep(spark, path)) if path else None)


def sequence_probs(docs: DataFrame, model: SequenceModel, weights: np.ndarray) -> DataFrame:
    """docs with probs: for each sentence but the last, how likely a boundary follows."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            vecs = _arrays(column)
            out: list[np.ndarray] = [np.zeros(0)] * len(vecs)
            for own in _groups(np.array([len(v) for v in vecs])):
                for k, z in zip(own, model.logits(shared.value, [vecs[k] for k in own])):
                    out[k] = _sigmoid(z)
            yield pd.Series(out)

    return docs.withColumn("probs", F.pandas_udf(score, "array<double>")("vecs"))
