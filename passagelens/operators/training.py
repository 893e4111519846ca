"""Training on the driver's weights with gradients summed where the rows are: one pass over a table a step.

A pass sends the weights to all tasks; each task returns one row of sums, and such rows are added up in rounds of FAN, so that the driver meets at
most FAN of them however many tasks there are. Rows of one round are added in the order of their tasks: the same table gives the same weights again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import commit, current

#: Rows of sums that are added up at once.
FAN = 64


def tree_sum(rows: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray], size: int, fan: int = FAN) -> np.ndarray:
    """The sum of sums(batch), arrays of `size` numbers, over all batches of rows."""

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for frame in frames:
            total += sums(frame)
        yield pd.DataFrame({"v": [total]})

    def of_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sorted(((row.at, row.v) for frame in frames for row in frame.itertuples(index=False)), key=lambda x: x[0])  # about fan rows
        if own:
            yield pd.DataFrame({"v": [np.sum([v for _, v in own], axis=0)]})

    parts, n = rows.mapInPandas(of_task, "v array<double>"), rows.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.withColumn("at", F.spark_partition_id()).repartition(n, F.floor(F.col("at") / fan)).mapInPandas(of_rows, "v array<double>")
    return np.sum([np.zeros(size), *(np.array(r.v) for r in parts.collect())], axis=0)


@dataclass
class Adam:
    """Adam with decoupled weight decay, a bound on the gradient's length, and a rate that rises for `warmup` steps and then falls to 0 at
    `total` (no schedule without total)."""

    rate: float
    decay: float = 0.0
    clip: float = 0.0
    warmup: int = 0
    total: int = 0
    step: int = 0
    m: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scheduled(self) -> float:
        if not self.total:
            return self.rate
        if self.step < self.warmup:
            return self.rate * self.step / self.warmup
        return self.rate * max(0.0, (self.total - self.step) / max(1, self.total - self.warmup))

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if not len(self.m):
            self.m, self.v = np.zeros(len(weights)), np.zeros(len(weights))
        length = float(np.sqrt(gradient @ gradient))
        if self.clip and length > self.clip:
            gradient = gradient * (self.clip / length)
        rate = self.scheduled()
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient * gradient
        change = (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)
        return weights * (1 - rate * self.decay) - rate * change


@dataclass
class State:
    """What a run needs to go on: weights, the optimiser's moments, the best weights so far, and a row of figures a step."""

    weights: np.ndarray
    adam: Adam
    best: np.ndarray
    best_loss: float = float("inf")
    waited: int = 0
    log: list[dict[str, float]] = field(default_factory=list)

    def keep(self, spark: SparkSession, path: str) -> None:
        """As a new version of a table of one row."""
        a = self.adam
        names = sorted({name for row in self.log for name in row})
        log = [[float(row[name]) if name in row else None for name in names] for row in self.log]
        kept = (self.weights.tolist(), self.best.tolist(), self.best_loss, self.waited, a.step, a.m.tolist(), a.v.tolist(), names, log)
        columns = "weights array<double>, best array<double>, best_loss double, waited int, step int, m array<double>, v array<double>, names array<string>, log array<array<double>>"
        commit(spark.createDataFrame([kept], columns).coalesce(1), path)

    @classmethod
    def restored(cls, spark: SparkSession, path: str, adam: Adam) -> State | None:
        """The last kept state, with adam's settings; None if there is none."""
        table = current(spark, path)
        if table is None:
            return None
        r = table.first()
        adam.step, adam.m, adam.v = r.step, np.array(r.m), np.array(r.v)
        log = [{name: v for name, v in zip(r.names, row) if v is not None} for row in r.log]
        return cls(np.array(r.weights), adam, np.array(r.best), r.best_loss, r.waited, log)


def run(state: State, one_step: Callable[[np.ndarray, int], tuple[np.ndarray, dict[str, float]]], steps: int, *, patience: int = 0, least_gain: float = 1e-4, enough: Callable[[dict[str, float]], bool] | None = None, keep: Callable[[State], None] | None = None) -> State:
    """Steps until there are `steps` of them in the log.

    one_step(weights, number of the step) gives the gradient and figures of the weights as they were before the step. With patience, the
    weights of least `watched` (a figure) are kept as best, and the run ends when that many steps in a row have not made it less by least_gain.
    The run also ends where enough(figures) holds, before the weights move. keep(state) is called after each step.
    """
    while len(state.log) < steps and not (patience and state.waited >= patience):
        gradient, figures = one_step(state.weights, len(state.log))
        figures = {name: float(value) for name, value in figures.items()}
        state.log.append({"step": float(len(state.log)), **figures})
        if "watched" in figures and figures["watched"] < state.best_loss - least_gain:
            state.best, state.best_loss, state.waited = state.weights.copy(), figures["watched"], 0
        else:
            state.waited += 1
        if enough is not None and enough(figures):
            break
        state.weights = state.adam.moved(state.weights, gradient)
        if keep is not None:
            keep(state)
    return state
