"""Kernel machines by random Fourier features (Rahimi and Recht, 2007), many fitted at once.

A machine separates a pair of classes for one setting (group of rows, C, gamma); all settings and pairs share each pass over the
rows, in which a task adds up the gradients of all machines, keyed by machine. The loss is C times the sum of squared hinges plus
half the squared weights. Steps divide the gradient by a matrix that bounds the curvature (1 + 2 C times the pair's Gram matrix,
sums of one matrix a class that the first pass makes), with momentum that restarts where it points uphill, so
that no step length has to be searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnwork.functions.batches import matrix, summed
from cairnwork.sources.shipping import ship


@dataclass(frozen=True)
class Setting:
    """Which rows train it (their group), the weight of errors, the kernel's width."""

    group: int
    c: float
    gamma: float


@dataclass(frozen=True)
class Machines:
    """weights: settings x pairs x (features + 1), the intercept last."""

    frequencies: np.ndarray  # features x dims, for gamma 1/2
    phases: np.ndarray
    classes: list[int]
    settings: list[Setting]
    weights: np.ndarray

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.classes)), 2))

    def mapped(self, v: np.ndarray, gamma: float) -> np.ndarray:
        return mapped(v, self.frequencies, self.phases, gamma)

    def margins(self, v: np.ndarray, setting: int) -> np.ndarray:
        """Rows x pairs; 0 or more is for the pair's first class."""
        return self.mapped(v, self.settings[setting].gamma) @ self.weights[setting].T

    def votes(self, v: np.ndarray, setting: int) -> np.ndarray:
        """Rows x classes."""
        first = self.margins(v, setting) >= 0
        out = np.zeros((len(v), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += first[:, k]
            out[:, j] += ~first[:, k]
        return out


def mapped(v: np.ndarray, frequencies: np.ndarray, phases: np.ndarray, gamma: float) -> np.ndarray:
    """Fourier features, and 1 for the intercept."""
    z = np.cos(v @ (frequencies.T * (2 * gamma) ** 0.5) + phases) * (2 / len(phases)) ** 0.5
    return np.c_[z, np.ones(len(v))]


def fit(rows: DataFrame, settings: list[Setting], dims: int, classes: list[int], features: int = 64, iterations: int = 30, seed: int = 42, tolerance: float = 1e-4) -> Machines:
    """rows: group, label, v (scaled already); they are read once for the Gram matrices and once an iteration.

    It ends after `iterations`, or when no weight moves by more than `tolerance` of the largest weight.
    """
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(size=(features, dims)), rng.uniform(0, 2 * np.pi, features)
    pairs = list(combinations(range(len(classes)), 2))
    kinds = list(dict.fromkeys((s.group, s.gamma) for s in settings))  # settings that share mapped rows
    width, at_class = features + 1, {c: k for k, c in enumerate(classes)}
    gram_shape, shape = (len(kinds), len(classes), width, width), (len(settings), len(pairs), width)
    rows = rows.select("group", "label", "v")

    def of_kinds(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Mapped rows and class numbers of a batch, a kind after the other."""
        group, labels, v = batch.column("group").to_numpy(), batch.column("label").to_pylist(), matrix(batch.column("v"))
        known = np.array([at_class.get(x, -1) for x in labels])
        for k, (g, gamma) in enumerate(kinds):
            own = (group == g) & (known >= 0)
            if own.any():
                yield k, mapped(v[own], frequencies, phases, gamma), known[own]

    def add_gram(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out = total.reshape(gram_shape)
        for k, z, of in of_kinds(batch):
            for c in np.unique(of):
                out[k, c] += z[of == c].T @ z[of == c]

    parts = rows.rdd.getNumPartitions()
    gram = summed(rows, int(np.prod(gram_shape)), add_gram, parts).reshape(gram_shape)
    bound = np.empty((*shape, width))
    own_weight = np.diag([1.0] * features + [1e-8])
    for s, setting in enumerate(settings):
        k = kinds.index((setting.group, setting.gamma))
        for p, (i, j) in enumerate(pairs):
            bound[s, p] = own_weight + 2 * setting.c * (gram[k, i] + gram[k, j])
    inverse = np.linalg.inv(bound)
    first, second = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
    weights = np.zeros(shape)
    ahead, pace = weights.copy(), 1.0
    members = [[s for s, setting in enumerate(settings) if (setting.group, setting.gamma) == kind] for kind in kinds]
    for _ in range(iterations if pairs else 0):
        now = ahead

        def add(total: np.ndarray, batch: pa.RecordBatch, now: np.ndarray = now) -> None:
            out = total.reshape(shape)
            for k, z, of in of_kinds(batch):
                sign = (of[:, None] == first).astype(float) - (of[:, None] == second)
                for s in members[k]:
                    short = z @ now[s].T - sign
                    short *= (sign != 0) & (short * sign < 0)
                    out[s] += short.T @ z

        slope = 2 * np.array([s.c for s in settings])[:, None, None] * summed(rows, int(np.prod(shape)), add, parts).reshape(shape)
        slope += now * np.diag(own_weight)
        after = now - np.einsum("spij,spj->spi", inverse, slope)
        step = after - weights
        uphill = (slope * step).sum(-1, keepdims=True) > 0
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = after + np.where(uphill, 0.0, (pace - 1) / next_pace) * step
        weights, pace = after, next_pace
        if np.abs(step).max() <= tolerance * max(np.abs(weights).max(), 1e-12):
            break
    return Machines(frequencies, phases, list(classes), list(settings), weights)


def predict(rows: DataFrame, key: str, machines: Machines) -> DataFrame:
    """setting, key, truth, pred: each row by every setting of its group, all in one pass. rows: key, group, label, v."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.array(machines.classes)
        for batch in batches:
            group, v = batch.column("group").to_numpy(), matrix(batch.column("v"))
            for s, setting in enumerate(machines.settings):
                own = np.flatnonzero(group == setting.group)
                if len(own):
                    pred = classes[machines.votes(v[own], s).argmax(1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), s, np.int32)), batch.column(0).take(pa.array(own)), batch.column("label").take(pa.array(own)).cast(pa.int32()), pa.array(pred, pa.int32())], names=["setting", key, "truth", "pred"])

    return rows.select(key, "group", "label", "v").mapInArrow(run, f"setting int, `{key}` {kind}, truth int, pred int")
