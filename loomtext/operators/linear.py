"""Linear one-versus-rest classifiers: logistic regression and SVM with explicit kernel maps, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from loomtext.errors import InvalidConfig

BATCH = 64
#: Batches that are gathered at a time; rows that the SVM takes at a time.
GATHER, STEP = 32, 64
#: Rows times epochs times classes from which classes are trained by Spark tasks.
PARALLEL = 5_000_000
RFF_COMPONENTS, MAX_LANDMARKS = 256, 128


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class LogisticConfig:
    learning_rate: float = 0.25
    epochs: int = 180
    reg: float = 1e-3

    def validate(self) -> LogisticConfig:
        if not self.learning_rate > 0 or self.epochs < 1 or self.reg < 0:
            raise InvalidConfig("logistic regression", "needs learning_rate > 0, epochs >= 1, lambda >= 0")
        return self


@dataclass
class LogisticModel:
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = np.maximum(sigmoid(x @ self.weights.T + self.bias), 1e-9)
        return p / p.sum(axis=1, keepdims=True)


def fit_logistic_class(x: np.ndarray, y: np.ndarray, cls: int, cfg: LogisticConfig) -> tuple[np.ndarray, float]:
    """Mini-batch gradient descent for one class against the rest; up to BATCH rows it is full-batch."""
    target = (y == cls).astype(float)
    w, b = np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(195_948_269 ^ (cls * 7919))
    for epoch in range(cfg.epochs):
        rate = cfg.learning_rate / (1 + 0.02 * epoch)
        order = rng.permutation(len(x)) if len(x) > BATCH else np.arange(len(x))
        for start in range(0, len(x), BATCH * GATHER):
            some = order[start : start + BATCH * GATHER]
            own, wanted = x[some], target[some]
            for at in range(0, len(some), BATCH):
                rows = own[at : at + BATCH]
                z = rows @ w + b
                error = 1 / (1 + np.exp(-np.minimum(np.maximum(z, -60), 60))) - wanted[at : at + BATCH]
                w = w * (1 - rate * cfg.reg) - rate * (error @ rows) / len(rows)
                b -= rate * (np.add.reduce(error) / len(rows))
    return w, b


def _each_class(fit: Callable, x: np.ndarray, y: np.ndarray, classes: int, cfg: Any, spark: SparkSession | None) -> list[tuple[np.ndarray, float]]:
    """fit for every class against the rest. They don't depend on each other: with a session and much to do, each is a Spark task."""
    if spark is None or len(x) * cfg.epochs * classes < PARALLEL:
        return [fit(x, y, c, cfg) for c in range(classes)]
    held = spark.sparkContext.broadcast((x, y))
    parts = spark.sparkContext.parallelize(range(classes), classes).map(lambda c: fit(*held.value, c, cfg)).collect()
    held.destroy()
    return parts


def fit_logistic(x: np.ndarray, y: np.ndarray, classes: int, cfg: LogisticConfig, spark: SparkSession | None = None) -> LogisticModel:
    parts = _each_class(fit_logistic_class, x, y, classes, cfg.validate(), spark)
    return LogisticModel(np.array([w for w, _ in parts]), np.array([b for _, b in parts]))


@dataclass
class SvmConfig:
    kernel: str = "Linear"
    c: float = 1.0
    learning_rate: float = 0.08
    epochs: int = 40
    gamma: float = 0.35
    degree: int = 2
    coef0: float = 0.0

    def validate(self) -> SvmConfig:
        if self.kernel not in ("Linear", "Rbf", "Polynomial", "Sigmoid"):
            raise InvalidConfig("svm", f"unknown kernel {self.kernel!r}")
        if not self.c > 0 or not self.learning_rate > 0 or self.epochs < 1:
            raise InvalidConfig("svm", "needs c > 0, learning_rate > 0, epochs >= 1")
        return self


@dataclass
class KernelMap:
    """The explicit feature map of a kernel: identity, random Fourier features, or products with landmarks."""

    cfg: SvmConfig
    omega: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    phase: np.ndarray = field(default_factory=lambda: np.zeros(0))
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def fit(cls, x: np.ndarray, cfg: SvmConfig) -> KernelMap:
        if cfg.kernel == "Rbf":
            rng = np.random.default_rng(4_277_321_950)
            return cls(cfg, rng.normal(0, np.sqrt(2 * cfg.gamma), (RFF_COMPONENTS, x.shape[1])), rng.uniform(0, 2 * np.pi, RFF_COMPONENTS))
        if cfg.kernel in ("Polynomial", "Sigmoid"):
            return cls(cfg, landmarks=x[np.random.default_rng(178_045_182).permutation(len(x))[:MAX_LANDMARKS]])
        return cls(cfg)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.cfg.kernel == "Rbf":
            return np.sqrt(2 / RFF_COMPONENTS) * np.cos(x @ self.omega.T + self.phase)
        if self.cfg.kernel in ("Polynomial", "Sigmoid"):
            z = self.cfg.gamma * (x @ self.landmarks.T) + self.cfg.coef0
            return z**self.cfg.degree if self.cfg.kernel == "Polynomial" else np.tanh(z)
        return x


@dataclass
class SvmModel:
    map: KernelMap
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        m = self.map(x) @ self.weights.T + self.bias
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_svm(x: np.ndarray, y: np.ndarray, classes: int, cfg: SvmConfig, spark: SparkSession | None = None) -> SvmModel:
    """Stochastic subgradient descent of the hinge loss, row by row in input order."""
    kernel = KernelMap.fit(x, cfg.validate())
    parts = _each_class(fit_svm_class, kernel(x), y, classes, cfg, spark)
    return SvmModel(kernel, np.array([w for w, _ in parts]), np.array([b for _, b in parts]))


def fit_svm_class(z: np.ndarray, y: np.ndarray, cls: int, cfg: SvmConfig) -> tuple[np.ndarray, float]:
    """One class against the rest.

    Rows are taken STEP at a time: one product of them with each other says what each, if it is inside the margin, adds to
    the margins of those after it, so that going from row to row is a sum of STEP numbers.
    """
    sign = np.where(y == cls, 1.0, -1.0)
    w, b = np.zeros(z.shape[1]), 0.0
    place = np.arange(STEP)
    gap = place[None, :] - place[:, None] - 1  # between a row and a later one
    for epoch in range(cfg.epochs):
        rate = cfg.learning_rate / (1 + 0.05 * epoch)
        held = np.power(1 - rate / cfg.c, np.arange(STEP + 1))  # what is left of the weights after so many rows
        fades = np.where(gap >= 0, held[np.maximum(gap, 0)], 0.0)
        later = (gap >= 0).astype(float)
        for at in range(0, len(z), STEP):
            rows, s = z[at : at + STEP], sign[at : at + STEP]
            n = len(rows)
            adds = ((rows @ rows.T) * fades[:n, :n] + later[:n, :n]) * (rate * s)[:, None] * s
            lacks = s * (held[:n] * (rows @ w) + b) - 1
            step = np.zeros(n)
            for i, add in enumerate(adds):
                if lacks[i] < 0:
                    np.add(lacks, add, out=lacks)
                    step[i] = rate
            step *= s
            w = w * held[n] + (held[:n][::-1] * step) @ rows
            b += np.add.reduce(step)
    return w, b
