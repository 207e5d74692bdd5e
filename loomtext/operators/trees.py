"""Random forests, gradient boosting and isolation forests; trees are flat arrays, trained tree-parallel."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from loomtext.errors import InvalidConfig
from loomtext.operators.linear import sigmoid

MAX_CANDIDATES = 32


@dataclass
class Tree:
    """Node i splits on feature[i] <= threshold[i] to left[i] or right[i]; feature -1 is a leaf with value[i]."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)

    def add(self, value: list[float], feature: int = -1, threshold: float = 0.0) -> int:
        self.feature.append(feature), self.threshold.append(threshold), self.left.append(-1), self.right.append(-1), self.value.append(value)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf and the depth that each row comes to."""
        f, t, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        node, depth = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        while len(rows := np.flatnonzero(f[node] >= 0)):
            at = node[rows]
            node[rows] = np.where(x[rows, f[at]] <= t[at], left[at], right[at])
            depth[rows] += 1
        return node, depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)[0]]

    def to_row(self) -> tuple:
        return self.feature, self.threshold, self.left, self.right, self.value

    @classmethod
    def from_row(cls, row: tuple) -> Tree:
        return cls(*(list(map(list, c)) if i == 4 else list(c) for i, c in enumerate(row)))


def _distinct(values: np.ndarray, eps: float) -> np.ndarray:
    """Ascending values, each more than eps from the one kept before it."""
    values = np.unique(values)
    near = np.diff(values) < eps
    if len(values) < 2 or not near.any():
        return values
    keep = np.r_[True, ~near]  # a value far from the one before it is far from every earlier one
    last = -1.0
    for i in np.flatnonzero(near) + 1:
        if keep[i - 1]:
            last = values[i - 1]
        if values[i] - last >= eps:
            keep[i] = True
    return values[keep]


# --- random forest ---


@dataclass
class ForestConfig:
    mode: str = "Standard"
    n_trees: int = 21
    max_depth: int = 6
    max_features: str = "Sqrt"
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    bootstrap: bool = True
    oob_score: bool = False
    random_seed: int | None = None

    def validate(self) -> ForestConfig:
        if self.mode not in ("Standard", "Balanced", "ExtraTrees"):
            raise InvalidConfig("random forest", f"unknown mode {self.mode!r}")
        if self.max_features not in ("Sqrt", "Log2", "All", "Half"):
            raise InvalidConfig("random forest", f"unknown max_features {self.max_features!r}")
        if self.n_trees < 1 or self.min_samples_leaf < 1 or self.max_depth < 1:
            raise InvalidConfig("random forest", "needs n_trees, max_depth and min_samples_leaf of at least 1")
        if self.oob_score and not self.bootstrap:
            raise InvalidConfig("random forest", "oob_score needs bootstrap")
        return self


def feature_budget(rule: str, total: int) -> int:
    n = {"Sqrt": round(math.sqrt(total)), "Log2": round(math.log2(max(total, 1))), "All": total, "Half": total // 2}[rule]
    return max(1, min(int(n), total))


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    return 1 - (p * p).sum(axis=-1)


def grow_class_tree(x: np.ndarray, y: np.ndarray, classes: int, rows: np.ndarray, cfg: ForestConfig, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """A Gini tree over these rows, and its feature importances."""
    tree, importance = Tree(), np.zeros(x.shape[1])
    budget = feature_budget(cfg.max_features, x.shape[1])
    onehot = np.eye(classes)[y]

    def grow(rows: np.ndarray, depth: int) -> int:
        counts = onehot[rows].sum(axis=0)
        leaf = list(counts / counts.sum()) if len(rows) else [0.0] * classes
        if not len(rows) or depth >= cfg.max_depth or len(rows) < max(2, cfg.min_samples_split) or len(rows) <= cfg.min_samples_leaf or (counts > 0).sum() == 1:
            return tree.add(leaf)
        best, at = -1.0, None
        for f in rng.permutation(x.shape[1])[:budget]:
            column = x[rows, f]
            values = _distinct(column, 1e-6)
            if len(values) < 2:
                continue
            if cfg.mode == "ExtraTrees":
                cuts = rng.uniform(values[0], values[-1], min(max(len(values), 2), 8))
            else:
                cuts = (values[1:] + values[:-1]) / 2
            order = np.argsort(column, kind="stable")
            upto = np.vstack([np.zeros(classes), np.cumsum(onehot[rows[order]], axis=0)])
            n_left = np.searchsorted(column[order], cuts, "right")
            left, right = upto[n_left], counts - upto[n_left]
            gain = _gini(counts) - n_left / len(rows) * _gini(left) - (1 - n_left / len(rows)) * _gini(right)
            gain[(n_left < cfg.min_samples_leaf) | (len(rows) - n_left < cfg.min_samples_leaf)] = -2
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = float(gain[k]), (int(f), float(cuts[k]))
        if at is None:
            return tree.add(leaf)
        importance[at[0]] += max(best, 0) * len(rows) / len(x)
        node = tree.add(leaf, *at)
        goes = x[rows, at[0]] <= at[1]
        tree.left[node] = grow(rows[goes], depth + 1)
        tree.right[node] = grow(rows[~goes], depth + 1)
        return node

    grow(rows, 0)
    return tree, importance


def balanced_bootstrap(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many rows as there are, drawn with replacement from the classes in turn."""
    _, first = np.unique(y, return_index=True)
    groups = [np.flatnonzero(y == y[i]) for i in np.sort(first)]
    return np.array([rng.choice(groups[i % len(groups)]) for i in range(len(y))])


@dataclass
class ForestModel:
    trees: list[Tree]
    classes: int
    importances: np.ndarray
    oob: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        votes = np.maximum(sum(t.predict(x) for t in self.trees), 1e-6)
        return votes / votes.sum(axis=1, keepdims=True)


_TREE = "tree_id long, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<array<double>>, extra array<double>, rows array<int>"


def tree_parallel(spark: SparkSession | None, n: int, make, *arrays: np.ndarray) -> list[tuple[Tree, np.ndarray, np.ndarray]]:
    """make(tree_id, *arrays) -> (tree, extra, rows) for each of n trees: one Spark task a tree, arrays broadcast.

    Without a session the trees grow here. The caller bounds the arrays (models.MAX_DENSE).
    """
    if spark is None:
        return [make(i, *arrays) for i in range(n)]
    held = spark.sparkContext.broadcast(arrays)

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                tree, extra, rows = make(int(i), *held.value)
                f, t, left, right, v = tree.to_row()
                yield pd.DataFrame([[i, f, t, left, right, v, list(map(float, extra)), list(map(int, rows))]], columns=[c.split()[0] for c in _TREE.split(", ")])

    parts = min(n, spark.sparkContext.defaultParallelism)
    found = spark.range(0, n, 1, parts).mapInPandas(run, _TREE).orderBy("tree_id").collect()
    return [(Tree.from_row((r.feature, r.threshold, r.left, r.right, r.value)), np.array(r.extra), np.array(r.rows, int)) for r in found]


def fit_forest(x: np.ndarray, y: np.ndarray, classes: int, cfg: ForestConfig, spark: SparkSession | None = None) -> ForestModel:
    cfg.validate()
    seed = 0xC0FFEE if cfg.random_seed is None else cfg.random_seed

    def make(i: int, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(seed + 17 * i)
        if not cfg.bootstrap:
            rows = np.arange(len(x))
        elif cfg.mode == "Balanced":
            rows = balanced_bootstrap(y, rng)
        else:
            rows = rng.integers(0, len(x), len(x))
        tree, importance = grow_class_tree(x, y, classes, rows, cfg, rng)
        return tree, importance, np.unique(rows)

    grown = tree_parallel(spark, cfg.n_trees, make, x, y)
    importance = sum(i for _, i, _ in grown)
    oob = None
    if cfg.oob_score:
        votes = np.zeros((len(x), classes))
        for tree, _, rows in grown:
            out = np.setdiff1d(np.arange(len(x)), rows)
            votes[out] += tree.predict(x[out])
        has = votes.sum(axis=1) > 0
        best = classes - 1 - votes[has][:, ::-1].argmax(axis=1)  # the last of equal ones
        oob = float((best == y[has]).mean()) if has.any() else 0.0
    return ForestModel([t for t, _, _ in grown], classes, importance / importance.sum() if importance.sum() > 0 else importance, oob)


# --- gradient boosting ---


@dataclass
class BoostingConfig:
    n_estimators: int = 24
    learning_rate: float = 0.2
    max_depth: int = 1

    def validate(self) -> BoostingConfig:
        if self.n_estimators < 1 or not self.learning_rate > 0 or self.max_depth < 1:
            raise InvalidConfig("gradient boosting", "needs n_estimators >= 1, learning_rate > 0, max_depth >= 1")
        return self


@dataclass
class Cuts:
    """Where features of some rows may be split: `feature` has those with two values or more, and for each of them `at` has the
    thresholds, `n_left` the rows up to each, and `bins` by row the number of thresholds below its value, at most 2 * MAX_CANDIDATES."""

    feature: list[int]
    at: list[np.ndarray]
    n_left: list[np.ndarray]
    bins: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, rows: np.ndarray | None = None) -> Cuts:
        out = cls([], [], [], [])
        for f in range(x.shape[1]):
            column = np.ascontiguousarray(x[:, f] if rows is None else x[rows, f])
            values = _distinct(column, 1e-7)
            if len(values) < 2:
                continue
            step = max(1, (len(values) - 1) // MAX_CANDIDATES)
            cuts = ((values[1:] + values[:-1]) / 2)[::step]
            bins = np.searchsorted(cuts, column, "left").astype(np.uint8)
            out.feature.append(f), out.at.append(cuts), out.bins.append(bins)
            out.n_left.append(np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1])
        return out

    def best(self, r: np.ndarray) -> tuple[int, float, float, float] | None:
        """(feature, threshold, left value, right value) of least squared loss with values shrunk by one row, for the residuals of the rows."""
        best, least = None, math.inf
        square, whole = (r * r).sum(), r.sum()
        for f, cuts, n_left, bins in zip(self.feature, self.at, self.n_left, self.bins):
            left = np.cumsum(np.bincount(bins, r, len(cuts) + 1))[:-1]
            right, n_right = whole - left, len(r) - n_left
            lv, rv = left / (n_left + 1), right / (n_right + 1)
            loss = square - 2 * (lv * left + rv * right) + n_left * lv**2 + n_right * rv**2
            loss[(n_left == 0) | (n_right == 0)] = math.inf
            k = int(loss.argmin())
            if loss[k] < least - 1e-12:
                least, best = float(loss[k]), (f, float(cuts[k]), float(lv[k]), float(rv[k]))
        return best


def grow_residual_tree(x: np.ndarray, residual: np.ndarray, max_depth: int, cuts: Cuts | None = None) -> Tree:
    """Leaves on the last level have the shrunk mean, leaves that end early the plain one. cuts: those of all rows, which don't change from tree to tree."""
    tree = Tree()

    def grow(rows: np.ndarray | None, depth: int) -> int:
        r = residual if rows is None else residual[rows]
        mean = [float(r.mean()) if len(r) else 0.0]
        split = None if depth >= max_depth or len(r) <= 2 else (cuts if rows is None and cuts else Cuts.of(x, rows)).best(r)
        if split is None:
            return tree.add(mean)
        f, t, lv, rv = split
        node = tree.add(mean, f, t)
        if depth + 1 >= max_depth:
            tree.left[node], tree.right[node] = tree.add([lv]), tree.add([rv])
            return node
        rows = np.arange(len(x)) if rows is None else rows
        goes = x[rows, f] <= t
        tree.left[node] = grow(rows[goes], depth + 1)
        tree.right[node] = grow(rows[~goes], depth + 1)
        return node

    grow(None, 0)
    return tree


@dataclass
class BoostingModel:
    base: list[float]
    rate: float
    trees: list[list[Tree]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logits = np.stack([b + self.rate * sum(t.predict(x)[:, 0] for t in trees) for b, trees in zip(self.base, self.trees)], axis=1)
        p = np.maximum(sigmoid(logits), 1e-9)
        return p / p.sum(axis=1, keepdims=True)


def fit_boosting(x: np.ndarray, y: np.ndarray, classes: int, cfg: BoostingConfig) -> BoostingModel:
    cfg.validate()
    base, trees, cuts = [], [], Cuts.of(x)
    for cls in range(classes):
        target = (y == cls).astype(float)
        positive = max(target.sum(), 1.0)
        base.append(math.log(positive / max(len(y) - positive, 1.0)))
        logit, own = np.full(len(y), base[-1]), []
        for _ in range(cfg.n_estimators):
            own.append(grow_residual_tree(x, target - sigmoid(logit), cfg.max_depth, cuts))
            logit += cfg.learning_rate * own[-1].predict(x)[:, 0]
        trees.append(own)
    return BoostingModel(base, cfg.learning_rate, trees)


# --- isolation forest ---


@dataclass
class IsolationConfig:
    n_trees: int = 64
    contamination: float = 0.05
    subsample_size: int = 64

    def validate(self) -> IsolationConfig:
        if self.n_trees < 1 or not 0 < self.contamination < 0.5 or self.subsample_size < 1:
            raise InvalidConfig("isolation forest", "needs n_trees >= 1, 0 < contamination < 0.5, subsample_size >= 1")
        return self


def c_factor(n: float) -> float:
    """The scale of path lengths among n rows."""
    return 0.0 if n <= 1 else 2 * math.log(n - 1) + 0.5772157 - 2 * (n - 1) / n


def grow_isolation_tree(x: np.ndarray, rows: np.ndarray, max_depth: int, rng: np.random.Generator) -> Tree:
    """Random splits; a leaf's value is its number of rows."""
    tree = Tree()

    def grow(rows: np.ndarray, depth: int) -> int:
        if len(rows) <= 1 or depth >= max_depth:
            return tree.add([float(len(rows))])
        f = int(rng.integers(x.shape[1]))
        low, high = x[rows, f].min(), x[rows, f].max()
        t = float(rng.uniform(low, high)) if high - low >= 1e-6 else low
        goes = x[rows, f] <= t
        if high - low < 1e-6 or goes.all() or not goes.any():
            return tree.add([float(len(rows))])
        node = tree.add([float(len(rows))], f, t)
        tree.left[node] = grow(rows[goes], depth + 1)
        tree.right[node] = grow(rows[~goes], depth + 1)
        return node

    grow(rows, 0)
    return tree


@dataclass
class IsolationModel:
    trees: list[Tree]
    threshold: float
    mean: float
    std: float
    subsample_size: int

    @staticmethod
    def raw(trees: list[Tree], x: np.ndarray, scale: float) -> np.ndarray:
        total = np.zeros(len(x))
        for t in trees:
            leaf, depth = t.leaves(x)
            extra = np.array([c_factor(v[0]) for v in t.value])
            total += depth + extra[leaf]
        return 2.0 ** (-(total / max(1, len(trees))) / scale)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(self.trees, x, max(c_factor(max(8, self.subsample_size)), 1e-6))
        logit = 0.85 * (s - self.mean) / self.std + np.clip(6 * (s - self.threshold), -2.5, 2.5)
        return np.clip(sigmoid(logit), 1e-6, 1 - 1e-6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Columns: the hot label, the cold one."""
        p = self.anomaly(x)
        return np.stack([p, 1 - p], axis=1)


def fit_isolation(x: np.ndarray, cfg: IsolationConfig, hot: int | None = None, spark: SparkSession | None = None) -> IsolationModel:
    """On all rows; with some but not all of them hot, contamination is their share, whatever is configured."""
    cfg.validate()
    n = len(x)
    contamination = min(max(hot / n, 0.001), 0.49) if hot is not None and 0 < hot < n else cfg.contamination
    size = min(n, max(8, cfg.subsample_size))
    depth = max(2, math.ceil(math.log2(max(2, n))))

    def make(i: int, x: np.ndarray):
        rng = np.random.default_rng(0xBADC0DE + 13 * i)
        return grow_isolation_tree(x, rng.integers(0, len(x), size), depth, rng), np.zeros(0), np.zeros(0, int)

    trees = [t for t, _, _ in tree_parallel(spark, cfg.n_trees, make, x)]
    scores = np.sort(IsolationModel.raw(trees, x, max(c_factor(size), 1e-6)))
    at = min(int(n * (1 - min(max(contamination, 0.001), 0.49))), n - 1)
    return IsolationModel(trees, max(float(scores[at]), 0.55), float(scores.mean()), max(float(scores.std()), 1e-6), cfg.subsample_size)
