"""Operator 10: URL filtering by gradient-boosted trees over lexical features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import table

#: Most labelled URLs of each class that the trees are fitted to, the ones with the lowest hash.
PER_CLASS = 20_000
#: Parts of the hosts, each of which is scored by trees of the others when the threshold is set.
FOLDS = 3
#: The thresholds to choose from.
GRID = np.linspace(0.05, 0.95, 91)
#: Registered names whose pages are labelled as unwanted where a table has no labels of its own.
BLOCKED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters",
    "hyphens", "host_hyphens", "host_labels", "longest_word", "is_secure", "has_fragment", "is_address", "suffix_rate", "suffix_count",
)


def _entropy(text: Column) -> Column:
    """Bits a character of a text, 0 for an empty one."""
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(F.filter(parts, lambda k: k > 0), F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(F.lit(0.0))


def lexical_features(urls: DataFrame) -> DataFrame:
    """urls (with __url) and the features that need no statistics, and __suffix; all built-in expressions."""
    url = F.lower(F.trim("__url"))
    d = urls.withColumn("__u", url).withColumn("__host", F.regexp_extract("__u", r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    d = d.withColumns({"__path": F.regexp_extract("__u", r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?[^/?#]*([^?#]*)", 1), "__query": F.regexp_extract("__u", r"\?([^#]*)", 1)})
    count = lambda c, pattern: F.length(c).cast("double") - F.length(F.regexp_replace(c, pattern, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.greatest(F.length("__u"), F.lit(1)).cast("double")
    return d.withColumns({
        "__suffix": F.when(F.col("__host").contains("."), F.substring_index("__host", ".", -1)).otherwise(""),
        "length": F.length("__u").cast("double"), "host_length": F.length("__host").cast("double"), "path_length": F.length("__path").cast("double"),
        "depth": F.size(F.filter(F.split("__path", "/"), lambda x: x != "")).cast("double"), "digit_ratio": count(F.col("__u"), "[0-9]") / n, "host_digits": count(F.col("__host"), "[0-9]"),
        "entropy": _entropy(F.col("__u")), "host_entropy": _entropy(F.col("__host")), "parameters": F.size(F.filter(F.split("__query", "[&;]"), lambda x: x != "")).cast("double"),
        "hyphens": count(F.col("__u"), "-"), "host_hyphens": count(F.col("__host"), "-"), "host_labels": F.size(F.split("__host", r"\.")).cast("double"),
        "longest_word": F.coalesce(F.array_max(F.transform(F.split("__u", "[^a-z]+"), F.length)), F.lit(0)).cast("double"),
        "is_secure": flag(F.col("__u").startswith("https:")), "has_fragment": flag(F.col("__u").contains("#")), "is_address": flag(F.col("__host").rlike(r"^[0-9.]+$")),
    })


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss; node i has children 2i+1 and 2i+2."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, value in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), np.int64)
            while (feature[node] >= 0).any():
                inner = feature[node] >= 0
                right = x[rows, np.maximum(feature[node], 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting with histograms over quantile bins; the classes weigh the same."""
    n, f = x.shape
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    nodes = 2 ** (depth + 1) - 1
    margin = np.zeros(n)
    features, splits, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, split, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.zeros(n, np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if not len(own):
                    continue
                g_all, h_all = g[own].sum(), h[own].sum()
                value[k] = -rate * g_all / (h_all + ridge)
                if level == depth or len(own) < 2 * least:
                    continue
                best = (1e-9, -1, 0)
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    size = len(edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(coded[own, j], w, size))[:-1] for w in (g[own], h[own], None))
                    gain = gl**2 / (hl + ridge) + (g_all - gl) ** 2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
                    gain[(nl < least) | (len(own) - nl < least)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], j, at)
                if best[1] >= 0:
                    feature[k], split[k] = best[1], edges[best[1]][best[2]]
                    node[own] = 2 * k + 1 + (coded[own, best[1]] > best[2])
        margin += value[node]
        features.append(feature), splits.append(split), values.append(value)
    return Trees(0.0, np.array(features), np.array(splits), np.array(values))


@dataclass
class Model:
    trees: Trees
    suffixes: dict[str, tuple[float, float]]
    prior: float
    threshold: float
    #: On hosts that the trees never saw; None where there was no measuring them.
    precision: float | None = None
    recall: float | None = None

    def features(self, x: np.ndarray, suffix: list[str]) -> np.ndarray:
        known = [self.suffixes.get(s, (self.prior, 0.0)) for s in suffix]
        return np.column_stack([x, np.array(known).reshape(-1, 2)])


def suffix_statistics(counts: dict[str, tuple[int, int]]) -> tuple[dict[str, tuple[float, float]], float]:
    """By suffix, from its unwanted and all URLs, the smoothed rate of unwanted ones and the log of its URLs in a million; and the rate of all."""
    bad, n = (sum(c[i] for c in counts.values()) for i in (0, 1))
    prior = bad / max(1, n)
    return {s: ((a + 20 * prior) / (b + 20), float(np.log1p(1e6 * b / n))) for s, (a, b) in counts.items()}, prior


def best_threshold(unwanted: np.ndarray, wanted: np.ndarray) -> float:
    """The middle one of the thresholds of GRID with the best F1; the arrays count URLs by how many thresholds they reach."""
    hit, alarm = (np.cumsum(k[::-1])[::-1][1:] for k in (unwanted, wanted))
    f1 = 2 * hit / np.maximum(1, unwanted.sum() + hit + alarm)
    good = GRID[f1 >= f1.max() - 1e-12]
    return float(good[len(good) // 2])


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([np.nan_to_num(np.asarray(batch.column(c).fill_null(0))) for c in range(first, batch.num_columns)])


def reached(rows: DataFrame, models: list[Model | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many unwanted and wanted rows (__label, __fold, __suffix, features) reach each number of thresholds of GRID, each by the model of its fold, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(GRID) + 1), np.int64)
        for batch in batches:
            folds = np.asarray(batch.column(1))
            for fold, model in enumerate(models):
                if model is not None and (folds == fold).any():
                    own = batch.filter(pa.array(folds == fold))
                    p = model.trees.probabilities(model.features(_matrix(own, 3), own.column(2).to_pylist()))
                    np.add.at(out, (np.asarray(own.column(0)), np.searchsorted(GRID, p, "right")), 1)
        label, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(out[label, at])], names=["label", "at", "n"])

    out = np.zeros((2, len(GRID) + 1), np.int64)
    for r in rows.mapInArrow(run, "label bigint, at bigint, n bigint").groupBy("label", "at").agg(F.sum("n").alias("n")).collect():
        out[r.label, r["at"]] = r.n
    return out[1], out[0]


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model of labelled URLs (url, label 0 or 1); None if a class is empty.

    Hosts fall into FOLDS parts by hash. For each part trees are fitted to the others, so that the threshold
    (best F1 at the class sizes of the table) and the precision and recall at it come from URLs of hosts
    that their trees never saw; the model itself is then fitted to all parts. A part whose others lack
    a class doesn't count for the threshold, which is 0.5 if none counts. Trees are fitted to at most
    per_class URLs of each class, which weigh alike; all else counts every labelled URL. The driver holds
    a row for each suffix.
    """
    known = labelled.where("url IS NOT NULL AND trim(url) <> '' AND label IN (0, 1)").select(F.col("url").alias("__url"), F.col("label").cast("int").alias("__label"))
    known = lexical_features(known).withColumn("__fold", F.pmod(F.xxhash64("__host"), F.lit(FOLDS)).cast("int"))
    parts: list[dict[str, tuple[int, int]]] = [{} for _ in range(FOLDS)]
    for r in known.groupBy("__suffix", "__fold").agg(F.sum("__label").alias("bad"), F.count("*").alias("n")).collect():
        parts[r["__fold"]][r["__suffix"]] = (r.bad, r.n)
    columns = ("__label", "__fold", "__suffix", *FEATURES[:-2])
    chosen = [known.where(F.col("__label") == c).orderBy(F.xxhash64("__url"), "__url").limit(per_class).select(*columns) for c in (0, 1)]
    rows = chosen[0].union(chosen[1]).collect()
    y, folds, suffixes = (np.array([r[i] for r in rows], kind) for i, kind in ((0, int), (1, int), (2, object)))
    x = np.array([list(r[3:]) for r in rows], float).reshape(-1, len(FEATURES) - 2)

    def fitted(use: np.ndarray, without: int = -1) -> Model | None:
        if len(np.unique(y[use])) < 2:
            return None
        counts: dict[str, tuple[int, int]] = {}
        for fold, part in enumerate(parts):
            for s, (bad, n) in part.items() if fold != without else ():
                a, b = counts.get(s, (0, 0))
                counts[s] = (a + bad, b + n)
        model = Model(Trees(), *suffix_statistics(counts), 0.5)
        model.trees = fit_trees(model.features(x[use], suffixes[use].tolist()), y[use])
        return model

    model = fitted(np.ones(len(y), bool))
    if model is not None:
        unwanted, wanted = reached(known.select(*columns), [fitted(folds != k, k) for k in range(FOLDS)])
        if unwanted.any() and wanted.any():
            model.threshold = best_threshold(unwanted, wanted)
            at = int(np.searchsorted(GRID, model.threshold, "left")) + 1
            hit, alarm = unwanted[at:].sum(), wanted[at:].sum()
            model.precision, model.recall = float(hit / max(1, hit + alarm)), float(hit / unwanted.sum())
    return model


def label_by_name(pages: DataFrame, names: tuple[str, ...] = BLOCKED_NAMES) -> DataFrame:
    """(url, label): 1 where a label of the host is a blocked name."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("url", F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, names))).cast("int").alias("label"))


def score_urls(pages: DataFrame, model: Model | None) -> DataFrame:
    """Every page with its URL's score: page_id, url, score (the probability of an unwanted URL), is_filtered.

    A row of pages gives a row, also for null and repeated ids. A null or blank URL has a null score and
    isn't filtered; so has every URL where there's no model (a class without labels). Features read the
    whole URL, of any length. Other columns aren't looked at. Needs no shuffle.
    """
    urls = pages.select(pages["page_id"].cast("bigint").alias("__id"), pages["url"].cast("string").alias("__url"))
    rows = lexical_features(urls).select("__id", "__url", "__suffix", *FEATURES[:-2])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("score", pa.float64()), ("is_filtered", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            fine = np.array([bool(u and u.strip()) for u in urls], bool)
            score = np.zeros(len(urls))
            if model and fine.any():
                score = model.trees.probabilities(model.features(_matrix(batch, 3), batch.column(2).to_pylist()))
            known = fine & (model is not None)
            filtered = known & (score >= (model.threshold if model else 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, mask=~known), pa.array(filtered)], schema=schema)

    return rows.mapInArrow(run, "page_id bigint, url string, score double, is_filtered boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return score_urls(pages, train(label_by_name(pages)))
