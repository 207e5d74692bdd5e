"""Work that must grow no faster than its input, and results that stay the same while it does."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.functions.hashing import subword_vector, subword_vectors
from loomtext.operators import embeddings, features, knn, linear, trees
from loomtext.operators.models import matrix_of
from loomtext.plans import catalogue
from loomtext.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_boosting_sorts_each_feature_once(monkeypatch):
    calls = []
    plain = trees._distinct
    monkeypatch.setattr(trees, "_distinct", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = (x[:, 2] > 0.3).astype(int)
    model = trees.fit_boosting(x, y, 2, trees.BoostingConfig())
    assert len(calls) == 5  # not once for every feature of every tree
    assert {t.feature[0] for t in model.trees[1]} == {2}
    assert ((model.scores(x)[:, 1] > 0.5) == (y == 1)).mean() > 0.97


def test_splits_are_those_of_sorted_rows():
    rng = np.random.default_rng(4)
    x, r = np.round(rng.normal(size=(200, 3)), 1), rng.normal(size=200)
    f, t, left, right = trees.Cuts.of(x).best(r)
    loss = {}
    for g in range(3):
        values = np.unique(x[:, g])
        for cut in ((values[1:] + values[:-1]) / 2)[:: max(1, (len(values) - 1) // trees.MAX_CANDIDATES)]:
            sides = [r[x[:, g] <= cut], r[x[:, g] > cut]]
            loss[g, float(cut)] = sum(((s - s.sum() / (len(s) + 1)) ** 2).sum() for s in sides)
    assert (f, t) == min(loss, key=loss.get)
    assert [left, right] == pytest.approx([s.sum() / (len(s) + 1) for s in (r[x[:, f] <= t], r[x[:, f] > t])])


def test_matrix_of_sparse_rows():
    places, values = [[0, 2], [1], [], [0, 1, 2]], [[1.0, 2.0], None, [], [3.0, 4.0, 5.0]]
    rows = pa.table({"id": [1, 2, 3, 4], "i": pa.array(places, pa.list_(pa.int32())), "v": pa.array(values, pa.list_(pa.float64()))})
    want = np.array([[1, 0, 2], [np.nan] * 3, [0] * 3, [3, 4, 5]])
    assert np.array_equal(matrix_of(rows, 3), want, equal_nan=True)
    assert np.array_equal(matrix_of(rows.slice(1), 3), want[1:], equal_nan=True)


@pytest.mark.parametrize(("metric", "p"), [("cosine", 2.0), ("euclidean", 2.0), ("manhattan", 2.0), ("minkowski", 3.0), ("minkowski", 1.5), ("minkowski", 0.5), ("minkowski", 6.0)])
@pytest.mark.parametrize("size", [1.0, 1e-6, 1e17])
def test_blocks_find_the_nearest_of_all_pairs(metric, p, size):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(5000, 6)), np.repeat(np.round(rng.normal(size=(20, 6)), 1), 9, axis=0), np.zeros((3, 6))]) * size
    x[17, 2] = np.nan
    ids = rng.permutation(len(x))
    probes = np.concatenate([x[4990:5100:3], np.zeros((1, 6)), rng.normal(size=(9, 6)) * size])
    r, c, d = knn.Block(ids, np.array(["a"] * len(x), object), x, 6, metric, p).nearest(probes)
    every = np.round(knn.distances(probes, x, metric, p), knn.PLACES)
    for i, row in enumerate(every):
        want = np.lexsort((ids, row))[:6]
        assert np.allclose(d[r == i], row[want], rtol=1e-12, atol=2e-12)
        if metric != "cosine":  # its products are summed in another order
            assert list(c[r == i]) == list(want)


def test_searches_hold_a_tile_and_spread_over_tasks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60_000, 8))
    block = knn.Block(np.arange(len(x)), np.array(["a"] * len(x), object), x, 6, "cosine", 2.0)
    tracemalloc.start()
    block.nearest(x[: knn.PROBES])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20  # all pairs of the block are 245 MB a copy
    train = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x[:400])], "train_id bigint, vector array<double>, label string")
    probes = train.select(F.col("train_id").alias("doc_id"), "vector").repartition(12)
    places = knn._in_blocks(train, probes, 2, 8, 8).groupBy("place").agg(F.count_if("asks").alias("asks"), F.sum(F.when(~F.col("asks"), F.size("labels"))).alias("rows")).collect()
    assert len(places) == 16 and sum(r.asks > 0 for r in places) > 4  # two blocks are the work of more than two tasks
    assert sum(r.rows for r in places) == 8 * 400


def test_classes_train_as_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(501, 4))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    cfg = linear.SvmConfig(epochs=5)
    w, b = np.zeros((3, 4)), np.zeros(3)
    for epoch in range(cfg.epochs):
        rate = cfg.learning_rate / (1 + 0.05 * epoch)
        for row, own in zip(x, y):
            s = np.where(np.arange(3) == own, 1.0, -1.0)
            step = rate * s * (s * (w @ row + b) < 1)
            w = w * (1 - rate / cfg.c) + step[:, None] * row
            b = b + step
    alone = linear.fit_svm(x, y, 3, cfg)
    assert np.allclose(alone.weights, w, atol=1e-12) and np.allclose(alone.bias, b, atol=1e-12)
    monkeypatch.setattr(linear, "PARALLEL", 1)  # every class a task
    for fit, c in ((linear.fit_svm, cfg), (linear.fit_logistic, linear.LogisticConfig(epochs=3))):
        here, there = fit(x, y, 3, c), fit(x, y, 3, c, spark)
        assert (here.weights == there.weights).all() and (here.bias == there.bias).all()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_read_a_text_once_where_it_lies(spark):
    assert plan_of(QUERIES["alert_titles"](spark, SF)).count("RLIKE") == len(catalogue.RULES)
    for name in ("rule_merge_scores", "report_records"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("RLIKE") == len(catalogue.RULES)
        assert plan.index("Join") < plan.index("RLIKE")  # what is joined is hits, not texts


@pytest.mark.parametrize("head", [500_000, 3])
def test_features_and_vectors_of_repeated_missing_and_rare(spark, monkeypatch, head):
    monkeypatch.setattr(features, "BROADCAST_TOKENS", head)
    rows = [(1, "a cat sat the cat"), (1, "cat dog"), (2, None), (3, ""), (4, "dog bird ééé"), (5, "cat fish"), (None, "cat loose"), (None, "dog")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    together = {1: "a cat sat the cat cat dog", 4: "dog bird ééé", 5: "cat fish", None: "cat loose dog"}
    lists = {i: t.split() for i, t in together.items()}
    df = Counter(w for _, t in rows for w in set((t or "").split()) if w not in features.STOPWORDS)
    idf = {w: math.log(9 / (n + 1)) + 1 for w, n in df.items()}
    for count_only in (False, True):
        model = features.fit_tfidf(docs, count=count_only)  # with idx, or without
        got = {(r.doc_id, r.token): r.value for r in model.weights(docs, count_only=count_only).collect()}
        want = {}
        for i, words in lists.items():
            w = {t: n if count_only else (1 + math.log(n)) * idf[t] for t, n in Counter(words).items() if t in idf}
            want |= {(i, t): v / math.hypot(*w.values()) for t, v in w.items()}
        assert got == pytest.approx(want)
        assert "Window" not in plan_of(model.weights(docs))  # one row a document is shuffled, not one a token
    vectors = embeddings.document_vectors(docs, embeddings.WordVectors(6, {}, embeddings.FastTextConfig(3, 4, 6)), features.fit_tfidf(docs, count=False)).collect()
    assert len(vectors) == len(rows)
    for r in vectors:
        words = lists.get(r.doc_id, []) if r.doc_id is not None else []
        total = sum((idf.get(w, 1.0) * subword_vector(w, 6, 3, 4) for w in words), np.zeros(6))
        assert np.allclose(r.vector, total / max(np.linalg.norm(total), 1e-12))


def test_subword_vectors_of_many_tokens():
    words = ["", "a", "ab", "straße", "日本語", "😀x", "averyverylongtoken" * 9]
    for low, high in ((3, 5), (1, 2), (6, 7)):
        assert np.array_equal(subword_vectors(words, 8, low, high), [subword_vector(w, 8, low, high) for w in words])
