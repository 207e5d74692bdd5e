"""Worked values, model invariants and whole runs of the classification engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomtext.errors import InvalidConfig, InvalidLabel
from loomtext.functions import text as tx
from loomtext.functions.labels import canonical_label
from loomtext.operators import ensemble, metrics
from loomtext.operators.trees import c_factor, feature_budget
from loomtext.plans.builder import builder
from loomtext.plans.persistence import load_binary, load_json, save_binary, save_json
from loomtext.operators.linear import LogisticConfig, SvmConfig
from loomtext.operators.trees import BoostingConfig, ForestConfig, IsolationConfig
from loomtext.sources.embedding_files import Word2VecFile

HOT = ["win a free prize now", "free cash claim prize", "urgent claim your free reward", "cash prize urgent winner"]
COLD = ["see you at lunch today", "meeting moved to monday", "please send the report", "lunch on monday then report"]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, t, "SPAM" if i < len(HOT) else "RAW_DATA") for i, t in enumerate(HOT + COLD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame([(1, "claim a free prize"), (2, "report at the monday meeting"), (3, ""), (4, None)], "doc_id bigint, text string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("Abc", ["A", "bc"]), ("ABc", ["AB", "c"]), ("a1B", ["a1", "B"]), ("", [])])
def test_case_splits(spark, text, want):
    assert one(spark, tx.tokenize, text) == want


def test_normalised_tokens(spark):
    assert one(spark, tx.tokens, "ab_c D-1") == ["ab", "c", "d", "1"]


@pytest.mark.parametrize(("text", "want"), [("%3Cb%3E", "<b>"), ("&amp;#60;", "<"), ("a--b", "a b"), ("un/**/ion", "union"), ("", ""), (None, None)])
def test_decoding(spark, text, want):
    assert one(spark, tx.decode_obfuscated_text, text) == want


def test_labels():
    assert canonical_label("web_attack") == "WEB_ATTACK" and canonical_label("MyLabel") == "MyLabel"
    for bad in ("", "x" * 65, "a\nb"):
        with pytest.raises(InvalidLabel):
            canonical_label(bad)


def test_metrics(spark):
    pairs = spark.createDataFrame([("T", "T"), ("T", "F"), ("F", "F"), ("F", "T"), ("T", "T")], "y_true string, y_pred string")
    assert list(metrics.precision_recall_f1(pairs, "T").first()) == pytest.approx([2 / 3] * 3)
    scored = spark.createDataFrame([(1.0, True), (0.9, True), (0.4, False), (0.2, False)], "score double, is_positive boolean")
    assert metrics.roc_auc(scored).first()[0] == 1.0
    assert metrics.roc_auc(scored.limit(0)).first()[0] == 0.0
    assert metrics.roc_auc(scored.where("is_positive")).first()[0] == 0.5
    assert metrics.accuracy(pairs.limit(0)).first()[0] == 0.0


def test_weighted_ensemble(spark):
    a, b = (spark.createDataFrame([(1, label, s)], "doc_id bigint, label string, score double") for label, s in (("hot", 90.0), ("cold", 40.0)))
    got = {r.label: r.score for r in ensemble.merge([(a, 2.0), (b, 1.0)]).collect()}
    assert got == pytest.approx({"hot": 180 / 220, "cold": 40 / 220})


def test_tree_parameters():
    assert c_factor(1) == 0
    assert c_factor(9) == pytest.approx(2 * np.log(8) + 0.5772157 - 16 / 9)
    assert (feature_budget("Sqrt", 30), feature_budget("Log2", 32), feature_budget("All", 7)) == (5, 5, 7)


MODELS = [("Bayes", "Count", None), ("Bayes", "TfIdf", None), ("LogisticRegression", "TfIdf", LogisticConfig()), ("Svm", "Count", SvmConfig()), ("RandomForest", "TfIdf", ForestConfig()), ("GradientBoosting", "Count", BoostingConfig()), ("IsolationForest", "TfIdf", IsolationConfig())]


@pytest.mark.parametrize(("method", "nlp", "config"), MODELS)
def test_models_rank_classify_and_reload(spark, samples, probes, tmp_path, method, nlp, config):
    b = builder(spark).samples(samples).method(method).nlp(nlp).hot_label("SPAM")
    model = (b.config(config) if config else b).build()
    got = {r.doc_id: r.labels for r in model.classify(probes).collect()}
    assert set(got) == {1, 2, 3, 4}
    if method != "IsolationForest":
        assert got[1][0].label == "SPAM" and got[2][0].label == "RAW_DATA"
        assert sum(x.score for x in got[1]) == pytest.approx(1, abs=1e-4)
    for save, load in ((save_json, load_json), (save_binary, load_binary)):
        path = str(tmp_path / save.__name__)
        save(model, path)
        again = {r.doc_id: r.labels for r in load(spark, path).classify(probes).collect()}
        for i, labels in got.items():
            assert {x.label: round(x.score, 4) for x in again[i]} == {x.label: round(x.score, 4) for x in labels}


def test_builder_rejects(spark, samples):
    for wrong in (lambda b: b.method("KnnCosine").nlp("FastText").k(0).build(), lambda b: b.threads(257), lambda b: b.method("Svm").nlp("Count").build(), lambda b: b.method("nonsense")):
        with pytest.raises(InvalidConfig):
            wrong(builder(spark).samples(samples))


def test_word2vec_header_out_of_range(tmp_path):
    path = tmp_path / "v.bin"
    path.write_bytes(b"999999999 300\n")
    with pytest.raises(Exception, match="999999999 words"):
        Word2VecFile(str(path))


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
