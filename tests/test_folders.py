"""From folders of files and a configuration to reports, saved models and streams."""

import csv
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomtext
from loomtext import errors
from loomtext.functions.hashing import deterministic_vector
from loomtext.operators.embeddings import train_skipgram
from loomtext.operators.knn import KnnModel, distances
from loomtext.operators.linear import KernelMap
from loomtext.plans.persistence import load_split, load_tables, load_vectors, save_split, save_tables, save_vectors
from loomtext.plans.specs import MODULES
from loomtext.streaming.scoring import classify_stream, score_rules

HOT = ["select password from users", "union select card from accounts", "drop table users now", "select secret union drop"]
COLD = ["the weather is fine today", "we walk in the green park", "lunch with friends in the park", "fine day for a walk"]
YAML = """
report_name: nightly
data: {{hot_test_path: hot, cold_test_path: cold, hot_label: web_attack, cold_label: raw_data, recursive_way: On, score_sum: {add}}}
pipeline: {{nlp: {nlp}, threads: 2, embedding_dimensions: 8, security_normalize_obfuscation: {decode}}}
model: {model}
extra_match:
  - {{recursive_way: On, engine: Regex, path: rules, score_add_points: 40, title: listed, description: from a list}}
"""
FAMILIES = {
    "Bayes": ("Count", "{method: Bayes}"),
    "KnnCosine": ("Word2Vec", "{method: KnnCosine, k: 3}"),
    "KnnMinkowski": ("FastText", "{method: KnnMinkowski, k: 3, p: 3.0}"),
    "LogisticRegression": ("TfIdf", "{method: LogisticRegression, learning_rate: 0.25, epochs: 60}"),
    "Svm": ("Count", "{method: Svm, kernel: Linear, c: 1.0}"),
    "RandomForest": ("Count", "{method: RandomForest, n_trees: 9, random_seed: 7}"),
    "GradientBoosting": ("TfIdf", "{method: GradientBoosting, n_estimators: 8, learning_rate: 0.3}"),
    "IsolationForest": ("Count", "{method: IsolationForest, n_trees: 20, contamination: 0.2}"),
}


@pytest.fixture
def folder(tmp_path):
    for name, texts in (("hot", HOT), ("cold", COLD), ("new", ["select password union drop", "a fine walk in the park"])):
        for i, t in enumerate(texts):
            path = tmp_path / name / ("deep" if i % 2 else "") / f"{name} {i}.txt"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(t)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.json").write_text(json.dumps([{"title": "sql", "description": "", "match_rule": r"(?i)\bselect\b", "score": 30}]))
    (tmp_path / "rules/b.yaml").write_text("- {title: drop, match_rule: 'drop', score: 20}\n")
    (tmp_path / "rules/c.txt").write_text("\nunion\n")
    return tmp_path


def configured(folder, family, add="Off", decode="false"):
    nlp, model = FAMILIES[family]
    (folder / "run.yaml").write_text(YAML.format(nlp=nlp, model=model, add=add, decode=decode))
    return loomtext.RulesFile.from_yaml(str(folder / "run.yaml"))


@pytest.mark.parametrize("family", FAMILIES)
def test_a_configuration_runs_to_a_report(spark, folder, family):
    rules = configured(folder, family)
    rows = loomtext.run_rules_pipeline(spark, rules, str(folder / "new")).collect()
    assert [r.title_object for r in rows] == ["new 1.txt", "new 0.txt"]  # by path: deep/ comes first
    assert [r.name_file_dataset for r in rows] == [str(folder / "new/deep/new 1.txt"), str(folder / "new/new 0.txt")]
    assert [r.match_titles for r in rows] == ["", "sql,drop,listed"]  # told with score sum off
    assert all(r.date_of_occurrence is not None and ":" in r.classify_names_list for r in rows)
    if family != "IsolationForest":
        assert rows[0].classify_names_list.startswith("RAW_DATA:") and rows[1].classify_names_list.startswith("WEB_ATTACK:")


def test_score_sum_on_boosts_every_label(spark, folder):
    off, on = (loomtext.run_rules_pipeline(spark, configured(folder, "Bayes", add), str(folder / "new")).collect() for add in ("Off", "On"))
    assert on[0].score_percent == off[0].score_percent and on[1].score_percent == 100.0
    scores = [float(x.split(":")[1]) for x in on[1].classify_names_list.split(",")]
    assert scores[0] == 1.0 and scores[1] >= 0.9  # 30 + 20 + 40 points


def test_reports_as_csv_and_json(spark, folder):
    report = loomtext.run_rules_pipeline(spark, configured(folder, "Bayes"), str(folder / "new"))
    loomtext.write_csv(report, "out.csv", str(folder))
    loomtext.write_json(report, "out.json", "nightly", str(folder))
    rows = list(csv.reader(open(folder / "out.csv"), delimiter=";"))
    assert rows[0][0] == "title object" and [r[0] for r in rows[1:]] == ["new 1.txt", "new 0.txt"]
    data = json.loads((folder / "out.json").read_text())
    assert data["report_name"] == "nightly" and [r["match_titles"] for r in data["records"]] == ["", "sql,drop,listed"]


def test_samples_of_folders_have_ids_of_their_own(spark, folder):
    one = loomtext.load_samples(spark, str(folder / "hot/hot 0.txt"), "spam")
    cold = loomtext.load_samples(spark, str(folder / "cold"), "raw_data")
    both = loomtext.union_samples(one, cold).collect()
    assert sorted(r.sample_id for r in both) == [0, 1, 2, 3, 4] and {r.label for r in both} == {"SPAM", "RAW_DATA"}
    assert loomtext.union_samples(one.limit(0), cold).count() == 4
    assert [t for _, t, _ in loomtext.sample_iter(str(folder / "cold"), "raw_data", recursive=False)] == [COLD[0], COLD[2]]
    with pytest.raises(errors.InvalidConfig):
        loomtext.load_samples(spark, str(folder / "nothing"), "spam")


@pytest.mark.parametrize(("change", "error"), [("threads: 2", "threads: 0"), ("method: Bayes", "method: Unknown"), ("nlp: Count", "nlp: Magic"), ("path: rules", "path: missing"), ("hot_test_path: hot", "hot_test_path: missing"), ("score_add_points: 40", "score_add_points: -1")])
def test_wrong_configurations_are_errors(folder, change, error):
    configured(folder, "Bayes")
    text = (folder / "run.yaml").read_text()
    assert change in text
    (folder / "run.yaml").write_text(text.replace(change, error))
    with pytest.raises(errors.InvalidConfig):
        loomtext.RulesFile.from_yaml(str(folder / "run.yaml"))


def samples(spark):
    return spark.createDataFrame([(i, t, "WEB_ATTACK" if i < 4 else "RAW_DATA") for i, t in enumerate(HOT + COLD)], "doc_id bigint, text string, label string")


def probes(spark):
    return spark.createDataFrame([(1, "select password union"), (2, "walk in the park"), (3, None), (None, "drop table")], "doc_id bigint, text string")


def best(model, docs):
    return {r.doc_id: r.labels[0].label if r.labels else None for r in model.classify(docs).collect()}


def test_specs_typed_builders_and_modules(spark, folder):
    s = samples(spark)
    for spec in (loomtext.ClassifierSpec.bayes(spark), loomtext.ClassifierSpec.knn_cosine(spark, 3).dims(8), loomtext.ClassifierSpec.logistic_regression(spark, loomtext.LogisticConfig()).nlp("Count")):
        got = best(spec.samples(s).build(), probes(spark))
        assert got[1] == "WEB_ATTACK" and got[2] == "RAW_DATA" and got[None] is None
    typed = loomtext.TypedClassifierBuilder.new(spark).method("Bayes").nlp("Count")
    assert not hasattr(typed, "build")
    ready = typed.training_data(str(folder / "hot"), "web_attack", str(folder / "cold"), "raw_data")
    assert best(ready.build(), probes(spark))[1] == "WEB_ATTACK"
    with pytest.raises(errors.InvalidConfig):
        typed.nlp("Count")
    assert MODULES["Svm"].with_config(spark, loomtext.SvmConfig()).nlp("Count").samples(s).build().labels == ["RAW_DATA", "WEB_ATTACK"]
    assert isinstance(loomtext.BayesBuilder().samples(s).build(), loomtext.ExplainableClassifier)
    with pytest.raises(errors.InvalidConfig):
        loomtext.KnnBuilder().samples(s).build()  # no k
    with pytest.raises(errors.InvalidConfig):
        loomtext.KnnBuilder().k(1).metric("minkowski").samples(s).build()  # no p


def test_nearest_neighbours_of_directories_call_cold_files_block_list(spark, folder):
    model = loomtext.KnnBuilder().k(3).dims(8).euclidean().fit_from_directories(spark, str(folder / "hot"), str(folder / "cold"), "spam")
    got = best(model, probes(spark))
    assert got[1] == "SPAM" and got[2] == "BLOCK_LIST"
    with pytest.raises(errors.InvalidConfig):
        loomtext.KnnBuilder().k(3).fit_from_directories(spark, None, str(folder / "cold"), "spam")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "minkowski"])
def test_neighbours_in_blocks_equal_brute_force(spark, monkeypatch, metric):
    from loomtext.operators import knn

    monkeypatch.setattr(knn, "BROADCAST_VALUES", 60)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 4))
    x[7] = x[8]
    train = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "train_id bigint, vector array<double>, label string")
    ask = rng.standard_normal((9, 4))
    got = KnnModel(train, 5, metric, 3.0).neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "doc_id bigint, vector array<double>")).collect()
    d = np.round(distances(ask, x, metric, 3.0), 12)
    want = {(i, r + 1): j for i in range(9) for r, j in enumerate(sorted(range(40), key=lambda j: (d[i, j], j))[:5])}
    assert {(r.doc_id, r["rank"]): r.train_id for r in got} == want


def test_external_vectors_split_and_table_round_trips(spark, tmp_path):
    s, p = samples(spark), probes(spark)
    words = {w: deterministic_vector(w, 6) for t in HOT + COLD for w in t.split()}
    path = tmp_path / "v.bin"
    path.write_bytes(f"{len(words)} 6\n".encode() + b"".join(w.encode() + b" " + struct.pack("<6f", *v) + b"\n" for w, v in words.items()))
    file = loomtext.Word2VecFile(str(path))
    kept = file.extract_for_vocab(["Select PASSWORD, from nowhere!", "park"])
    assert set(kept.words) == {"select", "password", "from", "park"}
    assert np.allclose(kept.vector_for("unknown"), np.mean([words[w] for w in ("select", "password", "from", "park")], axis=0), atol=1e-6)
    every = file.extract_all()
    save_vectors(every, str(tmp_path / "vectors"))
    assert np.allclose(load_vectors(str(tmp_path / "vectors")).vector_for("park"), words["park"])
    model = loomtext.KnnClassifier.train(s, k=3, external=every, normalize_features=True)
    want = {r.doc_id: r.labels for r in model.classify(p).collect()}
    assert want[1][0].label == "WEB_ATTACK" and want[2][0].label == "RAW_DATA"
    save_split(model, str(tmp_path / "nlp"), str(tmp_path / "ml"))
    loomtext.save_binary(model, str(tmp_path / "whole"))
    for again in (load_split(spark, str(tmp_path / "nlp"), str(tmp_path / "ml")), loomtext.load_binary(spark, str(tmp_path / "whole"))):
        assert {r.doc_id: [(x.label, round(x.score, 4)) for x in r.labels] for r in again.classify(p).collect()} == {i: [(x.label, round(x.score, 4)) for x in labels] for i, labels in want.items()}
    with pytest.raises(errors.InvalidData):
        load_split(spark, str(tmp_path / "ml"), str(tmp_path / "nlp"))
    (tmp_path / "whole").write_bytes(b"LTXM" + struct.pack("<I", 99) + b"x")
    with pytest.raises(errors.VersionMismatch):
        loomtext.load_binary(spark, str(tmp_path / "whole"))
    bayes = loomtext.BayesClassifier.train(s, "TfIdf").model
    save_tables(bayes, str(tmp_path / "tables"))
    a, b = ({(r.doc_id, r.label): round(r.score, 9) for r in m.scores(p).collect()} for m in (bayes, load_tables(spark, str(tmp_path / "tables"))))
    assert a == b and len(a) == 8


@pytest.mark.parametrize("kernel", ["Linear", "Rbf", "Polynomial", "Sigmoid"])
def test_kernels(spark, kernel):
    model = loomtext.AdvancedClassifier.train(samples(spark), "Svm", "Count", loomtext.SvmConfig(kernel=kernel))
    got = best(model, probes(spark))
    assert got[1] == "WEB_ATTACK" or kernel == "Sigmoid"
    x = np.arange(6.0).reshape(2, 3)
    assert KernelMap is not None and model.model.scores(np.zeros((1, model.pipeline.output_dims))).shape == (1, 2) and x.shape == (2, 3)


@pytest.mark.parametrize("mode", ["Standard", "Balanced", "ExtraTrees"])
def test_forest_modes_and_out_of_bag_score(spark, mode):
    config = loomtext.ForestConfig(mode=mode, n_trees=25, bootstrap=True, oob_score=True, random_seed=3)
    model = loomtext.AdvancedClassifier.train(samples(spark), "RandomForest", "Count", config)
    assert best(model, probes(spark))[1] == "WEB_ATTACK"
    assert 0.0 <= model.oob_score <= 1.0
    again = loomtext.AdvancedClassifier.train(samples(spark), "RandomForest", "Count", config)
    assert again.oob_score == model.oob_score
    assert model.feature_importances.sum() == pytest.approx(1, abs=1e-6)


def test_ensemble_keeps_hits_of_each_member(spark):
    s = samples(spark)
    members = [(loomtext.BayesClassifier.train(s), 1.0), (loomtext.AdvancedClassifier.train(s, "LogisticRegression", "Count"), 2.0)]
    matchers = [loomtext.build_matcher(spark, [loomtext.Rule("sql", "", "select", 10.0)])]
    for strategy in ("WeightedAverage", "ProductOfExperts"):
        model = loomtext.EnsembleClassifier(members).with_strategy(strategy)
        for add in (False, True):
            got = {r.doc_id: r for r in model.classify(probes(spark), add, matchers).collect()}
            assert got[1].labels[0].label == "WEB_ATTACK" and len(got[1].extra_hits) == 2 and not got[2].extra_hits
            assert sum(x.score for x in got[1].labels) == pytest.approx(1)
    assert len({r.doc_id: r for r in loomtext.EnsembleClassifier(members, dedupe_hits=True).classify(probes(spark), False, matchers).collect()}[1].extra_hits) == 1


def test_alerts_and_engine(spark, tmp_path):
    (tmp_path / "alerts.json").write_text(json.dumps([{"title": "a", "description": "x", "match_rule": "select", "score": 70, "target_labels": ["SPAM", "MALWARE"]}, {"title": "b", "description": "y", "match_rule": "union", "score": 90, "target_labels": ["SPAM"]}]))
    alerts = loomtext.AlertMatcher.load_json_file(str(tmp_path / "alerts.json"))
    got = {r.doc_id: r.t for r in probes(spark).select("doc_id", alerts.alert_titles(F.col("text")).alias("t")).collect()}
    assert got[1] == ["a: x", "b: y"] and got[2] == []
    engine = loomtext.EngineBuilder().model(loomtext.BayesClassifier.train(samples(spark))).alerts(alerts).outputs(loomtext.OutputWriters.disabled()).build()
    rows = {r.doc_id: {x.label: x.score for x in r.classifications} for r in engine.classify(probes(spark)).collect()}
    assert rows[1]["SPAM"] == 90 and rows[1]["MALWARE"] == 70 and set(rows[2]) == {"WEB_ATTACK", "RAW_DATA"}
    with pytest.raises(errors.InvalidConfig):
        loomtext.EngineBuilder().build()


def test_rule_tables_over_the_limit_are_errors(spark):
    from loomtext.operators import rules

    many = spark.range(rules.MAX_RULES + 1).selectExpr("cast(id as int) as rule_id", "'x' as match_rule", "1D as score")
    with pytest.raises(errors.TooLarge):
        loomtext.match_join(probes(spark), many)
    assert loomtext.match_join(probes(spark), many.limit(3)).count() == 0


def test_repeated_ids_give_a_row_each_and_the_same_labels(spark):
    docs = spark.createDataFrame([(1, "select password"), (1, "union drop"), (2, "walk park")], "doc_id bigint, text string")
    for model in (loomtext.BayesClassifier.train(samples(spark)), loomtext.AdvancedClassifier.train(samples(spark), "LogisticRegression", "Count")):
        rows = model.classify(docs).collect()
        assert sorted(r.doc_id for r in rows) == [1, 1, 2]
        one, two = (r.labels for r in rows if r.doc_id == 1)
        assert one == two and len(one) == 2 and sum(x.score for x in one) == pytest.approx(1)


def test_label_encoder(spark):
    code = loomtext.LabelEncoder.fit(samples(spark))
    assert code.labels == ("RAW_DATA", "WEB_ATTACK") and code.encode("WEB_ATTACK") == 1 and code.decode(0) == "RAW_DATA" and code.decode(9) == "RAW_DATA"
    with pytest.raises(errors.InvalidConfig, match="unseen label"):
        code.encode("SPAM")
    df = spark.createDataFrame([("WEB_ATTACK",), (None,)], "l string")
    assert [r.c for r in df.select(code.encoded(F.col("l")).alias("c")).collect()] == [1, None]
    with pytest.raises(Exception, match="unseen label: SPAM"):
        spark.createDataFrame([("SPAM",)], "l string").select(code.encoded(F.col("l"))).collect()


def test_skipgram_is_deterministic_and_of_unit_length():
    texts = [t.split() for t in HOT + COLD]
    a, b = (train_skipgram(texts, 8) for _ in range(2))
    assert all(np.array_equal(a.words[w], b.words[w]) for w in a.words)
    assert np.allclose([np.linalg.norm(v) for v in a.words.values()], 1, atol=1e-5)


def test_large_trainers_of_spark(spark):
    s = samples(spark)
    for method, nlp in (("LogisticRegression", "TfIdf"), ("RandomForest", "Count"), ("LogisticRegression", "FastText")):
        got = best(loomtext.train_mllib(s, method, nlp, 8), probes(spark))
        assert nlp == "FastText" or got[1] == "WEB_ATTACK" and got[2] == "RAW_DATA"


def test_streams_are_scored_like_tables(spark, tmp_path):
    probes(spark).where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    matchers = [loomtext.build_matcher(spark, [loomtext.Rule("sql", "", "select", 10.0)])]
    assert score_rules(stream, matchers).isStreaming
    model = loomtext.BayesClassifier.train(samples(spark))
    q = classify_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), matchers)
    q.processAllAvailable()
    q.stop()
    rows = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1].labels[0].label == "WEB_ATTACK" and rows[1].extra_hits[0].title == "sql" and rows[3].extra_hits == []
