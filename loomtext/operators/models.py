"""Classifiers: a text representation and a model behind one interface, batch first."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import EmptyTrainingSet, InvalidConfig, TooLarge
from loomtext.functions.scores import rank
from loomtext.operators import bayes as nb
from loomtext.operators import ensemble, linear, trees
from loomtext.operators.embeddings import document_vectors, train_word_vectors
from loomtext.operators.features import TfIdf, fit_tfidf, to_vectors, zscore
from loomtext.operators.knn import KnnModel
from loomtext.operators.rules import HIT, RuleMatcher, boosted, find_matches

NLP = ("Count", "TfIdf", "Word2Vec", "FastText")
DIMS = 32
#: Numbers in a dense training matrix that the exact trainers take; beyond it backend="mllib".
MAX_DENSE = 200_000_000
METHODS = ("LogisticRegression", "Svm", "RandomForest", "GradientBoosting", "IsolationForest")
CONFIGS = {"LogisticRegression": linear.LogisticConfig, "Svm": linear.SvmConfig, "RandomForest": trees.ForestConfig, "GradientBoosting": trees.BoostingConfig, "IsolationForest": trees.IsolationConfig}


def with_labels(docs: DataFrame, ranked: DataFrame, add: bool, matchers: list[RuleMatcher]) -> DataFrame:
    """(doc_id, labels, extra_hits) of docs (doc_id, text) and their ranked labels."""
    hits = docs.select("doc_id", F.coalesce(find_matches(F.col("text"), matchers), F.array().cast(HIT)).alias("extra_hits"))
    rows = hits.join(ranked, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<label:string,score:double>>")))
    rows = rows.withColumn("labels", boosted(F.col("labels"), F.col("extra_hits"))) if add and matchers else rows
    return rows.select("doc_id", "labels", "extra_hits")


class Classifier(ABC):
    """Gives every document its labels with scores. Subclasses give scores; users may bring their own."""

    @abstractmethod
    def scores(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, score) for docs (doc_id, text)."""

    def classify(self, docs: DataFrame, add_rules: bool = False, matchers: list[RuleMatcher] | None = None) -> DataFrame:
        """(doc_id, labels, extra_hits): labels by descending score, boosted by rules if add_rules; hits in either case.

        A row of docs gives a row. Rows that repeat a doc_id have hits of their own text, and the labels of
        the document that they make together; a null doc_id has hits and no labels. Texts stay where they are:
        what is joined is hits and labels.
        """
        return with_labels(docs, rank(self.scores(docs), "doc_id"), add_rules, matchers or [])

    def classify_text(self, spark: SparkSession, text: str, add_rules: bool = False, matchers: list[RuleMatcher] | None = None):
        """One text as a batch of one row."""
        return self.classify(spark.createDataFrame([(0, text)], "doc_id bigint, text string"), add_rules, matchers).first()


class ExplainableClassifier(Classifier):
    """A classifier that can say what each token adds to a document's best label."""

    @abstractmethod
    def explain(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, pos, token, contribution) of each token of docs (doc_id, text)."""


@dataclass
class BayesClassifier(ExplainableClassifier):
    model: nb.BayesModel

    @classmethod
    def train(cls, samples: DataFrame, nlp: str = "Count") -> BayesClassifier:
        return cls(nb.train_bayes(samples, nlp))

    def scores(self, docs: DataFrame) -> DataFrame:
        return self.model.scores(docs)

    def explain(self, docs: DataFrame) -> DataFrame:
        return self.model.explain(docs)


@dataclass
class FeaturePipeline:
    """A representation fitted on training texts and used unchanged on others; its IDF is that of training."""

    nlp: str
    tfidf: TfIdf | None = None
    vectors: Any = None
    use_idf: bool = False

    @classmethod
    def fit(cls, samples: DataFrame, nlp: str, dims: int = DIMS, external: Any = None, backend: str = "exact", idf_for_trained: bool = True) -> FeaturePipeline:
        if external is not None:
            return cls("External", fit_tfidf(samples), external.validate(), True)
        if nlp not in NLP:
            raise InvalidConfig("nlp", f"unknown option {nlp!r}")
        if nlp in ("Count", "TfIdf"):
            return cls(nlp, fit_tfidf(samples))
        idf = fit_tfidf(samples) if idf_for_trained else None
        return cls(nlp, idf, train_word_vectors(samples, nlp, dims, backend), idf_for_trained)

    @property
    def output_dims(self) -> int:
        return self.vectors.dims if self.vectors is not None else max(1, self.tfidf.size)

    def transform(self, docs: DataFrame) -> DataFrame:
        """(doc_id, idxs, vals): sparse rows; all coordinates for word vectors."""
        if self.vectors is not None:
            dense = document_vectors(docs, self.vectors, self.tfidf if self.use_idf else None)
            return dense.select("doc_id", F.sequence(F.lit(0), F.lit(self.output_dims - 1)).alias("idxs"), F.col("vector").alias("vals"))
        return to_vectors(self.tfidf.weights(docs, count_only=self.nlp == "Count"), docs)


@dataclass
class DensePipeline:
    """For tables that have their vectors already: (doc_id, vector)."""

    output_dims: int

    def transform(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.sequence(F.lit(0), F.lit(self.output_dims - 1)).alias("idxs"), F.col("vector").cast("array<double>").alias("vals"))


def matrix_of(rows: pa.Table | pa.RecordBatch, dims: int, idxs: int = 1, vals: int = 2) -> np.ndarray:
    """A dense matrix of sparse rows."""
    x = np.zeros((rows.num_rows, dims))
    there = np.ones(rows.num_rows, bool)
    if rows.column(vals).null_count:  # a missing vector is one of NaNs
        there = np.asarray(pc.is_valid(rows.column(vals)))
        x[~there] = np.nan
        rows = rows.filter(pa.array(there))
    at, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(idxs), rows.column(vals)))
    lengths, given = (np.asarray(pc.list_value_length(c).fill_null(0)) for c in (at, v))
    if (lengths != given).any():
        raise ValueError("a row has more places than values, or fewer")
    x[np.repeat(np.flatnonzero(there), lengths), np.asarray(at.flatten())] = np.asarray(v.flatten())
    return x


@dataclass
class AdvancedClassifier(Classifier):
    """Logistic regression, SVM, random forest, boosting or isolation forest over a FeaturePipeline."""

    method: str
    pipeline: FeaturePipeline
    labels: list[str]
    model: Any

    @classmethod
    def train(cls, samples: DataFrame, method: str, nlp: str = "TfIdf", config: Any = None, dims: int = DIMS, external: Any = None, hot_label: str = "WEB_ATTACK", cold_label: str = "RAW_DATA", threads: int | None = None) -> AdvancedClassifier:
        """From (doc_id, text, label). Features are computed in parallel; the matrix, checked against
        MAX_DENSE, is what the exact trainers get. threads never changes results."""
        if method not in METHODS:
            raise InvalidConfig("method", f"unknown method {method!r}")
        config = (config or CONFIGS[method]()).validate()
        samples = samples.select("doc_id", "text", "label")
        n = samples.count()
        if not n:
            raise EmptyTrainingSet(method, "no sample")
        return cls._fit(samples, n, FeaturePipeline.fit(samples, nlp, dims, external), method, config, hot_label, cold_label)

    @classmethod
    def train_dense(cls, samples: DataFrame, method: str, config: Any = None, hot_label: str = "WEB_ATTACK", cold_label: str = "RAW_DATA") -> AdvancedClassifier:
        """From (doc_id, vector, label); what scores() gets then has vectors too."""
        config = (config or CONFIGS[method]()).validate()
        head = samples.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        if not head.n:
            raise EmptyTrainingSet(method, "no sample")
        return cls._fit(samples, head.n, DensePipeline(head.d), method, config, hot_label, cold_label)

    @classmethod
    def _fit(cls, samples: DataFrame, n: int, pipe: Any, method: str, config: Any, hot_label: str, cold_label: str) -> AdvancedClassifier:
        spark = samples.sparkSession
        if n * pipe.output_dims > MAX_DENSE:
            raise TooLarge(method, f"{n} rows of {pipe.output_dims} features; train_mllib takes larger ones")
        rows = pipe.transform(samples).join(samples.select("doc_id", "label"), "doc_id").orderBy("doc_id").toArrow()
        x = matrix_of(rows, pipe.output_dims)
        names = rows.column("label").to_pylist()
        labels = [hot_label, cold_label] if method == "IsolationForest" else sorted(set(names), key=str.encode)
        if method == "IsolationForest":
            return cls(method, pipe, labels, trees.fit_isolation(x, config, sum(l == hot_label for l in names), spark))
        code = {l: i for i, l in enumerate(labels)}
        y = np.array([code[l] for l in names])
        fit = {"LogisticRegression": linear.fit_logistic, "Svm": linear.fit_svm, "RandomForest": trees.fit_forest, "GradientBoosting": trees.fit_boosting}
        model = fit[method](x, y, len(labels), config, *([] if method == "GradientBoosting" else [spark]))
        return cls(method, pipe, labels, model)

    def scores(self, docs: DataFrame) -> DataFrame:
        """Rows are scored in slices, so that at most a few hundred dense rows exist at a time."""
        held = docs.sparkSession.sparkContext.broadcast((self.model, self.labels, self.pipeline.output_dims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, labels, dims = held.value
            step = max(1, min(1024, 4_000_000 // dims))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    s = model.scores(matrix_of(piece, dims))
                    ids = piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), len(labels))))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(labels * piece.num_rows, pa.string()), pa.array(s.ravel())], names=["doc_id", "label", "score"])

        features = self.pipeline.transform(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "idxs", "vals")
        return features.mapInArrow(run, "doc_id bigint, label string, score double")

    @property
    def oob_score(self) -> float | None:
        return getattr(self.model, "oob", None)

    @property
    def feature_importances(self) -> np.ndarray | None:
        return getattr(self.model, "importances", None)


def _typed(method: str):
    class Typed(AdvancedClassifier):
        @classmethod
        def train(cls, samples: DataFrame, nlp: str = "TfIdf", config: Any = None, threads: int | None = None, dims: int = DIMS, **more: Any) -> AdvancedClassifier:
            return AdvancedClassifier.train(samples, method, nlp, config, dims, threads=threads, **more)

    Typed.__name__ = Typed.__qualname__ = method + "Classifier"
    return Typed


LogisticClassifier, SvmClassifier, RandomForestClassifier, GradientBoostingClassifier, IsolationForestClassifier = map(_typed, METHODS)


@dataclass
class MllibClassifier(Classifier):
    """The same heads trained by Spark ML, for tables that don't fit the exact trainers."""

    pipeline: FeaturePipeline
    labels: list[str]
    model: Any

    def _vectors(self, docs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.linalg import Vectors, VectorUDT

        dims = self.pipeline.output_dims
        sparse = F.udf(lambda i, v: Vectors.sparse(dims, i, v), VectorUDT())
        features = array_to_vector("vals") if self.pipeline.vectors is not None else sparse("idxs", "vals")
        return self.pipeline.transform(docs).select("doc_id", features.alias("features"))

    def scores(self, docs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._vectors(docs))
        column = "probability" if "probability" in out.columns else "rawPrediction"
        each = out.select("doc_id", F.posexplode(vector_to_array(column)).alias("at", "score"))
        return each.withColumn("label", F.element_at(F.array(*map(F.lit, self.labels)), F.col("at") + 1)).select("doc_id", "label", "score")


def train_mllib(samples: DataFrame, method: str, nlp: str = "FastText", dims: int = DIMS) -> MllibClassifier:
    from pyspark.ml import classification as ml

    pipe = FeaturePipeline.fit(samples, nlp, dims, backend="mllib")
    labels = sorted((r.label for r in samples.select("label").distinct().collect()), key=str.encode)
    heads = {"LogisticRegression": lambda: ml.LogisticRegression(regParam=1e-3), "Svm": lambda: ml.OneVsRest(classifier=ml.LinearSVC(regParam=1e-2)), "RandomForest": lambda: ml.RandomForestClassifier(numTrees=21, maxDepth=6, seed=1), "GradientBoosting": lambda: ml.OneVsRest(classifier=ml.GBTClassifier(maxIter=24, maxDepth=1, stepSize=0.2, seed=1))}
    if method not in heads:
        raise InvalidConfig("mllib", f"no such head: {method!r}")
    out = MllibClassifier(pipe, labels, None)
    names = F.array(*map(F.lit, labels))
    data = out._vectors(samples).join(samples.select("doc_id", (F.array_position(names, F.col("label")) - 1).cast("double").alias("label")), "doc_id")
    out.model = heads[method]().fit(data)
    return out


@dataclass
class KnnClassifier(Classifier):
    pipeline: FeaturePipeline
    knn: KnnModel
    normalise: bool = False
    fitted: DataFrame | None = None

    @classmethod
    def train(cls, samples: DataFrame, nlp: str = "FastText", k: int = 3, metric: str = "cosine", p: float = 2.0, dims: int = DIMS, normalize_features: bool = False, external: Any = None, threads: int | None = None) -> KnnClassifier:
        """Over word vectors only. Vectors trained here are averaged without IDF, external ones with it."""
        if external is None and nlp not in ("Word2Vec", "FastText"):
            raise InvalidConfig("knn", "needs Word2Vec or FastText")
        KnnModel(samples, k, metric, p)
        if not samples.take(1):
            raise EmptyTrainingSet("knn", "no sample")
        pipe = FeaturePipeline.fit(samples, nlp, dims, external, idf_for_trained=False)
        raw = document_vectors(samples, pipe.vectors, pipe.tfidf if pipe.use_idf else None).persist()
        train = zscore(raw) if normalize_features else raw
        train = train.join(samples.select("doc_id", "label"), "doc_id").select(F.col("doc_id").alias("train_id"), "vector", "label").persist()
        return cls(pipe, KnnModel(train, k, metric, p), normalize_features, raw)

    def scores(self, docs: DataFrame) -> DataFrame:
        probes = document_vectors(docs, self.pipeline.vectors, self.pipeline.tfidf if self.pipeline.use_idf else None)
        return self.knn.scores(zscore(probes, self.fitted) if self.normalise else probes)


@dataclass
class EnsembleClassifier(Classifier):
    members: list[tuple[Classifier, float]]
    strategy: str = "WeightedAverage"
    dedupe_hits: bool = False

    def with_strategy(self, strategy: str) -> EnsembleClassifier:
        return EnsembleClassifier(self.members, strategy, self.dedupe_hits)

    def _merged(self, docs: DataFrame, add: bool, matchers: list[RuleMatcher]) -> DataFrame:
        parts = [(m.classify(docs, add, matchers).select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.label", "l.score"), w) for m, w in self.members]
        return ensemble.merge(parts, self.strategy)

    def scores(self, docs: DataFrame) -> DataFrame:
        return self._merged(docs, False, [])

    def classify(self, docs: DataFrame, add_rules: bool = False, matchers: list[RuleMatcher] | None = None) -> DataFrame:
        """Members boost their own scores; their hits follow one another, once with dedupe_hits."""
        matchers = matchers or []
        rows = with_labels(docs, rank(self._merged(docs, add_rules, matchers), "doc_id"), False, matchers)
        return rows if self.dedupe_hits else rows.withColumn("extra_hits", F.flatten(F.array_repeat("extra_hits", len(self.members))))

