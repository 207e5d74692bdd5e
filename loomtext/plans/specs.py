"""Other ways to a classifier: specifications by family, a builder that can't be finished early, builders of two families."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

from loomtext.errors import InvalidConfig
from loomtext.operators.models import METHODS, BayesClassifier, Classifier, KnnClassifier
from loomtext.plans.builder import ClassifierBuilder, builder
from loomtext.sources.dataset import load_samples, union_samples

T = TypeVar("T")


class Builder(ABC, Generic[T]):
    """Anything that is set up step by step and then built; every setter gives a new builder."""

    @abstractmethod
    def build(self) -> T:
        """What was set up, or InvalidConfig."""


@dataclass(frozen=True)
class _Spec(Builder[Classifier]):
    inner: ClassifierBuilder

    def _with(self, inner: ClassifierBuilder):
        return replace(self, inner=inner)

    def nlp(self, name: str):
        return self._with(self.inner.nlp(name))

    def threads(self, n: int | None):
        return self._with(self.inner.threads(n))

    def hot_label(self, label: str):
        return self._with(self.inner.hot_label(label))

    def cold_label(self, label: str):
        return self._with(self.inner.cold_label(label))

    def recursive(self, on: bool):
        return self._with(self.inner.recursive(on))

    def samples(self, samples: DataFrame):
        return self._with(self.inner.samples(samples))

    def training_data(self, hot: str, cold: str):
        return self._with(self.inner.hot_path(hot).cold_path(cold))

    def build(self) -> Classifier:
        return self.inner.build()


class BayesSpec(_Spec):
    pass


class KnnSpec(_Spec):
    def dims(self, n: int):
        return self._with(self.inner.embedding_dimensions(n))

    def normalize_features(self, on: bool = True):
        return self._with(self.inner.normalize_features(on))

    def external_embeddings(self, vectors: Any):
        return self._with(self.inner.external_embeddings(vectors))

    external_fasttext = external_embeddings


class AdvancedSpec(_Spec):
    def embedding_dims(self, n: int):
        return self._with(self.inner.embedding_dimensions(n))

    def external_embeddings(self, vectors: Any):
        return self._with(self.inner.external_embeddings(vectors))

    external_fasttext = external_embeddings


class ClassifierSpec:
    """A specification for each family; nlp is Count for naive Bayes and Word2Vec for the others unless set."""

    @staticmethod
    def bayes(spark: SparkSession) -> BayesSpec:
        return BayesSpec(builder(spark).method("Bayes").nlp("Count"))

    @staticmethod
    def _knn(spark: SparkSession, method: str, k: int, p: float | None = None) -> KnnSpec:
        inner = builder(spark).method(method).nlp("Word2Vec").k(k)
        return KnnSpec(inner if p is None else inner.p(p))

    @classmethod
    def knn_cosine(cls, spark: SparkSession, k: int) -> KnnSpec:
        return cls._knn(spark, "KnnCosine", k)

    @classmethod
    def knn_euclidean(cls, spark: SparkSession, k: int) -> KnnSpec:
        return cls._knn(spark, "KnnEuclidean", k)

    @classmethod
    def knn_manhattan(cls, spark: SparkSession, k: int) -> KnnSpec:
        return cls._knn(spark, "KnnManhattan", k)

    @classmethod
    def knn_minkowski(cls, spark: SparkSession, k: int, p: float) -> KnnSpec:
        return cls._knn(spark, "KnnMinkowski", k, p)

    @staticmethod
    def _advanced(spark: SparkSession, method: str, config: Any) -> AdvancedSpec:
        return AdvancedSpec(builder(spark).method(method).nlp("Word2Vec").config(config))

    @classmethod
    def logistic_regression(cls, spark: SparkSession, config: Any) -> AdvancedSpec:
        return cls._advanced(spark, "LogisticRegression", config)

    @classmethod
    def random_forest(cls, spark: SparkSession, config: Any) -> AdvancedSpec:
        return cls._advanced(spark, "RandomForest", config)

    @classmethod
    def svm(cls, spark: SparkSession, config: Any) -> AdvancedSpec:
        return cls._advanced(spark, "Svm", config)

    @classmethod
    def gradient_boosting(cls, spark: SparkSession, config: Any) -> AdvancedSpec:
        return cls._advanced(spark, "GradientBoosting", config)

    @classmethod
    def isolation_forest(cls, spark: SparkSession, config: Any) -> AdvancedSpec:
        return cls._advanced(spark, "IsolationForest", config)


@dataclass(frozen=True)
class TypedClassifierBuilder:
    """A builder that has no build() until method, nlp and training data are set, each once."""

    inner: ClassifierBuilder
    have: frozenset[str] = frozenset()

    @classmethod
    def new(cls, spark: SparkSession) -> TypedClassifierBuilder:
        return cls(builder(spark))

    def _set(self, what: str, inner: ClassifierBuilder) -> TypedClassifierBuilder:
        if what in self.have:
            raise InvalidConfig("builder", f"{what} is set already")
        have = self.have | {what}
        return (ReadyClassifierBuilder if have == {"method", "nlp", "training data"} else TypedClassifierBuilder)(inner, have)

    def method(self, name: str) -> TypedClassifierBuilder:
        return self._set("method", self.inner.method(name))

    def nlp(self, name: str) -> TypedClassifierBuilder:
        return self._set("nlp", self.inner.nlp(name))

    def training_data(self, hot_path: str, hot_label: str, cold_path: str, cold_label: str) -> TypedClassifierBuilder:
        return self._set("training data", self.inner.hot_path(hot_path).hot_label(hot_label).cold_path(cold_path).cold_label(cold_label))

    def recursive(self, on: bool):
        return replace(self, inner=self.inner.recursive(on))

    def threads(self, n: int | None):
        return replace(self, inner=self.inner.threads(n))

    def k(self, k: int):
        return replace(self, inner=self.inner.k(k))

    def p(self, p: float):
        return replace(self, inner=self.inner.p(p))

    def config(self, config: Any):
        """The configuration of whichever method: LogisticConfig, SvmConfig, ForestConfig, BoostingConfig, IsolationConfig."""
        return replace(self, inner=self.inner.config(config))


class ReadyClassifierBuilder(TypedClassifierBuilder):
    def build(self) -> Classifier:
        return self.inner.build()


@dataclass(frozen=True)
class BayesBuilder(Builder[BayesClassifier]):
    samples_: DataFrame | None = None
    nlp_: str = "Count"

    def nlp(self, name: str) -> BayesBuilder:
        return replace(self, nlp_=name)

    def samples(self, samples: DataFrame) -> BayesBuilder:
        return replace(self, samples_=samples)

    def threads(self, n: int | None) -> BayesBuilder:
        return self

    def build(self) -> BayesClassifier:
        if self.samples_ is None:
            raise InvalidConfig("bayes", "needs samples")
        return builder(self.samples_.sparkSession).method("Bayes").nlp(self.nlp_).samples(self.samples_).build()


@dataclass(frozen=True)
class KnnBuilder(Builder[KnnClassifier]):
    """Word2Vec of 32 dimensions and cosine distance unless set."""

    samples_: DataFrame | None = None
    nlp_: str = "Word2Vec"
    metric_: str = "cosine"
    k_: int | None = None
    p_: float | None = None
    dims_: int = 32
    normalize_: bool = False
    external_: Any = None

    def nlp(self, name: str) -> KnnBuilder:
        return replace(self, nlp_=name)

    def samples(self, samples: DataFrame) -> KnnBuilder:
        return replace(self, samples_=samples)

    def k(self, k: int) -> KnnBuilder:
        return replace(self, k_=k)

    def p(self, p: float) -> KnnBuilder:
        return replace(self, p_=p)

    def dims(self, n: int) -> KnnBuilder:
        return replace(self, dims_=n)

    def threads(self, n: int | None) -> KnnBuilder:
        return self

    def normalize_features(self, on: bool = True) -> KnnBuilder:
        return replace(self, normalize_=on)

    def external_fasttext(self, vectors: Any) -> KnnBuilder:
        return replace(self, external_=vectors)

    def metric(self, name: str, p: float | None = None) -> KnnBuilder:
        return replace(self, metric_=name, p_=self.p_ if p is None else p)

    def cosine(self) -> KnnBuilder:
        return self.metric("cosine")

    def euclidean(self) -> KnnBuilder:
        return self.metric("euclidean")

    def manhattan(self) -> KnnBuilder:
        return self.metric("manhattan")

    def minkowski(self, p: float) -> KnnBuilder:
        return self.metric("minkowski", p)

    def fit_from_directories(self, spark: SparkSession, hot_path: str | None, cold_path: str | None, hot_label: str) -> KnnClassifier:
        """Trained on the files below both folders; those of the cold one are BLOCK_LIST."""
        for path, name in ((hot_path, "hot"), (cold_path, "cold")):
            if path is None:
                raise InvalidConfig("knn", f"the {name} directory is required")
        both = union_samples(load_samples(spark, hot_path, hot_label), load_samples(spark, cold_path, "BLOCK_LIST"))
        return self.samples(both).build()

    def build(self) -> KnnClassifier:
        if self.samples_ is None:
            raise InvalidConfig("knn", "needs samples")
        b = builder(self.samples_.sparkSession).method("Knn" + self.metric_.capitalize()).nlp(self.nlp_).samples(self.samples_)
        b = b.embedding_dimensions(self.dims_).normalize_features(self.normalize_).external_embeddings(self.external_)
        b = b if self.k_ is None else b.k(self.k_)
        return (b if self.p_ is None else b.p(self.p_)).build()


@dataclass(frozen=True)
class Module:
    """The entry to one family: a builder with its method set, with or without a configuration."""

    method: str

    def factory(self, spark: SparkSession) -> ClassifierBuilder:
        return builder(spark).method(self.method)

    def with_config(self, spark: SparkSession, config: Any) -> ClassifierBuilder:
        return self.factory(spark).config(config)


MODULES = {name: Module(name) for name in (*METHODS, "Bayes", "KnnCosine", "KnnEuclidean", "KnnManhattan", "KnnMinkowski")}
