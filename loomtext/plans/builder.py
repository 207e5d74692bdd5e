"""Builders and the run from a YAML file to a report."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig
from loomtext.functions.labels import canonical_label
from loomtext.functions.scores import top_score
from loomtext.functions.text import decode_obfuscated_text
from loomtext.operators.models import AdvancedClassifier, BayesClassifier, Classifier, KnnClassifier, with_labels
from loomtext.operators.rules import RuleMatcher, build_matcher, load_rules
from loomtext.plans.config import ExtraMatch, ModelConfig, RulesFile, is_knn, method_kind, nlp_option, requires_p
from loomtext.sources.dataset import load_samples, union_samples
from loomtext.sources.security import MAX_FILE_BYTES, MAX_THREADS


@dataclass(frozen=True)
class ClassifierBuilder:
    """What a classifier is built from; every setter gives a new builder, so part-built ones can be shared."""

    spark: SparkSession
    method_: str | None = None
    nlp_: str | None = None
    hot_label_: str = "WEB_ATTACK"
    cold_label_: str = "RAW_DATA"
    hot_path_: str | None = None
    cold_path_: str | None = None
    recursive_: bool = True
    threads_: int | None = None
    dims_: int = 32
    k_: int | None = None
    p_: float | None = None
    config_: Any = None
    samples_: DataFrame | None = None
    normalize_: bool = False
    external_: Any = None
    decode_: bool = False
    max_bytes_: int = MAX_FILE_BYTES

    def _with(self, **kw: Any) -> ClassifierBuilder:
        return replace(self, **{k + "_": v for k, v in kw.items()})

    def method(self, name: str) -> ClassifierBuilder:
        return self._with(method=method_kind(name))

    def nlp(self, name: str) -> ClassifierBuilder:
        return self._with(nlp=nlp_option(name))

    def hot_label(self, label: str) -> ClassifierBuilder:
        return self._with(hot_label=canonical_label(label))

    def cold_label(self, label: str) -> ClassifierBuilder:
        return self._with(cold_label=canonical_label(label))

    def hot_path(self, path: str) -> ClassifierBuilder:
        return self._with(hot_path=path)

    def cold_path(self, path: str) -> ClassifierBuilder:
        return self._with(cold_path=path)

    def recursive(self, on: bool) -> ClassifierBuilder:
        return self._with(recursive=on)

    def threads(self, n: int | None) -> ClassifierBuilder:
        if n is not None and not 1 <= n <= MAX_THREADS:
            raise InvalidConfig("threads", f"must be 1 to {MAX_THREADS}")
        return self._with(threads=n)

    def embedding_dimensions(self, n: int) -> ClassifierBuilder:
        if n < 1:
            raise InvalidConfig("embedding_dimensions", "must be at least 1")
        return self._with(dims=n)

    def samples(self, samples: DataFrame) -> ClassifierBuilder:
        """(text, label) with sample_id or doc_id: instead of folders."""
        return self._with(samples=samples)

    def k(self, k: int) -> ClassifierBuilder:
        return self._with(k=k)

    def p(self, p: float) -> ClassifierBuilder:
        return self._with(p=p)

    def config(self, config: Any) -> ClassifierBuilder:
        """The method's own configuration (LogisticConfig, SvmConfig, ForestConfig, BoostingConfig, IsolationConfig)."""
        return self._with(config=config.validate())

    def normalize_features(self, on: bool = True) -> ClassifierBuilder:
        return self._with(normalize=on)

    def external_embeddings(self, vectors: Any) -> ClassifierBuilder:
        return self._with(external=vectors)

    def from_rules_file(self, rules: RulesFile) -> ClassifierBuilder:
        b = self.method(rules.model.method).nlp(rules.nlp).threads(rules.threads)
        b = b._with(hot_label=rules.hot_label, cold_label=rules.cold_label, hot_path=rules.hot_path, cold_path=rules.cold_path, recursive=rules.recursive, decode=rules.decode, max_bytes=rules.max_file_bytes or MAX_FILE_BYTES)
        if rules.embedding_dimensions is not None:
            b = b.embedding_dimensions(rules.embedding_dimensions)
        if is_knn(rules.model.method):
            return b.k(rules.model.k).p(rules.model.p)
        return b._with(config=rules.model.advanced())

    def _samples(self) -> DataFrame:
        if self.samples_ is not None:
            s = self.samples_
            ids = "doc_id" if "doc_id" in s.columns else "sample_id"
            s = s.select(F.col(ids).cast("bigint").alias("doc_id"), "text", "label")
        else:
            if not self.hot_path_ or not self.cold_path_:
                raise InvalidConfig("builder", "needs samples, or a hot and a cold path")
            hot, cold = (load_samples(self.spark, p, l, self.recursive_, self.max_bytes_) for p, l in ((self.hot_path_, self.hot_label_), (self.cold_path_, self.cold_label_)))
            s = union_samples(hot, cold).select(F.col("sample_id").alias("doc_id"), "text", "label")
        return (s.withColumn("text", decode_obfuscated_text(F.col("text"))) if self.decode_ else s).persist()

    def build(self) -> Classifier:
        if not self.method_ or not self.nlp_:
            raise InvalidConfig("builder", "needs a method and an nlp option")
        if self.method_ == "Bayes":
            return BayesClassifier.train(self._samples(), self.nlp_)
        if is_knn(self.method_):
            if self.k_ is None or self.k_ < 1:
                raise InvalidConfig("builder", "nearest neighbours need k of at least 1")
            if requires_p(self.method_) and not (self.p_ and self.p_ > 0):
                raise InvalidConfig("builder", "Minkowski needs a positive p")
            metric = ModelConfig(self.method_).metric
            return KnnClassifier.train(self._samples(), self.nlp_, self.k_, metric, self.p_ or 2.0, self.dims_, self.normalize_, self.external_)
        if self.config_ is None:
            raise InvalidConfig("builder", f"{self.method_} needs a configuration")
        return AdvancedClassifier.train(self._samples(), self.method_, self.nlp_, self.config_, self.dims_, self.external_, self.hot_label_, self.cold_label_)


def builder(spark: SparkSession) -> ClassifierBuilder:
    return ClassifierBuilder(spark)


def builder_from_rules(spark: SparkSession, rules: RulesFile) -> ClassifierBuilder:
    return builder(spark).from_rules_file(rules)


def matcher_from(spark: SparkSession, extra: ExtraMatch) -> RuleMatcher:
    return build_matcher(spark, load_rules(extra.path, extra.recursive, extra.score_add_points, extra.title, extra.description), extra.engine)


def matchers_from_rules_file(spark: SparkSession, rules: RulesFile) -> list[RuleMatcher]:
    return [matcher_from(spark, e) for e in rules.extra_match]


def report(classified: DataFrame, docs: DataFrame, untitled: str = "object", when: Any = None) -> DataFrame:
    """Report rows of classified documents (doc_id, labels, extra_hits); docs has their source_name, a path.

    title_object is the last name of the path, or `untitled` where it has none.
    """
    title = F.regexp_extract("source_name", r"[^/\\]*$", 0)
    title = F.when(F.length(title) > 0, title).otherwise(F.lit(untitled))
    names = F.array_join(F.transform("labels", lambda x: F.concat(x["label"], F.lit(":"), F.format_string("%.2f", x["score"]))), ",")
    at = F.current_timestamp() if when is None else F.lit(when)
    joined = classified.join(docs.select("doc_id", "source_name"), "doc_id")
    return joined.select(title.alias("title_object"), F.col("source_name").alias("name_file_dataset"), names.alias("classify_names_list"), at.alias("date_of_occurrence"), (top_score(F.col("labels")) * 100).alias("score_percent"), F.array_join(F.transform("extra_hits", lambda h: h["title"]), ",").alias("match_titles"))


def run_rules_pipeline(spark: SparkSession, rules: RulesFile, path: str) -> DataFrame:
    """Train on the folders of the configuration, classify the files below path, and report on each.

    Nothing is written: csv_output and json_output are for sources.report.
    """
    model = builder_from_rules(spark, rules).build()
    probes = load_samples(spark, path, "RAW_DATA", rules.recursive, rules.max_file_bytes or MAX_FILE_BYTES).withColumnRenamed("sample_id", "doc_id")
    view = probes.withColumn("text", decode_obfuscated_text(F.col("text"))) if rules.decode else probes
    ranked = model.classify(view).select("doc_id", "labels")
    classified = with_labels(probes, ranked, rules.score_sum, matchers_from_rules_file(spark, rules))  # rules read the text as it is
    return report(classified, probes).orderBy("name_file_dataset")
