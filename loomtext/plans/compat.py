"""The older engine: a model's labels merged with alert labels by the larger score."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomtext.errors import InvalidConfig
from loomtext.functions.scores import rank
from loomtext.operators.models import Classifier, FeaturePipeline
from loomtext.operators.rules import AlertMatcher, max_merge


@dataclass(frozen=True)
class OutputWriters:
    """Kept for older callers; the engine writes nothing."""

    enabled: bool = False

    @classmethod
    def disabled(cls) -> OutputWriters:
        return cls(False)

    @property
    def is_disabled(self) -> bool:
        return not self.enabled


@dataclass
class Engine:
    model: Classifier
    alerts: AlertMatcher | None = None

    def classify(self, docs: DataFrame) -> DataFrame:
        """(doc_id, classifications): the model's scores in [0, 1] and alert scores up to 100, not rescaled."""
        scores = self.model.scores(docs)
        merged = max_merge(scores, self.alerts.classify_labels(docs)) if self.alerts else scores
        return rank(merged, "doc_id").withColumnRenamed("labels", "classifications")


class EngineBuilder:
    def __init__(self):
        self._model: Classifier | None = None
        self._alerts: AlertMatcher | None = None

    def model(self, model: Classifier) -> EngineBuilder:
        self._model = model
        return self

    def alerts(self, alerts: AlertMatcher) -> EngineBuilder:
        self._alerts = alerts
        return self

    def outputs(self, writers: OutputWriters) -> EngineBuilder:
        return self

    def build(self) -> Engine:
        if self._model is None:
            raise InvalidConfig("engine", "needs a model")
        return Engine(self._model, self._alerts)


class NlpPipelineBuilder:
    """Deprecated: use FeaturePipeline.fit."""

    def __init__(self):
        warnings.warn("NlpPipelineBuilder is deprecated", DeprecationWarning, stacklevel=2)
        self._kind, self._dims = "TfIdf", 32

    def representation(self, kind: str) -> NlpPipelineBuilder:
        self._kind = kind
        return self

    def fasttext_config(self, config) -> NlpPipelineBuilder:
        self._kind, self._dims = "FastText", config.dimensions
        return self

    def build(self, samples: DataFrame) -> FeaturePipeline:
        return FeaturePipeline.fit(samples, self._kind, self._dims)
