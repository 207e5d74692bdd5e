"""loomtext: text classification and rule scoring as Spark DataFrame plans."""

from importlib import import_module

__version__ = "0.2.0"

_PUBLIC = {
    "errors": "EmptyTrainingSet InvalidConfig InvalidData InvalidLabel PatternError TooLarge Unsupported",
    "functions.labels": "CANONICAL canonical_label label_column LabelEncoder",
    "operators.embeddings": "FastTextConfig WordVectors train_word_vectors document_vectors",
    "operators.features": "TfIdf fit_tfidf",
    "operators.linear": "LogisticConfig SvmConfig",
    "operators.models": "AdvancedClassifier BayesClassifier Classifier EnsembleClassifier ExplainableClassifier FeaturePipeline GradientBoostingClassifier IsolationForestClassifier KnnClassifier LogisticClassifier RandomForestClassifier SvmClassifier train_mllib",
    "operators.rules": "AlertMatcher RegexMatcher Rule RuleMatcher build_matcher load_rules match_join",
    "operators.trees": "BoostingConfig ForestConfig IsolationConfig",
    "plans.builder": "ClassifierBuilder builder builder_from_rules matchers_from_rules_file report run_rules_pipeline",
    "plans.compat": "Engine EngineBuilder NlpPipelineBuilder OutputWriters",
    "plans.config": "ExtraMatch ModelConfig RulesFile",
    "plans.persistence": "load_binary load_json save_binary save_json",
    "plans.specs": "AdvancedSpec BayesBuilder BayesSpec Builder ClassifierSpec KnnBuilder KnnSpec MODULES TypedClassifierBuilder",
    "sources.dataset": "collect_files load_samples sample_iter union_samples",
    "sources.embedding_files": "CentroidVectors FastTextFile SubwordVectors Word2VecFile",
    "sources.report": "write_csv write_json",
    "sources.security": "read_text",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Public names are imported when first asked for, so that a worker loads only what it uses."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return [*globals(), *__all__]
