"""YAML configuration of a classification run."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from loomtext.errors import InvalidConfig
from loomtext.functions.labels import canonical_label
from loomtext.operators.linear import LogisticConfig, SvmConfig
from loomtext.operators.trees import BoostingConfig, ForestConfig, IsolationConfig
from loomtext.sources.security import MAX_THREADS, MAX_YAML_BYTES, input_path, output_path, read_text

_KNN = {"KnnCosine": "cosine", "KnnEuclidean": "euclidean", "KnnManhattan": "manhattan", "KnnMinkowski": "minkowski"}
METHOD_KINDS = ("Bayes", *_KNN, "LogisticRegression", "RandomForest", "Svm", "GradientBoosting", "IsolationForest")


def _plain(name: object) -> str:
    return str(name).replace("-", "").replace("_", "").replace(" ", "").lower()


def _one_of(what: str, value: object, names: tuple[str, ...], aliases: dict[str, str] | None = None) -> str:
    known = {_plain(n): n for n in names} | (aliases or {})
    if _plain(value) not in known:
        raise InvalidConfig(what, f"{value!r} is none of {', '.join(names)}")
    return known[_plain(value)]


def method_kind(name: object) -> str:
    return _one_of("model.method", name, METHOD_KINDS)


def is_knn(method: str) -> bool:
    return method in _KNN


def requires_p(method: str) -> bool:
    return method == "KnnMinkowski"


def nlp_option(name: object) -> str:
    return _one_of("pipeline.nlp", name, ("Count", "TfIdf", "Word2Vec", "FastText"))


def on_off(value: object, default: bool) -> bool:
    """YAML reads On and Off as booleans; both forms are fine."""
    if value is None or isinstance(value, bool):
        return default if value is None else value
    return _one_of("switch", value, ("On", "Off")) == "On"


@dataclass
class ModelConfig:
    """A method and its parameters; which ones are required depends on the method."""

    method: str
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: object) -> ModelConfig:
        if not isinstance(data, dict) or "method" not in data:
            raise InvalidConfig("model", "needs a method")
        return cls(method_kind(data["method"]), {k: v for k, v in data.items() if k != "method"})

    def _get(self, *names: str, required: bool = True, default: Any = None) -> Any:
        for n in names:
            if self.params.get(n) is not None:
                return self.params[n]
        if required:
            raise InvalidConfig("model", f"{self.method} needs {names[0]}")
        return default

    @property
    def k(self) -> int:
        return int(self._get("k"))

    @property
    def p(self) -> float:
        return float(self._get("p", required=requires_p(self.method), default=2.0))

    @property
    def metric(self) -> str:
        return _KNN[self.method]

    def advanced(self) -> Any:
        """The parameters as the method's configuration; None for naive Bayes and nearest neighbours."""
        g = self._get
        opt = lambda n, d: g(n, required=False, default=d)
        if self.method == "LogisticRegression":
            return LogisticConfig(float(g("learning_rate")), int(g("epochs")), float(g("lambda", "reg", required=False, default=1e-3)))
        if self.method == "Svm":
            d = SvmConfig()
            return SvmConfig(_one_of("kernel", g("kernel"), ("Linear", "Rbf", "Polynomial", "Sigmoid")), float(g("c")), float(opt("learning_rate", d.learning_rate)), int(opt("epochs", d.epochs)), float(opt("gamma", d.gamma)), int(opt("degree", d.degree)), float(opt("coef0", d.coef0)))
        if self.method == "RandomForest":
            d = ForestConfig()
            mode = _one_of("mode", opt("mode", d.mode), ("Standard", "Balanced", "ExtraTrees"), {"standart": "Standard"})
            features = _one_of("max_features", opt("max_features", d.max_features), ("Sqrt", "Log2", "All", "Half"), {"auto": "All"})
            seed = opt("random_seed", None)
            return ForestConfig(mode, int(g("n_trees")), int(opt("max_depth", d.max_depth)), features, int(opt("min_samples_split", d.min_samples_split)), int(opt("min_samples_leaf", d.min_samples_leaf)), on_off(opt("bootstrap", None), d.bootstrap), on_off(opt("oob_score", None), d.oob_score), None if seed is None else int(seed))
        if self.method == "GradientBoosting":
            d = BoostingConfig()
            return BoostingConfig(int(g("n_estimators")), float(g("learning_rate")), int(opt("max_depth", d.max_depth)))
        if self.method == "IsolationForest":
            d = IsolationConfig()
            return IsolationConfig(int(g("n_trees")), float(g("contamination")), int(opt("subsample_size", d.subsample_size)))
        return None

    def validate(self) -> ModelConfig:
        if is_knn(self.method):
            if self.k < 1:
                raise InvalidConfig("model", "k must be at least 1")
            if requires_p(self.method) and not self.p > 0:
                raise InvalidConfig("model", "p must be positive")
        elif (advanced := self.advanced()) is not None:
            advanced.validate()
        return self


@dataclass
class ExtraMatch:
    path: str
    engine: str = "Regex"
    recursive: bool = True
    score_add_points: float = 0.0
    title: str | None = None
    description: str | None = None


@dataclass
class RulesFile:
    hot_path: str
    cold_path: str
    nlp: str
    model: ModelConfig
    hot_label: str = "WEB_ATTACK"
    cold_label: str = "RAW_DATA"
    recursive: bool = True
    score_sum: bool = False
    threads: int | None = None
    embedding_dimensions: int | None = None
    decode: bool = False
    extra_match: list[ExtraMatch] = field(default_factory=list)
    report_name: str | None = None
    csv_output: str | None = None
    json_output: str | None = None
    max_file_bytes: int | None = None
    base: str | None = None

    @classmethod
    def from_yaml(cls, path: str, base: str | None = None) -> RulesFile:
        """Read, parse and validate; relative paths may start at the file's folder. Unknown keys don't matter."""
        text = read_text(path, MAX_YAML_BYTES)
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise InvalidConfig("yaml", f"{path}: {e}") from e
        return cls.parse(data, base or str(Path(path).resolve().parent)).validate()

    @classmethod
    def parse(cls, data: object, base: str | None = None) -> RulesFile:
        if not isinstance(data, dict):
            raise InvalidConfig("yaml", "the root must be a mapping")
        try:
            d, p = data["data"], data["pipeline"]
            extra = [ExtraMatch(str(e["path"]), _one_of("engine", e.get("engine", "Regex"), ("Regex", "Vectorscan")), on_off(e.get("recursive_way"), True), float(e.get("score_add_points") or 0), e.get("title"), e.get("description")) for e in data.get("extra_match") or []]
            return cls(
                str(d["hot_test_path"]), str(d["cold_test_path"]), nlp_option(p["nlp"]), ModelConfig.parse(data["model"]),
                canonical_label(str(d.get("hot_label") or "WEB_ATTACK")), canonical_label(str(d.get("cold_label") or "RAW_DATA")), on_off(d.get("recursive_way"), True), on_off(d.get("score_sum"), False),
                p.get("threads"), p.get("embedding_dimensions"), bool(p.get("security_normalize_obfuscation")), extra, data.get("report_name"), data.get("csv_output"), data.get("json_output"), data.get("max_file_bytes"), base,
            )
        except (KeyError, TypeError, AttributeError) as e:
            raise InvalidConfig("yaml", f"missing or wrong: {e}") from e

    def validate(self) -> RulesFile:
        if self.threads is not None and not 1 <= self.threads <= MAX_THREADS:
            raise InvalidConfig("pipeline.threads", f"must be 1 to {MAX_THREADS}")
        if self.embedding_dimensions is not None and self.embedding_dimensions < 1:
            raise InvalidConfig("pipeline.embedding_dimensions", "must be at least 1")
        if any(e.score_add_points < 0 for e in self.extra_match):
            raise InvalidConfig("extra_match.score_add_points", "must not be negative")
        self.hot_path, self.cold_path = (str(input_path(p, self.base)) for p in (self.hot_path, self.cold_path))
        for e in self.extra_match:
            e.path = str(input_path(e.path, self.base))
        for out in (self.csv_output, self.json_output):
            if out:
                output_path(out, self.base)
        self.model.validate()
        return self
