"""Saved classifiers: one JSON file, one compressed binary file, or a representation and a model apart.

Vocabularies and counts that are too large for one file are Parquet tables instead (save_tables).
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from dataclasses import asdict, fields
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomtext.errors import InvalidData, TooLarge, Unsupported, VersionMismatch
from loomtext.operators.bayes import BayesModel
from loomtext.operators.embeddings import FastTextConfig, WordVectors
from loomtext.operators.features import TfIdf
from loomtext.operators.knn import KnnModel
from loomtext.operators.linear import KernelMap, LogisticModel, SvmConfig, SvmModel
from loomtext.operators.models import AdvancedClassifier, BayesClassifier, Classifier, FeaturePipeline, KnnClassifier
from loomtext.operators.trees import BoostingModel, ForestModel, IsolationModel, Tree
from loomtext.sources.embedding_files import CentroidVectors, SubwordVectors
from loomtext.sources.security import MAX_MODEL_BYTES, read_bytes

VERSION = 1
MAX_FEATURES = 1_000_000
#: Rows of a vocabulary or a training table in one file.
MAX_ROWS = 5_000_000
_HEAD = struct.Struct("<4sI")
_MAGIC = b"LTXM"
_VOCAB, _COUNTS, _LABELS, _TRAIN = "token string, idx int, df bigint, idf double", "label string, token string, c bigint", "label string, docs bigint, prior double, total bigint", "train_id bigint, vector array<double>, label string"


def _array(a: np.ndarray) -> dict:
    return {"shape": list(a.shape), "values": np.asarray(a, float).ravel().tolist()}


def _numpy(d: dict) -> np.ndarray:
    return np.array(d["values"], float).reshape(d["shape"])


def _rows(df: DataFrame) -> list[list]:
    """The rows of a table that has to fit into one file; over MAX_ROWS are an error before any is fetched."""
    if (n := df.count()) > MAX_ROWS:
        raise TooLarge("save", f"{n} rows; save_tables writes naive Bayes models of any size")
    return [list(r) for r in df.collect()]


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema).persist()


def _tfidf_state(t: TfIdf | None) -> dict | None:
    return t and {"vocab": _rows(t.vocab.orderBy("idx").select("token", "idx", "df", "idf")), "min_df": t.min_df, "max_df_ratio": t.max_df_ratio}


def _tfidf(spark: SparkSession, s: dict | None) -> TfIdf | None:
    return s and TfIdf(_frame(spark, s["vocab"], _VOCAB), len(s["vocab"]), s["min_df"], s["max_df_ratio"])


def _vectors_state(v: Any) -> dict | None:
    if v is None:
        return None
    out = {"dims": v.dims, "words": {w: np.asarray(x, float).tolist() for w, x in v.words.items()}}
    if isinstance(v, WordVectors):
        return out | {"kind": "trained", "fasttext": v.fasttext and asdict(v.fasttext)}
    if isinstance(v, SubwordVectors):
        return out | {"kind": "subword", "buckets": {str(k): np.asarray(x, float).tolist() for k, x in v.buckets.items()}, "sizes": [v.min_n, v.max_n, v.n_buckets, v.n_words]}
    return out | {"kind": "centroid", "centroid": np.asarray(v.centroid, float).tolist()}


def _vectors(s: dict | None) -> Any:
    if s is None:
        return None
    words = {w: np.array(x, np.float32) for w, x in s["words"].items()}
    if any(len(x) != s["dims"] for x in words.values()):
        raise InvalidData("model", f"vectors must all have {s['dims']} dimensions")
    if s["kind"] == "trained":
        return WordVectors(s["dims"], words, FastTextConfig(**s["fasttext"]) if s["fasttext"] else None)
    if s["kind"] == "subword":
        return SubwordVectors(s["dims"], words, {int(k): np.array(x, np.float32) for k, x in s["buckets"].items()}, *s["sizes"]).validate()
    return CentroidVectors(s["dims"], words, np.array(s["centroid"], np.float32)).validate()


def pipeline_state(p: FeaturePipeline) -> dict:
    return {"nlp": p.nlp, "use_idf": p.use_idf, "tfidf": _tfidf_state(p.tfidf), "vectors": _vectors_state(p.vectors)}


def pipeline_from(spark: SparkSession, s: dict) -> FeaturePipeline:
    p = FeaturePipeline(s["nlp"], _tfidf(spark, s["tfidf"]), _vectors(s["vectors"]), s["use_idf"])
    if p.vectors is None and p.tfidf is None or not 1 <= p.output_dims <= MAX_FEATURES:
        raise InvalidData("model", f"needs 1 to {MAX_FEATURES} features")
    return p


def _trees(trees: list[Tree]) -> list:
    return [list(t.to_row()) for t in trees]


def _model_state(m: Any) -> dict:
    if isinstance(m, LogisticModel):
        return {"kind": "logistic", "weights": _array(m.weights), "bias": _array(m.bias)}
    if isinstance(m, SvmModel):
        return {"kind": "svm", "weights": _array(m.weights), "bias": _array(m.bias), "config": asdict(m.map.cfg), "map": [_array(m.map.omega), _array(m.map.phase), _array(m.map.landmarks)]}
    if isinstance(m, ForestModel):
        return {"kind": "forest", "trees": _trees(m.trees), "classes": m.classes, "importances": _array(m.importances), "oob": m.oob}
    if isinstance(m, BoostingModel):
        return {"kind": "boosting", "base": m.base, "rate": m.rate, "trees": [_trees(t) for t in m.trees]}
    if isinstance(m, IsolationModel):
        return {"kind": "isolation"} | {f.name: getattr(m, f.name) for f in fields(m)} | {"trees": _trees(m.trees)}
    raise Unsupported("model", type(m).__name__)


def _model(s: dict) -> Any:
    kind = s["kind"]
    if kind == "logistic":
        return LogisticModel(_numpy(s["weights"]), _numpy(s["bias"]))
    if kind == "svm":
        return SvmModel(KernelMap(SvmConfig(**s["config"]), *map(_numpy, s["map"])), _numpy(s["weights"]), _numpy(s["bias"]))
    if kind == "forest":
        return ForestModel([Tree.from_row(t) for t in s["trees"]], s["classes"], _numpy(s["importances"]), s["oob"])
    if kind == "boosting":
        return BoostingModel(s["base"], s["rate"], [[Tree.from_row(t) for t in ts] for ts in s["trees"]])
    if kind == "isolation":
        return IsolationModel([Tree.from_row(t) for t in s["trees"]], s["threshold"], s["mean"], s["std"], s["subsample_size"])
    raise InvalidData("model", f"unknown kind {kind!r}")


def state(c: Classifier) -> dict:
    """The classifier as plain values: nlp for its representation, ml for its model."""
    if isinstance(c, BayesClassifier):
        m = c.model
        return {"kind": "bayes", "nlp": {"idf": _tfidf_state(m.idf)}, "ml": {"labels": _rows(m.labels), "counts": _rows(m.counts.select("label", "token", "c")), "n_tokens": m.n_tokens, "alpha": m.alpha}}
    if isinstance(c, KnnClassifier):
        fitted = _rows(c.fitted.select("doc_id", "vector")) if c.normalise else []
        return {"kind": "knn", "nlp": pipeline_state(c.pipeline), "ml": {"train": _rows(c.knn.train.select("train_id", "vector", "label")), "k": c.knn.k, "metric": c.knn.metric, "p": c.knn.p, "normalise": c.normalise, "fitted": fitted}}
    if isinstance(c, AdvancedClassifier):
        return {"kind": "advanced", "nlp": pipeline_state(c.pipeline), "ml": {"method": c.method, "labels": c.labels, "model": _model_state(c.model)}}
    raise Unsupported("save", type(c).__name__)


def from_state(spark: SparkSession, s: dict) -> Classifier:
    """The classifier of saved values; raises InvalidData where they don't fit together."""
    try:
        nlp, ml = s["nlp"], s["ml"]
        if s["kind"] == "bayes":
            names = [r[0] for r in ml["labels"]]
            if not names or len(set(names)) < len(names) or any(not 0 < r[2] <= 1 or r[3] < 0 for r in ml["labels"]) or not (ml["alpha"] > 0 and math.isfinite(ml["alpha"])) or ml["n_tokens"] < 1 or any(r[0] not in names for r in ml["counts"]):
                raise InvalidData("model", "labels need priors, totals and counts, alpha must be positive")
            return BayesClassifier(BayesModel(_frame(spark, ml["labels"], _LABELS), _frame(spark, ml["counts"], _COUNTS), ml["n_tokens"], _tfidf(spark, nlp["idf"]), ml["alpha"]))
        pipe = pipeline_from(spark, nlp)
        if s["kind"] == "knn":
            if not ml["train"] or any(len(r[1]) != pipe.output_dims or r[2] is None for r in ml["train"]):
                raise InvalidData("model", f"training rows need a label and {pipe.output_dims} numbers")
            fitted = _frame(spark, ml["fitted"], "doc_id bigint, vector array<double>") if ml["normalise"] else None
            return KnnClassifier(pipe, KnnModel(_frame(spark, ml["train"], _TRAIN), ml["k"], ml["metric"], ml["p"]), ml["normalise"], fitted)
        if s["kind"] == "advanced":
            if not ml["labels"]:
                raise InvalidData("model", "needs labels")
            return AdvancedClassifier(ml["method"], pipe, list(ml["labels"]), _model(ml["model"]))
        raise InvalidData("model", f"unknown kind {s['kind']!r}")
    except (KeyError, TypeError, IndexError) as e:
        raise InvalidData("model", f"missing or wrong: {e!r}") from e


def _parse(data: bytes, path: str) -> dict:
    try:
        s = json.loads(data)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise InvalidData("load", f"{path} is damaged: {e}") from e
    if not isinstance(s, dict):
        raise InvalidData("load", f"{path} holds no model")
    if s.get("version", 0) not in (0, VERSION):
        raise VersionMismatch("load", f"{path} has version {s['version']}")
    return s


def _write(path: str, data: bytes) -> None:
    if len(data) > MAX_MODEL_BYTES:
        raise TooLarge("save", f"{path} would be over {MAX_MODEL_BYTES} bytes")
    Path(path).write_bytes(data)


def save_json(c: Classifier, path: str) -> None:
    _write(path, json.dumps({"version": VERSION} | state(c)).encode())


def load_json(spark: SparkSession, path: str) -> Classifier:
    return from_state(spark, _parse(read_bytes(path, MAX_MODEL_BYTES), path))


def _pack(s: dict) -> bytes:
    return _HEAD.pack(_MAGIC, VERSION) + zlib.compress(json.dumps(s).encode(), 6)


def _unpack(path: str) -> dict:
    data = read_bytes(path, MAX_MODEL_BYTES)
    if len(data) < _HEAD.size or _HEAD.unpack_from(data)[0] != _MAGIC:
        raise InvalidData("load", f"{path} holds no model")
    if (version := _HEAD.unpack_from(data)[1]) != VERSION:
        raise VersionMismatch("load", f"{path} has version {version}")
    try:
        return _parse(zlib.decompress(data[_HEAD.size :]), path)
    except zlib.error as e:
        raise InvalidData("load", f"{path} is damaged: {e}") from e


def save_binary(c: Classifier, path: str) -> None:
    _write(path, _pack(state(c)))


def load_binary(spark: SparkSession, path: str) -> Classifier:
    return from_state(spark, _unpack(path))


def save_split(c: Classifier, nlp_path: str, ml_path: str) -> None:
    """The representation in one file, the model in another, so that several models can share the first."""
    s = state(c)
    if s["kind"] == "bayes":
        raise Unsupported("save", "naive Bayes has no representation of its own")
    _write(nlp_path, _pack({"part": "nlp", "nlp": s["nlp"]}))
    _write(ml_path, _pack({"part": "ml", "kind": s["kind"], "ml": s["ml"]}))


def load_split(spark: SparkSession, nlp_path: str, ml_path: str) -> Classifier:
    a, b = _unpack(nlp_path), _unpack(ml_path)
    if a.get("part") != "nlp" or b.get("part") != "ml":
        raise InvalidData("load", "the two parts are mixed up")
    return from_state(spark, {"kind": b["kind"], "nlp": a["nlp"], "ml": b["ml"]})


def save_tables(model: BayesModel, folder: str) -> None:
    """A naive Bayes model as Parquet tables: for vocabularies of any size."""
    model.labels.write.mode("overwrite").parquet(f"{folder}/labels")
    model.counts.write.mode("overwrite").parquet(f"{folder}/counts")
    if model.idf is not None:
        model.idf.vocab.write.mode("overwrite").parquet(f"{folder}/idf")
    meta = [(VERSION, model.n_tokens, model.alpha, model.idf is not None, model.idf.size if model.idf else None)]
    model.labels.sparkSession.createDataFrame(meta, "version int, n_tokens bigint, alpha double, has_idf boolean, idf_size bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load_tables(spark: SparkSession, folder: str) -> BayesModel:
    meta = spark.read.parquet(f"{folder}/meta").first()
    if meta.version != VERSION:
        raise VersionMismatch("load", f"{folder} has version {meta.version}")
    idf = TfIdf(spark.read.parquet(f"{folder}/idf"), meta.idf_size) if meta.has_idf else None
    return BayesModel(spark.read.parquet(f"{folder}/labels"), spark.read.parquet(f"{folder}/counts"), meta.n_tokens, idf, meta.alpha)


def save_vectors(v: Any, path: str) -> None:
    """External embeddings in one binary file."""
    _write(path, _pack({"part": "vectors", "vectors": _vectors_state(v)}))


def load_vectors(path: str) -> Any:
    s = _unpack(path)
    if s.get("part") != "vectors":
        raise InvalidData("load", f"{path} holds no embeddings")
    return _vectors(s["vectors"])
