"""Word vectors: skip-gram training, lookup, and document vectors as weighted means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig, TooLarge
from loomtext.functions.hashing import deterministic_vector, deterministic_vectors, subword_vector, subword_vectors
from loomtext.functions.text import tokens
from loomtext.operators.features import Known, TfIdf, counted, list_column, token_lists
from loomtext.sources.embedding_files import CentroidVectors, SubwordVectors

WINDOW, NEGATIVES, EPOCHS, RATE = 2, 5, 6, 0.05
#: Tokens of a corpus up to which the exact trainer runs on the driver.
MAX_TOKENS = 2_000_000


@dataclass(frozen=True)
class FastTextConfig:
    min_n: int = 3
    max_n: int = 5
    dimensions: int = 32

    def __post_init__(self):
        if self.min_n < 1 or self.max_n < self.min_n or self.dimensions < 1:
            raise InvalidConfig("fasttext", "needs 1 <= min_n <= max_n and dimensions >= 1")


@dataclass
class WordVectors:
    """Trained vectors; other words get their subwords' vector with a FastTextConfig, else zeros."""

    dims: int
    words: dict[str, np.ndarray]
    fasttext: FastTextConfig | None = None

    def vector_for(self, word: str) -> np.ndarray:
        if word in self.words:
            return self.words[word]
        return subword_vector(word, self.dims, self.fasttext.min_n, self.fasttext.max_n) if self.fasttext else np.zeros(self.dims, np.float32)


def vectors_for(model: WordVectors | SubwordVectors | CentroidVectors, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each word as a row, and whether it has one."""
    if isinstance(model, WordVectors) and model.fasttext and not model.words:
        return subword_vectors(words, model.dims, model.fasttext.min_n, model.fasttext.max_n), np.ones(len(words), bool)
    found = [model.vector_for(w) for w in words]
    there = np.array([v is not None for v in found], bool)
    return np.array([np.zeros(model.dims) if v is None else v for v in found], float).reshape(-1, model.dims), there


def train_skipgram(texts: list[list[str]], dims: int, fasttext: FastTextConfig | None = None, epochs: int = EPOCHS, seed: int = 0x57A9C0DE) -> WordVectors:
    """Skip-gram with negative sampling over token lists, one pair at a time; vectors have length one."""
    dims = max(1, dims)
    names = sorted({t for text in texts for t in text}, key=str.encode)
    if not names:
        return WordVectors(dims, {}, fasttext)
    index = {t: i for i, t in enumerate(names)}
    corpus = [np.array([index[t] for t in text]) for text in texts if text]
    counts = np.bincount(np.concatenate(corpus), minlength=len(names))
    noise = np.cumsum(counts**0.75)
    w_in = np.stack([deterministic_vector(t, dims) for t in names]).astype(float)
    w_out = np.zeros((len(names), dims))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for c in rng.permutation(len(corpus)):
            doc = corpus[c]
            for pos, center in enumerate(doc):
                for at in range(max(0, pos - WINDOW), min(len(doc), pos + WINDOW + 1)):
                    if at == pos:
                        continue
                    drawn = np.searchsorted(noise, rng.uniform(0, noise[-1], NEGATIVES)).clip(0, len(names) - 1)
                    for k, target in [(doc[at], 1.0), *((d, 0.0) for d in drawn if d != doc[at])]:
                        out = w_out[k].copy()
                        scale = RATE * (target - 1 / (1 + np.exp(-np.clip(w_in[center] @ out, -60, 60))))
                        w_out[k] += scale * w_in[center]
                        w_in[center] += scale * out
    if fasttext:
        w_in += 0.15 * np.stack([subword_vector(t, dims, fasttext.min_n, fasttext.max_n) for t in names])
    norm = np.linalg.norm(w_in, axis=1, keepdims=True)
    w_in = np.where(norm > 1e-12, w_in / np.maximum(norm, 1e-300), w_in)
    return WordVectors(dims, {t: w_in[i].astype(np.float32) for t, i in index.items()}, fasttext)


def train_word_vectors(samples: DataFrame, kind: str, dims: int, backend: str = "exact") -> WordVectors:
    """Word2Vec or FastText vectors of a corpus (text).

    backend="exact" follows the pairwise trainer on the driver, for corpora up to MAX_TOKENS tokens.
    backend="mllib" trains Spark's own Word2Vec (hierarchical softmax) in parallel, for larger ones.
    """
    fasttext = FastTextConfig(dimensions=dims) if kind == "FastText" else None
    lists = samples.select(tokens(F.col("text")).alias("t"))
    if backend == "mllib":
        from pyspark.ml.feature import Word2Vec

        model = Word2Vec(vectorSize=dims, windowSize=WINDOW, minCount=1, maxIter=1, inputCol="t", outputCol="v", seed=42).fit(lists.where(F.size("t") > 0))
        rows = model.getVectors().collect()
        vectors = {r.word: np.array(r.vector.toArray(), np.float32) for r in rows}
        if fasttext:
            vectors = {w: v + np.float32(0.15) * subword_vector(w, dims) for w, v in vectors.items()}
        return WordVectors(dims, {w: v / max(float(np.linalg.norm(v)), 1e-12) for w, v in vectors.items()}, fasttext)
    size = lists.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    if size > MAX_TOKENS:
        raise TooLarge("word vectors", f"{size} tokens; use backend='mllib' beyond {MAX_TOKENS}")
    return train_skipgram([r.t for r in lists.collect()], dims, fasttext)


def document_vectors(docs: DataFrame, model: WordVectors | SubwordVectors | CentroidVectors, idf: TfIdf | None = None) -> DataFrame:
    """(doc_id, vector): the mean of token vectors, weighted by IDF (1 for tokens without one) if given.

    Trained vectors count every token, in the denominator too, and have length one in the end. Vectors from
    fastText files leave out tokens without any; those from word2vec files take the centroid; neither is
    normalised. A document without tokens has a zero vector. Tokens are counted and summed where the text is read, with
    the IDF of the most frequent ones; only the others are joined on token, so the whole vocabulary's IDF never has to
    fit into a task.
    """
    spark = docs.sparkSession
    lists, repeated = (docs.select("doc_id", tokens(F.col("text")).alias("t")), False) if idf is None else token_lists(docs)
    if idf is not None:  # what has no doc_id has no tokens either
        lists = lists.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("t")).alias("t"))
        head, _, least = idf.head()
        names, idfs = head.column(0).to_pylist(), head.column(1).to_numpy()
    held = spark.sparkContext.broadcast((model, Known(names), idfs) if idf is not None else (model, None, None))
    unit, dims, weighted = isinstance(model, WordVectors), model.dims, idf is not None

    def sums(m, row: np.ndarray, words: list[str], place: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """By row, the weighted sum of its words' vectors, and of the weights of those that have one; a word is words[place]."""
        vectors, there = vectors_for(m, words)
        keep = there[place]
        row, place, w = row[keep], place[keep], w[keep]
        x = np.zeros((rows, dims))
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        step = max(1, (1 << 22) // dims)
        for s in range(0, len(row), step):  # a part of the words at a time
            inside = np.unique(np.r_[s, cuts[(cuts >= s) & (cuts < s + step)]])
            np.add.at(x, row[inside], np.add.reduceat(vectors[place[s : s + step]] * w[s : s + step, None], inside - s, axis=0))
        return x, np.bincount(row, w, rows).astype(float)  # of no rows it counts integers

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, idfs = held.value
        for batch in batches:
            for piece, row, code, n, words in counted(batch):
                at = known.places(words)[code] if weighted else np.zeros(len(code), np.int64)
                here = at >= 0
                w = n[here] * (idfs[at[here]] if weighted else 1.0)
                used, place = np.unique(code[here], return_inverse=True)
                x, total = sums(m, row[here], words.take(pa.array(used)).to_pylist(), place, w, piece.num_rows)
                rare = [list_column(row[~here], piece.num_rows, v) for v in (words.take(pa.array(code[~here])), pa.array(n[~here]))]
                yield pa.RecordBatch.from_arrays([piece.column(0), list_column(np.repeat(np.arange(len(x)), dims), len(x), pa.array(x.ravel())), pa.array(total), *rare], names=["doc_id", "x", "total", "rare", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x, total = np.asarray(piece.column(1).flatten()).reshape(-1, dims).copy(), np.asarray(piece.column(2)).copy()
                if weighted:
                    row = np.repeat(np.arange(piece.num_rows), np.asarray(pc.list_value_length(piece.column(3)).fill_null(0)))
                    words = piece.column(3).flatten().dictionary_encode()
                    more, further = sums(m, row, words.dictionary.to_pylist(), np.asarray(words.indices, np.int64), np.asarray(piece.column(4).flatten()), piece.num_rows)
                    x, total = x + more, total + further
                x = np.where(total[:, None] != 0, x / np.maximum(total, 1e-6)[:, None], x)
                norm = np.linalg.norm(x, axis=1)[:, None]
                x = np.where(norm > 1e-12, x / np.maximum(norm, 1e-300), x) if unit else x
                yield pa.RecordBatch.from_arrays([piece.column(0), list_column(np.repeat(np.arange(len(x)), dims), len(x), pa.array(x.ravel()))], names=["doc_id", "vector"])

    parts = lists.select(F.col("doc_id").cast("bigint").alias("doc_id"), "t").mapInArrow(near, "doc_id bigint, x array<double>, total double, rare array<string>, n array<bigint>")
    if weighted:
        parts = parts.persist()
        each = parts.select("doc_id", F.explode(F.arrays_zip("rare", "n")).alias("r")).select("doc_id", F.col("r.rare").alias("token"), F.col("r.n").alias("n"))
        rest = idf.vocab.where(F.col("df") < least).select("token", "idf")
        rare = each.join(rest, "token", "left").groupBy("doc_id").agg(F.collect_list("token").alias("rare"), F.collect_list(F.col("n") * F.coalesce("idf", F.lit(1.0))).alias("w"))
        rare = rare.withColumnRenamed("doc_id", "own")
        parts = parts.select("doc_id", "x", "total").join(rare, F.col("doc_id").eqNullSafe(F.col("own")), "left").drop("own")
    out = parts.mapInArrow(whole, "doc_id bigint, vector array<double>")
    if not repeated:
        return out
    zero = F.array_repeat(F.lit(0.0), dims)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(out, "doc_id", "left").select("doc_id", F.coalesce("vector", zero).alias("vector"))


def vector_table(docs: DataFrame, dims: int, kind: str = "hash") -> DataFrame:
    """(token, vector) of the distinct tokens of docs: hashed vectors, or those of their subwords."""
    words = docs.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = deterministic_vectors(names, dims) if kind == "hash" else subword_vectors(names, dims)
            flat = pa.array(rows.astype(float).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * dims), flat)], names=["token", "vector"])

    return words.mapInArrow(run, "token string, vector array<double>")
