"""Vocabulary, IDF, and sparse count and TF-IDF features, in long form (doc_id, idx, value)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import tokens

STOPWORDS = "the is to a an and or of for in on at by with from that this it be as are was were".split()
MIN_DF, MAX_DF_RATIO = 1, 0.95
#: Vocabularies of at most this many tokens are broadcast to where tokens are looked up; larger ones are joined by shuffle.
BROADCAST_TOKENS = 500_000


def token_lists(docs: DataFrame, decode: bool = False) -> tuple[DataFrame, bool]:
    """(doc_id, t): the tokens of each document, and whether a doc_id repeats. If one does, the tokens of its rows are put together, which shuffles them."""
    lists = docs.select("doc_id", tokens(F.col("text"), decode).alias("t"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return lists, False
    return lists.groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t")), True


class Known:
    """Some tokens by number, for tasks to look up: `names` goes to them, a dict is made there. Stop words can be among them, with numbers below zero."""

    def __init__(self, names: list[str], skip: list[str] = ()):
        self.names, self.skip, self._at = names, skip, None

    def places(self, tokens: pa.Array) -> np.ndarray:
        """The number of each token, -1 for one that isn't known, -2 for one to be skipped."""
        if self._at is None:
            self._at = {t: i for i, t in enumerate(self.names)} | dict.fromkeys(self.skip, -2)
        return np.fromiter((self._at.get(t, -1) for t in tokens.to_pylist()), np.int64, len(tokens))

    def __getstate__(self):
        return {"names": self.names, "skip": self.skip, "_at": None}


def counted(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """A batch (doc_id, t) in pieces, each with row, token number and count of its distinct tokens by row, and the tokens that the numbers mean."""
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        lengths = np.asarray(pc.list_value_length(piece.column(1)).fill_null(0))
        words = piece.column(1).flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        key = np.repeat(np.arange(piece.num_rows), lengths) * size + np.asarray(words.indices, np.int64)
        key, n = np.unique(key, return_counts=True)
        row, code = np.divmod(key, size)
        yield piece, row, code, n, words.dictionary


def list_column(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values that belong to rows in ascending order, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


@dataclass
class TfIdf:
    """vocab has (token, idx, df, idf) by token in byte order; size is its number of rows."""

    vocab: DataFrame
    size: int | None
    min_df: int = MIN_DF
    max_df_ratio: float = MAX_DF_RATIO
    #: Tokens left out for being in too many documents; None where that isn't known.
    common: DataFrame | None = None
    _head: tuple | None = field(default=None, repr=False)

    def head(self) -> tuple[pa.Table, list[str], int]:
        """The most frequent tokens with idf (and idx), BROADCAST_TOKENS at most; tokens known to be no part of the vocabulary; and the least df of the former.

        No df is taken in part, so that the rest of the vocabulary is told by its df alone.
        """
        if self._head is None:
            if self.common is None:
                self.vocab.persist()
            taken, least = 0, 1 << 62
            for r in sorted(self.vocab.groupBy("df").count().collect(), key=lambda r: -r.df):
                if (taken := taken + r["count"]) > BROADCAST_TOKENS:
                    break
                least = r.df
            rows = self.vocab.where(F.col("df") >= least).select("token", "idf", *self._idx()).toArrow().combine_chunks()
            common = [] if self.common is None else [r.token for r in self.common.limit(BROADCAST_TOKENS).collect()]
            self._head = rows, [*STOPWORDS, *common], least
        return self._head

    def _idx(self) -> list[str]:
        return [c for c in ("idx",) if c in self.vocab.columns]

    def weights(self, docs: DataFrame, decode: bool = False, count_only: bool = False) -> DataFrame:
        """(doc_id, token, idx, value): (1 + ln n) * idf, or n alone; each document's vector has length one.

        Documents without a token of the vocabulary have no rows: their vectors are zero. Tokens are counted where the
        text is read, and the most frequent ones looked up there; only the others are shuffled to be looked up, and one row
        a document to bring them together.
        """
        lists, _ = token_lists(docs, decode)
        idx = self._idx()
        rows, skip, least = self.head()
        held = docs.sparkSession.sparkContext.broadcast((Known(rows.column(0).to_pylist(), skip), [rows.column(i).to_numpy() for i in range(1, rows.num_columns)]))
        key = dict(lists.dtypes)["doc_id"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, (idf, *places) = held.value
            for batch in batches:
                for piece, row, code, n, words in counted(batch):
                    at = known.places(words)[code]
                    here = at >= 0
                    row, code, n, at = row[here], code[here], n[here].astype(float), at[here]
                    w = n if count_only else (1 + np.log(n)) * idf[at]
                    columns = [words.take(pa.array(code)), pa.array(w), *(pa.array(p[at]) for p in places)]
                    yield pa.RecordBatch.from_arrays([piece.column(0), *(list_column(row, piece.num_rows, c) for c in columns), pa.array(np.bincount(row, w * w, piece.num_rows).astype(float))], names=["doc_id", "token", "w", *idx, "square"])

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value[0]
            for batch in batches:
                for piece, row, code, n, words in counted(batch):
                    far = known.places(words)[code] == -1
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row[far])), words.take(pa.array(code[far])), pa.array(n[far])], names=["doc_id", "token", "n"])

        more = "".join(f", {c} array<int>" for c in idx)
        one = lists.mapInArrow(near, f"doc_id {key}, token array<string>, w array<double>{more}, square double")
        rest = self.vocab.where(F.col("df") < least).select("token", *idx, "idf")
        found = lists.mapInArrow(rare, f"doc_id {key}, token string, n bigint").join(rest, "token")
        w = F.col("n").cast("double") if count_only else (1 + F.log(F.col("n").cast("double"))) * F.col("idf")
        found = found.withColumn("w", w).groupBy("doc_id").agg(F.collect_list(F.struct("token", "w", *idx)).alias("rare"), F.sum(F.col("w") * F.col("w")).alias("s"))
        found = found.withColumnRenamed("doc_id", "own")
        both = one.join(found, F.col("doc_id").eqNullSafe(F.col("own")), "left")
        norm = F.sqrt(F.col("square") + F.coalesce("s", F.lit(0.0))).alias("norm")
        kind = "array<struct<token:string,w:double" + "".join(f",{c}:int" for c in idx) + ">>"
        every = F.concat(F.arrays_zip("token", "w", *idx).cast(kind), F.coalesce(F.col("rare").cast(kind), F.array().cast(kind)))
        each = both.select("doc_id", norm, F.explode(every).alias("x")).select("doc_id", "norm", "x.*")
        return each.select("doc_id", "token", *idx, F.when(F.col("norm") > 1e-12, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("value"))


def fit_tfidf(docs: DataFrame, min_df: int = MIN_DF, max_df_ratio: float = MAX_DF_RATIO, decode: bool = False, count: bool = True) -> TfIdf:
    """Document frequencies over all documents, empty ones too; idf = ln((n+1)/(df+1)) + 1.

    The number of documents joins as a one-row table. With count off the vocabulary is one plan, kept when it
    is first used, without idx and size; else it is kept, sorted and numbered part by part.
    """
    seen = docs.select(F.explode(F.array_distinct(tokens(F.col("text"), decode))).alias("token")).where(~F.col("token").isin(STOPWORDS))
    total = docs.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("n_docs"))
    df = seen.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    df = df if count else df.persist()  # both what is kept and what is too common come from it
    kept = df.where((F.col("df") >= min_df) & (F.col("df") / F.col("n_docs") <= max_df_ratio))
    vocab = kept.select("token", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if not count:
        return TfIdf(vocab, None, min_df, max_df_ratio, df.where(F.col("df") / F.col("n_docs") > max_df_ratio).select("token"))
    return TfIdf(*numbered(vocab), min_df, max_df_ratio)


def numbered(vocab: DataFrame) -> tuple[DataFrame, int]:
    """vocab with idx, the dense place of each token in byte order, and its size.

    Tokens are range-partitioned and sorted, kept, and counted by partition; a place is what lies in the partitions
    before and before it in its own. Only the counts reach the driver.
    """
    ranged = vocab.repartitionByRange("token").sortWithinPartitions("token").persist()
    counts = {r[0]: r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    offset = F.get(F.array(*map(F.lit, before or [0])), F.spark_partition_id())
    return ranged.select("token", (inside + offset).cast("int").alias("idx"), *[c for c in vocab.columns if c != "token"]), total


def to_vectors(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """Long weights to one row a document: (doc_id, idxs, vals), empty arrays for zero vectors."""
    rows = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("f"))
    sparse = rows.select("doc_id", F.col("f.idx").alias("idxs"), F.col("f.value").alias("vals"))
    joined = docs.select("doc_id").join(sparse, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("idxs", F.array().cast("array<int>")).alias("idxs"), F.coalesce("vals", F.array().cast("array<double>")).alias("vals"))


def dense(idxs: Column, vals: Column, size: int) -> Column:
    """A dense array of a sparse row; for small sizes only."""
    table = F.map_from_arrays(idxs, vals)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0)))


def zscore(vectors: DataFrame, fit_on: DataFrame | None = None, vector: str = "vector", floor: float = 1e-6) -> DataFrame:
    """Each coordinate less its mean, over its population deviation (at least floor), of fit_on."""
    source = vectors if fit_on is None else fit_on
    stats = source.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.greatest(F.stddev_pop(F.col("x").cast("double")), F.lit(floor)).alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("__z"))
    joined = vectors.crossJoin(F.broadcast(row))
    return joined.withColumn(vector, F.zip_with(F.col(vector), F.col("__z"), lambda x, z: (x.cast("double") - z["m"]) / z["s"])).drop("__z")
