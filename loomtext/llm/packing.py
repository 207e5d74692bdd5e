"""Operator 5: packing documents along a space-filling curve."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe
from loomtext.llm.common import durable, slices, table

#: Tokens in a sequence.
CAPACITY = 2048
#: Buckets of the hashed document vector, dimensions it is projected to, and bits of each on the curve.
BUCKETS, DIMS, DEPTH = 512, 3, 20
_BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_CACHE = 300_000


class _Places(dict):
    """By word: its bucket, doubled, plus one if its sign is negative."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) % (2 * BUCKETS)
        if len(self) < _CACHE:
            self[word] = value
        return value


_places = _Places()
_projection = np.random.default_rng(515).standard_normal((BUCKETS, DIMS))
_erf = np.vectorize(math.erf, otypes=[float])


def vectors(texts: list[str]) -> np.ndarray:
    """Hashed vectors of the distinct words of each whole text, of length one (zeros for no words)."""
    out = np.zeros((len(texts), BUCKETS))
    for i, text in enumerate(texts):
        words = set(text.lower().encode("utf-8", "replace").translate(_BLANK).split())
        if words:
            both = np.bincount(np.fromiter(map(_places.__getitem__, words), np.int64, len(words)), minlength=2 * BUCKETS)
            out[i] = both[::2] - both[1::2]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def grid(vecs: np.ndarray) -> np.ndarray:
    """Cells of the projected vectors: their normal quantiles in steps of 2**-DEPTH."""
    quantile = 0.5 * (1 + _erf(vecs @ _projection / math.sqrt(2)))
    return np.clip((quantile * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1)


def hilbert(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The place of each cell (rows of whole numbers below 2**depth) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:  # undo the rotations, from the largest cube to the smallest
        low = bit - 1
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def keyed(docs: DataFrame, vocab_path: str = bpe.VOCAB_PATH) -> DataFrame:
    """(key, doc_id, n_tokens) of every document with a token."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.fromiter(map(coder.count, texts), np.int64, len(texts))
            keep = pa.array(counts > 0)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(grid(vectors(texts)))).filter(keep), batch.column(0).filter(keep), pa.array(counts).filter(keep)], schema=schema)

    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "key bigint, doc_id bigint, n_tokens bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocab_path: str = bpe.VOCAB_PATH) -> DataFrame:
    """Sequences of `capacity` tokens, filled with documents in the order of the Hilbert curve.

    A row for each piece of a document in a sequence: sequence_id, position (of its first token in the
    sequence), doc_id, token_start and token_end (of the piece in the document), key. All sequences but
    the last are full: a document that reaches over an end goes on in the next sequence.

    Order: Hilbert key, then doc_id (nulls first), then token count; rows that agree in all three are
    interchangeable. Null and empty texts have no tokens and are in no sequence; every row of a repeated
    id is packed. Documents of any length are packed whole. An empty table gives no rows. Other columns
    aren't looked at.

    Vectors and keys are computed once; what is range-sorted has three numbers a document. A sequence's
    number follows from token sums by partition, of which the driver gets one number each, so the
    result doesn't depend on where partitions end.
    """
    spark = docs.sparkSession
    narrow = durable(keyed(docs, vocab_path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens")]
    line = durable(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order))
    sums = {r.p: r.s for r in line.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n_tokens").alias("s")).collect()}
    begins, at = {}, 0
    for p in sorted(sums):
        begins[p] = at
        at += sums[p]
    schema = pa.schema([("sequence_id", pa.int64()), ("position", pa.int64()), ("doc_id", pa.int64()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("key", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = begins.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.asarray(batch.column(2))
            ends = at + np.cumsum(counts)
            starts = ends - counts
            at = int(ends[-1])
            pieces = (ends - 1) // capacity - starts // capacity + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            seq = starts[row] // capacity + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a, b = np.maximum(starts[row], seq * capacity), np.minimum(ends[row], (seq + 1) * capacity)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(a - seq * capacity), batch.column(1).take(take), pa.array(a - starts[row]), pa.array(b - starts[row]), batch.column(0).take(take)], schema=schema)

    return line.mapInArrow(fill, "sequence_id bigint, position bigint, doc_id bigint, token_start bigint, token_end bigint, key bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
