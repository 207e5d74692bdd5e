"""Operator 8: exact top-k inner products over vectors in descending order of length.

The vectors of a stated query set meet all vectors, part by part of their order by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomtext.llm.common import durable, table
from loomtext.llm.vectors import clean_vectors, matrix, pack_rows

K = 10
#: Queries are the vectors whose ids this divides.
EVERY = 50
#: Vectors in a block, the unit of comparison, and of the head, the longest vectors, which every query meets first.
BLOCK = 2048
#: Bytes of vectors, as doubles, in a part of the order by length, and the most ranges of that order, each of which holds one part or more.
PART_BYTES, MOST_RANGES = 8 << 20, 1024
#: Blocks of queries that stay in a task while parts pass, and the most groups of parts that pass one by one.
QUERY_BLOCKS, GROUPS = 4, 32
#: Bytes of an Arrow batch: a pair of a part and blocks of queries fills one by itself, and more of them would only wait in memory.
BATCH_BYTES = 4 << 20
#: Products are ranked as rounded to this many places, so that ties don't hang on the order of sums.
PLACES = 9
#: Above this share of pairs that the bound leaves open, a block is multiplied as a whole, and so are the next ones.
DENSE, NEXT = 0.05, 15


def spectral_rotation(items: DataFrame, dims: int, kind: str) -> np.ndarray:
    """The right singular vectors of the packed vectors `x`, the largest first: eigenvectors of their Gram matrix.

    The Gram matrix is summed by element, so that the driver gets dims**2 numbers from any table.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for packed in batch.column(0):
                x = _vectors(packed, kind, dims)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["at", "value"])

    rows = items.select("x").mapInArrow(grams, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros(dims * dims)
    for r in rows:
        gram[r["at"]] = r["value"]
    gram = gram.reshape(dims, dims)
    scale = np.abs(gram).max()
    _, vectors = np.linalg.eigh((gram + gram.T) / (2 * scale) if scale > 0 else gram)
    return vectors[:, ::-1]


def _vectors(packed: pa.Scalar, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind).astype(np.float64).reshape(-1, dims)


def _best(scores: np.ndarray, q: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query row, id, score) triples the k best of each query row."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, np.arange(n))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], ids[keep], scores[keep]


def slack(query_lengths: np.ndarray | float, longest: np.ndarray | float) -> np.ndarray:
    """What rounding may take from a bound."""
    return 1e-5 * (1 + query_lengths * longest)


def _reaching(values: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values aren't below the floor of their row; few rows have any."""
    rows = np.flatnonzero(~(values.max(axis=1, initial=-np.inf) < floor))
    q, i = np.nonzero(~(values[rows] < floor[rows, None]))
    return rows[q], i


class Running:
    """The best k so far of each row of a block of queries; `floor` has what their k-th products are known to reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.known = np.full(len(ids), -np.inf) if floor is None else floor
        self.least = self.known
        self.lengths = np.sqrt((x * x).sum(axis=1))
        self.products = self.waiting = self.whole = 0
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Take a block of items into account: bound by length, then by partial sums, then exact products.

        False if lengths alone leave the block out; so they will any block of shorter vectors.
        """
        longest = float(np.sqrt((x * x).sum(axis=1)).max(initial=0))
        room = slack(self.lengths, longest)
        live = np.flatnonzero(self.lengths * longest + room >= self.least)
        if not len(live):
            return False
        own, short = self.x[live].astype(np.float32), x.astype(np.float32)
        floor = (self.least - room)[live].astype(np.float32)
        if not self.whole:
            h = max(1, x.shape[1] // 4)
            rest_q = np.sqrt((self.x[live, h:] ** 2).sum(axis=1)).astype(np.float32)
            rest_x = np.sqrt((x[:, h:] ** 2).sum(axis=1)).astype(np.float32)
            bound = own[:, :h] @ short[:, :h].T
            bound += rest_q[:, None] * rest_x[None, :]
            self.whole = (NEXT + 1) * (np.count_nonzero(bound < floor[:, None]) < (1 - DENSE) * bound.size)
            q, i = _reaching(bound, floor) if not self.whole else (live[:0], live[:0])
        if self.whole:  # whole-block product, then the same test with all dimensions
            self.whole -= 1
            full = own @ short.T
            if np.isneginf(self.least).any() and x.shape[0] > self.k:
                part = np.where(self.ids[live][:, None] == ids[None, :], -np.inf, full)
                kth = np.partition(part, -self.k, axis=1)[:, -self.k]
                floor = np.maximum(floor, (kth - room[live]).astype(np.float32))
            q, i = _reaching(full, floor)
        q = live[q]
        other = self.ids[q] != ids[i]
        q, i = q[other], i[other]
        self.products += len(q)
        scores = np.concatenate([np.einsum("ij,ij->i", self.x[q[s : s + 65536]], x[i[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        self.pending.append((np.round(scores, PLACES) + 0.0, q, ids[i]))
        self.waiting += len(q)
        if self.waiting >= len(self.ids) * self.k:
            self.settle()
        return True

    def settle(self) -> None:
        """Rank what waits, which only now raises the k-th products."""
        scores, q, found = (np.concatenate(c) for c in zip((self.scores, self.q, self.found), *self.pending))
        self.pending, self.waiting = [], 0
        self.q, self.found, self.scores = _best(scores, q, found, len(self.ids), self.k)
        full_rows = np.bincount(self.q, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.q, np.arange(len(self.ids)), "right") - 1
        now = np.where(full_rows, self.scores[np.maximum(last, 0)] if len(self.scores) else -np.inf, -np.inf)
        self.least = np.maximum(self.known, now)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of jobs in here end at `size` bytes, or with the row that exceeds them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def top_products(vecs: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For the vectors whose ids `every` divides, the k others with the largest inner products: vec_id, rank, other_id, score.

    The result is exact. Vectors are cut into parts in descending order of length and rotated to the right
    singular vectors of the table, so that most of a product comes from the first coordinates. Each query
    first meets the BLOCK longest vectors, which gives a floor to its k-th product and so the last part that
    can hold a better one by length; it goes on to just those parts. There items pass by descending length:
    the rest of a part is left out where lengths alone bound it below the k-th products so far, a pair where
    the partial sum and the Cauchy-Schwarz bound of the residuals do.

    Parts and blocks of queries are written once and read from there by every task that needs them: a task
    keeps QUERY_BLOCKS blocks of queries while one of GROUPS groups of parts passes, so vectors are shuffled
    only to be ordered, and k rows of a query from each group to be ranked. The driver gets the BLOCK longest
    vectors, and of a part only its number, size and length.

    Products count as rounded to PLACES decimal places and ties go to the smaller id, so ranks don't
    depend on the order of sums. A vector isn't compared with itself, but with others that equal it. With
    fewer than k others there are fewer ranks. Left out as in clean_vectors: nulls, NaNs, other
    dimensions, all but one vector of a repeated id. Zero vectors stay. An empty table gives no rows.
    """
    with batches_of(vecs.sparkSession, BATCH_BYTES):
        return _top_products(vecs, k, every)


def _top_products(vecs: DataFrame, k: int, every: int) -> DataFrame:
    spark = vecs.sparkSession
    out = "vec_id bigint, rank int, other_id bigint, score double"
    clean, dims = clean_vectors(vecs)
    if not dims:
        return spark.createDataFrame([], out)
    single = vecs.schema["embedding"].dataType.elementType == FloatType()  # then four bytes hold each element as it is
    kind = "<f4" if single else "<f8"
    clean = clean.withColumn("length", F.sqrt(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)")))
    clean = clean.withColumn("embedding", F.col("embedding").cast("array<float>")) if single else clean
    size = max(1, PART_BYTES // (8 * dims))
    ranges = max(1, min(MOST_RANGES, -(-clean.count() // size)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32

        def part(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            row = [place, len(ids), float(np.sqrt((x * x).sum(axis=1)).max()), ids.astype("<i8").tobytes(), x.astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()))], names=["part", "n", "longest", "ids", "x"])

        ids, x = np.zeros(0, np.int64), np.zeros((0, dims))
        for batch in batches:
            ids, x = np.r_[ids, np.asarray(batch.column(0))], np.r_[x, matrix(batch.column(1), dims)]
            while len(ids) >= 2 * size:  # a range that is a little large stays one part
                yield part(ids[:size], x[:size])
                ids, x, place = ids[size:], x[size:], place + 1
        if len(ids):
            yield part(ids, x)

    ordered = clean.repartitionByRange(ranges, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    items = durable(ordered.select("vec_id", "embedding").mapInArrow(packed, "part bigint, n bigint, longest double, ids binary, x binary"))
    order = sorted((r.part, r.n, r.longest) for r in items.select("part", "n", "longest").collect())
    names, counts, lengths = (np.array(c) for c in zip(*order))
    turn = spectral_rotation(items, dims, kind)

    first = items.where(F.col("part") <= int(names[min(np.searchsorted(np.cumsum(counts), BLOCK), len(names) - 1)]))
    wide = np.dtype(kind).itemsize * dims
    longest = sorted(first.select("part", F.substring("ids", 1, 8 * BLOCK).alias("ids"), F.substring("x", 1, wide * BLOCK).alias("x")).collect(), key=lambda r: r.part)
    head_ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in longest])[:BLOCK]
    head_x = np.concatenate([np.frombuffer(r.x, kind) for r in longest]).astype(np.float64).reshape(-1, dims)[:BLOCK] @ turn

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own_ids, own_x in zip(*batch.columns):
                ids = np.frombuffer(own_ids.as_buffer(), "<i8")
                asked = np.flatnonzero(ids % every == 0)
                for at in range(0, len(asked), BLOCK):
                    mine = asked[at : at + BLOCK]
                    now = Running(ids[mine], _vectors(own_x, kind, dims)[mine] @ turn, k)
                    now.meet(head_ids, head_x)
                    now.settle()
                    # lengths descend, so that the parts a query needs are the first ones
                    reach = [int((n * lengths + slack(n, lengths) >= least).sum()) for n, least in zip(now.lengths, now.least)]
                    yield pa.RecordBatch.from_arrays([pa.array(now.ids), pa.array(now.least), pa.array(reach, pa.int64()), pack_rows(now.x.astype("<f8"))], names=["vec_id", "floor", "reach", "x"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK * QUERY_BLOCKS):
                piece = batch.slice(at, BLOCK * QUERY_BLOCKS)
                ids, floor, reach = (np.asarray(c) for c in piece.columns[:3])
                row = [int(ids[0]), int(names[reach.max() - 1]) if reach.max() else -1, ids.astype("<i8").tobytes(), floor.astype("<f8").tobytes(), b"".join(piece.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "last", "q_ids", "floor", "q_x"])

    bins = max(1, -(-int(counts.sum()) // (every * BLOCK * QUERY_BLOCKS)))
    queries = items.select("ids", "x").mapInArrow(seeded, "vec_id bigint, floor double, reach bigint, x binary")
    queries = durable(queries.repartitionByRange(bins, "reach", "vec_id").mapInArrow(block, "block bigint, last bigint, q_ids binary, floor binary, q_x binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Running]] = {}
        for batch in batches:
            for name, q_ids, floor, q_x, ids, x in zip(*batch.columns):
                if name.as_py() not in held:
                    own, least, q = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(floor.as_py(), "<f8"), np.frombuffer(q_x.as_py(), "<f8").reshape(-1, dims)
                    held[name.as_py()] = [Running(own[s : s + BLOCK], q[s : s + BLOCK], k, least[s : s + BLOCK]) for s in range(0, len(own), BLOCK)]
                ids, x = np.frombuffer(ids.as_buffer(), "<i8"), _vectors(x, kind, dims) @ turn
                for now in held[name.as_py()]:
                    for at in range(0, len(x), BLOCK):
                        if not now.meet(ids[at : at + BLOCK], x[at : at + BLOCK]):
                            break
        for now in (now for block in held.values() for now in block):
            now.settle()
            yield pa.RecordBatch.from_arrays([pa.array(now.ids[now.q]), pa.array(now.found), pa.array(now.scores)], names=["vec_id", "other_id", "score"])

    # a Cartesian product by name: it reads partitions where they are written, and a broadcast would go through the driver
    sides = items.select("part", "ids", "x").coalesce(GROUPS).hint("shuffle_replicate_nl")
    pairs = sides.join(queries.hint("shuffle_replicate_nl"), F.col("part") <= F.col("last"))
    best = pairs.select("block", "q_ids", "floor", "q_x", "ids", "x").mapInArrow(search, "vec_id bigint, other_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "other_id"))
    return durable(best.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "other_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings")).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5).cast("double") / 1e6)


SQL = f"""
with v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id, b.vec_id as other_id, round(list_dot_product(a.e, b.e), {PLACES}) as s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
r as (select vec_id, row_number() over (partition by vec_id order by s desc, other_id) as rank, other_id, s from p)
select vec_id, rank::int as rank, other_id, floor(s * 1e6::double + 0.5::double) / 1e6::double as score from r where rank <= {K}
"""
