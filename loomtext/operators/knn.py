"""Nearest neighbours over dense vectors: four distances, votes weighted by exp(-distance)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig
from loomtext.functions.scores import softmax

METRICS = ("cosine", "euclidean", "manhattan", "minkowski")
#: Numbers in a training matrix up to which it goes to every task as one array; a larger one is cut into blocks of as many, to which blocks of probes are joined.
BROADCAST_VALUES = 4_000_000
#: Probes, or rows on their way to a block, in a piece; rows of a block that a piece meets at a time.
PROBES, TILE = 512, 4096
#: Decimal places to which distances count.
PLACES = 12


def distance(a: Column, b: Column, metric: str, p: float = 2.0) -> Column:
    """The distance of two array columns as an expression."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    d = lambda x: x.cast("double")
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: d(x) * d(y)))
        na, nb = (F.sqrt(total(F.transform(c, lambda x: d(x) * d(x)))) for c in (a, b))
        return F.when((na < 1e-8) | (nb < 1e-8), F.lit(1.0)).otherwise(1 - dot / (na * nb))
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (d(x) - d(y)) * (d(x) - d(y)))))
    if metric == "manhattan":
        return total(F.zip_with(a, b, lambda x, y: F.abs(d(x) - d(y))))
    if metric == "minkowski":
        return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(d(x) - d(y)), F.lit(float(p))))), F.lit(1.0 / p))
    raise InvalidConfig("knn", f"unknown metric {metric!r}")


def distances(probes: np.ndarray, train: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """All distances between rows of two matrices."""
    if metric == "cosine":
        na, nb = np.linalg.norm(probes, axis=1), np.linalg.norm(train, axis=1)
        out = 1 - (probes @ train.T) / np.maximum(na[:, None] * nb[None, :], 1e-300)
        out[na < 1e-8, :] = 1.0
        out[:, nb < 1e-8] = 1.0
        return out
    out = np.empty((len(probes), len(train)))
    for i, row in enumerate(probes):
        diff = np.abs(train - row)
        out[i] = np.sqrt((diff**2).sum(axis=1)) if metric == "euclidean" else diff.sum(axis=1) if metric == "manhattan" else (diff**p).sum(axis=1) ** (1 / p)
    return out


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """The distance of each row of a to the same row of b, rounded to PLACES."""
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        out = 1 - np.einsum("ij,ij->i", a, b) / np.maximum(na * nb, 1e-300)
        out[(na < 1e-8) | (nb < 1e-8)] = 1.0
    else:
        diff = np.abs(a - b)
        out = np.sqrt((diff**2).sum(axis=1)) if metric == "euclidean" else diff.sum(axis=1) if metric == "manhattan" else (diff**p).sum(axis=1) ** (1 / p)
    return np.round(out, PLACES)


class Block:
    """Training rows held by a task, and the search for the k nearest of them.

    Every pair is looked at in single precision: by a matrix product, from which a lower bound of the distance
    follows (equal to it for cosine and euclidean, by norm inequalities for minkowski), or as the distance itself
    (manhattan). Pairs that the bound, less the most that rounding can do, leaves below a probe's k-th best so
    far get the exact distance. Where numbers are too large for single precision all pairs do.
    """

    def __init__(self, ids: np.ndarray, names: np.ndarray, x: np.ndarray, k: int, metric: str, p: float):
        self.ids, self.names, self.x, self.k, self.metric, self.p = ids, names, x, k, metric, p
        dims = max(1, x.shape[1])
        self.screened = bool(np.fmax.reduce(np.abs(x), axis=None, initial=0) < 1e15) and (metric != "minkowski" or p >= 1)
        #: The power of dims by which the distance may be less than the euclidean one.
        self.loss = dims ** (1 / p - 0.5) if metric == "minkowski" and p > 2 else 1.0
        self.eps = (dims + 8) * 6e-8
        held, self.norm = self._scaled(x)
        self.cols = np.ascontiguousarray(held.T)

    def _scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in single precision, of length one for cosine, and their norms."""
        if self.metric == "manhattan":
            return x.astype(np.float32), np.abs(x).sum(axis=1)
        norm = np.linalg.norm(x, axis=1)
        if self.metric == "cosine":
            x = np.where(norm[:, None] < 1e-8, 0.0, x / np.maximum(norm, 1e-300)[:, None])
        return x.astype(np.float32), norm

    def _looked_at(self, held: np.ndarray, tile: slice) -> np.ndarray:
        """For probes and the rows of a tile: minus the products (cosine), what |p|^2 lacks to the squared euclidean distance, or the manhattan distance."""
        cols = self.cols[:, tile]
        if self.metric == "manhattan":
            out = np.zeros((len(held), cols.shape[1]), np.float32)
            gap = np.empty((8, cols.shape[1]), np.float32)
            for at in range(0, len(held), 8):
                own, total = held[at : at + 8], out[at : at + 8]
                now = gap[: len(own)]
                for d in range(len(cols)):
                    np.subtract(cols[d], own[:, d : d + 1], out=now)
                    np.abs(now, out=now)
                    np.add(total, now, out=total)
            return out
        out = (held * np.float32(-1 if self.metric == "cosine" else -2)) @ cols
        if self.metric != "cosine":
            out += (self.norm[tile] ** 2).astype(np.float32)
        return out

    def _limits(self, kth: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
        """What _looked_at may be at most for a pair with that distance; kth is infinite at first."""
        kth = kth + 1e-11  # they are rounded
        if self.metric == "cosine":
            return kth - 1 + 2 * self.eps
        if self.metric == "manhattan":
            return kth + 2 * self.eps * (norm + most)
        return (kth / self.loss) ** 2 * (1 + 1e-6) - norm**2 + 2 * self.eps * (norm + most) ** 2

    def _exact(self, probes: np.ndarray, r: np.ndarray, c: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(r, c, distance) of pairs, without some that are beyond kth."""
        found = []
        step = max(1, (1 << 21) // max(1, probes.shape[1]))
        for at in range(0, len(r), step):
            i, j = r[at : at + step], c[at : at + step]
            if self.metric == "minkowski" and self.p != 2 and self.screened:  # powers are slow: once more in single precision
                diff = np.abs((probes[i] - self.x[j]).astype(np.float32))
                top = np.maximum(diff.max(axis=1), np.float32(1e-30))
                ratio = diff / top[:, None]
                power = (ratio * ratio * ratio if self.p == 3 else ratio ** np.float32(self.p)).sum(axis=1, dtype=np.float64)
                near = top * power ** (1 / self.p) <= kth[i] * (1 + 1e-4) + 1e-11
                i, j = i[near], j[near]
            found.append((i, j, pair_distances(probes[i], self.x[j], self.metric, self.p)))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (r, c, np.zeros(0))

    def nearest(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of probes, row of the block, distance) of the k nearest of each probe by distance, then id."""
        held, norm = self._scaled(probes)
        screened = self.screened and bool(np.fmax.reduce(np.abs(probes), axis=None, initial=0) < 1e15)
        kth = np.full(len(probes), np.inf)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(self.ids), TILE):
            tile = slice(at, min(len(self.ids), at + TILE))
            if screened:
                seen = self._looked_at(held, tile)
                most = float(np.fmax.reduce(self.norm[tile], initial=0))
                if not at:  # the k-th of some near ones is a first limit
                    n = min(2 * self.k + 4, seen.shape[1])
                    near = np.argpartition(seen, n - 1, axis=1)[:, :n]
                    if n >= self.k:
                        first = pair_distances(np.repeat(probes, n, axis=0), self.x[near.ravel()], self.metric, self.p).reshape(-1, n)
                        kth = np.sort(first, axis=1)[:, self.k - 1]
                with np.errstate(invalid="ignore", over="ignore"):
                    limit = self._limits(kth, norm, most)[:, None].astype(np.float32)
                    r, c = np.divmod(np.flatnonzero(~(seen > np.nextafter(limit, np.float32(np.inf)))), seen.shape[1])
            else:
                r, c = (i.ravel() for i in np.indices((len(probes), tile.stop - at)))
            r, c, d = self._exact(probes, r, c + at, kth)
            keep = d <= kth[r]
            r, c, d = (np.concatenate([old, new[keep]]) for old, new in zip(best, (r, c, d)))
            order = np.lexsort((self.ids[c], d, r))
            r, c, d = r[order], c[order], d[order]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(probes)))[r] < self.k
            best = r, c, d = r[keep], c[keep], d[keep]
            last = np.flatnonzero(np.bincount(r, minlength=len(probes)) == self.k)
            kth[last] = np.minimum(kth[last], d[np.searchsorted(r, last, "right") - 1])
        return best

    def answer(self, probe_ids: pa.Array, probes: np.ndarray) -> pa.RecordBatch:
        r, c, d = self.nearest(probes)
        return pa.RecordBatch.from_arrays([probe_ids.take(pa.array(r)), pa.array(self.ids[c]), pa.array(list(self.names[c]), pa.string()), pa.array(d)], names=["doc_id", "train_id", "label", "dist"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of vectors as a matrix; all have to have as many numbers."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    if (lengths != dims).any():
        raise InvalidConfig("knn", f"vectors must have {dims} numbers each")
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


@dataclass
class KnnModel:
    """train has (train_id, vector, label); vectors may have been z-scored by the caller."""

    train: DataFrame
    k: int
    metric: str = "cosine"
    p: float = 2.0

    def __post_init__(self):
        if self.k < 1:
            raise InvalidConfig("knn", "k must be at least 1")
        if self.metric not in METRICS:
            raise InvalidConfig("knn", f"unknown metric {self.metric!r}")
        if self.metric == "minkowski" and not self.p > 0:
            raise InvalidConfig("knn", "p must be positive")

    def neighbours(self, probes: DataFrame) -> DataFrame:
        """(doc_id, train_id, label, dist, rank): the k nearest of each probe (doc_id, vector); ties by train_id.

        A training table under BROADCAST_VALUES numbers is one array in every task. A larger one is cut into blocks of
        as many, by hash, and every block goes to some tasks, together all that run at a time or more. Of the probes,
        which come in pieces after it, each task of a block gets its share; one window then merges the k best of all blocks.
        So a task holds one block, one piece, and a tile of what lies between, whatever the sizes of the tables.
        """
        spark = probes.sparkSession
        head = self.train.select(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        if not head.n:
            return spark.createDataFrame([], "doc_id bigint, train_id bigint, label string, dist double, rank int")
        blocks = max(1, -(-head.n * head.d // BROADCAST_VALUES))
        tasks = 4 * spark.sparkContext.defaultParallelism
        schema = "doc_id bigint, train_id bigint, label string, dist double"
        train = self.train.select(F.col("train_id").cast("bigint"), F.col("label").cast("string"), F.col("vector").cast("array<double>"))
        asked = probes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
        search = self.k, self.metric, self.p
        if blocks == 1:
            rows = train.toArrow().combine_chunks()
            x = _matrix(rows.column(2).combine_chunks(), head.d) if rows.num_rows else np.zeros((0, head.d))
            held = spark.sparkContext.broadcast((rows.column(0).to_numpy(), rows.column(1).to_pylist(), x))
            best = asked.repartition(tasks).mapInArrow(_among(held, *search), schema)
        else:
            best = _in_blocks(train, asked, blocks, -(-tasks // blocks), head.d).mapInArrow(_by_block(*search, head.d), schema)
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("dist", "train_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= self.k)

    def votes(self, probes: DataFrame) -> DataFrame:
        """(doc_id, label, score): sums of exp(-distance) over the k nearest; labels without a neighbour are absent."""
        return self.neighbours(probes).groupBy("doc_id", "label").agg(F.sum(F.exp(-F.col("dist"))).alias("score"))

    def scores(self, probes: DataFrame) -> DataFrame:
        return softmax(self.votes(probes), "doc_id")


def _among(held, k: int, metric: str, p: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = held.value
        block = Block(ids, np.array(labels, object), x, k, metric, p)
        for batch in batches:
            for at in range(0, batch.num_rows, PROBES):
                piece = batch.slice(at, PROBES)
                yield block.answer(piece.column(0), _matrix(piece.column(1), x.shape[1]))

    return run


def _in_blocks(train: DataFrame, probes: DataFrame, blocks: int, shares: int, dims: int) -> DataFrame:
    """(place, asks, ids, labels, x): at each place a block's rows, in pieces, and after them pieces of its share of the probes."""

    def packed(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in range(blocks) if not asks else (-1,):
                    own = batch if asks else batch.filter(pa.array(np.asarray(batch.column(0)) == block))
                    for at in range(0, own.num_rows, PROBES):
                        piece = own.slice(at, PROBES)
                        ids = np.asarray(piece.column(1)).astype("<i8")
                        names = None if asks else piece.column(3).to_pylist()
                        share = int(ids[0]) * 0x9E3779B1 % (1 << 32) >> 7
                        yield pa.RecordBatch.from_arrays([pa.array([block if not asks else share % shares]), pa.array([ids.tobytes()]), pa.array([names], pa.list_(pa.string())), pa.array([_matrix(piece.column(2), dims).astype("<f8").tobytes()])], names=["at", "ids", "labels", "x"])

        return run

    row = "at bigint, ids binary, labels array<string>, x binary"
    block = F.pmod(F.xxhash64("train_id"), F.lit(blocks)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = train.select(block.alias("at"), "train_id", "vector", "label").mapInArrow(packed(False), row).withColumn("other", every(shares))
    asked = probes.where("doc_id IS NOT NULL").select(F.lit(-1).cast("bigint").alias("at"), "doc_id", "vector").mapInArrow(packed(True), row).withColumn("other", every(blocks))
    rows = rows.select((F.col("at") * shares + F.col("other")).cast("int").alias("place"), F.lit(False).alias("asks"), "ids", "labels", "x")
    asked = asked.select((F.col("other") * shares + F.col("at")).cast("int").alias("place"), F.lit(True).alias("asks"), "ids", "labels", "x")
    return rows.union(asked).repartitionById(blocks * shares, F.col("place")).sortWithinPartitions("place", "asks")


def _by_block(k: int, metric: str, p: float, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        ids, labels, xs = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                here, asks = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if here != place:
                    place, block, ids, labels, xs = here, None, [], [], []
                own, x = np.frombuffer(batch.column(2)[i].as_py(), "<i8"), np.frombuffer(batch.column(4)[i].as_py(), "<f8").reshape(-1, dims)
                if not asks:
                    ids.append(own), labels.extend(batch.column(3)[i].as_py()), xs.append(x)
                    continue
                if block is None:
                    if not ids:
                        continue  # a block without rows
                    block = Block(np.concatenate(ids), np.array(labels, object), np.concatenate(xs), k, metric, p)
                    ids, labels, xs = [], [], []
                yield block.answer(pa.array(own), x)

    return run
