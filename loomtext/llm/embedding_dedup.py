"""Operator 2: embedding near-duplicates by binary codes of randomly rotated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.buckets import chunks, connected, first_with
from loomtext.llm.common import durable, join_counted, table
from loomtext.llm.simhash import join
from loomtext.llm.vectors import clean_vectors, matrix, pack_rows, unpack_rows

#: Vectors with at least this cosine are near-duplicates.
COSINE = 0.95
#: The recall of a pair with just that cosine that the tables are laid out for.
RECALL = 0.97
#: Standard deviations on either side of an estimate; outside its bounds no product is computed.
EPSILON = 3.5
#: Rows of whole buckets whose estimates are made together; pairs that are multiplied at a time.
TOGETHER, PRODUCTS = 16_384, 65_536


def rotation(dims: int, seed: int = 907) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Pairs:
    """Estimates of all products among coded rows, from codes under two independent rotations alone.

    With x and y the sign codes of o under the one and the other rotation, and f and g their factors,
    <x(o), y(q)> / (f(o) g(q)) estimates <o, q> without bias, since the two codes' errors are independent; the mean of
    that and of the same with o and q exchanged is what's used. `least` bounds from below, with EPSILON
    standard deviations, what a pair of the given cosine is estimated at.
    """

    def __init__(self, code: np.ndarray, other: np.ndarray, f: np.ndarray, g: np.ndarray, cosine: float, turn: np.ndarray):
        dims = len(turn)
        self.x, self.y = (self._signs(b, dims, h) for b, h in ((code, f), (other, g)))
        self.y = self.y @ turn.T.astype(np.float32)  # to the basis of the first rotation
        self.u, self.v = ((1 - h**2) / h**2 for h in (f, g))
        self.sin2, self.dims, self.cosine = 1 - cosine**2, dims, cosine

    @staticmethod
    def _signs(bits: np.ndarray, dims: int, factor: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits, axis=1)[:, :dims].astype(np.float64)
        x *= 2
        x -= 1
        x /= math.sqrt(dims) * factor[:, None]
        return x

    def likely(self, rows: slice, others: slice) -> np.ndarray:
        """Which pairs of rows and others the bound leaves."""
        guess = (self.x[rows] @ self.y[others].T + self.y[rows] @ self.x[others].T) / 2
        u, v = self.u[rows, None], self.v[rows, None]
        p, q = self.u[None, others], self.v[None, others]
        variance = ((u + v + p + q) * self.sin2 + u * q + v * p) / (4 * max(1, self.dims - 1))
        return guess + EPSILON * np.sqrt(variance) >= self.cosine

    def partnered(self, at: int, end: int, block: int = 1024) -> np.ndarray:
        """Whether each row from at to end has a likely partner among them."""
        found = np.zeros(end - at, bool)
        for i in range(at, end, block):
            for j in range(i, end, block):
                a, b = slice(i, min(end, i + block)), slice(j, min(end, j + block))
                if found[a.start - at : a.stop - at].all() and found[b.start - at : b.stop - at].all():
                    continue
                hit = self.likely(a, b)
                if i == j:
                    np.fill_diagonal(hit, False)
                found[a.start - at : a.stop - at] |= hit.any(axis=1)
                found[b.start - at : b.stop - at] |= hit.any(axis=0)
        return found


class Codes:
    """Sign codes of rotated unit vectors with the factor that corrects their inner products.

    For a unit vector o with rotated coordinates and the code x = sign(o)/sqrt(d), factor is <x, o>.
    <x, q>/factor then estimates <o, q> for any unit q without bias; its error is within
    EPSILON * sqrt((1 - factor**2) / factor**2 / (d - 1)) except with a vanishing probability.
    """

    def __init__(self, bits: np.ndarray, factor: np.ndarray, dims: int):
        self.signs = (np.unpackbits(bits, axis=1)[:, :dims].astype(np.float32) * 2 - 1) / math.sqrt(dims)
        self.factor = factor
        self.bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dims - 1))

    @staticmethod
    def of(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The packed code and the factor of each row."""
        return np.packbits(rotated > 0, axis=1), (np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1]))

    def estimates(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Estimated inner products of coded rows (by number) with full rotated queries."""
        return (self.signs[rows] @ queries.T.astype(np.float32)) / self.factor[rows, None]


def layout(n: int, dims: int, cosine: float, recall: float = RECALL) -> list[np.ndarray]:
    """For each table, the code bits that make its bucket."""
    prefix = min(max(4, round(0.75 * math.log2(max(n, 2)))), 2 * dims)
    hit = max(1e-6, (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi)) ** prefix
    tables = 1 if hit > 1 - 1e-9 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
    rng = np.random.default_rng(77)
    return [rng.permutation(2 * dims)[:prefix] for _ in range(tables)]


def connect(rotated: np.ndarray, bits: np.ndarray, factor: np.ndarray, cosine: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Edges that connect what the pairs of a bucket with that cosine connect, and what was decided how.

    An upper bound below the cosine rejects a pair, a lower bound above it accepts one, the rest get the
    exact product. `known` has by row the first row that it's connected to already; a row that is
    connected to another is not compared with it again.
    """
    n, dims = rotated.shape
    codes = Codes(bits, factor, dims)
    label = np.arange(n) if known is None else first_with(known)
    before = label.copy()
    seen = {"rejected": 0, "accepted": 0, "exact": 0}
    step = max(1, min(512, (1 << 22) // n))
    for at in range(0, n, step):
        q = np.arange(at, min(n, at + step))
        rows = np.arange(at + 1, n)
        guess = codes.estimates(rows, rotated[q])
        later = (rows[:, None] > q[None, :]) & (label[rows][:, None] != label[q][None, :])
        bound = codes.bound[rows, None]
        sure = later & (guess - bound >= cosine)
        open_ = later & (guess + bound >= cosine) & ~sure
        i, j = np.nonzero(open_)
        exact = np.zeros(len(i), bool)
        for s in range(0, len(i), PRODUCTS):  # among copies nearly all pairs may be open
            e = slice(s, s + PRODUCTS)
            exact[e] = np.einsum("ij,ij->i", rotated[rows[i[e]]], rotated[q[j[e]]]) >= cosine - 1e-9
        seen["accepted"] += int(sure.sum())
        seen["exact"] += len(i)
        seen["rejected"] += int(later.sum() - sure.sum()) - len(i)
        si, sj = np.nonzero(sure)
        label = join(label, np.concatenate([rows[i[exact]], rows[si]]), np.concatenate([q[j[exact]], q[sj]]))
    moved = np.flatnonzero(label != before)
    return moved, label[moved], seen


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]


def near_duplicate_vectors(vecs: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Groups of near-duplicate embeddings: vec_id, keep_id (the least id of the group), is_kept.

    Groups are the connected parts of the relation "cosine at least `cosine`"; only those of two or
    more have rows. Vectors are normalised and rotated once, twice over. Tables of code bits bring likely pairs
    together, each such pair with RECALL or more. Into the tables go codes and factors alone; they
    tell which rows have a likely partner in a bucket, and only these are sent there with their vectors.
    Among them estimates and bounds decide which pairs are multiplied exactly. There's no cap on
    partners. Equal vectors go through the tables as one.

    Left out as in clean_vectors: nulls, NaNs, other dimensions, all but one vector of a repeated id;
    and zero vectors, which have no direction. An empty table gives no rows. Equal vectors are in one
    group. Other columns aren't looked at.
    """
    clean, dims = clean_vectors(vecs)
    out = "vec_id bigint, keep_id bigint, is_kept boolean"
    if not dims:
        return vecs.sparkSession.createDataFrame([], out)
    turn, second = rotation(dims), rotation(dims, 908)
    width = -(-dims // 8)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            norm = np.sqrt((x * x).sum(axis=1))
            keep = norm > 0
            x = (x[keep] / norm[keep, None]) @ turn
            (bits, f), (other, g) = Codes.of(x), Codes.of(x @ second)
            code = np.concatenate([bits, other, f.astype("<f4")[:, None].view("u1"), g.astype("<f4")[:, None].view("u1")], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pack_rows(code), pack_rows(x.astype("<f4"))], names=["vec_id", "code", "rotated"])

    def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = unpack_rows(column, "u1", 2 * width + 8)
        factors = np.ascontiguousarray(raw[:, 2 * width :]).view("<f4").astype(np.float64)
        return raw[:, :width], raw[:, width : 2 * width], factors[:, 0], factors[:, 1]

    every = durable(clean.mapInArrow(encode, "vec_id bigint, code binary, rotated binary"))
    same = F.xxhash64("rotated"), F.xxhash64(F.lit(1), "rotated")
    reps = every.groupBy(same[0].alias("h"), same[1].alias("l")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    copies = durable(reps.where("n > 1").select("h", "l", "rep"))
    keyed = every.withColumn("h", same[0]).withColumn("l", same[1])
    twins = durable(join_counted(keyed, copies, ["h", "l"]).where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    coded = join_counted(every, twins.select(F.col("a").alias("vec_id")), "vec_id", "left_anti")
    tables = layout(every.count(), dims, cosine)

    def keys(code: tuple[np.ndarray, ...]) -> Iterator[np.ndarray]:
        both = np.concatenate([np.unpackbits(b, axis=1)[:, :dims] for b in code[:2]], axis=1).astype(np.int64)
        for t, bits in enumerate(tables):
            yield both[:, bits] @ (1 << np.arange(len(bits), dtype=np.int64)) + (t << 44)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in keys(unpack(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], names=["bucket", "vec_id", "code"])

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, opened, open_ in chunks(batches):
            bucket, ids = (rows.column(c).to_numpy() for c in (0, 1))
            cuts = _cuts(bucket)
            keep = np.zeros(len(bucket), bool)
            at = 0
            while at < len(cuts) - 1:  # buckets of about TOGETHER rows
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + TOGETHER, "right")) - 1)
                first = cuts[at]
                pairs = Pairs(*unpack(rows.column(2).slice(first, cuts[to] - first)), cosine, second)
                for s, e in zip(cuts[at:to], cuts[at + 1 : to + 1]):
                    keep[s:e] = pairs.partnered(s - first, e - first)
                at = to
            keep |= (bucket == bucket[0]) & opened | (bucket == bucket[-1]) & open_  # others of the bucket may be elsewhere
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(bucket[keep])], names=["vec_id", "bucket"])

    def forest(rows: pa.Table, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")  # visitors follow all residents
        known = first_with(known[order])
        code, x = unpack(rows.column("code")), unpack_rows(rows.column("rotated"), "<f4", dims)
        cuts = _cuts(bucket[order])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s > 1:
                own = order[s:e]
                i, j, _ = connect(x[own], code[0][own], code[2][own], cosine, known[s:e])
                a.append(own[i]), b.append(own[j])
        return np.concatenate(a), np.concatenate(b)

    places = coded.select("vec_id", "code").mapInArrow(spread, "bucket bigint, vec_id bigint, code binary").repartitionByRange("bucket", "vec_id").sortWithinPartitions("bucket")
    likely = durable(places.mapInArrow(partnered, "vec_id bigint, bucket bigint"))
    wanted = durable(likely.select("vec_id").distinct())
    vectors = join_counted(coded, wanted, "vec_id", "left_semi")
    met = likely.join(vectors, "vec_id").select("bucket", F.col("vec_id").alias("id"), "code", "rotated")
    roots = connected(met, ["id"], forest, 50_000, 100_000)
    twins = twins.join(roots, twins["b"] == roots["node"], "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
    groups = durable(roots.union(twins))
    keepers = groups.select("root").distinct().select(F.col("root").alias("node"), "root")
    return groups.union(keepers).select(F.col("node").alias("vec_id"), F.col("root").alias("keep_id"), (F.col("node") == F.col("root")).alias("is_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def query_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over embeddings to which scaled and disturbed copies of a third and a fifth of the vectors are added."""
    base = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = base.where("vec_id % 9 = 0").select(F.col("vec_id") + 1, F.transform("embedding", lambda x: x * 2))
    disturbed = base.where("vec_id % 15 = 0").select(F.col("vec_id") + 2, F.transform("embedding", lambda x, i: x * (1 + F.lit(0.05) * ((i * 7 + F.col("vec_id")) % 5 - 2))))
    return near_duplicate_vectors(base.union(scaled).union(disturbed))


_GROUPS = f"""
edge as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) >= {COSINE} * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
grp as (select a as vec_id, least(a, min(b)) as keep_id from reach group by a)
select vec_id, keep_id, vec_id = keep_id as is_kept from grp
"""

SQL = f"with recursive v as (select vec_id, embedding::double[] as e from embeddings), {_GROUPS}"

SQL_WITH_COPIES = f"""
with recursive b as (select vec_id * 3 as vec_id, embedding::double[] as e from embeddings),
v as (
  select vec_id, e from b
  union all select vec_id + 1, list_transform(e, lambda x: x * 2) from b where vec_id % 9 = 0
  union all select vec_id + 2, list_transform(e, lambda x, i: x * (1 + 0.05::double * (((i - 1) * 7 + vec_id) % 5 - 2))) from b where vec_id % 15 = 0),
{_GROUPS}
"""
