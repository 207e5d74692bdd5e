"""Operator 7: SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.buckets import connected, first_with
from loomtext.llm.common import durable, join_counted, slices, table
from loomtext.llm.graph import components

BITS = 128
#: Fingerprints that differ in at most this many of 128 bits are near-duplicates.
DISTANCE = 22
#: The least recall that the tables are laid out for, of pairs at the full distance; nearer pairs have more.
RECALL, AT_DISTANCE = 0.97, DISTANCE
#: Rows below a lowest node of the index, and nodes below an upper one.
FAN = 16
_BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_U = np.uint64
_CACHE = 300_000


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_128_digest(word)
        if len(self) < _CACHE:
            self[word] = value
        return value


_digests = _Digests()


def fingerprint(text: str | None) -> bytes | None:
    """128 bits: each is the majority, over the distinct words of the whole text, of that bit of their hashes.

    A text with no letter or digit counts as one word; an empty or null one has no fingerprint.
    """
    if not text:
        return None
    words = set(text.lower().encode("utf-8", "replace").translate(_BLANK).split())
    if not words:
        bare = text.strip().encode("utf-8", "replace")
        if not bare:
            return None
        words = {bare}
    bits = np.unpackbits(np.frombuffer(b"".join(map(_digests.__getitem__, words)), np.uint8).reshape(-1, BITS // 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(words)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of every document that has an id and a fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            keep = [p is not None for p in prints]
            words = np.frombuffer(b"".join(p for p in prints if p), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(words[:, 0]), pa.array(words[:, 1])], schema=schema)

    narrow = docs.where("doc_id IS NOT NULL").select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint")


def layout(n: int) -> list[np.ndarray]:
    """The bit order of each table for n fingerprints; the first bits of an order are the table's bucket.

    Buckets have three quarters of log2 n bits, so that they stay small while the number of tables,
    which RECALL sets, grows slowly.
    """
    prefix = max(4, round(0.75 * math.log2(max(n, 2))))
    hit = math.comb(BITS - AT_DISTANCE, prefix) / math.comb(BITS, prefix)  # the bits of a bucket are all different
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - hit))
    rng = np.random.default_rng(20_240_607)
    return [rng.permutation(BITS)[:prefix] for _ in range(tables)]


def _bucket(hi: np.ndarray, lo: np.ndarray, order: np.ndarray) -> np.ndarray:
    key = np.zeros(len(hi), np.uint64)
    for bit in order:
        word = hi if bit < 64 else lo
        key = (key << _U(1)) | ((word >> _U(63 - bit % 64)) & _U(1))
    return key


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code in Gray order, as two words: the exclusive or of all its prefixes."""
    out = []
    for word in (hi, lo):
        word = word.copy()
        for s in (1, 2, 4, 8, 16, 32):
            word ^= word >> _U(s)
        out.append(word)
    odd = (np.bitwise_count(hi) & 1).astype(bool)
    out[1] = np.where(odd, ~out[1], out[1])
    return out[0], out[1]


class GrayIndex:
    """Codes in Gray order, per bucket, below nodes that hold the bits all codes of a node share.

    A node has only the shared bits that its parent lacks, so a search adds a node's differences to
    those on the way down and leaves out the whole group once they exceed the distance.
    """

    def __init__(self, bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        g_hi, g_lo = gray_rank(hi, lo)
        self.order = np.lexsort((g_lo, g_hi, bucket))
        bucket, hi, lo = bucket[self.order], hi[self.order], lo[self.order]
        self.codes = (hi, lo)
        self.starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(bucket)])
        self.levels = []
        begin, count = self.starts, self.sizes  # of the items below, in each bucket
        first_item = np.arange(len(bucket))
        pats, masks = self.codes, tuple(np.full(len(hi), ~_U(0)) for _ in range(2))
        for _ in range(3):
            nodes = -(-count // FAN)
            node_begin = np.r_[0, np.cumsum(nodes)[:-1]].astype(np.int64) if len(nodes) else np.zeros(0, np.int64)
            within = np.arange(int(nodes.sum())) - np.repeat(node_begin, nodes)
            child_begin = np.repeat(begin, nodes) + within * FAN
            child_count = np.minimum(FAN, np.repeat(count, nodes) - within * FAN)
            new_pats, new_masks = [], []
            for pat, mask in zip(pats, masks):
                head = np.repeat(pat[child_begin], child_count)
                differ = np.bitwise_or.reduceat((pat ^ head) | ~mask, child_begin) if len(child_begin) else mask[:0]
                new_masks.append(~differ)
                new_pats.append(pat[child_begin] & ~differ)
            parent = np.repeat(np.arange(len(child_begin)), child_count)
            own = tuple(m & ~p[parent] for m, p in zip(masks, new_masks))
            self.levels.append({"pats": pats, "own": own, "begin": child_begin, "count": child_count, "row": first_item[child_begin]})
            pats, masks, begin, count, first_item = tuple(new_pats), tuple(new_masks), node_begin, nodes, first_item[child_begin]
        self.top = {"pats": pats, "own": masks, "begin": begin, "count": count}
        self.bucket_of = np.repeat(np.arange(len(self.starts)), self.sizes)

    def _differ(self, q: np.ndarray, node: np.ndarray, level: dict) -> np.ndarray:
        out = np.zeros(len(q), np.int64)
        for code, pat, own in zip(self.codes, level["pats"], level["own"]):
            out += np.bitwise_count((code[q] ^ pat[node]) & own[node])
        return out

    def _common(self, label: np.ndarray, depth: int) -> np.ndarray:
        """By node of that depth, the label that all rows below share, or -1."""
        low = high = label
        for level in self.levels[:depth]:
            low, high = np.minimum.reduceat(low, level["begin"]), np.maximum.reduceat(high, level["begin"])
        return np.where(low == high, low, -1)

    def pairs(self, q: np.ndarray, distance: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, later row of its bucket) within the distance; with labels, not those that share one."""
        n = self.top["count"][self.bucket_of[q]]
        node = _spread(self.top["begin"][self.bucket_of[q]], n)
        q = np.repeat(q, n)
        so_far = self._differ(q, node, self.top)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = so_far <= distance
            q, node, so_far = q[keep], node[keep], so_far[keep]
            n = level["count"][node]
            q, so_far, node = np.repeat(q, n), np.repeat(so_far, n), _spread(level["begin"][node], n)
            keep = self.levels[depth - 1]["row"][node] + FAN**depth > q if depth else node > q
            if label is not None:
                keep &= (self._common(label, depth) if depth else label)[node] != label[q]
            q, node, so_far = q[keep], node[keep], so_far[keep]
            so_far = so_far + self._differ(q, node, level)
        keep = so_far <= distance
        return q[keep], node[keep]

    def forest(self, distance: int, work: int = 1 << 21, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect just what all pairs within the distance connect, as rows of the input.

        `known` has by row the first row that it's connected to already. Queries go in chunks. Rows that
        one chunk has connected needn't be compared by the next, so a bucket full of copies costs about as
        many comparisons as it has rows.
        """
        rows = len(self.order)
        label = np.arange(rows) if known is None else first_with(known[self.order])
        before = label.copy()
        cost = np.cumsum(np.repeat(self.sizes, self.sizes)) if rows else np.zeros(0, np.int64)
        at = 0
        while at < rows:
            end = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + work, "right"))
            end = min(rows, max(end, at + 1))
            a, b = self.pairs(np.arange(at, end), distance, label)
            label = join(label, a, b)
            at = end
        moved = np.flatnonzero(label != before)
        return self.order[moved], self.order[label[moved]]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges begin .. begin + count one after the other."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(begin, count)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each part so far) after a and b are joined pairwise."""
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        if not keep.any():
            break
        x, y = x[keep], y[keep]
        a, b = a[keep], b[keep]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def near_parts(prints: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of the parts that fingerprints (rep, hi, lo) within the distance connect, for n of them or so."""
    orders = layout(n)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, hi, lo = (np.asarray(c) for c in batch.columns)
            high, low = hi.view(np.uint64), lo.view(np.uint64)
            for t, order in enumerate(orders):
                key = (_bucket(high, low, order) | _U(t << 44)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rep, hi, lo)], names=["bucket", "id", "hi", "lo"])

    def forest(table: pa.Table, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, hi, lo = (table.column(c).to_numpy() for c in ("bucket", "hi", "lo"))
        return GrayIndex(bucket, hi.view(np.uint64), lo.view(np.uint64)).forest(distance, known=known)

    placed = prints.select("rep", "hi", "lo").mapInArrow(spread, "bucket bigint, id bigint, hi bigint, lo bigint")
    return connected(placed, ["hi", "lo"], forest)


def _groups(docs: DataFrame, distance: int) -> DataFrame:
    """(doc_id, keep_id) by row of docs that has a fingerprint.

    Equal fingerprints, however many, are counted and joined by them, never gathered.
    """
    base = durable(fingerprints(docs))
    prints = durable(base.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = near_parts(prints, prints.count(), distance)
    moved = prints.where("n > 1").select("hi", "lo", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "full")
    kept = durable(moved.select("hi", "lo", F.col("rep").alias("of"), F.coalesce("root", "rep").alias("to")))
    copies = kept.where("hi IS NOT NULL").select("hi", "lo", "to")
    alone = kept.where("hi IS NULL").select(F.col("of").alias("doc_id"), F.col("to").alias("single"))
    joined = join_counted(join_counted(base, durable(copies), ["hi", "lo"], "left"), durable(alone), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("to", "single", "doc_id").alias("keep_id"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, keep_id, is_kept.

    Documents whose fingerprints differ in at most `distance` bits are near-duplicates; groups are the
    connected parts of that relation. keep_id is the least doc_id of the group, the document that
    stays. Only groups of two documents or more have rows, one for each distinct doc_id.

    Candidates share a bucket of one of the tables of layout(), which finds a pair at AT_DISTANCE with
    probability RECALL and closer ones with more; within a bucket the search is exact and there is no
    cap on partners. Equal fingerprints are one entry of the index.

    Null ids, null and empty texts are in no group. A repeated doc_id is one document; where its rows
    have different texts it belongs to the groups of both, which joins them. An empty table gives no
    rows. Whole texts count. Other columns aren't looked at.
    """
    pairs = _groups(docs, distance)
    per_doc = durable(pairs.groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"), F.max("keep_id").alias("other")))
    if not per_doc.where("keep_id <> other").isEmpty():
        clash = pairs.join(per_doc.where("keep_id <> other").select("doc_id", F.col("keep_id").alias("low")), "doc_id").select(F.col("keep_id").alias("a"), F.col("low").alias("b"))
        roots = components(clash)
        per_doc = per_doc.join(roots, per_doc["keep_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "keep_id").alias("keep_id"))
    dropped = per_doc.where("doc_id <> keep_id").select("doc_id", "keep_id")
    keepers = dropped.select("keep_id").distinct().select(F.col("keep_id").alias("doc_id"), "keep_id")
    return dropped.union(keepers).select("doc_id", "keep_id", (F.col("doc_id") == F.col("keep_id")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs without the near-duplicates: of each group the document with the least id stays.

    Rows that repeat a doc_id are one document, so one of them stays (the one with the least hash of
    its text). Rows without an id, and null or empty texts with ids that don't repeat, all stay. Other
    columns are carried along, whatever their names.
    """
    groups = durable(near_duplicates(docs, distance).where("NOT is_kept").select(F.col("doc_id").alias("__gone")))
    ids = docs.where("doc_id IS NOT NULL").select(docs["doc_id"].cast("bigint").alias("__again"))
    again = durable(ids.groupBy("__again").count().where("count > 1").select("__again"))
    kept = docs.join(groups, docs["doc_id"] == groups["__gone"], "left_anti")
    if again.isEmpty():
        return kept
    names = [f"__c{i}" for i in range(len(docs.columns))]
    marked = kept.select(*[kept[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)], kept["doc_id"].cast("bigint").alias("__again"), F.xxhash64(kept["text"]).alias("__hash"))
    once = marked.join(again, "__again", "left_anti")
    more = marked.join(again, "__again", "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("__again").orderBy("__hash"))).where("__nth = 1")
    return once.select(*names).union(more.select(*names)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
