"""Connected parts of rows that meet in buckets, some of which may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import durable
from loomtext.llm.graph import components

#: Rows after which a chunk ends, with its bucket if that ends soon, within it if it doesn't.
CHUNK, LONGEST = 200_000, 400_000
#: Visitors of a chunk that are searched together.
VISITORS = 50_000
Forest = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]


def chunks(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK, longest: int = LONGEST) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Batches sorted by their first column in larger pieces: (rows, whether the first bucket may have begun before, whether the last may go on)."""
    held: list[pa.RecordBatch] = []
    rows, opened = 0, True
    for batch in batches:
        while batch.num_rows:
            if rows < chunk:
                take = min(batch.num_rows, chunk - rows)
            else:  # to the end of the bucket, or as far as a piece may go
                keys, last = batch.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
                take = min(int(np.searchsorted(keys, last, "right")), longest - rows)
                if take < batch.num_rows:
                    cut = keys[take] == last
                    yield pa.Table.from_batches([*held, batch.slice(0, take)]).combine_chunks(), opened, cut
                    held, rows, opened, batch = [], 0, cut, batch.slice(take)
                    continue
            held.append(batch.slice(0, take))
            rows += take
            batch = batch.slice(take)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks(), opened, True


def first_with(label: np.ndarray) -> np.ndarray:
    """By row, the first row that has the same label."""
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return first[back]


def connected(rows: DataFrame, by: list[str], forest: Forest, chunk: int = CHUNK, longest: int = LONGEST) -> DataFrame:
    """(node, root) as components() gives them, of the relation that `forest` finds within buckets.

    rows has bucket, id and further columns, `by` tells the rows of a bucket apart. forest(table, label) gets rows of whole or cut buckets, in order
    of the bucket, and for each the first row that it is known to be connected to; it returns rows
    to be joined pairwise so that within each bucket all are connected that the relation connects.

    Rows are range-partitioned by bucket and `by`, so that no task gets more than its share, whatever
    the sizes of buckets. A bucket that a boundary cuts is connected chunk by chunk first. Then, of its
    rows, those outside the bucket's largest part so far visit all its other chunks; two rows of that part
    needn't meet again. So a bucket full of copies costs little more than its rows, and none is left out.
    """
    further = rows.columns[2:]
    kinds = dict(rows.dtypes)
    extra = "".join(f", {c} {kinds[c]}" for c in further)
    ranged = rows.repartitionByRange("bucket", *by).sortWithinPartitions("bucket", *by)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, (table, opened, open_) in enumerate(chunks(batches, chunk, longest)):
            bucket, ids = table.column(0).to_numpy(), table.column(1)
            a, b = forest(table, np.arange(len(bucket)))
            none = [pa.nulls(len(a), c.type) for c in table.columns[2:]]
            edges = [ids.take(pa.array(a)).combine_chunks(), ids.take(pa.array(b)).combine_chunks(), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), *none]
            yield pa.RecordBatch.from_arrays(edges, names=["a", "b", "bucket", "chunk", *further])
            cut = (bucket == bucket[0]) & opened | (bucket == bucket[-1]) & open_
            if cut.any():
                part = table.filter(pa.array(cut)).combine_chunks()
                n = part.num_rows
                home = np.full(n, (TaskContext.get().partitionId() << 24) + nth)
                columns = [part.column(1), pa.nulls(n, pa.int64()), part.column(0), pa.array(home), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["a", "b", "bucket", "chunk", *further])

    found = durable(ranged.mapInArrow(search, f"a bigint, b bigint, bucket bigint, chunk bigint{extra}"))
    edges = found.where("bucket IS NULL").select("a", "b")
    rest = found.where("bucket IS NOT NULL").drop("b").withColumnRenamed("a", "id")
    cut = durable(rest.groupBy("bucket").agg(F.array_sort(F.collect_set("chunk")).alias("homes")).where("size(homes) > 1"))  # at most two for each task, and those within hot buckets
    if cut.isEmpty():
        return components(edges)
    roots = components(edges)
    known = rest.join(F.broadcast(cut), "bucket").join(roots, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "id")).drop("node", "root")
    known = durable(known)
    sizes = known.groupBy("bucket", "label").count()
    largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    known = known.join(F.broadcast(largest), "bucket")  # a row for each cut bucket
    home = known.select("bucket", "chunk", F.lit(False).alias("visits"), "id", "label", *further)
    away = known.where("label <> largest").withColumn("to", F.explode(F.filter("homes", lambda h: h != F.col("chunk"))))
    away = away.select("bucket", F.col("to").alias("chunk"), F.lit(True).alias("visits"), "id", "label", *further)
    met = home.union(away).repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "visits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, residents, visitors, waiting = None, [], [], 0

        def joined() -> pa.RecordBatch:
            table = pa.Table.from_batches([*residents, *visitors]).combine_chunks()
            ids, label = table.column(3), table.column(4).to_numpy()
            start = first_with(label)
            a, b = forest(table.select(["bucket", "id", *further]), start)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)).combine_chunks(), ids.take(pa.array(b)).combine_chunks()], names=["a", "b"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c).cast(pa.int64())) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                here, visits = (int(keys[0, s]), int(keys[1, s])), bool(keys[2, s])
                if here != at:
                    if visitors:
                        yield joined()
                    at, residents, visitors, waiting = here, [], [], 0
                piece = batch.slice(s, e - s)
                if not visits:
                    residents.append(piece)
                    continue
                for x in range(0, piece.num_rows, VISITORS):
                    visitors.append(piece.slice(x, VISITORS))
                    waiting += visitors[-1].num_rows
                    if waiting >= VISITORS:
                        yield joined()
                        visitors, waiting = [], 0
        if visitors:
            yield joined()

    more = met.mapInArrow(meet, "a bigint, b bigint")
    star = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(star.union(more))
