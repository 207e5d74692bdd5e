"""Clean embedding tables, for the operators over vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import durable, join_counted


def clean_vectors(vecs: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) with usable vectors only, one for each id, and their dimension.

    Left out: null ids and vectors, vectors with a null, a NaN or an infinite element, and those whose
    dimension isn't the most frequent one (the larger of two as frequent). Of the vectors of a repeated
    id the greatest in array order stays. The dimension of an empty table is 0.
    """
    good = vecs.select(vecs["vec_id"].cast("bigint").alias("vec_id"), vecs["embedding"].cast("array<double>").alias("embedding"))
    fine = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND x = x AND abs(x) < double('infinity'))"
    good = good.where(fine)
    ids = durable(good.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes.d if sizes else 0
    good = good.where(F.size("embedding") == dims)
    if ids.isEmpty():  # whole vectors are shuffled only where ids repeat, and of those only the repeated ones
        return good, dims
    again = join_counted(good, ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return join_counted(good, ids, "vec_id", "left_anti").union(again), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of one length as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def pack_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpack_rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
