"""Folders of text files as tables of training samples: one file is one document."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig, TooLarge
from loomtext.functions.labels import canonical_label
from loomtext.sources.security import MAX_FILE_BYTES, MAX_FILES, read_text

SAMPLE = "sample_id bigint, label string, text string, source_name string"


def collect_files(root: str, recursive: bool = True, max_bytes: int = MAX_FILE_BYTES) -> list[str]:
    """Regular files below root in path order; too large a file or too many of them are errors."""
    top = Path(root)
    if not top.exists():
        raise InvalidConfig("files", f"{root!r} doesn't exist")
    top = top.resolve()
    if top.is_file():
        found = [str(top)]
    elif recursive:
        found = [os.path.join(d, f) for d, _, files in os.walk(top, followlinks=False) for f in files]
    else:
        found = [str(p) for p in top.iterdir()]
    found = sorted((p for p in found if os.path.isfile(p) and not os.path.islink(p)), key=os.fsencode)
    if len(found) > MAX_FILES:
        raise TooLarge("files", f"{root!r} has over {MAX_FILES} files")
    for p in found:
        if os.path.getsize(p) > max_bytes:
            raise TooLarge("files", f"{p} is over {max_bytes} bytes")
    return found


def sample_iter(root: str, label: str, recursive: bool = True) -> Iterator[tuple[str, str, str]]:
    """(label, text, source_name) one by one, in path order."""
    name = canonical_label(label)
    for path in collect_files(root, recursive):
        yield name, read_text(path), path


def load_samples(spark: SparkSession, root: str, label: str, recursive: bool = True, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(sample_id, label, text, source_name) of the files below root; ids follow path order.

    The files are checked and listed on the driver (there are at most MAX_FILES), their texts are read
    by the executors, one by one, so the folder must be one that all of them share. Names may hold any character.
    Bytes that aren't UTF-8 are an error of the reading task.
    """
    paths = collect_files(root, recursive, max_bytes)
    if not paths:
        return spark.createDataFrame([], SAMPLE)
    name = canonical_label(label)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                text = read_text(row.column(1)[0].as_py(), max_bytes)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([name]), pa.array([text]), row.column(1)], names=["sample_id", "label", "text", "source_name"])

    ids = spark.createDataFrame(list(enumerate(paths)), "sample_id bigint, source_name string")
    parts = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return ids.repartitionByRange(parts, "sample_id").sortWithinPartitions("sample_id").mapInArrow(read, SAMPLE)


def union_samples(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both tables, cold ids after hot ones."""
    last = hot.agg(F.max("sample_id")).first()[0]
    offset = 0 if last is None else last + 1
    return hot.unionByName(cold.withColumn("sample_id", F.col("sample_id") + F.lit(offset)))
