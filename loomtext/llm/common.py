"""Shared pieces of the training-data operators: durable cuts of lineage and Arrow row iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, so that a batch of very long texts stays small.
SLICE = 128


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir where the session has it.

    Only a local session (tests, bench) without that setting gets a temporary folder; a cluster
    without it is an error, since a folder of one machine can't be read by the others.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lineage ends there, and it outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reread(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a folder of its own under the shared one, and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table of counted size is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def join_counted(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """df joined to a table that is already written; broadcast only where a count finds it small."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)
