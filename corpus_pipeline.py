"""A corpus pipeline of five of the training-data operators: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
rereads as the next one's docs. All stages but the last return the columns of documents, and any
others that docs has, whatever their names. Every stage takes an empty table, and texts of any length
are read whole. What each does with nulls, empty texts, repeats and ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import mixing, packing, pii, simhash, toxicity
from loomtext.llm.common import reread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that compress like toxic text; the model is trained on the labelled ones of docs.

    Null and empty texts stay; each row is judged by its own text, whatever its id. Without labels of both
    classes all rows stay.
    """
    return toxicity.drop_toxic(docs, toxicity.model_for(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Rows without an id, or with a null or empty text, are in no group and stay; of rows that repeat an id one
    stays, that with the least hash of its text.
    """
    return simhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in text replaced by their kinds; n_chars follows. Every row stays; null, empty and clean texts are as they were."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as before, shared by sources in proportion to the square roots of their sizes.

    A null source is a source. Null and empty texts have no weight and aren't drawn; ties in the draw go by
    id and weight. A row may come more than once.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of equal length, in the order of the curve; see packing.pack for its columns.

    Null and empty texts are in no sequence; equal rows are all packed.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the checkpoint folder and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express compression distance, SimHash, the transducers or the Hilbert order.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
