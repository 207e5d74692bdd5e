"""Rules over streams: a stateless projection, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.models import Classifier
from loomtext.operators.rules import RuleMatcher, find_matches, rule_boost


def score_rules(stream: DataFrame, matchers: list[RuleMatcher], text: str = "text") -> DataFrame:
    """The stream with extra_hits and boost; needs neither state nor a watermark."""
    hit = stream.withColumn("extra_hits", find_matches(F.col(text), matchers))
    return hit.withColumn("boost", rule_boost(F.col("extra_hits")))


def classify_stream(stream: DataFrame, model: Classifier, path: str, checkpoint: str, matchers: list[RuleMatcher] | None = None, add_rules: bool = False):
    """Start a query that classifies each micro-batch of (doc_id, text) and appends it to Parquet.

    Each batch has its own folder, written over if the batch runs again after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        model.classify(batch, add_rules, matchers).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
