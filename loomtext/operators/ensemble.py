"""Ensembles: label scores of several classifiers merged by weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig
from loomtext.functions.scores import softmax


def merge(members: list[tuple[DataFrame, float]], strategy: str = "WeightedAverage") -> DataFrame:
    """(doc_id, label, score) of weighted members; weights count by their share of the absolute sum.

    WeightedAverage: the weighted sum over the sum of all labels. ProductOfExperts: softmax of the weighted
    logarithms. A label that a member doesn't have adds nothing.
    """
    if strategy not in ("WeightedAverage", "ProductOfExperts"):
        raise InvalidConfig("ensemble", f"unknown strategy {strategy!r}")
    total = max(sum(abs(w) for _, w in members), 1e-9)
    rows = [m.select("doc_id", "label", F.col("score"), F.lit(w / total).alias("w")) for m, w in members]
    every = reduce(DataFrame.unionByName, rows)
    if strategy == "ProductOfExperts":
        logs = every.groupBy("doc_id", "label").agg(F.sum(F.col("w") * F.log(F.greatest("score", F.lit(1e-9)))).alias("score"))
        return softmax(logs, "doc_id")
    sums = every.groupBy("doc_id", "label").agg(F.sum(F.col("w") * F.col("score")).alias("score"))
    per_doc = sums.groupBy("doc_id").agg(F.sum("score").alias("t"))
    return sums.join(per_doc, "doc_id").select("doc_id", "label", (F.col("score") / F.greatest("t", F.lit(1e-9))).alias("score"))


def merge_hits(docs: list[DataFrame], dedupe: bool = False) -> DataFrame:
    """extra_hits of the members one after the other, by doc_id; equal hits once with dedupe."""
    out = reduce(lambda a, b: a.join(b.withColumnRenamed("extra_hits", "__more"), "doc_id").select("doc_id", F.concat("extra_hits", "__more").alias("extra_hits")), [d.select("doc_id", "extra_hits") for d in docs])
    return out.withColumn("extra_hits", F.array_distinct("extra_hits")) if dedupe else out
