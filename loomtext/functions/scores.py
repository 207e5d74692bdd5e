"""Softmax, in its window and array forms, and ranking of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """scores with the column replaced by its softmax over the rows that share `by`."""
    w = Window.partitionBy(by)
    shifted = scores.withColumn(score, F.exp(F.col(score) - F.max(score).over(w)))
    return shifted.withColumn(score, F.col(score) / F.sum(score).over(w))


def softmax_array(scores: Column) -> Column:
    """The softmax of an array of doubles; an empty array stays empty."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(scores, lambda x: F.exp(x - top) / total)


def normalise(scores: DataFrame, by: str, score: str = "score", floor: float = 1e-12) -> DataFrame:
    """scores divided by their sum over the rows that share `by`."""
    total = F.sum(score).over(Window.partitionBy(by))
    return scores.withColumn(score, F.col(score) / F.greatest(total, F.lit(floor)))


def rank(scores: DataFrame, by: str) -> DataFrame:
    """Long (by, label, score) to one row each: labels, an array of (label, score) by descending score, then label; equal rows count once."""
    pairs = F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("label").alias("label")))
    ordered = F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score")))
    return scores.groupBy(by).agg(ordered.alias("labels"))


def top_label(labels: Column) -> Column:
    return F.get(labels, F.lit(0))["label"]


def top_score(labels: Column) -> Column:
    """The best score, 0 for no labels."""
    return F.coalesce(F.get(labels, F.lit(0))["score"], F.lit(0.0))


def is_hot(labels: Column, threshold: float) -> Column:
    return top_score(labels) >= F.lit(float(threshold))
