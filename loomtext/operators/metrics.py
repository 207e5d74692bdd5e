"""Evaluation of predictions: a table (y_true, y_pred) in, numbers out as DataFrames of one or few rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r < 1e-9, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r < 1e-9, F.lit(1.0)).otherwise(p + r))


def accuracy(pairs: DataFrame) -> DataFrame:
    """accuracy, 0 for no rows."""
    return pairs.agg(_ratio(F.count_if(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("accuracy"))


def precision_recall_f1(pairs: DataFrame, positive: object) -> DataFrame:
    """precision, recall and f1 of one class; 0 where undefined."""
    t, p = F.col("y_true") == F.lit(positive), F.col("y_pred") == F.lit(positive)
    c = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    c = c.select(_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return c.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def per_class(pairs: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) over the classes of either column; one aggregation of the rows."""
    both = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = both.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("support")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    out = sums.select("class", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), "support")
    return out.select("class", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"), "support")


def macro_f1(pairs: DataFrame) -> DataFrame:
    return per_class(pairs).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def weighted_f1(pairs: DataFrame) -> DataFrame:
    return per_class(pairs).agg(_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion_matrix(pairs: DataFrame, labels: list) -> DataFrame:
    """(y_true, y_pred, n) for every pair of the labels, zeros too; other labels are left out."""
    spark = pairs.sparkSession
    kind = dict(pairs.dtypes)["y_true"]
    names = spark.createDataFrame([(x,) for x in labels], f"y_true {kind}")
    grid = names.crossJoin(names.select(F.col("y_true").alias("y_pred")))
    counts = pairs.where(F.col("y_true").isin(labels) & F.col("y_pred").isin(labels)).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(counts), ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def roc_auc(scored: DataFrame, ties: str = "rows", order: str | None = None) -> DataFrame:
    """auc of (score, is_positive): 0 for no rows, 0.5 for one class.

    ties="grouped" is the usual measure: equal scores share a trapezoid. ties="rows" takes rows one by one by
    descending score and then by the column `order`, which has to make their order definite; equal scores
    then count by that order. Either way rows are sorted in ranges, each of which gives one row of sums.
    """
    y = F.col("is_positive").cast("bigint")
    if ties == "grouped":
        steps, keys = scored.groupBy("score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")), [F.desc("score")]
    else:
        keys = [F.desc("score"), *([F.col(order)] if order else [])]
        steps = scored.select(y.alias("pos"), (1 - y).alias("neg"), "score", *([order] if order else []))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = n = 0
        area = 0.0
        for batch in batches:
            pos, neg = (np.asarray(c.fill_null(0)) for c in batch.columns)
            area += float((neg * (p + np.cumsum(pos) - pos / 2.0)).sum())  # a row is either, a group may be both
            p, n = p + int(pos.sum()), n + int(neg.sum())
        if p + n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([p]), pa.array([n]), pa.array([area])], names=["part", "pos", "neg", "area"])

    ranged = steps.repartitionByRange(*keys).sortWithinPartitions(*keys).select("pos", "neg")
    parts = ranged.mapInArrow(sums, "part bigint, pos bigint, neg bigint, area double")  # a row a partition
    before = F.coalesce(F.sum("pos").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = parts.select("pos", "neg", (F.col("area") + F.col("neg") * before).alias("area"))
    s = area.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("area").alias("a"))
    return s.select(F.when(F.col("p").isNull(), F.lit(0.0)).when((F.col("p") == 0) | (F.col("n") == 0), F.lit(0.5)).otherwise(F.col("a") / (F.col("p").cast("double") * F.col("n"))).alias("auc"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """Rows for the classes of y_true by descending support, then accuracy, macro_f1 and weighted_f1.

    (class, precision, recall, f1, support, accuracy, macro_f1, weighted_f1); the last three are the same in
    every row. macro_f1 takes classes that occur only as predictions into account.
    """
    classes = per_class(pairs)
    whole = classes.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    out = classes.where("support > 0").crossJoin(F.broadcast(accuracy(pairs))).crossJoin(F.broadcast(whole))
    return out.orderBy(F.desc("support"), "class")
