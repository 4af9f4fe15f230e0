"""Ranks and running sums over rows that are ordered globally but never gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import shuffle_partitions

BUCKET = "__bucket"


def range_buckets(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add a bucket number such that buckets follow the order. Range partitioning keeps them even.

    The numbers belong to one execution: use them within one plan, or write the frame first.
    """
    parts = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(parts, *order).withColumn(BUCKET, F.spark_partition_id())


def before_in(order: Column, group: Sequence[str] = ()) -> WindowSpec:
    return W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def roc_auc(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve as one row ``auc``; null when a class is missing. A row counts ``weight`` times.

    Rows are first added up per score. Each score range then needs only its own running sum, and the
    ranges are put together from three totals each.
    """
    positive = F.col(label).cast("double")
    times = F.lit(1.0) if weight is None else F.col(weight)
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(positive * times).alias("p"), F.sum((1.0 - positive) * times).alias("n")
    )
    negatives_below = F.coalesce(F.sum("n").over(before_in(F.col("s"), [BUCKET])), F.lit(0.0))
    per_range = (
        range_buckets(per_score, ["s"])
        .withColumn("pairs", F.col("p") * (negatives_below + F.col("n") / 2))
        .groupBy(BUCKET)
        .agg(F.sum("pairs").alias("pairs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    # One row per shuffle partition from here on.
    ranges_below = F.coalesce(F.sum("n").over(before_in(F.col(BUCKET))), F.lit(0.0))
    return (
        per_range.withColumn("pairs", F.col("pairs") + F.col("p") * ranges_below)
        .agg(F.sum("pairs").alias("pairs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
        .select(F.try_divide(F.col("pairs"), F.col("p") * F.col("n")).alias("auc"))
    )


def roc_auc_value(df: DataFrame, score: str, label: str, weight: str | None = None) -> float | None:
    return roc_auc(df, score, label, weight).first()["auc"]
