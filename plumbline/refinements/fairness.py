"""Confusion counts and false-negative rates of the test predictions per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import LINEAGE, row_id_of, with_source_rows
from .base import Refinement

COUNTS = ("true_positives", "false_negatives", "false_positives", "true_negatives")


def group_membership(source_rows: DataFrame, source_id: int, attribute: str, non_protected) -> DataFrame:
    """``(row_id, non_protected)`` per source row; a null attribute is in the protected group."""
    return source_rows.select(
        row_id_of(F.col(LINEAGE), source_id).alias("row_id"),
        F.col(attribute).eqNullSafe(F.lit(non_protected)).alias("non_protected"),
    )


def confusion_by_group(predicted: DataFrame, membership: DataFrame, source_id: int) -> DataFrame:
    """Confusion counts and ``false_negative_rate`` for both groups, also for an empty one.

    The test rows are first counted per source row and outcome, so that a source row used by a third
    of all test rows reaches the join as at most four rows.
    """
    outcome = (
        F.when(F.col("label") == 1.0, F.when(F.col("prediction") == 1.0, COUNTS[0]).otherwise(COUNTS[1]))
        .when(F.col("prediction") == 1.0, COUNTS[2])
        .otherwise(COUNTS[3])
    )
    per_row = (
        with_source_rows(predicted, source_id, "row_id")
        .select("row_id", outcome.alias("outcome"))
        .groupBy("row_id", "outcome")
        .agg(F.count("*").alias("n"))
    )
    counted = (
        per_row.join(membership, "row_id")
        .groupBy("non_protected")
        .agg(
            *[
                F.sum(F.when(F.col("outcome") == c, F.col("n")).otherwise(0)).alias(c)
                for c in COUNTS
            ]
        )
    )
    both = predicted.sparkSession.createDataFrame([(True,), (False,)], "non_protected boolean")
    missed = F.col("false_negatives")
    return (
        both.join(counted, "non_protected", "left")
        .select("non_protected", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
        .withColumn("false_negative_rate", F.try_divide(missed, missed + F.col("true_positives")))
    )


def fairness_metric_rows(confusion: DataFrame, attribute: str, non_protected) -> DataFrame:
    """``(metric, value)`` rows: four counts and the rate for each group."""
    stem = f"fairness.{attribute}."
    group = str(non_protected).lower()
    prefix = F.when(F.col("non_protected"), F.lit(f"{stem}{group}.")).otherwise(
        F.lit(f"{stem}not.{group}.")
    )
    return (
        confusion.select(
            prefix.alias("prefix"),
            *[F.col(c).cast("double").alias(c) for c in (*COUNTS, "false_negative_rate")],
        )
        .unpivot("prefix", [*COUNTS, "false_negative_rate"], "name", "value")
        .select(F.concat("prefix", "name").alias("metric"), "value")
    )


class FairnessMetrics(Refinement):
    """Compares the rows whose attribute equals the non-protected class with all others.

    The attribute is looked up in the entity table of the test side, or else in the one other source
    that has it.
    """

    def __init__(self, sensitive_attribute: str, non_protected_class):
        self.sensitive_attribute = sensitive_attribute
        self.non_protected_class = non_protected_class

    def _source(self, pipeline):
        fact = pipeline.fact_source("test")
        if self.sensitive_attribute in fact.rows.columns:
            return fact
        holders = [s for s in pipeline.sources("test") if self.sensitive_attribute in s.rows.columns]
        if len(holders) != 1:
            raise ValueError(
                f"{len(holders)} test sources have the attribute {self.sensitive_attribute!r}"
            )
        return holders[0]

    def confusion(self, pipeline) -> DataFrame:
        source = self._source(pipeline)
        membership = group_membership(
            source.rows, source.source_id, self.sensitive_attribute, self.non_protected_class
        )
        predicted = pipeline.predicted.filter(F.col("split") == "test").select(LINEAGE, "label", "prediction")
        return confusion_by_group(predicted, membership, source.source_id)

    def compute(self, pipeline, run=None):
        metrics = fairness_metric_rows(
            self.confusion(pipeline), self.sensitive_attribute, self.non_protected_class
        )
        if run is not None:
            run.log_metrics({r["metric"]: r["value"] for r in metrics.collect()})
        return metrics
