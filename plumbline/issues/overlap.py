"""Training rows that also serve as test rows: same source rows, whatever their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import LINEAGE
from .base import Issue, IssueDetector


def shared_lineages(outputs: DataFrame) -> DataFrame:
    """Distinct lineages found in both splits: one aggregation with two flags, no join."""
    return (
        outputs.groupBy(LINEAGE)
        .agg(
            F.bool_or(F.col("split") == "train").alias("in_train"),
            F.bool_or(F.col("split") == "test").alias("in_test"),
        )
        .filter("in_train AND in_test")
        .select(LINEAGE)
    )


def overlapping_rows(outputs: DataFrame) -> DataFrame:
    """All rows, of both splits, whose lineage is in both. One scan and one shuffle: rows of one lineage meet, and these
    are few."""
    same = Window.partitionBy(LINEAGE)
    marked = outputs.withColumns(
        {f"__in_{s}": F.bool_or(F.col("split") == s).over(same) for s in ("train", "test")}
    )
    return marked.filter("__in_train AND __in_test").drop("__in_train", "__in_test")


class TrainTestOverlap(IssueDetector):
    def detect(self, pipeline) -> Issue:
        found = shared_lineages(pipeline.rows.select("split", LINEAGE)).count()
        return Issue("traintest_overlap", found > 0, {"num_overlapping_records": found})

    def message(self, issue: Issue) -> str:
        return f"{issue.details['num_overlapping_records']} records are in both train and test"
