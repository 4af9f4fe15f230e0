from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import LINEAGE, lineage_text
from plumbline.operators.lineage import LINEAGE_TYPE
from plumbline.plans import ClassificationPipeline

FRAME = f"split string, lineage {LINEAGE_TYPE}, features array<double>, label double, prediction double"


def frame(spark, rows):
    """Rows of (split, [(operator, row), ..], features, label, prediction)."""
    return spark.createDataFrame(rows, FRAME)


def pipeline_of(outputs, sources=None, joins=frozenset()):
    sources = sources or {"train": {}, "test": {}}
    names = {i: f"source-{i}" for by_id in sources.values() for i in by_id}
    return ClassificationPipeline(outputs, sources, names, joins)


def simple_pipeline(spark, train, test):
    """One source; train and test are lists of (features, label)."""
    rows = [("train", [(0, i)], x, y, y) for i, (x, y) in enumerate(train)]
    rows += [("test", [(0, len(train) + i)], x, y, y) for i, (x, y) in enumerate(test)]
    outputs = frame(spark, rows)
    source = outputs.select(LINEAGE)
    return pipeline_of(outputs, {"train": {0: source}, "test": {0: source}})


def lineages(df) -> list[str]:
    return sorted(r["t"] for r in df.select(lineage_text(F.col(LINEAGE)).alias("t")).collect())
