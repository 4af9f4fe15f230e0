"""What is known about a pipeline's inputs and outputs, as (key, value) rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..features.vectors import width
from .classification import SPLITS, ClassificationPipeline


def pipeline_profile(pipeline: ClassificationPipeline) -> list[tuple[str, str]]:
    """Role, rows, attributes and types of every source; rows and features of X_train and X_test; the
    encoders with their arguments."""
    rows: list[tuple[str, str]] = []
    counts: dict[int, int] = {}
    for split in SPLITS:
        for source in pipeline.sources(split):
            key = f"{split}_source.{source.source_id}"
            data = source.data
            shared = pipeline.source_rows["train"].get(source.source_id) is source.rows
            if split == "train" or not shared:
                counts[source.source_id] = data.count()
            rows += [
                (f"{key}.type", source.role),
                (f"{key}.num_records", str(counts[source.source_id])),
                (f"{key}.attributes", ",".join(data.columns)),
                (f"{key}.attribute_types", ",".join(t for _, t in data.dtypes)),
            ]
    shapes = {
        r["split"]: r
        for r in pipeline.outputs.groupBy("split")
        .agg(F.count("*").alias("n"), F.max(width(pipeline.outputs)).alias("d"))
        .collect()
    }
    for split in SPLITS:
        shape = shapes.get(split)
        rows.append((f"X_{split}.num_rows", str(shape["n"] if shape else 0)))
        rows.append((f"X_{split}.num_features", str(shape["d"] if shape else 0)))
    for number, (kind, arguments) in enumerate(pipeline.preprocessing):
        rows.append((f"preprocessing.{number}.type", kind))
        rows.append((f"preprocessing.{number}.arguments", json.dumps(arguments)))
    return rows
