from .base import Refinement
from .fairness import FairnessMetrics, confusion_by_group, fairness_metric_rows
from .usage import InputUsage, UsedRows
from .valuation import DataValuation, knn_shapley, value_source_rows

__all__ = [
    "DataValuation",
    "FairnessMetrics",
    "InputUsage",
    "Refinement",
    "UsedRows",
    "confusion_by_group",
    "fairness_metric_rows",
    "knn_shapley",
    "value_source_rows",
]
