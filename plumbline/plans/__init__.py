from .classification import ClassificationPipeline, Source, build_classification
from .fact_table import fact_table_id, join_usage, one_to_one_sources, source_cardinalities
from .models import fit_linear, fit_network, predict
from .profile import pipeline_profile
from .run_store import Run, RunStore
from .screening import ScreeningFailed, ScreeningReport, screen

__all__ = [
    "ClassificationPipeline",
    "Run",
    "RunStore",
    "ScreeningFailed",
    "ScreeningReport",
    "Source",
    "build_classification",
    "fact_table_id",
    "fit_linear",
    "fit_network",
    "join_usage",
    "one_to_one_sources",
    "pipeline_profile",
    "predict",
    "screen",
    "source_cardinalities",
]
