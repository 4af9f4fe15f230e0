from .encoders import (
    Apply,
    ArrayFeature,
    Encoder,
    HashNgrams,
    ImputeMean,
    ImputeMode,
    OneHot,
    SafeLog,
    StandardScale,
)
from .plan import FeatureBlock, FeaturePlan, FittedFeatures, Part
from .vectors import dense, is_sparse, stored_entries, vector, width

__all__ = [
    "Apply",
    "ArrayFeature",
    "Encoder",
    "FeatureBlock",
    "FeaturePlan",
    "FittedFeatures",
    "HashNgrams",
    "ImputeMean",
    "ImputeMode",
    "OneHot",
    "Part",
    "SafeLog",
    "StandardScale",
    "dense",
    "is_sparse",
    "stored_entries",
    "vector",
    "width",
]
