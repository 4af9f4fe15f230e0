from .base import Issue, IssueDetector
from .features import ConstantFeatures, UnnormalisedFeatures
from .overlap import TrainTestOverlap, overlapping_rows, shared_lineages
from .shift import (
    AUC_THRESHOLD,
    CovariateShift,
    LabelShift,
    covariate_shift_between_runs,
    domain_classifier_auc,
)

# In the order in which they run.
DETECTORS = {
    "constant_features": ConstantFeatures,
    "unnormalised_features": UnnormalisedFeatures,
    "label_shift": LabelShift,
    "covariate_shift": CovariateShift,
    "traintest_overlap": TrainTestOverlap,
}

__all__ = [
    "AUC_THRESHOLD",
    "DETECTORS",
    "ConstantFeatures",
    "CovariateShift",
    "Issue",
    "IssueDetector",
    "LabelShift",
    "TrainTestOverlap",
    "UnnormalisedFeatures",
    "covariate_shift_between_runs",
    "domain_classifier_auc",
    "overlapping_rows",
    "shared_lineages",
]
