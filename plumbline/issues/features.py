"""Issues seen in the training features alone. Both read the same single pass over the features."""

from __future__ import annotations

from .base import Issue, IssueDetector

# The tolerances within which a mean counts as 0 and a variance as 1.
MEAN_TOLERANCE = 1e-8
VARIANCE_TOLERANCE = 1e-8 + 1e-5


def is_constant(stats) -> bool:
    # NaN equals NaN here, as in Spark: a feature without any number is constant.
    both_nan = stats["low"] != stats["low"] and stats["high"] != stats["high"]
    return both_nan or stats["low"] == stats["high"]


def is_binary(stats) -> bool:
    """Only zeros and ones, and both of them."""
    return stats["n_zero"] + stats["n_one"] == stats["n"] and stats["n_zero"] > 0 < stats["n_one"]


class ConstantFeatures(IssueDetector):
    def detect(self, pipeline) -> Issue:
        constant = [s["pos"] for s in pipeline.feature_stats if is_constant(s)]
        others = [s["pos"] for s in pipeline.feature_stats if not is_constant(s)]
        return Issue(
            "constant_features",
            bool(constant),
            {"constant_feature_indices": constant, "nonconstant_feature_indices": others},
        )

    def message(self, issue: Issue) -> str:
        return f"{len(issue.details['constant_feature_indices'])} training feature(s) never vary"


class UnnormalisedFeatures(IssueDetector):
    def detect(self, pipeline) -> Issue:
        numeric = [s for s in pipeline.feature_stats if not is_binary(s)]
        # Written so that NaN is flagged.
        off_mean = [s["pos"] for s in numeric if not abs(s["mean"]) <= MEAN_TOLERANCE]
        off_variance = [
            s["pos"] for s in numeric if not abs(s["variance"] - 1.0) <= VARIANCE_TOLERANCE
        ]
        return Issue(
            "unnormalised_features",
            bool(off_mean or off_variance),
            {
                "non_binary_features": [s["pos"] for s in numeric],
                "non_zero_mean_features": off_mean,
                "non_unit_variance_features": off_variance,
            },
        )

    def message(self, issue: Issue) -> str:
        return (
            f"of the non-binary features {len(issue.details['non_zero_mean_features'])} have a mean "
            f"other than 0 and {len(issue.details['non_unit_variance_features'])} a variance other than 1"
        )
