"""Run chosen detectors and refinements over one pipeline and report."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..issues import DETECTORS, Issue, IssueDetector
from ..refinements import Refinement
from .classification import ClassificationPipeline
from .run_store import Run

REPORT_SCHEMA = "issue string, is_present boolean, details string, message string"


class ScreeningFailed(Exception):
    """At least one issue was found."""


@dataclass
class ScreeningReport:
    issues: list[Issue]
    messages: dict[str, str]
    refined: list

    @property
    def passes(self) -> bool:
        return not any(i.is_present for i in self.issues)

    def assert_passes(self) -> None:
        found = [self.messages[i.id] for i in self.issues if i.is_present]
        if found:
            raise ScreeningFailed("; ".join(found))

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i.id, i.is_present, json.dumps(i.details), self.messages.get(i.id)) for i in self.issues
        ]
        return spark.createDataFrame(rows, REPORT_SCHEMA)


def screen(
    pipeline: ClassificationPipeline,
    detect: Iterable[str | IssueDetector] | None = None,
    refine: Sequence[Refinement] = (),
    run: Run | None = None,
) -> ScreeningReport:
    """Detectors run in the order of ``DETECTORS`` whatever the order of their names.

    ``detect`` may be empty or None. An unknown name is an error. Refinements may repeat. With a
    ``run`` the verdicts become its tags, and refinements log there.
    """
    wanted = list(detect or [])
    named = {d for d in wanted if isinstance(d, str)}
    unknown = named - set(DETECTORS)
    if unknown:
        raise ValueError(f"unknown issues: {', '.join(sorted(unknown))}")
    detectors = [make() for name, make in DETECTORS.items() if name in named]
    detectors += [d for d in wanted if isinstance(d, IssueDetector)]

    issues, messages = [], {}
    for detector in detectors:
        issue = detector.detect(pipeline)
        issues.append(issue)
        if issue.is_present:
            messages[issue.id] = detector.message(issue)
    if run is not None and issues:
        run.set_tags(
            {
                f"issues.{i.id}.{key}": value
                for i in issues
                for key, value in (
                    ("is_present", json.dumps(i.is_present)),
                    ("details", json.dumps(i.details)),
                )
            }
        )
    refined = [refinement.compute(pipeline, run) for refinement in refine]
    return ScreeningReport(issues, messages, refined)
