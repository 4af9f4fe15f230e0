from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Issue:
    id: str
    is_present: bool
    details: dict = field(default_factory=dict)


class IssueDetector(ABC):
    """Looks for one kind of issue in a pipeline."""

    @abstractmethod
    def detect(self, pipeline) -> Issue: ...

    def message(self, issue: Issue) -> str:
        return f"Found {issue.id}"
