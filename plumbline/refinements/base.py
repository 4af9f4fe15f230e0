from __future__ import annotations

from abc import ABC, abstractmethod


class Refinement(ABC):
    """Derives refined inputs, or metrics, from a pipeline; logs to the run when there is one."""

    @abstractmethod
    def compute(self, pipeline, run=None): ...
