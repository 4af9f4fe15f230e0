"""L-BFGS with a line search by the strong Wolfe conditions: the steps, limits and stops of the optimiser that pyspark.ml's
estimators use, for objectives that are computed outside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]

MEMORY = 10  # steps kept for the curvature
COMPARED = 20  # values that a new one must fall below
SEARCHED = 10  # evaluations of a line search, and as many to zoom in
DECREASE, CURVATURE = 1e-4, 0.9


class SearchError(Exception):
    """No step found from here."""


@dataclass(frozen=True)
class Point:
    """A place on the line, with value and slope."""

    t: float
    value: float
    slope: float


def minimize(objective: Objective, start: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """The last place and the values on the way. A failed search is tried again once without the curvature."""
    last: list = [None, None]

    def once(x: np.ndarray) -> tuple[float, np.ndarray]:
        # a search starts where the one before has ended
        if last[0] is None or not np.array_equal(last[0], x):
            last[:] = x.copy(), objective(x)
        return last[1]

    x = start
    value, grad = once(x)
    first, values, history = abs(value), [math.inf], [value]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    done, failed = 0, False
    while not (done >= max_iter or _converged(value, grad, first, values, tolerance)):
        try:
            way = _direction(steps, grad)
            t = _search(once, x, way, 1.0 / _norm(way) if done == 0 else 1.0)
            if t * _norm(grad) < 1e-10:
                raise SearchError("the step is too small")
        except SearchError:
            if failed:
                break
            failed, steps = True, []
            history.append(value)
            continue
        place = x + way * t
        value, new = once(place)
        steps = [(place - x, new - grad), *steps][:MEMORY]
        values = [*values, value][-COMPARED:]
        x, grad, done, failed = place, new, done + 1, False
        history.append(value)
    return x, history


def _norm(x: np.ndarray) -> float:
    return float(np.linalg.norm(x))


def _converged(value: float, grad: np.ndarray, first: float, values: list[float], tolerance: float) -> bool:
    if len(values) >= 2 and abs(value - max(values)) <= tolerance * first:
        return True
    return _norm(grad) <= max(tolerance * abs(value), 1e-8)


def _direction(steps: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    scale = 1.0
    if steps:
        step, change = steps[0]
        along = float(step @ change)
        if not along > 0:
            raise SearchError("no curvature")
        scale = along / float(change @ change)
    way, parts = grad.copy(), []
    for step, change in steps:
        rho = float(step @ change)
        part = float(step @ way) / rho if rho else math.nan
        if math.isnan(part):
            raise SearchError("no curvature")
        way -= part * change
        parts.append((part, rho))
    way *= scale
    for (step, change), (part, rho) in zip(reversed(steps), reversed(parts)):
        way += (part - float(change @ way) / rho) * step
    return -way


def _search(objective: Objective, x: np.ndarray, way: np.ndarray, t: float) -> float:
    def at(t: float) -> Point:
        value, grad = objective(x + way * t)
        return Point(t, value, float(grad @ way))

    start = low = at(0.0)
    if start.slope > 0:
        raise SearchError("the direction leads upwards")

    def too_high(point: Point) -> bool:
        return point.value > start.value + DECREASE * point.t * start.slope

    def flat(point: Point) -> bool:
        return abs(point.slope) <= CURVATURE * abs(start.slope)

    def zoom(low: Point, high: Point) -> float:
        for _ in range(SEARCHED):
            point = at(_between(*sorted((low, high), key=lambda p: p.t)))
            if too_high(point) or point.value >= low.value:
                high = point
                continue
            if flat(point):
                return point.t
            if point.slope * (high.t - low.t) >= 0:
                high = low
            low = point
        raise SearchError("no step found in the bracket")

    for i in range(SEARCHED):
        point = at(t)
        if math.isinf(point.value) or math.isnan(point.value):
            t /= 2.0
            continue
        if too_high(point) or (point.value >= low.value and i > 0):
            return zoom(low, point)
        if flat(point):
            return point.t
        if point.slope >= 0:
            return zoom(point, low)
        low = point
        t *= 1.5
    raise SearchError("no step found")


def _between(left: Point, right: Point) -> float:
    """The minimum of the cubic through both, not too close to either."""
    d1 = left.slope + right.slope - 3 * (left.value - right.value) / (left.t - right.t)
    square = d1 * d1 - left.slope * right.slope
    d2 = math.sqrt(square) if square >= 0 else math.nan
    width = right.t - left.t
    below = right.slope - left.slope + 2 * d2
    t = right.t - width * (right.slope + d2 - d1) / below if below else math.nan
    low, high = left.t + 0.1 * width, left.t + 0.9 * width
    return low if t < low else high if t > high else t
