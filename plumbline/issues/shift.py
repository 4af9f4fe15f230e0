"""Shifts between training and test rows, or between the training rows of two runs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..features.vectors import vector
from ..operators.lineage import LINEAGE
from ..operators.ranking import roc_auc_value
from ..operators.sampling import split_at_rank
from ..session import shared_folder
from .base import Issue, IssueDetector

# Fixed values.
LABEL_SHIFT_P = 0.001
AUC_THRESHOLD = 0.7
HELD_OUT = 0.2

#: Bins of a feature, which are all that a forest sees of it.
BINS = 32
#: Features up to which rows are binned, and equal ones counted, before a forest is fitted.
NARROW = 128
#: Parts that rows of equal bins are dealt to; the forest's bootstrap draws parts.
PARTS = 64
#: Rows of one partition of what a forest is fitted on.
_CELLS = 10_000
#: Different values of a feature up to which they are counted one by one.
_COUNTED = 1000


def chi_square_2x2(a: float, b: float, c: float, d: float) -> float:
    """Chi-square of the table ((a, b), (c, d)) with Yates' correction; 0 when a margin is empty."""
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    if margins == 0:
        return 0.0
    total = a + b + c + d
    return total * max(abs(a * d - b * c) - total / 2, 0.0) ** 2 / margins


class LabelShift(IssueDetector):
    """Independence of split and label. Two classes: with Yates' correction; more: without. Rows without a label are
    left out and counted in the details."""

    def __init__(self, threshold: float = LABEL_SHIFT_P):
        self.threshold = threshold

    def detect(self, pipeline) -> Issue:
        counts = pipeline.label_counts
        unknown = {s: counts[s].get(None, 0) for s in ("train", "test")}
        labels = sorted(y for y in set(counts["train"]) | set(counts["test"]) if y is not None)
        if len(labels) <= 2:
            pair = [*labels, None, None][:2]
            cells = [float(counts[s].get(y, 0)) for s in ("train", "test") for y in pair]
            # One degree of freedom: the survival function is erfc(sqrt(x / 2)).
            p_value = math.erfc(math.sqrt(chi_square_2x2(*cells) / 2))
        else:
            p_value = self._more_classes(pipeline.rows.filter(F.col("label").isNotNull()))
        return Issue(
            "label_shift",
            p_value < self.threshold,
            {"threshold": self.threshold, "p_value": p_value}
            | ({"rows_without_label": unknown} if any(unknown.values()) else {}),
        )

    @staticmethod
    def _more_classes(outputs: DataFrame) -> float:
        encoded = outputs.select(
            (F.col("split") == "test").cast("double").alias("domain"),
            array_to_vector(F.array("label")).alias("labels"),
        )
        return float(ChiSquareTest.test(encoded, "labels", "domain").first()["pValues"][0])

    def message(self, issue: Issue) -> str:
        return (
            "label frequencies differ between train and test: "
            f"p-value {issue.details['p_value']} < {issue.details['threshold']}"
        )


def domain_classifier_auc(
    one: DataFrame, two: DataFrame, seed: int = 42, trees: int = 100, depth: int = 10
) -> float | None:
    """AUC with which a random forest tells held-out rows of ``two`` from those of ``one``.

    Both frames hold ``lineage`` and ``features``. The held-out fifth is chosen by hash, exactly.
    Trees are at most ``depth`` deep, which bounds what a forest holds; the default of 10 is ours.
    The forest sees rows by their bins only, so rows of equal bins are counted first and are fitted with their number
    as weight: a forest costs as much as there are different rows, not all rows for each of its trees. Every tree draws
    its bootstrap from up to ``PARTS`` parts of equal rows, which are single rows where there are few. Rows of more than
    ``NARROW`` features hardly repeat and are fitted as they are.
    The forest regresses the 0/1 domain: its splits are those of the Gini impurity and its score is
    the mean share of domain 1 in the leaves. The classifier would merge sibling leaves with the same
    majority and so lose the scores when one side is much larger.
    """
    both = _with_domain(one, 0.0, seed).unionByName(_with_domain(two, 1.0, seed))
    both = both.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held_out, fitted_on = split_at_rank(both, _held_out, seed)
        return _forest_auc(fitted_on, held_out, seed, trees, depth)
    finally:
        both.unpersist()


def _held_out(rows: int) -> int:
    return math.ceil(HELD_OUT * rows)


def _forest_auc(fitted_on: DataFrame, held_out: DataFrame, seed: int, trees: int, depth: int) -> float | None:
    """``fitted_on`` and ``held_out`` hold ``(vector, domain, part)``."""
    shared_folder(fitted_on.sparkSession)  # the forest checkpoints its node ids there
    kept = []
    edges = _bin_edges(fitted_on)
    if edges is not None:
        counted = _cells(fitted_on, edges, "part").persist(StorageLevel.MEMORY_AND_DISK)
        partitions = math.ceil(counted.count() / _CELLS) or 1
        # in one order, so that the bootstrap is the same in every run
        keys = ["bins", "domain", "part"]
        ordered = counted.repartition(partitions, *keys).sortWithinPartitions(*keys)
        fitted_on = _bin_vectors(ordered).persist(StorageLevel.MEMORY_AND_DISK)
        held_out = _bin_vectors(_cells(held_out, edges))
        kept = [counted, fitted_on]
    else:
        fitted_on, held_out = (x.withColumn("weight", F.lit(1.0)) for x in (fitted_on, held_out))
    try:
        forest = RandomForestRegressor(
            featuresCol="vector",
            labelCol="domain",
            weightCol="weight",
            predictionCol="score",
            numTrees=trees,
            maxDepth=depth,
            maxBins=BINS,
            featureSubsetStrategy="sqrt",
            seed=seed,
            maxMemoryInMB=1024,
            cacheNodeIds=True,
        ).fit(fitted_on)
        return roc_auc_value(forest.transform(held_out), "score", "domain", "weight")
    finally:
        for rows in kept:
            rows.unpersist()


def _bin_edges(rows: DataFrame) -> list[np.ndarray] | None:
    """The upper ends of each feature's bins but the last; None for rows of more than ``NARROW`` features.

    Between all values where there are few; else at the quantiles, put between counted values as the forest's own splits
    are where these can be counted.
    """
    first = rows.select("vector").first()
    if first is None or first["vector"].size > NARROW:
        return None
    places = range(first["vector"].size)
    values = rows.select(vector_to_array("vector").alias("x"))
    shares = [i / BINS for i in range(1, BINS)]
    found = values.agg(*[
        F.struct(F.percentile_approx(x, shares, 10_000).alias("ends"), F.approx_count_distinct(x).alias("n")).alias(f"f{i}")
        for i, x in ((i, F.get("x", F.lit(i))) for i in places)
    ]).first()
    few = [i for i in places if found[i]["n"] <= _COUNTED]
    numbers = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.get("x", F.lit(i)).alias("value")) for i in few]))
    counts: dict[int, list] = {i: [] for i in few}
    if few:
        for row in values.select(numbers.alias("e")).groupBy("e.pos", "e.value").count().collect():
            counts[row["pos"]].append((row["value"], row["count"]))
    return [_ends(counts[i]) if i in counts else np.unique(np.array(found[i]["ends"], np.float64)) for i in places]


def _ends(counts: list[tuple[float, int]]) -> np.ndarray:
    """Upper ends of at most ``BINS`` bins of about equal weight over counted values."""
    values, weights = np.array(counts, np.float64)[np.argsort([v for v, _ in counts], kind="stable")].T
    if len(values) <= BINS:
        return values[:-1]
    stride = weights.sum() / BINS
    below, target, ends = np.cumsum(weights), stride, []
    for i in range(1, len(values)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            ends.append(values[i - 1])
            target += stride
    return np.array(ends)


def _cells(rows: DataFrame, edges: list[np.ndarray], *by: str) -> DataFrame:
    """``(bins, domain, by, weight)``: how many rows have the same bins."""
    bins = _binned(edges)(vector_to_array("vector")).alias("bins")
    return rows.select(bins, "domain", *by).groupBy("bins", "domain", *by).agg(F.count("*").cast("double").alias("weight"))


def _bin_vectors(cells: DataFrame) -> DataFrame:
    return cells.select(array_to_vector(F.col("bins").cast("array<double>")).alias("vector"), "domain", "weight")


def _binned(edges: list[np.ndarray]):
    @F.arrow_udf("array<tinyint>")
    def bins(values: pa.Array) -> pa.Array:
        numbers = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(edges))
        found = np.empty(numbers.shape, np.int8)
        for i, ends in enumerate(edges):
            found[:, i] = np.searchsorted(ends, numbers[:, i])
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(edges)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.reshape(-1), pa.int8()))

    return bins


def _part(seed: int):
    """The part that a row belongs to among rows of equal bins."""
    return F.pmod(F.xxhash64(F.lit(seed), LINEAGE), F.lit(PARTS)).cast("int").alias("part")


def _with_domain(df: DataFrame, domain: float, seed: int) -> DataFrame:
    return df.select(LINEAGE, vector(df).alias("vector"), F.lit(domain).alias("domain"), _part(seed))


class CovariateShift(IssueDetector):
    def __init__(
        self, threshold: float = AUC_THRESHOLD, seed: int = 42, trees: int = 100, depth: int = 10
    ):
        self.threshold = threshold
        self.seed = seed
        self.trees = trees
        self.depth = depth

    def detect(self, pipeline) -> Issue:
        auc = domain_classifier_auc(
            pipeline.output("X_train"), pipeline.output("X_test"), self.seed, self.trees, self.depth
        )
        return Issue(
            "covariate_shift",
            auc is not None and auc > self.threshold,
            {"test_size": HELD_OUT, "auc": auc, "auc_threshold": self.threshold},
        )

    def message(self, issue: Issue) -> str:
        return (
            "a random forest tells test features from training features: "
            f"AUC {issue.details['auc']} > {issue.details['auc_threshold']}"
        )


class RunRows:
    """The training rows of stored runs as vectors, each run split into rows to fit on and a held-out fifth.

    Every run is read, split and turned into vectors once, and kept in that form for all pairs it takes part in, until
    ``release``.
    """

    def __init__(self, store, run_ids: Sequence[str], seed: int = 42):
        self.rows: dict[str, DataFrame] = {}
        for run_id in run_ids:
            features = store.features(run_id, "train")
            held_out, fitted_on = split_at_rank(features, _held_out, seed)
            rows = fitted_on.withColumn("held_out", F.lit(False)).unionByName(held_out.withColumn("held_out", F.lit(True)))
            kept = rows.select(vector(rows).alias("vector"), "held_out", _part(seed))
            self.rows[run_id] = kept.persist(StorageLevel.MEMORY_AND_DISK)

    def pair(self, a: str, b: str) -> DataFrame:
        """``(vector, held_out, part, domain)``; domain 1 is run b."""
        one, two = (self.rows[r].withColumn("domain", F.lit(d)) for r, d in ((a, 0.0), (b, 1.0)))
        return one.unionByName(two)

    def sizes(self) -> dict[str, tuple[int, int]]:
        """Rows and held-out rows of every run."""
        found = {}
        for run_id, rows in self.rows.items():
            row = rows.agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out")).first()
            found[run_id] = (row["n"], row["held_out"])
        return found

    def release(self) -> None:
        for rows in self.rows.values():
            rows.unpersist()


def covariate_shift_between_runs(
    store,
    run_ids: Sequence[str],
    threshold: float = AUC_THRESHOLD,
    seed: int = 42,
    trees: int = 100,
    depth: int = 10,
    at_once: int = 4,
) -> list[tuple[str, str, float | None, bool]]:
    """(run a, run b, AUC, shifted) for each pair of stored runs, from their training features.

    ``at_once`` pairs are worked on side by side, so that the small jobs of one forest fill the gaps of another.
    """
    runs = RunRows(store, run_ids, seed)

    def auc_of(pair: tuple[str, str]) -> float | None:
        rows = runs.pair(*pair)
        return _forest_auc(rows.filter("NOT held_out"), rows.filter("held_out"), seed, trees, depth)

    pairs = list(combinations(run_ids, 2))
    try:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            found = list(pool.map(inheritable_thread_target(store.spark)(auc_of), pairs))
    finally:
        runs.release()
    return [(a, b, auc, auc is not None and auc > threshold) for (a, b), auc in zip(pairs, found)]
