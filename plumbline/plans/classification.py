"""The classification template: tracked train and test rows, their features, labels and predictions.

Features, label, prediction and lineage of a row stay together in one frame
``(split, lineage, features, label, prediction)``, so nothing is ever aligned by position. What needs no features reads
the same rows without them, and then nothing is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..features import FeaturePlan, is_sparse
from ..features.vectors import stored, stored_entries, width
from ..operators.lineage import LINEAGE
from ..operators.tracked import JoinRecord, Tracked
from .fact_table import fact_table_id
from .models import predict

ENTITIES = "Entities"
SIDE_DATA = "SideData"
SPLITS = ("train", "test")
OUTPUTS = {
    "X_train": ("train", "features"),
    "y_train": ("train", "label"),
    "X_test": ("test", "features"),
    "y_test": ("test", "label"),
    "y_pred": ("test", "prediction"),
}


@dataclass(frozen=True)
class Source:
    """One input table of a split; ``rows`` carries the lineage column, ``data`` does not."""

    source_id: int
    role: str
    name: str
    rows: DataFrame

    @property
    def data(self) -> DataFrame:
        return self.rows.drop(LINEAGE)


class ClassificationPipeline:
    """What detectors and refinements work on. ``source_rows`` is ``{split: {source_id: rows}}``.

    ``outputs`` may be a function; it is called, and the features are fitted, when they are first asked for. ``rows`` are
    the outputs without features, and without predictions where a model makes them.
    """

    def __init__(
        self,
        outputs: DataFrame | Callable[[ClassificationPipeline], DataFrame],
        source_rows: dict[str, dict[int, DataFrame]],
        source_names: dict[int, str],
        joins: frozenset[JoinRecord] = frozenset(),
        rows: DataFrame | None = None,
        cached: Sequence[DataFrame] = (),
        known_facts: Mapping[str, int] | None = None,
        preprocessing: Sequence[tuple[str, dict[str, str]]] = (),
    ):
        self._outputs = outputs
        self.source_rows = source_rows
        self.source_names = source_names
        self.joins = joins
        self._rows = rows
        self.cached = list(cached)
        self.known_facts = dict(known_facts or {})
        self.preprocessing = list(preprocessing)
        self._model: Model | None = None

    @cached_property
    def outputs(self) -> DataFrame:
        return self._outputs(self) if callable(self._outputs) else self._outputs

    @property
    def rows(self) -> DataFrame:
        return self.outputs if self._rows is None else self._rows

    @property
    def predicted(self) -> DataFrame:
        """Rows with their predictions: those without features unless a model has to make them."""
        return self.rows if "prediction" in self.rows.columns else self.outputs

    @property
    def model(self) -> Model | None:
        """The fitted model, if the predictions come from one."""
        _ = self.outputs
        return self._model

    @staticmethod
    def _of_split(df: DataFrame, split: str) -> DataFrame:
        if split not in SPLITS:
            raise ValueError(f"no split {split!r}")
        return df.filter(F.col("split") == split).drop("split")

    def split(self, split: str) -> DataFrame:
        return self._of_split(self.outputs, split)

    def split_rows(self, split: str) -> DataFrame:
        """The rows of a split without features."""
        return self._of_split(self.rows, split)

    def output(self, name: str) -> DataFrame:
        """One of X_train, y_train, X_test, y_test, y_pred with its lineage."""
        if name not in OUTPUTS:
            raise ValueError(f"no output {name!r}")
        split, column = OUTPUTS[name]
        df = self.rows if column in self.rows.columns else self.outputs
        if column not in df.columns:
            raise ValueError(f"the pipeline has no output {name!r}")
        return self._of_split(df, split).select(LINEAGE, column)

    def fact_id(self, split: str) -> int:
        if split not in self.known_facts:
            self.known_facts[split] = fact_table_id(
                self.split_rows(split), self.source_rows[split], self.joins
            )
        return self.known_facts[split]

    def sources(self, split: str) -> list[Source]:
        """The inputs that lead to a split; one of them is the entity table."""
        fact = self.fact_id(split)
        return [
            Source(i, ENTITIES if i == fact else SIDE_DATA, self.source_names[i], rows)
            for i, rows in sorted(self.source_rows[split].items())
        ]

    def fact_source(self, split: str) -> Source:
        return next(s for s in self.sources(split) if s.role == ENTITIES)

    @cached_property
    def feature_stats(self) -> list:
        """Per training feature: count, zeros, ones, min, max, mean, population variance. One pass."""
        return feature_statistics(self.split("train")).orderBy("pos").collect()

    @cached_property
    def label_counts(self) -> dict[str, dict[float, int]]:
        counts: dict[str, dict[float, int]] = {s: {} for s in SPLITS}
        for row in self.rows.groupBy("split", "label").count().collect():
            counts[row["split"]][row["label"]] = row["count"]
        return counts

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached.clear()


def feature_statistics(df: DataFrame) -> DataFrame:
    """One row per feature position: pos, n, n_zero, n_one, low, high, mean, variance.

    Partial sums per task keep the shuffle at d rows per task. Of sparse features only what is stored is gone through,
    and one more entry per row, which counts the rows; the zeros follow from that.
    """
    if is_sparse(df):
        return _sparse_statistics(df)
    entries = stored_entries(df).select("pos", F.col("value").alias("x"))
    return entries.groupBy("pos").agg(F.count("*").alias("n"), F.count_if(F.col("x") == 0).alias("n_zero"), *_moments())


def _moments() -> list[Column]:
    return [
        F.count_if(F.col("x") == 1).alias("n_one"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("variance"),
    ]


def sparse_entries(df: DataFrame) -> DataFrame:
    """``(pos, x)`` of what sparse features store, and for every row one entry at -1 that holds the features' width."""
    row = F.struct(F.lit(-1).alias("pos"), width(df).cast("double").alias("value"))
    return df.select(F.inline_outer(F.concat(F.array(row), stored(df)))).select("pos", F.col("value").alias("x"))


def _sparse_statistics(df: DataFrame) -> DataFrame:
    sums = sparse_entries(df).groupBy("pos").agg(F.count("*").alias("stored"), *_moments())
    every = sums.filter("pos = -1 AND high > 0").select(
        F.explode(F.sequence(F.lit(0), F.col("high").cast("int") - 1)).alias("pos"), F.col("stored").alias("n")
    )
    both = every.join(sums.filter("pos >= 0"), "pos", "left")
    n, stored = F.col("n"), F.coalesce("stored", F.lit(0))
    zeros = n - stored
    zero = F.when(zeros > 0, F.lit(0.0))
    mean, variance = F.coalesce("mean", F.lit(0.0)), F.coalesce("variance", F.lit(0.0))
    return both.select(
        "pos",
        "n",
        zeros.alias("n_zero"),
        F.coalesce("n_one", F.lit(0)).alias("n_one"),
        F.coalesce(F.least("low", zero), "low", zero).alias("low"),
        F.coalesce(F.greatest("high", zero), "high", zero).alias("high"),
        (mean * stored / n).alias("mean"),
        # the zeros lie at a distance of the stored ones' mean
        ((variance + mean * mean * zeros / n) * stored / n).alias("variance"),
    )


def build_classification(
    train: Tracked,
    test: Tracked,
    features: FeaturePlan,
    label: Column | tuple[Column, Column],
    fit: Callable[[DataFrame], Model] | None = None,
    prediction: Column | None = None,
    carry: Sequence[str] = (),
    cache: bool = True,
) -> ClassificationPipeline:
    """Features fitted on train and applied to both splits, labels and predictions; fitted when they are asked for.

    ``label`` is one expression, or one per split. Predictions come from ``fit``, which gets the
    encoded training rows and returns a pyspark.ml model, or from the plain expression ``prediction``.
    ``carry`` names further columns to keep. With ``cache`` the rows needed are kept (in memory and on
    local disk, recomputed when an executor is lost) until ``release``: they are far narrower than the
    features, which are derived from them on the fly.
    """
    labels = label if isinstance(label, tuple) else (label, label)
    wanted = [F.col(f"`{c}`") for c in dict.fromkeys([*features.columns, *carry])]
    if prediction is not None:
        wanted.append(prediction.cast("double").alias("prediction"))
    rows = _both_splits(train, test, labels, wanted, once=cache)
    cached = []
    if cache:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(rows)

    def encoded(pipeline: ClassificationPipeline) -> DataFrame:
        fitted = features.fit(rows.filter(F.col("split") == "train"))
        predicted = [] if prediction is None else ["prediction"]
        outputs = fitted.transform(rows).select("split", LINEAGE, "features", "label", *predicted, *carry)
        if fit is None:
            return outputs
        pipeline._model = fit(outputs.filter(F.col("split") == "train"))
        return predict(pipeline._model, outputs)

    kept = ["split", LINEAGE, "label", *([] if prediction is None else ["prediction"]), *carry]
    return ClassificationPipeline(
        encoded,
        {"train": dict(train.sources), "test": dict(test.sources)},
        {**train.names, **test.names},
        train.joins | test.joins,
        rows.select(*dict.fromkeys(kept)),
        cached,
        preprocessing=features.described(),
    )


def _both_splits(
    train: Tracked,
    test: Tracked,
    labels: tuple[Column, Column],
    columns: Sequence[Column],
    once: bool,
) -> DataFrame:
    """``(split, lineage, columns, label)`` of both splits.

    With ``once``, splits that are filters of one frame are cut out of a single pass over it; a row
    that satisfies both filters comes out twice. Otherwise they are put together by a union, through
    which a later choice of one split still reaches the scan.
    """

    def needed(df: DataFrame, split: Column, label: Column) -> DataFrame:
        chosen = [split.alias("split"), F.col(LINEAGE), *columns, label.cast("double").alias("label")]
        return df.select(*chosen)

    one, other = train.branch, test.branch
    if not once or one is None or other is None or one.parent is not other.parent:
        first = needed(train.df, F.lit("train"), labels[0])
        return first.unionByName(needed(test.df, F.lit("test"), labels[1]))
    in_split = F.array_compact(
        F.array(
            F.when(one.condition, F.lit("train")), F.when(other.condition, F.lit("test"))
        )
    )
    rows = one.parent.filter(one.condition | other.condition)
    rows = rows.select("*", F.explode_outer(in_split).alias("__split"))
    split = F.col("__split")
    label = labels[0] if labels[0] is labels[1] else F.when(split == "train", labels[0]).otherwise(labels[1])
    return needed(rows, split, label)


def accuracy(outputs: DataFrame) -> DataFrame:
    """Share of test rows whose prediction equals the label, as one row ``accuracy``."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return outputs.filter(F.col("split") == "test").agg(F.avg(hit).alias("accuracy"))
