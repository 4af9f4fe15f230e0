"""Classifiers of pyspark.ml over ``features``, dense or sparse, and ``label double``."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import DataFrame

from ..features.vectors import vector
from .network import fit_perceptron

_VECTOR = "__vector"


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn(_VECTOR, vector(df))


def fit_linear(
    train: DataFrame,
    penalty: str = "l1",
    strength: float = 1e-4,
    max_iter: int = 1000,
    tolerance: float = 1e-4,
) -> Model:
    """Logistic regression with an L1 or L2 penalty."""
    if penalty not in ("l1", "l2"):
        raise ValueError("penalty must be 'l1' or 'l2'")
    learner = LogisticRegression(
        featuresCol=_VECTOR,
        labelCol="label",
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        regParam=strength,
        maxIter=max_iter,
        tol=tolerance,
        standardization=False,
    )
    return learner.fit(with_vector(train))


def fit_network(
    train: DataFrame, hidden: tuple[int, ...] = (256, 64), max_iter: int = 30, seed: int = 42
) -> Model:
    """A dense network with two outputs."""
    learner = MultilayerPerceptronClassifier(
        featuresCol=_VECTOR, labelCol="label", maxIter=max_iter, seed=seed
    )
    return fit_perceptron(learner, hidden, 2, train, with_vector(train))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """The frame with a ``prediction double`` column."""
    scored = model.transform(with_vector(df.drop("prediction")))
    return scored.select(*[c for c in df.columns if c != "prediction"], "prediction")
