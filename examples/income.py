"""Does a person earn more than 50,000? Train and test come from two files of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.features import FeatureBlock, FeaturePlan, ImputeMean, ImputeMode, OneHot, SafeLog, StandardScale
from plumbline.functions import binarize
from plumbline.operators import Tracked, track
from plumbline.plans import ClassificationPipeline, build_classification, fit_linear
from plumbline.sources import landed_ids, read_delimited

# The columns of the census files in their order.
SCHEMA = (
    "age double, workclass string, fnlwgt double, education string, `education-num` double, "
    "`marital-status` string, occupation string, relationship string, race string, sex string, "
    "`capital-gain` double, `capital-loss` double, `hours-per-week` double, `native-country` string, "
    "`income-per-year` string"
)
CATEGORIES = ["workclass", "education", "occupation"]
NUMBERS = ["age", "capital-gain", "capital-loss", "hours-per-week"]


def load(spark: SparkSession, path: str, source_id: int, name: str, skip_first_line: bool) -> Tracked:
    rows = read_delimited(spark, path, SCHEMA, ", ", "?", skip_first_line)
    return track(landed_ids(rows), source_id, name)


def income_pipeline(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    excluded: Sequence[str] = ("Federal-gov", "State-gov"),
) -> ClassificationPipeline:
    train = load(spark, train_path, 0, "train", False).exclude("workclass", excluded)
    test = load(spark, test_path, 1, "test", True).exclude("workclass", excluded)
    plan = FeaturePlan(
        [
            FeatureBlock(CATEGORIES, [ImputeMode(), OneHot()]),
            FeatureBlock(NUMBERS, [ImputeMean(), SafeLog(), StandardScale()]),
        ]
    )
    income = F.col("`income-per-year`")
    # The test file spells the classes with a dot.
    labels = binarize(income, ["<=50K", ">50K"]), binarize(income, ["<=50K.", ">50K."])
    return build_classification(train, test, plan, labels, fit=lambda rows: fit_linear(rows, "l2"))
