"""Which of two kinds of product does an image show? Images are numbers joined by colons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.features import ArrayFeature, FeatureBlock, FeaturePlan
from plumbline.functions import binarize, parse_int_array
from plumbline.operators import random_split, track
from plumbline.plans import ClassificationPipeline, build_classification, fit_linear
from plumbline.sources import landed_ids, read_plain_csv


def images_pipeline(
    spark: SparkSession,
    folder: str,
    kinds: Sequence[str] = ("Sneaker", "Ankle boot"),
    seed: int = 1337,
) -> ClassificationPipeline:
    raw = read_plain_csv(spark, f"{folder}/product_images.csv", "image string, category_id int")
    images = track(landed_ids(raw.withColumn("image", parse_int_array(F.col("image")))), 0, "images")
    categories = track(
        read_plain_csv(
            spark, f"{folder}/product_categories.csv", "category_id int, category_name string"
        ),
        1,
        "categories",
        key="category_id",
    )
    shown = images.join(categories, on="category_id").filter_in("category_name", kinds)
    train, test = random_split(shown, 0.2, seed)
    plan = FeaturePlan([FeatureBlock(["image"], [ArrayFeature(divisor=255.0)])])
    return build_classification(train, test, plan, binarize(F.col("category_name"), kinds), fit_linear)
