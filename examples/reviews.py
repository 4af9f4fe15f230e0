"""Is a product review helpful? A star of four CSV files, with errors that can be planted on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.features import (
    FeatureBlock,
    FeaturePlan,
    HashNgrams,
    ImputeMean,
    ImputeMode,
    OneHot,
    SafeLog,
    StandardScale,
)
from plumbline.functions import binarize, positive_flag
from plumbline.operators import Tracked, balance_classes, temporal_split, track
from plumbline.plans import ClassificationPipeline, build_classification, fit_linear, fit_network
from plumbline.sources import read_indexed_csv

# In the order of reading; the file names are part of the data.
FILES = ("reviews.csv.gz", "products.csv", "categories.csv", "ratings.csv")
PLANTED = (None, "covariate_shift", "label_shift", "traintest_overlap")


def load(spark: SparkSession, folder: str) -> dict[str, Tracked]:
    sources = {}
    for source_id, file in enumerate(FILES):
        name = file.split(".")[0]
        rows = read_indexed_csv(spark, f"{folder}/{file}", index_as_row_id=True)
        sources[name] = track(rows, source_id, name)
    return sources


def joined_reviews(
    sources: dict[str, Tracked],
    categories: Sequence[str],
    start_date: str,
    marketplace: str | None,
    verified_only: bool,
) -> Tracked:
    reviews = sources["reviews"].filter_between("review_date", low=start_date)
    if verified_only:
        reviews = reviews.filter_equal("verified_purchase", "Y")
    if marketplace is not None:
        reviews = reviews.filter_equal("marketplace", marketplace)
    wanted = sources["categories"].filter_in("category", categories)
    products = sources["products"].join(wanted, left_on="category_id", right_on="id")
    return reviews.join(sources["ratings"], on="review_id").join(products, on="product_id")


def linear_features() -> FeaturePlan:
    return FeaturePlan(
        [
            FeatureBlock(["star_rating"], [StandardScale()]),
            FeatureBlock(["vine", "verified_purchase", "category_id"], [OneHot()]),
            FeatureBlock(["all_text"], [HashNgrams()]),
        ]
    )


def network_features() -> FeaturePlan:
    return FeaturePlan(
        [
            FeatureBlock(["star_rating"], [ImputeMean(), SafeLog(), StandardScale()]),
            FeatureBlock(["vine", "verified_purchase", "category_id"], [ImputeMode(), OneHot()]),
            FeatureBlock(["all_text"], [HashNgrams()]),
        ]
    )


def reviews_pipeline(
    spark: SparkSession,
    folder: str,
    categories: Sequence[str] = ("Digital_Video_Games",),
    split_date: str = "2015-07-31",
    start_date: str = "2015-01-01",
    planted: str | None = None,
    network: bool = False,
) -> ClassificationPipeline:
    """``network`` trains the neural classifier on title and body only, over all marketplaces."""
    if planted not in PLANTED:
        raise ValueError(f"cannot plant {planted!r}")
    texts = ["product_title", "review_headline", "review_body"]
    if network:
        texts.remove("review_headline")
    full = joined_reviews(
        load(spark, folder), categories, start_date, None if network else "US", verified_only=True
    )
    full = full.fill_null(texts, "").concat_text("all_text", texts)
    full = full.with_column("is_helpful", positive_flag(F.col("helpful_votes")))

    train, test = temporal_split(
        full, "review_date", split_date, overlap=planted == "traintest_overlap"
    )
    if planted == "covariate_shift":
        test = test.scale_column("star_rating", 10.0)
    elif planted == "label_shift":
        test = balance_classes(test, F.col("is_helpful"))
    return build_classification(
        train,
        test,
        network_features() if network else linear_features(),
        binarize(F.col("is_helpful"), [True, False]),
        fit=fit_network if network else fit_linear,
    )
