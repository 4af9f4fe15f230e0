"""The example pipelines over generated files, with and without planted errors."""

from __future__ import annotations

import gzip
import random

import pytest

from examples.images import images_pipeline
from examples.income import income_pipeline
from examples.reviews import reviews_pipeline
from plumbline.issues import CovariateShift, covariate_shift_between_runs
from plumbline.plans import RunStore, screen
from plumbline.refinements import DataValuation, FairnessMetrics, InputUsage

WORDS = "good bad game fun dull great play story level boss map sound hero".split()


def write(path, header, rows):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as out:
        for row in ([header] if header else []) + rows:
            out.write(",".join("" if v is None else str(v) for v in row) + "\n")


@pytest.fixture(scope="module")
def review_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("reviews")
    rng = random.Random(11)
    reviews, ratings = [], []
    for i in range(1200):
        day = "2015-07-31" if i % 50 == 6 else f"2015-{1 + i % 12:02d}-{1 + i % 28:02d}"
        words = [" ".join(rng.choices(WORDS, k=n)) if rng.random() > 0.1 else None for n in (3, 9)]
        reviews.append(
            (i, f"r{i}", f"p{rng.randrange(40)}", "Y" if i % 9 else "N", "US" if i % 11 else "DE", day,
             "Y" if i % 5 == 0 else "N", *words)
        )
        ratings.append((i, f"r{i}", rng.randint(1, 5), rng.choice([0, 0, 0, 2])))
    write(
        folder / "reviews.csv.gz",
        ("", "review_id", "product_id", "verified_purchase", "marketplace", "review_date", "vine",
         "review_headline", "review_body"),
        reviews,
    )
    write(folder / "ratings.csv", ("", "review_id", "star_rating", "helpful_votes"), ratings)
    products = [(i, f"p{i}", i % 2, f"title {WORDS[i % 13]}" if i % 7 else None) for i in range(40)]
    write(folder / "products.csv", ("", "product_id", "category_id", "product_title"), products)
    write(folder / "categories.csv", ("", "id", "category"), [(0, 0, "Digital_Video_Games"), (1, 1, "Toys")])
    return str(folder)


def test_clean_reviews(spark, review_files):
    pipeline = reviews_pipeline(spark, review_files)
    assert pipeline.fact_source("train").name == "reviews"
    assert [s.name for s in pipeline.sources("test")] == ["reviews", "products", "categories", "ratings"]
    # one number, two values of vine, one of each filtered category, 100 hash buckets
    assert pipeline.output("X_train").first()["features"]["size"] == 1 + 2 + 1 + 1 + 100
    report = screen(pipeline, ["label_shift", "traintest_overlap", CovariateShift(trees=20, depth=5)])
    assert report.passes
    used = {s.name: s.data.filter("is_used").count() for s in InputUsage().compute(pipeline)}
    assert used["categories"] == 1 and used["products"] == 20
    assert used["reviews"] == used["ratings"] == pipeline.output("X_train").count()
    pipeline.release()


@pytest.mark.parametrize("planted", ["covariate_shift", "label_shift", "traintest_overlap"])
def test_planted_errors_are_found(spark, review_files, planted):
    pipeline = reviews_pipeline(spark, review_files, planted=planted)
    detector = CovariateShift(trees=20, depth=5) if planted == "covariate_shift" else planted
    assert not screen(pipeline, [detector]).passes
    pipeline.release()


def test_network_variant(spark, review_files):
    pipeline = reviews_pipeline(spark, review_files, network=True)
    assert pipeline.output("y_pred").count() == pipeline.output("X_test").count() > 0
    pipeline.release()


def test_runs_with_different_start_dates(spark, review_files, tmp_path):
    store = RunStore(spark, str(tmp_path))
    ids = []
    for start in ("2015-01-01", "2015-03-01"):
        run = store.start("reviews", {"start_date": start})
        pipeline = reviews_pipeline(spark, review_files, start_date=start)
        run.save(pipeline)
        pipeline.release()
        ids.append(run.run_id)
    ((a, b, auc, shifted),) = covariate_shift_between_runs(store, ids, trees=20, depth=5)
    assert [a, b] == ids and 0 <= auc <= 1 and shifted == (auc > 0.7)


@pytest.fixture(scope="module")
def income_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("income")
    rng = random.Random(5)

    def person(dot):
        work = rng.choice(["Private", "Federal-gov", "Self-emp", "?"])
        return ", ".join(
            map(str, [rng.randint(17, 80), work, 1000, rng.choice(["HS", "BA"]), 9, "Single",
                      rng.choice(["Sales", "Tech", "?"]), "Own-child", rng.choice(["White", "Black"]),
                      rng.choice(["Male", "Female"]), rng.choice([0, 0, 5000]), 0, rng.randint(10, 60),
                      "US", rng.choice(["<=50K", ">50K"]) + dot])
        )

    twice = person("")
    (folder / "train").write_text("\n".join([twice, twice] + [person("") for _ in range(400)]) + "\n")
    (folder / "test").write_text("|1x3 Cross validator\n" + "\n".join(person(".") for _ in range(200)) + "\n")
    return str(folder / "train"), str(folder / "test")


def test_income(spark, income_files):
    pipeline = income_pipeline(spark, *income_files)
    train, test = pipeline.fact_source("train"), pipeline.fact_source("test")
    assert (train.source_id, train.data.count(), test.source_id, test.data.count()) == (0, 402, 1, 200)
    used = InputUsage().compute(pipeline)[0].data
    # Unknown employment stays, excluded employment does not; equal rows count one by one.
    assert used.filter("workclass is null and is_used").count() == used.filter("workclass is null").count() > 0
    assert used.filter("workclass = 'Federal-gov' and is_used").count() == 0
    assert pipeline.output("X_train").count() == used.filter("is_used").count()
    labels = {r["label"] for r in pipeline.output("y_test").distinct().collect()}
    assert labels == {0.0, 1.0}
    for attribute, group in (("sex", "Male"), ("race", "White")):
        rows = FairnessMetrics(attribute, group).confusion(pipeline).collect()
        assert sum(sum(tuple(r)[1:5]) for r in rows) == pipeline.output("y_pred").count()
    assert "constant_features" in {i.id for i in screen(pipeline, ["constant_features"]).issues}
    pipeline.release()


def test_images(spark, tmp_path):
    rng = random.Random(3)
    rows = [(":".join(str(rng.randrange(256)) for _ in range(16)), i % 4) for i in range(300)]
    write(tmp_path / "product_images.csv", ("image", "category_id"), rows)
    kinds = ["T-shirt", "Sneaker", "Bag", "Ankle boot"]
    write(tmp_path / "product_categories.csv", ("category_id", "category_name"), list(enumerate(kinds)))
    pipeline = images_pipeline(spark, str(tmp_path))
    assert pipeline.output("X_train").count() == 120 and pipeline.output("X_test").count() == 30
    assert pipeline.fact_source("train").name == "images"
    valued = DataValuation(10, 100).compute(pipeline).data
    assert valued.count() == 300 and valued.filter("shapley_value <> 0").count() > 100
    pipeline.release()
