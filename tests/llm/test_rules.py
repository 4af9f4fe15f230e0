"""The rule ensemble: its parts by hand, its column expression against numpy, and its scores on held-out labels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from plumbline.llm import rules
from tests.llm.test_operators import DOCS, docs_of, empty

FAST = rules.Settings(trees=12, steps=80)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)

    def word():
        return "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8)))

    def text(kind):
        words = [word() for _ in range(rng.randint(20, 150))]
        if kind == 1:
            return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        return rng.choice([
            lambda: " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words),
            lambda: " ".join(w.upper() + "!!" for w in words),
            lambda: " ".join([words[0]] * len(words)),
            lambda: " | ".join(words)])()

    labels = {i: int(rng.random() > 0.2) for i in range(500)}
    rows = [(i, text(q), "en", "s") for i, q in labels.items()]
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, " \n\t", "en", "s"), (None, text(1), "en", "s"),
             (903, text(1) * 200, "en", "s"), rows[0], rows[0]]
    return rows, labels


def labels_of(spark, pairs):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in pairs], "doc_id long, quality int, toxic int, text string")


def test_statistics_by_hand():
    s = dict(zip(rules.STATISTICS, rules.text_statistics("Ab ab ab | !! ÉA\nAb ab ab | 12 www.x.y a@b\n\n")))
    assert s["words"] == 13 and s["lines"] == 2 and s["distinct_lines"] == 1 and s["line_words"] == 6.5
    assert s["distinct_words"] == 8 / 13 and s["equal_neighbours"] == 2 / 13 and s["odd_words"] == 3 / 13
    dark = len("Ababab|!!ÉAAbabab|12www.x.ya@b".encode())
    assert s["word_length"] == dark / 13 and s["symbols"] == 3 / dark and s["digits"] == 2 / dark
    assert s["capitals"] == 3 / dark and s["beyond_ascii"] == 2 / dark and s["addresses"] == 2 / 13 and s["stops"] == 2 / dark
    assert s["capital_words"] == 0
    assert set(rules.text_statistics(None)) == set(rules.text_statistics(" \n")) == {0.0}


def test_tree_paths_and_lasso_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    fitted = rules.fit_ensemble(x, y, rules.Settings(trees=10, steps=120))
    used = {c.statistic for rule in fitted.rules for c in rule}
    assert {1, 3} <= used
    margin = rules.holds(fitted.rules, x) @ np.array(fitted.weights) + fitted.bias
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    assert len(fitted.rules) < len(rules.path_rules(x, y, rules.Settings(trees=10)))  # the lasso drops some
    assert rules.tightened((rules.Condition(2, 1.0, True), rules.Condition(0, 5.0, False), rules.Condition(2, 3.0, True))) == (
        rules.Condition(0, 5.0, False), rules.Condition(2, 3.0, True))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 12)).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(a[:, 0] * 2 - a[:, 5])))).astype(float)
    (w, bias), = rules.lasso(a, y, [0.03], 3000)
    slope = (1 / (1 + np.exp(-(a @ w + bias))) - y) @ a / 400
    assert abs((1 / (1 + np.exp(-(a @ w + bias))) - y).mean()) < 1e-4
    assert (np.abs(slope) <= 0.03 + 1e-4).all() and np.flatnonzero(w).tolist()[:1] == [0]
    for k in np.flatnonzero(w):
        assert slope[k] == pytest.approx(-0.03 * np.sign(w[k]), abs=1e-4)


def test_scores_on_held_out_labels(spark, corpus):
    rows, labels = corpus
    docs = docs_of(spark, rows)
    fitted = rules.fit_rules(docs, labels_of(spark, labels.items()), settings=FAST)
    got = rules.score(docs, fitted)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows)
    import zlib

    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:  # the expression against numpy
            x = np.array([rules.text_statistics(texts[r["doc_id"]])])
            margin = float(rules.holds(fitted.rules, x)[0] @ np.array(fitted.weights) + fitted.bias)
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 60
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97


def test_held_out_labels_are_not_read(spark, corpus):
    rows, labels = corpus
    import zlib

    docs = docs_of(spark, rows)
    turned = {i: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q for i, q in labels.items()}
    one = rules.fit_rules(docs, labels_of(spark, labels.items()), settings=FAST)
    two = rules.fit_rules(docs, labels_of(spark, turned.items()), settings=FAST)
    assert one == two


def test_defined_cases(spark, corpus):
    rows, labels = corpus
    docs = docs_of(spark, rows)
    none = rules.fit_rules(docs, labels_of(spark, []))
    assert {r["score"] for r in rules.score(docs, none).collect()} == {0.5}
    odd = [(None, 1), (1, None), (99999, 1), (2, 1), (2, 1), (3, 1)]
    only = rules.fit_rules(docs, labels_of(spark, odd), settings=FAST)
    assert min(r["score"] for r in rules.score(docs, only).collect()) > 0.5
    assert rules.score(empty(spark), only).count() == 0
    assert rules.fit_rules(empty(spark), labels_of(spark, labels.items())).rules == []
    assert "kept" in DOCS  # extra columns of clashing names went along above
