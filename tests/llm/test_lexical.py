"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import lexical

DOCS = "doc_id long, text string, item_id string, rank string, score string, term string"
ITEMS = "item_id long, text string, doc_id string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS).repartition(parts)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], ITEMS)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    lists = [(i, Counter(terms(t))) for i, t in docs]
    lists = [(i, c) for i, c in lists if c]
    n, total = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, names in wanted.items():
        scores = []
        for i, c in lists:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in names if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeé日0", k=rng.randint(1, 5))) for _ in range(120)]
    weights = [1 / (k + 1) for k in range(120)]  # a few words are in nearly all documents

    def text(k):
        return rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=k))

    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (500, None), (501, ""), (502, " .,!\x00\x7f"), (503, text(5000)),
             (504, "ÀB c_d"), (0, docs[3][1])]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    items += [(31, docs[7][1]), (32, None), (33, ""), (34, "zzzz"), (35, "ÀB àb C"), (31, "zzzz a b c"), (None, "a b e")]
    return docs, items


@pytest.mark.parametrize("parts,block,window,short,group", [(3, 1 << 24, 4096, 1 / 16, 200_000), (2, 3000, 16, 0.3, 40), (1, 700, 5, 0.0, 7)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, parts, block, window, short, group):
    docs, items = corpus
    # functions of this module are sent to the workers by value of what they refer to
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    for top in (10, 1):
        got = lexical.ranked_search(docs_of(spark, docs, parts), items_of(spark, items), top=top, group=group)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, top)


@pytest.mark.parametrize("window,short,blocks", [(4096, 1 / 16, 1), (16, 0.3, 4), (7, 0.0, 9), (64, 1.0, 2)])
def test_blocks_equal_brute_force(corpus, monkeypatch, window, short, blocks):
    """The search inside a task, with other windows and other divisions into short and long lists."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "SHORT", short)
    docs, items = corpus
    lists = [set(terms(t)) for _, t in docs]
    n, total = sum(bool(s) for s in lists), sum(len(terms(t)) for _, t in docs)
    df = Counter(t for s in lists for t in s)
    vocabulary = {t.encode(): k for k, t in enumerate(df)}
    import numpy as np

    weights = np.array([lexical.weight(n, c) for c in df.values()])
    whole = [(i, t) for i, t in docs if t]
    for item, text in items[:32]:
        if not terms(text):
            continue
        wanted = lexical.Item(item, np.array(sorted({vocabulary[t.encode()] for t in terms(text) if t in df})))
        best = lexical.Best(10)
        for k in range(blocks):
            part = whole[k::blocks]
            block = lexical.Block([i for i, _ in part], [t for _, t in part], vocabulary, weights, (n, total))
            lexical.search_block(block, wanted, best)
        expected = [(s, d) for _, _, d, s in sorted(brute(docs, [(item, text)], 10), key=lambda r: r[1])]
        assert [(-s, None if none else d) for s, none, d in best.rows] == expected


def test_defined_cases(spark):
    docs, items = docs_of(spark, [(1, "a b")]), items_of(spark, [(1, "a")])
    assert lexical.ranked_search(docs, items_of(spark, [])).count() == 0
    assert lexical.ranked_search(docs_of(spark, []), items).count() == 0
    assert lexical.ranked_search(docs_of(spark, [(1, None)]), items).count() == 0
    assert lexical.ranked_search(docs_of(spark, []), items).columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r["doc_id"], r["rank"]) for r in lexical.ranked_search(docs, items).collect()] == [(1, 1)]
