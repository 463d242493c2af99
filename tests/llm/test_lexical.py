"""Block-Max WAND against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from catalink.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _slow(docs, items, most=20):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        asked = Counter(_terms(text))
        weights = {w: r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w, r in asked.items() if w in df}
        scores = []
        for i, c, n in counts:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(x * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, x in weights.items() if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=lambda x: (x[0], x[1]))


def _corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(60)), "Äpfel", "x1", "ÉTÉ"]
    text = lambda k: " ".join(rng.choices(words, [40, 30, *(60 / (i + 1) for i in range(60)), 1, 1, 1], k=k))
    return [(i, text(rng.choice([1, 5, 30, 30, 200]))) for i in rng.sample(range(10 * n), n)], text


def _found(spark, docs, items, most=20, **how):
    indexed, n = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **{k: v for k, v in how.items() if k in ("shard_postings", "block")})
    rows = lexical.search(indexed, n, spark.createDataFrame(items, "item_id long, text string"), most, **{k: v for k, v in how.items() if k != "shard_postings"}).collect()
    return sorted(map(tuple, rows), key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("how", [{}, {"shard_postings": 300, "block": 4, "items_together": 5}, {"shard_postings": 5000, "block": 1}])
def test_equals_scoring_all(spark, how):
    docs, text = _corpus(400)
    docs += [(7777777, docs[0][1]), (7777778, docs[0][1]), (None, docs[0][1]), (1, None), (2, " .-_ "), (3, "The-THE_the w1.w1"), (4, "naïve ÄPFEL äpfel été"), (5, "w2 " * 30000)]
    items = [(i, text(k)) for i, k in enumerate([1, 2, 3, 8, 30, 60] * 4)] + [(90, docs[0][1]), (91, ""), (92, None), (93, "unknownword"), (94, "the the the of"), (95, "Äpfel ÉTÉ x1")]
    assert _found(spark, docs, items, **how) == _slow(docs, items)


def test_blocks_below_the_threshold_stay_closed():
    rng = np.random.default_rng(5)
    lists = []
    for n, among in ((9000, 20000), (8000, 20000), (500, 2000), (40, 2000)):
        docs = np.sort(rng.choice(among, n, replace=False))
        tf = np.where(rng.random(n) < 0.01, 50, 1)
        lists.append(lexical.List(dict(zip(("n", "width", "last", "top", "docs", "low", "high"), lexical.posting_row(docs, lexical.impacts(tf, np.full(n, 100), 20000, 2000000), 64), strict=True)), 64))
    weights, told = [100, 120, 3600, 6000], Counter()
    got = lexical.best(lists, weights, 20, told)
    scores = np.zeros(20000, dtype=np.int64)
    for x, w in zip(lists, weights, strict=True):
        all_blocks = np.arange(len(x.last))
        d = x.docs(all_blocks).ravel()[: x.n]
        scores[d] += w * x.impacts(*np.divmod(np.arange(x.n), min(x.n, 64)))
    order = np.lexsort((np.arange(20000), -scores))[:20]
    assert got[0].tolist() == order.tolist() and got[1].tolist() == scores[order].tolist()
    assert told["impacts"] <= told["numbers"] < told["blocks"] / 2


def test_ties_go_by_id(spark):
    docs = [(i, "same words") for i in range(100, 0, -1)] + [(None, "same words"), (1000, "other")]
    assert [r[2] for r in _found(spark, docs, [(0, "same")], 5, shard_postings=20)] == [1, 2, 3, 4, 5]


def test_repeated_items_are_ranked_each(spark):
    docs, _ = _corpus(50)
    got = _found(spark, docs, [(1, "w1 w2"), (1, "w1 w2")], 3)
    assert [r[:2] for r in got] == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (1, 3)]


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert _found(spark, docs, items) == []
    wide = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS shard")
    assert lexical.ranked(wide, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS key")).columns == ["item_id", "rank", "doc_id", "score"]
