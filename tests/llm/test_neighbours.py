"""Nearest neighbours: exactness at full share, recall at the production share, traversal order and edge cases."""

import itertools

import numpy as np

from catalink.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cell string"


def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[99]
    rows = [(i, [float(v) for v in r], 0, "c") for i, r in enumerate(x)]
    bad = [(700, None, 0, "c"), (720, [0.0] * 16, 0, "c"), (740, [float("nan")] + [1.0] * 15, 0, "c"), (760, [None] + [1.0] * 15, 0, "c"), (780, [float("inf")] * 16, 0, "c"), (800, [1.0], 0, "c"), (None, [1.0] * 16, 0, "c")]
    return rows + bad + [rows[5]], x.astype(np.float64)


def brute(x, q, k):
    s = (x * x[q]).sum(axis=1)
    return [(i, s[i]) for i in sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]]


def test_exact_at_full_share_and_recall(spark, monkeypatch):
    rows, x = data()
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 9)
    ask = docs.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id")
    got = {}
    for r in neighbours.nearest(docs, ask, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: brute(x, q, 20) for q in range(0, 600, 20)}
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(docs, ask).collect()}
    assert sum((q, i) in found for q in got for i, _ in got[q]) >= 0.9 * 20 * len(got)


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    books, q = (rng.normal(size=(5, 4)), rng.normal(size=(7, 4))), rng.normal(size=8)
    got = neighbours.traverse(q, books, np.ones(35, int), 35)
    want = sorted(itertools.product(range(5), range(7)), key=lambda c: -(books[0][c[0]] @ q[:4] + books[1][c[1]] @ q[4:]))
    assert got == [a * 7 + b for a, b in want]


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (1, [2.0, 1.0], 1, "")], SCHEMA)
    ask = docs.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id")
    assert [tuple(r) for r in neighbours.nearest(docs, ask).collect()] == [(0, 1, 1, 4.0)]
    assert neighbours.nearest(docs.where("false"), ask).count() == 0


def test_shards_hold_every_cell_once():
    sizes = np.asarray([3, 0, 5, 9, 40, 1, 2, 2] + [0] * 8)
    shards = neighbours.Shards.of(sizes, 2, 10)
    rows = sizes.reshape(-1, 2).sum(axis=1)
    assert shards.splits.tolist() == [1, 2, 5, 1, 1, 1, 1, 1]
    assert shards.base.tolist() == [0, 1, 3, 8, 8, 8, 8, 8]
    for number in set(shards.base.tolist()):
        own = np.flatnonzero(shards.base == number)
        assert len(set(shards.place[own].tolist())) == len(own) and rows[own].sum() / shards.splits[own].max() <= 10


def test_fitted_share_falls_on_clustered_vectors():
    rng = np.random.default_rng(5)
    far, near = rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(30, 16)) * 3, 50, axis=0) + rng.normal(size=(1500, 16)) * 0.1
    shares = []
    for x in (far, near):
        books = (neighbours.codebook(x[:, :8], 16), neighbours.codebook(x[:, 8:], 16))
        shares.append(neighbours.share_for(x, books, 20))
    assert 2 * shares[1] < shares[0] <= 1
