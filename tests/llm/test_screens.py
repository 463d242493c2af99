"""Screens let every key of their set through, few others, and give way to joins beyond their bound."""

import numpy as np

from catalink.llm.screens import held, screen_of


def test_screens(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS k")
    screen = screen_of(keys.unionByName(keys), 10_000)
    own = np.asarray([r.k for r in keys.collect()])
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    assert held(screen, own).all() and held(screen, others).mean() < 0.02
    assert screen_of(keys, 2999) is None
    assert not held(screen_of(keys.limit(0), 10), own).any()
