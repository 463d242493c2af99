"""Exact duplicates: filters, classes against brute force, byte checks and edge cases."""

import hashlib
import random
import string

import numpy as np
import pytest

from catalink.llm import exact_dedup, fuse

SCHEMA = "doc_id long, text string, sha string, keep_id int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_filter_holds_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63, n)
    cells = fuse.build(keys)
    assert fuse.contains(cells, keys).all()
    assert fuse.contains(cells, rng.integers(-(2**63), 2**63, 20000)).mean() < 0.001


def rows():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abÉé \n", k=rng.randint(0, 3))) for _ in range(120)] + [None, "", "É", "é", "HELLO", "hello"]
    data = [(i, t) for i, t in enumerate(texts)]
    return data + [(125, "hello"), (125, "hello"), (None, "hello"), (None, "only null"), (7, "other text of one id")]


def brute(data):
    classes = {}
    for i, t in data:
        classes.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in classes.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_matches_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "SENT_KEYS", sent)
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 9)
    data = rows()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in data], SCHEMA)
    assert sorted((tuple(r) for r in exact_dedup.decisions(docs).collect()), key=str) == brute(data)


def test_equal_digests_of_other_bytes_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits, real=F.sha2: real(c, bits) if bits == 512 else F.substring(real(c, bits), 1, 1))
    data = [(i, f"text {i % 11}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in data], SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.decisions(docs).collect()}
    assert got == {i: tuple(k[1:3]) for i, *k in [(r[0], *r) for r in brute(data)]}


def test_no_rows(spark):
    assert exact_dedup.decisions(spark.createDataFrame([], SCHEMA)).count() == 0
