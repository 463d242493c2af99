"""SimHash near-duplicates against a brute-force version."""

import random
import re

import numpy as np
import xxhash

from catalink.llm import simhash
from catalink.llm.components import components

SCHEMA = "doc_id long, text string, fp string, slot int"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    marks = {i: slow_fingerprint(t) for i, t in rows}
    ids, group = list(marks), {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (marks[a] ^ marks[b]).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (f"{marks[i]:016x}", group[i]) for i in ids}


def texts():
    rng = random.Random(3)
    words = [f"{a}{b}é" for a in "qwertzuiop" for b in "asdfghjkl"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(30)]
    rows = list(base)
    for t in base[:12]:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [None, "", " \t\n", base[0].upper().replace("É", "é"), base[1] + "  ", "\x85x\x1cy z"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 9)
    monkeypatch.setattr(simhash, "PART", 20)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == slow_components(rows)


def test_forest_grown_without_pairs_has_the_same_length():
    rng = np.random.default_rng(2)
    lanes = np.unique((np.uint64(1) << rng.integers(0, 14, (300, 5), dtype=np.uint64)).sum(axis=1))[:, None]
    i, j = np.triu_indices(len(lanes), 1)
    d = simhash._distance(lanes, i, j)
    near = d <= 3
    i, j, d = i[near], j[near], d[near]
    keep = simhash.forest(i, j, d, len(lanes))
    assert sorted(d[keep].tolist()) == sorted(simhash._grown(lanes, 3)[2].tolist())


def test_empty_table_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(5, "a b", None, None), (5, "a b", None, None), (None, "a b", None, None)], SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(0, 5), (5, 5), (5, 5)]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(301)} | {900: 900, 901: 900}
