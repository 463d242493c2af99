"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from catalink.llm import repeats

SCHEMA = "doc_id long, text string, key long, place string"
N = repeats.LENGTH


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                gone[i : i + N] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    passages = [make(n) for n in (350, 380, 420, 600, 1500)]
    texts = [make(rng.randint(0, 1500)) for _ in range(25)]
    for _ in range(25):
        p = rng.choice(passages)
        a, b = sorted((rng.randint(0, len(p) // 4), rng.randint(3 * len(p) // 4, len(p))))
        texts.append(make(rng.randint(0, 700)) + p[a:b] + make(rng.randint(0, 700)) + rng.choice(["", rng.choice(passages)]))
    base = make(2500)
    for _ in range(6):
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    texts += [base, base, "x" * 900, "ab" * 420 + "c", make(399), make(400), None, "", base[:N], "q" + base[1 : N + 1]]
    return [(i * 5 % 101, t) for i, t in enumerate(texts)] + [(7, base), (None, base[100:900]), (5, texts[2])]


def brute_passages(rows):
    """Whether each row holds 51 words in a row that a row of another id or text holds."""
    words = [(t or "").encode().split() for _, t in rows]
    owners = {}
    for (i, t), w in zip(rows, words, strict=True):
        for k in range(len(w) - 50):
            owners.setdefault(tuple(w[k : k + 51]), set()).add((i, t))
    return [any(len(owners[tuple(w[k : k + 51])]) > 1 for k in range(len(w) - 50)) for w in words]


@pytest.mark.parametrize("classes, sent", [(4096, 10**6), (1, 10**6), (4096, 0)])
def test_matches_brute_force(spark, monkeypatch, classes, sent):
    monkeypatch.setattr(repeats, "CLASSES", classes)
    monkeypatch.setattr(repeats, "SLICE", 700 if classes == 1 else 1 << 20)
    monkeypatch.setattr(repeats, "SENT_KEYS", sent)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in data], SCHEMA)
    found = repeats.trimmed(docs).collect()
    got = sorted((tuple(r)[:5] for r in found), key=str)
    want = brute(data)
    assert sum(w[2] for w in want) > 5000
    assert got == want
    marks = brute_passages(data)
    assert 10 < sum(marks) < len(marks) - 10
    assert sorted((str(r.doc_id), r.n_bytes, r.shared_passage) for r in found) == sorted((str(i), len((t or "").encode()), m) for (i, t), m in zip(data, marks, strict=True))


def test_passages_of_words_under_400_bytes(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    passage = rng.choices(words, k=51)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200)) + (passage if i % 4 == 0 else passage[: 50 if i % 4 == 1 else 0]) + rng.choices(words, k=rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, "lone " * 300), (101, " ".join(2 * rng.choices(words, k=80))), (102, None)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.shared_passage for r in repeats.trimmed(docs).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_passages(rows), strict=True))
    assert all(got[i] for i in range(0, 60, 4)) and not any(got[i] for i in (2, 3, 6, 7, 100, 101, 102))


def test_empty_table(spark):
    assert repeats.trimmed(spark.createDataFrame([], SCHEMA)).count() == 0
