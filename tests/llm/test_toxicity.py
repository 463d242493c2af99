"""Toxicity: gradients against differences, window cover, held-out accuracy and edge cases."""

import random

import numpy as np

from catalink.llm import gru, toxicity

SCHEMA = "doc_id long, text string, lang string, toxic string"


def made(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ba", "ti", "ro", "mel", "sun", "vor"], k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 120))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Nastor!", "horrid,"]) if i % 2 else f"grum{word()}")
        docs.append((i, " ".join(words), "x", "z"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = gru.Net({k: v.astype(np.float64) for k, v in gru.train([], np.zeros(0, np.int64), np.zeros(0)).p.items()})
    net.p["o"] = rng.normal(size=net.p["o"].shape)
    g, at, truth = rng.normal(size=(9, 48)), rng.integers(0, 9, (3, gru.WINDOW)), np.asarray([0.0, 1.0, 1.0])

    def loss():
        x = net.run(g, at, keep=True)[0]
        return float((np.log1p(np.exp(x)) - truth * x).sum())

    x, saved = net.run(g, at, keep=True)
    d, d_g = net.gradients(g, at, 1 / (1 + np.exp(-x)) - truth, saved)
    for array, grad in [(g, d_g), *((net.p[k], d[k]) for k in ("uf", "ub", "a", "v", "o", "ob"))]:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in array.shape)
            keep = array[i]
            array[i] = keep + 1e-3
            up = loss()
            array[i] = keep - 1e-3
            down = loss()
            array[i] = keep
            assert abs((up - down) / 2e-3 - grad[i]) < 2e-3 * max(1, abs(grad[i]))


def test_windows_cover_every_word():
    for n in (0, 1, 6, 23, 24, 25, 42, 43, 500):
        w = gru.windows_of(np.arange(1, n + 1))
        assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1)) and (n <= gru.WINDOW) == (len(w) == 1)


def fitted():
    docs, labels = made(150)
    return gru.train([d[1] for d in docs], np.asarray([y for _, y in labels]), np.ones(len(docs)))


def test_every_start_is_scored():
    net, rng = fitted(), random.Random(4)
    words = "ba ti romel sunvor tiba melro horrid nastor".split()
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 23, 24, 25, 26, 47, 100, 90)] + [""]
    rows = [net.numbers(gru.words_of(t)) for t in texts]
    slow = [net.run(None, np.ascontiguousarray(gru.windows_of(x))).max() for x in rows]
    assert [len(gru.windows_of(x)) for x in rows] == [1, 1, 1, 2, 3, 24, 77, 67, 1]
    assert np.abs(net.logits(texts) - slow).max() < 1e-3
    assert np.abs(net.slide(rows[6], most=7) - net.run(None, np.ascontiguousarray(gru.windows_of(rows[6])))).max() < 1e-3


def test_passage_counts_at_every_offset():
    net, rng = fitted(), random.Random(5)
    passage = rng.choices("ba ti romel horrid nastor! grumti".split(), k=gru.WINDOW)
    alone = net.logits([" ".join(passage)])[0]
    for offset in range(40):
        put = " ".join([*rng.choices(["ba", "ti", "romel"], k=offset), *passage, *rng.choices(["ba", "sun"], k=31)])
        assert net.logits([put])[0] >= alone - 1e-3


def test_long_runs_are_scored_to_their_end():
    for run in ("ab" * 500 + "horrid", "ab" * 31 + "horrid" + "ab" * 31, "x" * 65):
        pieces = gru.words_of(f"so {run} be")[1:-1]
        assert all(any(run[i : i + 17] in p for p in pieces) for i in range(len(run) - 16)) and max(map(len, pieces)) <= 64
    assert gru.words_of("-".join(["mild"] * 20) + "_horrid!") == ["mild"] * 20 + ["horrid"] and gru.words_of("=" * 70)
    net = fitted()
    for joint in "_-/":
        words = ["ba", "ti", "romel"] * 12 + ["nastor"]
        assert net.scores([joint.join(words)])[0] == net.scores([" ".join(words)])[0] > net.scores([joint.join(words[:-1])])[0] + 0.2
    mild = "batiro" * 15
    assert net.scores([f"{mild}nastor"])[0] > net.scores([mild])[0] + 0.01


def test_held_out_accuracy_and_rows(spark):
    docs, labels = made(700)
    docs += [(1000, None, None, None), (1001, "", None, None), (3, docs[3][1], "x", "z"), (1002, "ba " * 3000 + "horrid", "x", "z")]
    got = toxicity.scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth, by_id = dict(labels), {r.doc_id: r for r in got}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 80 and sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert by_id[1000].score == by_id[1001].score < 0.5 < by_id[1002].score


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b", "x", "y")], SCHEMA)
    (row,) = toxicity.scores(docs, labels).collect()
    assert row.predicted == 0
    assert toxicity.scores(docs.where("false"), labels).count() == 0


def test_marks_stay_with_their_letters():
    from catalink.llm import gru

    run = "สวัสดีชาวโลกที่น่ารัก" * 8
    pieces = gru.words_of(run)
    assert {c for p in pieces for c in p} == set(run) and len(pieces[0]) == gru.PIECE
    joined = pieces[0] + "".join(p[gru.PIECE_STEP :] for p in pieces[1:])
    assert joined == run
