"""Language ID: held-out accuracy and edge cases."""

import random

from catalink.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"
SYLLABLES = {"aa": ["ka", "ri", "to", "mu"], "bb": ["schn", "eit", "ung", "ver"], "cc": ["éau", "eux", "ment", "ç"]}


def rows():
    rng = random.Random(1)
    out = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(rng.randint(3, 60))]
        out.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words) + ("!!" if i % 7 else ""), lang, 1))
    return [*out, (900, None, "aa", 1), (901, "", "bb", 1), (902, "123 $$$ _ ²½Ⅷ①", "cc", 1), (903, "karito", None, 1), (3, out[3][1], out[3][2], 2)]


def test_held_out_accuracy(spark):
    data = rows()
    got = language.predictions(spark.createDataFrame(data, SCHEMA), per_language=60).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    tested = [x for x in data if by_id[x[0]].held_out and x[0] < 900]
    assert sum(by_id[i].lang_pred == lang for i, _, lang, _ in tested) >= 0.97 * len(tested) > 30
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[903].lang_pred == "aa" and not by_id[903].rejected
    assert all(0 <= r.score <= 1 for r in got)


def test_foreign_and_random_texts_are_rejected(spark):
    rng = random.Random(6)
    data = [x for x in rows() if x[0] < 300]
    others = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 4, "Все люди рождаются свободными и равными в своем достоинстве. " * 4, "人人生而自由，在尊严和权利上一律平等。" * 8,
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=800)),
    ]
    docs = spark.createDataFrame([*data, *((2000 + i, t, None, 1) for i, t in enumerate(others))], SCHEMA)
    rejected = {r.doc_id for r in language.predictions(docs).where("rejected").collect()}
    assert rejected == set(range(2000, 2000 + len(others)))
    assert {r.doc_id for r in language.accepted(docs).collect()} == {x[0] for x in data}


def test_no_labels_and_no_rows(spark):
    assert language.predictions(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = language.predictions(spark.createDataFrame([(1, "abc", None, 0)], SCHEMA)).collect()
    assert row.lang_pred == "und"


def test_without_labels_texts_with_a_letter_stay(spark):
    data = [(1, "plain words of a text", None, 0), (2, "others", None, 0), (3, "12 -", None, 0), (4, None, None, 0)]
    assert sorted(r.doc_id for r in language.accepted(spark.createDataFrame(data, SCHEMA)).collect()) == [1, 2]


def test_sample_is_bounded_over_all_labels(spark):
    from catalink.llm.common import labelled_sample

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 1000) AS text", "id % 40 AS lang")
    assert labelled_sample(docs, "lang", 1000, "text").count() == 4000
    assert 100 < labelled_sample(docs, "lang", 1000, "text", most_rows=200).count() < 320
    assert 100 < labelled_sample(docs, "lang", 1000, "text", most_bytes=200_000).count() < 320
