"""SentencePiece: exact round trips, and ids against the library reading the same pieces as a unigram model."""

import random

import public_tokenizers
import pytest
import sentencepiece

from catalink.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  blanks ", "line\n\nends\n", "héllo wörld", "日本語 と 𝄞", "tab\tx", "a" * 700, "▁ odd", "ñandú über straße " * 50, "\x00\x01", "x"]
SCHEMA = "doc_id long, text string, ids string"


def unigram():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def ids_of(model, text):
    raw = model.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_ids_match_the_library():
    model, library, rng = pieces.Pieces(PATH), unigram(), random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñß.,!", k=rng.randint(1, 14))) for _ in range(1500)]
    for w in [*words, "Internationalization", "the", "don't stop"]:
        assert ids_of(model, w) == library.nbest_encode_as_ids(w, 2)[0], w


def test_best_sum_by_enumeration():
    model = pieces.Pieces(PATH)
    known = {model.raw[i]: s for i, s in zip(model.ids.tolist(), model.scores.tolist(), strict=True)}

    def best(raw):
        out = [0.0] + [float("-inf")] * len(raw)
        for j in range(1, len(raw) + 1):
            out[j] = max((out[i] + known[raw[i:j]] for i in range(j) if raw[i:j] in known), default=float("-inf"))
        return out[-1]

    for w in ("internationality", "qzxv", "strength", "aaaaaaaaaaa"):
        got = ids_of(model, w)
        assert sum(known[model.raw[i]] for i in got) == best(b" " + w.encode())


def test_round_trip_and_rows(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "z")], SCHEMA)
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.text == (TEXTS[r.doc_id] or "").replace("▁", " ") and (r.n_tokens == 0) == (not TEXTS[r.doc_id])
    assert pieces.digests(docs.where("false"), PATH).count() == 0
