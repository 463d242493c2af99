"""Trie encoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalink.llm import prefix_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = ["a", "b", "the", " ", "  ", "\n", "<|endoftext|>", "<|", "é", "你好", "🎉", "́", "'s", "'S", "12", "_", "...", "\t", "　", "ﬁ", "İ", "x" * 70, "ab" * 200, " " * 90, "\x00", "\x85"]


def _texts():
    rng = random.Random(3)
    wide = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(100)]
    return [None, "", " ", "a" * 20000, "=-" * 9000, "".join(rng.choices("abcdefgh", k=20000)), "twice", "twice"] + wide + ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, library):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.digests(docs, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), repr(text)[:80]


def test_plain_names_of_tokens(library):
    library.encode_special_tokens = True
    plain = library.encode("a<|endoftext|> b", add_special_tokens=False).ids
    library.encode_special_tokens = False
    assert np.frombuffer(prefix_bpe.trie_encoder(PATH, True).encode("a<|endoftext|> b"), "<u4").tolist() == plain
    assert 50256 not in plain


def test_decode_of_any_ids(spark, library):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(9)] for _ in range(200)] + [[], None, [99999999]]
    rows = prefix_bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>"), PATH).collect()
    told = {r.doc_id: r.text for r in rows}
    assert all(told[i] == library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists[:200]))
    assert told[200] == told[201] == told[202] == ""


def test_prefixes_are_encoded_once(monkeypatch):
    trie = prefix_bpe.Trie(prefix_bpe.Merges(PATH))
    calls = []
    monkeypatch.setattr(trie.merges, "last", lambda *x, f=trie.merges.last: calls.append(x[0][: x[1]]) or f(*x))
    trie.encode([b" walking", b" walked", b" walk", b" talk"])
    trie.encode([b" walker"])
    assert len(calls) == len(set(calls)) == len({w[:n] for w in (b" walking", b" walked", b" talk", b" walker") for n in range(1, len(w) + 1)})


def test_a_full_trie_begins_anew(monkeypatch, library):
    monkeypatch.setattr(prefix_bpe, "MOST_NODES", 20)
    monkeypatch.setattr(prefix_bpe, "MOST_PAIRS", 5)
    encoder = prefix_bpe.TrieEncoder(PATH)
    for text in ("some words here", "other words there", "some words here"):
        assert np.frombuffer(encoder.direct(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert prefix_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        prefix_bpe.Merges(public_tokenizers.path("word_bpe_49k.json"))
