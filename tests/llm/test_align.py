"""Token alignment against a slow version over byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catalink.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = ["a", "b", "the", " ", "  ", "\n", "<s>", "é", "你好", "🎉", "'s", "12", "_", "...", "\t", "ing", "x" * 20, "▁", "</s>", "<0x41>", "<|endoftext|>", "\x00", "\r\n", "ﬁ"]


def _texts():
    rng = random.Random(7)
    fixed = [None, "", " ", "\n", "a\n", "\na", " \n x ", "x" * 5000, "é ü " * 200, "same text", "same text", "a▁b"]
    return fixed + ["".join(rng.choices(POOL, k=rng.randint(0, 14))) for _ in range(300)]


def _ranges(sizes):
    at = 0
    for n in sizes:
        yield at, at + n
        at += n


def _slow(texts):
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    rows = []
    for text in texts:
        whole = f" {text or ''}".encode()
        a = left.encode(whole.decode(), add_special_tokens=False)
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens]
        b = right.encode(text or "")
        raw_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            rows.append(([], [], [], []))
            continue
        ra, rb = list(_ranges(map(len, raw_a))), list(_ranges(map(len, raw_b)))
        links = [(x, y) for x, (s, e) in zip(a.ids, ra, strict=True) for y, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
        groups, last = [], 0
        for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
            groups.append(([x for x, (_, e) in zip(a.ids, ra, strict=True) if last < e <= cut], [y for y, (_, e) in zip(b, rb, strict=True) if last < e <= cut]))
            last = cut
        rows.append((a.ids, b, groups, links))
    counts = Counter(x for r in rows for x in r[3])
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""


def test_equals_a_slow_version(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids_a string, row long").repartition(3)
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.digests(docs, A, B).collect()}
    assert [found[i] for i in range(len(texts))] == list(_slow(texts))
    assert found[0] == found[1] == (0, 0, 0, 0, 0, 0, "") and found[11][0] == 0


def test_groups_hold_all_tokens(spark):
    docs = spark.createDataFrame([(1, "Tokenization of words"), (None, None), (1, "x")], "doc_id long, text string")
    rows = align.aligned(docs, A, B).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert all(sum(r.group_a) == len(r.ids_a) and sum(r.group_b) == len(r.ids_b) and sum(r.links) == len(r.ids_a) + len(r.ids_b) - len(r.group_a) for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, None), (5, None), (5, "")]])
def test_empty_tables_and_rows(spark, rows):
    found = align.digests(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert len(found) == len(rows) and all(r.n_links == 0 and r.groups_sha256 == "" for r in found)


def test_full_tables_of_words_and_spans_begin_anew(monkeypatch):
    monkeypatch.setattr(align, "KEPT_WORDS", 3)
    monkeypatch.setattr(align, "KEPT_SPANS", 1)
    few, many = align.Aligner(A, B), align.aligner(A, B)
    for text in ("some words and more words", "a\nb c", "some other words"):
        (a, b), (x, y) = few.encode_all([text])[0], many.encode_all([text])[0]
        assert a.tolist() == x.tolist() and b.tolist() == y.tolist()
        labels = few.labels(len(text) + 1, a, b)
        assert [s.tolist() for s in few.group_sizes(labels)] == [s.tolist() for s in many.group_sizes(labels)]
