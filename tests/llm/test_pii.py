"""Personal data: base patterns against plain re, the random field on made sentences, and its sums against enumeration."""

import hashlib
import re

from catalink.llm import pii, semicrf

SCHEMA = "doc_id long, text string, spans int, KINDS string"
#: The base patterns as stated.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "mail a.b@c.de and +1 (017) 555-7713 from 97.51.17.173, card 4111 1111 1111 1111.", "a@b@c.d.e x@y z@@q.r a@b..c",
    "1.2.3.4.5.6.7.8 and 1.2.3.256 or 001.002.003.004", "4111111111111111 4111-1111-1111-1112 4111111111111111411111", "+1 +12345678 +1234567890123456 ++49 30 123456 9",
    "é+49(30)1234567é ü@ü.de Ünder@x-y.org.", "9" * 3000 + "." + "1.1.1", "x" * 5000 + "@" + "y.z" * 50, "+1 2 3 4 5 6 7 8) (", "version 2.0. Then 12:30:01.123",
]


def slow(text):
    out = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and total % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_and_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1, "x")], SCHEMA)
    got = pii.personal_data(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = slow(TEXTS[r.doc_id] or "")
        assert pii.base_spans(TEXTS[r.doc_id] or "") == want
        named = pii.written_out(want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in range(4))
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(docs.where("false")).count() == 0


def test_field_adds_other_notations():
    def found(text):
        base = pii.base_spans(text)
        return [(semicrf.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, base, pii.model())]

    assert found("write to sdrn [at] plome.org soon, ") == [("email", "sdrn [at] plome.org")]
    assert found("call (030) 555-1234 or not") == [("phone", "(030) 555-1234")]
    for clean in ("version 2.0 of it", "born 2024-01-31 at", 'token = "04dbebab91ab85687d33"', "no numbers here", "1, 2 and 3 of 4"):
        assert found(clean) == []


def test_field_adds_short_addresses_and_at_in_any_case():
    def found(text):
        return [(semicrf.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), pii.model())]

    for ip in ("10 . 0 . 0 . 1", "127[.]0[.]0[.]1", "8[.]8[.]8[.]8", "1 . 1 . 1 . 1"):
        assert found(f"the host {ip} is up") == [("ip", ip)]
    for mail in ("sdrn [AT] plome.org", "sdrn (At) plome.org", "sdrn[AT]plome.org"):
        assert found(f"write to {mail} soon, ") == [("email", mail)]
    for clean in ("version 2 . 0 . 1 of it", "points 1 2 3 4 of 5", "sections 1.2, 3.4 and 5"):
        assert found(clean) == []
    for tokens, gold in semicrf.examples():
        assert {g[:2] for g in gold} <= set(semicrf.candidates(tokens))


def test_held_out_sentences():
    right = wrong = missed = 0
    for tokens, gold in semicrf.examples(200, seed=77):
        got, want = set(pii.model().decode(tokens)), set(gold)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 150 and wrong + missed <= 0.04 * right


def test_decoding_is_the_best_of_all_segmentations():
    def score(tokens, n, segments):
        total, last = 0.0, 0
        ends = {i: (j, y) for i, j, y in segments}
        i = 0
        while i < n:
            j, y = ends.get(i, (i + 1, -1))
            total += pii.model().moves[last, y + 1] + (pii.model().scores([semicrf.features(tokens, i, j)])[0, y] if y >= 0 else 0)
            i, last = j, y + 1
        return total

    def every(spans, at, n):
        yield []
        for i, j in spans:
            if i >= at:
                for y in range(4):
                    for rest in every(spans, j, n):
                        yield [(i, j, y), *rest]

    for tokens, _ in semicrf.examples(12, seed=3):
        tokens = tokens[:14]
        spans = semicrf.candidates(tokens)[:5]
        if not spans:
            continue
        keep = semicrf.candidates
        semicrf.candidates = lambda _, s=spans: s
        try:
            got = pii.model().decode(tokens)
        finally:
            semicrf.candidates = keep
        best = max(score(tokens, len(tokens), s) for s in every(spans, 0, len(tokens)))
        assert abs(score(tokens, len(tokens), got) - best) < 1e-9


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd now", 7, "k"), (2, None, None, None), (3, "clean", 1, "z")], SCHEMA)
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    assert {r[0]: r[1] for r in got.collect()} == {1: "to <EMAIL> now", 2: None, 3: "clean"}
