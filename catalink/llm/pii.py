"""Personal data in whole texts: four patterns, and further spans by a semi-Markov conditional random field.

The patterns find e-mail and IP addresses, card and phone numbers in their plain notations (leftmost,
non-overlapping, each kind by itself; matches that fail their check are dropped). Around digits, at-signs
and bracketed "at" outside of these spans, the random field of `semicrf` adds entities in other notations.

Cases: a null text counts as empty and has no spans; offsets are code points, end exclusive; repeated
rows are searched each; an empty table gives an empty result; other columns are ignored or, in
`redacted`, kept; long runs of digits or letters are searched in linear time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import semicrf
from .common import few_records, pick, small_batches
from .semicrf import KINDS, luhn

#: The four base patterns; an address is matched from its at-sign, as its left part cannot hold one.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Characters on either side of a trigger that the random field sees.
SIDE = 100

Span = tuple[int, int, int]  # kind number, start, end


def _emails(text: str) -> Iterator[Span]:
    done, k = 0, text.find("@")
    while k >= 0:
        s = k
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, k) if s < k else None
        if m:
            yield 0, s, m.end()
            done = m.end()
        k = text.find("@", max(done, k + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    out = list(_emails(text))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def added_spans(text: str, base: list[Span], model: semicrf.Model) -> list[Span]:
    """Entities by the random field that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    zones: list[list[int]] = []
    at = 0
    for m in semicrf.TRIGGER.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        left = max(m.start() - SIDE, max((b for _, b in taken[max(0, at - 4) : at]), default=0))
        right = min(m.end() + SIDE, taken[at][0] if at < len(taken) else len(text))
        if zones and left <= zones[-1][1]:
            zones[-1][1] = max(zones[-1][1], right)
        else:
            zones.append([left, right])
    out = []
    for left, right in zones:
        tokens = semicrf.TOKEN.findall(text[left:right])
        edges = [left]
        for t in tokens:
            edges.append(edges[-1] + len(t))
        out += [(y, edges[i], edges[j]) for i, j, y in model.decode(tokens) if not any(edges[i] < b and a < edges[j] for a, b in taken)]
    return out


@functools.cache
def model() -> semicrf.Model:
    """Trained on made sentences, always with the same result."""
    return semicrf.train(semicrf.examples())


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(batches: Iterator[pa.RecordBatch], field: semicrf.Model) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text or "")
            every = base + added_spans(text or "", base, field)
            counts = [sum(k == x for k, _, _ in base) for x in range(4)]
            rows.append((doc_id, *counts, hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(every)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = docs.sparkSession.sparkContext.broadcast(model())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(lambda batches: _found(batches, field.value), schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text column masked; a null text stays null."""
    few_records(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(model())

    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [pa.array([], pa.string())]
            for part in small_batches([pa.RecordBatch.from_arrays([batch], names=["text"])], "text"):
                texts = part.column("text").to_pylist()
                for i, text in enumerate(texts):
                    base = base_spans(text or "")
                    every = base + added_spans(text or "", base, field.value)
                    texts[i] = mask(text, every) if every else text
                out.append(pa.array(texts, pa.string()))
            yield pa.concat_arrays(out)

    masked.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text_col)
    new = F.arrow_udf(masked, T.StringType())(F.col(f"c{at}"))
    return inner.withColumn(f"c{at}", new).toDF(*names)
