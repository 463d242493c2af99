"""Alignment of two tokenizers' tokens over the same text.

A is a byte-level BPE file, B a SentencePiece model file; A encodes a blank and the text, B the text, to
which it adds that blank itself. Both cut the same bytes, so each byte gets a label: none, end of a token
of A, of B, or both. A regular expression scans the label string for spans up to each `both`; the labels
in a span say how many tokens of A and of B make up one group. Between two neighbouring labels lies the
overlap of exactly one token of A with one of B: a link.

Links are counted by pairs of ids within each document, then over the corpus by a sum that is combined
before its shuffle. The counts come back to the documents by a sorted join on the pair, at any size (a frequent pair stands once
in a document, and adaptive execution splits its rows); nothing is broadcast.

A's words and B's words (text before a blank, or from a line end on; no piece of the model reaches across)
are encoded once per worker while there is room.

Cases: a text that is null or empty, or whose tokens don't give its bytes back on both sides (such as one
with U+2581), has no tokens and so no groups or links; names of special tokens are text like any other;
texts of any length are taken whole; repeated rows and repeated or null ids are rows of their own; ties
for the highest count of a B id all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, written
from .tokens import Encoder, _byte_letters, encoder

BLANK = "▁"
#: Labels of a byte; a span of the scan ends with BOTH.
END_A, END_B, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: Words of B and spans of labels that a worker keeps (about 250 bytes each).
KEPT_WORDS, KEPT_SPANS = 400_000, 100_000
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_SIDE = 1 << 20


class ModelB:
    """ids of whole texts by a SentencePiece model, each word encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        texts = [model.id_to_piece(i) for i in ids]
        plain = [t for i, t in zip(ids, texts, strict=True) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        if any(BLANK in t.lstrip(BLANK) for t in plain) or any("\n" in t for t in plain):
            raise ValueError("a piece reaches over a blank or a line end")
        self.raw = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace(BLANK, " ").encode() for i, t in zip(ids, texts, strict=True)]
        self.sizes = np.asarray([len(t) for t in self.raw], dtype=np.int64)
        self.blank = model.piece_to_id(BLANK)
        #: ids of words; None for those whose pieces don't give them back.
        self.words: dict[str, bytes | None] = {}

    def cut(self, text: str) -> list[str]:
        """The words of a text: without the blank before each, or from a line end on."""
        if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
            return [part for w in WORD.findall(BLANK + text.replace(" ", BLANK)) for part in self._parts(w)]
        return text.replace("\n", " \n").split(" ")[text[:1] == "\n" :]

    @staticmethod
    def _parts(word: str) -> list[str]:
        """A word of a text with runs of blanks; a lone blank and what follows it from a line end on are two."""
        if word[:2] in (BLANK, f"{BLANK}\n"):
            return [BLANK, *([word[1:]] if word[1:] else [])]
        return [word[1:].replace(BLANK, " ")]

    def _new(self, words: list[str]) -> dict[str, bytes | None]:
        found, raw = {}, self.raw
        for word, ids in zip(words, self.model.encode(words, num_threads=1), strict=True):
            # What the model adds before a line end isn't there but at the text's begin, where encode_all puts it.
            ids = [self.blank] if word == BLANK else ids[1:] if word[:1] == "\n" else ids
            said = " " if word == BLANK else word if word[:1] == "\n" else f" {word}"
            found[word] = array("I", ids).tobytes() if b"".join(map(raw.__getitem__, ids)) == said.encode() else None
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """ids of each text, None where they don't give it back."""
        split = [self.cut(t) if t else [] for t in texts]
        known = self.words
        known.update(self._new(list(set().union(*split).difference(known))))
        first, out = array("I", [self.blank]).tobytes(), []
        for words in split:
            try:
                ids = b"".join(map(known.__getitem__, words))
            except TypeError:  # a word without ids
                out.append(None)
                continue
            out.append(np.frombuffer(first + ids if words and words[0][:1] == "\n" else ids, dtype="<u4"))
        if len(known) > KEPT_WORDS:
            known.clear()
        return out


class Aligner:
    """Groups and links of texts by one pair of files."""

    def __init__(self, a: str, b: str):
        self.a: Encoder = encoder(a, True)
        self.b = ModelB(b)
        back = {ord(letter): byte for byte, letter in _byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = token.translate(back).encode("latin-1") if all(ord(c) in back for c in token) else token.encode()
        self.sizes = np.asarray([len(t) for t in self.raw], dtype=np.int64)
        self.spans: dict[bytes, int] = {}
        # Digits of every id with what may follow it: , | ; or nothing.
        top = max(len(self.raw), len(self.b.raw))
        self.shown = [b"%d%b" % (i, end) for end in (b",", b"|", b";", b"") for i in range(top)]
        self.top = top

    def labels(self, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The label of each byte of a text."""
        out = np.zeros(size, dtype=np.uint8)
        out[np.cumsum(self.sizes[a]) - 1] = END_A
        out[np.cumsum(self.b.sizes[b]) - 1] |= END_B
        return out

    def group_sizes(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group has, from the spans of the label string."""
        spans, known = SPAN.findall(labels.tobytes()), self.spans
        for span in set(spans).difference(known):
            known[span] = span.count(END_A) + span.count(BOTH) + (span.count(END_B) + span.count(BOTH)) * _SIDE
        sizes = np.asarray(list(map(known.__getitem__, spans)), dtype=np.int64)
        if len(known) > KEPT_SPANS:
            known.clear()
        return sizes % _SIDE, sizes // _SIDE

    def links(self, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of ids (a * 2^32 + b) with the number of their links."""
        told = labels[labels > 0]
        at_a, at_b = (np.cumsum(told & bit > 0) - (told & bit > 0) for bit in (END_A, END_B))
        return np.unique(a[at_a].astype(np.int64) << 32 | b[at_b].astype(np.int64), return_counts=True)

    def text_of(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: the groups' ids in order."""
        sides = np.stack([n_a, n_b], axis=1).ravel()
        ends = np.cumsum(sides) - 1
        begins = ends - sides + 1
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        of_a = np.repeat(begins[::2] - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(a))
        of_b = np.repeat(begins[1::2] - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(b))
        ids[of_a], ids[of_b] = a, b
        ids[ends[::2]] += self.top
        ids[ends[1::2]] += 2 * self.top
        ids[ends[-1]] += self.top
        return b"".join(map(self.shown.__getitem__, ids.tolist()))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids of A and B of each text; none where either side doesn't give the text back."""
        empty = np.zeros(0, dtype="<u4")
        left = [np.frombuffer(x, dtype="<u4") for x in self.a.encode_all([f" {t}" for t in texts])]
        right = self.b.encode_all(["" if BLANK in t else t for t in texts])
        out = []
        for t, a, b in zip(texts, left, right, strict=True):
            # Tokens of A are cut from the text's own bytes; those of B are compared with them word by word.
            good = b is not None and len(b) and int(self.sizes[a].sum()) == int(self.b.sizes[b].sum()) == len(t.encode()) + 1
            out.append((a, b) if good else (empty, empty))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One aligner for each pair of files and worker."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in values])])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(values).astype(kind)))


def _rows(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, ...]]]]:
    """For each slice of a batch the ids of its documents and of each (ids of A, of B, group sizes of A, of B, pairs, their links)."""
    known = aligner(a, b)
    for batch in small_batches(batches, "text", 1 << 20):
        found = []
        for ids_a, ids_b in known.encode_all([t or "" for t in batch.column("text").to_pylist()]):
            labels = known.labels(int(known.sizes[ids_a].sum()), ids_a, ids_b)
            found.append((ids_a, ids_b, *known.group_sizes(labels), *known.links(labels, ids_a, ids_b)))
        yield batch.column("doc_id"), found


def _aligned(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    for doc_id, found in _rows(batches, a, b):
        columns = [_lists(list(x), kind) for x, kind in zip(zip(*found, strict=True), (np.int32,) * 4 + (np.int64, np.int64), strict=True)]
        yield pa.RecordBatch.from_arrays([doc_id, *columns], names=["doc_id", "ids_a", "ids_b", "group_a", "group_b", "pairs", "links"])


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids_a, ids_b, group_a and group_b (tokens of each side in each group), pairs (a * 2^32 + b) and links (of each pair)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lambda x: _aligned(x, a, b), "doc_id long, ids_a array<int>, ids_b array<int>, group_a array<int>, group_b array<int>, pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) over rows with pairs and links: the links of each pair, and whether no pair of its B id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    counts = written(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("count")), "pair-counts")
    side = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(side("pair").alias("b")).agg(F.max("count").alias("most"))
    told = counts.join(most, side("pair") == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return written(told, "best-pairs")


def _digested(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    known = aligner(a, b)
    for doc_id, found in _rows(batches, a, b):
        sizes = [pa.array([len(x[k]) for x in found], pa.int64()) for k in (0, 1, 2)]
        shas = [hashlib.sha256(known.text_of(*x[:4])).hexdigest() if len(x[0]) else "" for x in found]
        yield pa.RecordBatch.from_arrays([doc_id, *sizes, pa.array(shas, pa.string()), _lists([x[4] for x in found], np.int64), _lists([x[5] for x in found], np.int64)], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links"])


def digests(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is best of its B id), count_sum (corpus-wide counts over links), groups_sha256."""
    rows = pick(docs, doc_id="doc_id", text="text").mapInArrow(lambda x: _digested(x, a, b), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<long>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(rows)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = each.join(counts.hint("merge"), "pair").groupBy("row").agg(F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", none("n_links"), none("n_best"), none("count_sum"), "groups_sha256")
