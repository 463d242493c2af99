"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A model file gives pieces and scores; a text's ids are those of the segmentation with the largest sum of
scores, as in a unigram model (whatever the type the file names; see README). No piece holds a blank
after another character, so a text is cut before its blanks and each distinct word is segmented once per
worker. A text is also cut at line ends and after words, where no piece goes on. Words of equal length advance together: hashes of all substrings probe the sorted hashes of the
pieces, one maximum a position is taken over all words at once, and its length is kept as backpointer.
Ties go to the longest last piece. Characters without a piece become their UTF-8 byte pieces.

Cases: a null text counts as empty and has no ids; decoding restores a text exactly, blanks and line
ends included, but for U+2581, which stands for a blank in pieces and comes back as one; repeated rows are encoded each; an empty table gives an empty result; other columns are
ignored; a text without blanks is one word of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_crc, pick, small_batches

BLANK = "▁"
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Cuts further at line ends and after word characters, where the model's pieces allow.
FINE = re.compile(rf"\n|{BLANK}*\w+|{BLANK}*[^\w{BLANK}\n]+\w*|{BLANK}+")
TIE = re.compile(rf"(\w)[^\w{BLANK}]")
#: Words a worker keeps (about 250 bytes a word); cells of a group of words that advance together.
KEPT_WORDS, CELLS = 500_000, 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Told apart by length, substrings of different lengths never share a key by their first characters.
_LENGTHS = np.arange(1 << 10, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

_models: dict[str, Pieces] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Pieces:
    """The pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        if any(BLANK in t.lstrip(BLANK) for t in texts):
            raise ValueError("a piece holds a blank after another character")
        self.longest = max(map(len, texts))
        # Characters that some piece ties to a following mark; a text with one of them is cut at blanks only.
        ties = {m for t in texts for m in TIE.findall(t)}
        self.tied = re.compile(f"[{re.escape(''.join(sorted(ties)))}]") if ties else re.compile("(?!)")
        self.lines = not any("\n" in t for t in texts)
        scores = [model.get_score(i) for i in plain]
        self.unknown = min(scores) - 10.0
        keys = np.asarray([self._hashes(np.asarray([list(map(ord, t))], dtype=np.uint32))[0][0, -1] for t in texts])
        keys = keys + _LENGTHS[[len(t) for t in texts]]
        order = np.argsort(keys)
        self.keys, self.scores, self.ids = keys[order], np.asarray(scores)[order], np.asarray(plain, dtype=np.int32)[order]
        # Whether any key begins with these 20 bits: most substrings are no piece, and need no search.
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[(self.keys >> np.uint64(44)).view(np.int64)] = True
        self.bytes = np.asarray([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.raw = [b""] * len(ids)
        for i, t in zip(plain, texts, strict=True):
            self.raw[i] = t.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.raw[i] = bytes([b])
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each row's first characters, and the factor of each length."""
        mixed, out = _mixed(points), np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + mixed[:, j]
        return out, np.cumprod(np.concatenate([[np.uint64(1)], np.full(points.shape[1], _BASE)]))

    def segment(self, words: list[str]) -> list[bytes]:
        """ids of words of one length, as little-endian 32-bit integers."""
        size, n, k = len(words[0]), len(words), self.longest
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, size)
        prefix, factors = self._hashes(points)
        score = np.full((n, size, k), -np.inf)
        which = np.full((n, size, k), -1, dtype=np.int32)
        for length in range(1, min(k, size) + 1):  # column 0 is the longest piece
            h = prefix[:, length:] - prefix[:, : size - length + 1] * factors[length] + _LENGTHS[length]
            row, start = np.nonzero(self.may[(h >> np.uint64(44)).view(np.int64)])
            h = h[row, start]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            row, end, at = row[hit], start[hit] + length - 1, at[hit]
            score[row, end, k - length] = self.scores[at]
            which[row, end, k - length] = self.ids[at]
        lone = which[:, :, k - 1] < 0
        score[:, :, k - 1][lone] = self.unknown
        best = np.full((n, size + k), -np.inf)
        best[:, k - 1] = 0
        back = np.zeros((n, size), dtype=np.int64)
        rows = np.arange(n)
        for j in range(size):
            ways = best[:, j : j + k] + score[:, j]
            back[:, j] = np.argmax(ways, axis=1)
            best[:, j + k] = ways[rows, back[:, j]]
        # From the ends back: one piece of every word at a time.
        owners, found, ends = [], [], []
        at, live = np.full(n, size), rows
        while len(live):
            column = back[live, at[live] - 1]
            owners.append(live)
            found.append(which[live, at[live] - 1, column])
            ends.append(at[live])
            at[live] -= k - column
            live = live[at[live] > 0]
        owner, piece = (np.concatenate(x[::-1]) for x in (owners, found))
        order = np.argsort(owner, kind="stable")
        raw = piece[order].astype("<i4").tobytes()
        edges = (np.cumsum(np.bincount(owner, minlength=n)) * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *edges], edges, strict=False)]
        end = np.concatenate(ends[::-1])[order]
        for row in np.unique(owner[piece < 0]).tolist():
            own = owner[order] == row
            out[row] = b"".join(p.to_bytes(4, "little") if p >= 0 else self.bytes[list(words[row][e - 1].encode("utf-8", "replace"))].tobytes() for p, e in zip(piece[order][own].tolist(), end[own].tolist(), strict=True))
        return out

    def cut(self, text: str) -> list[str]:
        """The words of a text, at whose ends no piece goes on."""
        return (FINE if self.lines and not self.tied.search(text) else WORD).findall(f" {text}".replace(" ", BLANK)) if text else []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as little-endian 32-bit integers; new words of all texts are segmented together."""
        split, known = [self.cut(t) for t in texts], self.words
        groups: dict[int, list[str]] = {}
        for w in set().union(*split).difference(known):
            groups.setdefault(len(w), []).append(w)
        found: dict[str, bytes] = {}
        for size, group in groups.items():
            step = max(1, CELLS // size)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                found.update(zip(part, self.segment(part), strict=True))
        if len(known) + len(found) <= KEPT_WORDS:
            known.update(found)
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([found[w] if w in found else known[w] for w in words]) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces give nothing."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def pieces(path: str) -> Pieces:
    """One model for each file and worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in small_batches(batches, "text", 2 << 20):
        ids = [np.frombuffer(x, dtype="<i4") for x in model.encode_all([t or "" for t in batch.column("text").to_pylist()])]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([ids_crc(x) for x in ids], pa.int64())], names=["doc_id", "ids", "ids_crc32"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, ids_crc32."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _encoded(b, model), "doc_id long, ids array<int>, ids_crc32 long")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        lists = batch.column("ids")
        edges = lists.offsets.to_numpy().tolist()
        ids = lists.values.to_numpy()
        texts = [model.decode(ids[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)]
        sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("ids_crc32"), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_crc32", "text"])


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """One row per row of tokens (doc_id, ids, ids_crc32): doc_id, n_tokens, ids_crc32, text."""
    return tokens.select("doc_id", "ids", "ids_crc32").mapInArrow(lambda b: _decoded(b, model), "doc_id long, n_tokens long, ids_crc32 long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and decoded_sha256 of the text that the ids give back."""
    return decode(encode(docs, model), model).select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
