"""Byte-level BPE by a prefix-sharing trie: encoding and decoding of whole texts.

A tokenizer file gives byte tokens and merges in order. The encoding of a word's first n bytes is that of
a shorter prefix and one last token, and the last token is the only one of the vocabulary's tokens ending
there that stands beside the shorter prefix's last token without a merge across the border. So a word
needs no merging: its prefixes' last tokens follow from each other. Distinct words are put into a trie in
sorted order, which is the trie's depth-first order; each new node's last token is found from the states
on the path to it, so that a prefix that many words share is encoded once. A word's ids are read from its
node upwards.

Texts are cut into words as the file says (see `tokens`), its added tokens first. A worker keeps its trie
for later batches until MOST_NODES; a word of over LONGEST bytes is a path of its own that isn't kept.

Cases: a null text counts as empty and has no ids; texts of any length are taken whole; the name of an
added token in a text is that token, unless plain; repeated rows are encoded each; an empty table gives
an empty result; other columns are ignored; ids may be null. decode takes ids that name no token as
nothing.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches
from .tokens import Encoder, _byte_letters

#: Nodes of a worker's trie (about 130 bytes a node) and known pairs of tokens; beyond, both begin anew.
MOST_NODES, MOST_PAIRS = 1_000_000, 2_000_000
#: Bytes of the longest word that enters the trie.
LONGEST = 64
_FAR = 1 << 30


class Merges:
    """Tokens numbered by their merges: the 256 bytes first, then each merge's product, in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, kind = told["model"], (told.get("pre_tokenizer") or {}).get("type")
        if model["type"] != "BPE" or kind != "ByteLevel" or model.get("end_of_word_suffix") or told.get("normalizer"):
            raise ValueError("not a byte-level BPE file")
        back = {ord(letter): byte for byte, letter in _byte_letters().items()}
        as_bytes = lambda token: token.translate(back).encode("latin-1")
        vocabulary = model["vocab"]
        number = {as_bytes(letter): byte for byte, letter in _byte_letters().items()}
        self.id_of = [vocabulary[letter] for _, letter in sorted(_byte_letters().items())]
        self.left, self.right, self.merged = array("i", range(256)), array("i", range(256)), {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = number[as_bytes(left)], number[as_bytes(right)], len(self.id_of)
            product = as_bytes(left + right)
            if product in number:
                raise ValueError("two merges make one token")
            number[product] = self.merged[a << 20 | b] = new
            self.left.append(a)
            self.right.append(b)
            self.id_of.append(vocabulary[left + right])
        self.ids = np.asarray(self.id_of, dtype="<u4")
        self.added = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        self.raw = {self.id_of[n]: token for token, n in number.items()} | {i: t.encode() for t, i in self.added.items()}
        self.pairs: dict[int, bool] = {}
        # Tokens that stand for themselves: the merges that build them are those of their bytes.
        whole = bytearray(b"\x01" * len(self.id_of))
        for t in range(256, len(whole)):
            a, b = self.left[t], self.right[t]
            whole[t] = whole[a] and whole[b] and self._apart(a, b, t)
        self.whole = bytes(whole)
        self._ends(number)

    def _ends(self, number: dict[bytes, int]) -> None:
        """The tokens read backwards, as a table of steps: state and byte to state, and each state's token."""
        self.step, self.token_at = {}, array("i", [-1])
        for token, n in number.items():
            state = 0
            for byte in reversed(token):
                key = state << 8 | byte
                state = self.step.get(key, 0)
                if not state:
                    state = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[state] = n

    def _apart(self, a: int, b: int, before: int = _FAR) -> bool:
        """Whether no merge earlier than `before` crosses the border of tokens a and b.

        The merges that made a and b are undone from the last one back; a merge of the two pieces at the
        border would have come first if it is earlier than the one undone, or the same and further left.
        """
        merged, left, right = self.merged, self.left, self.right
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < before:
                return False
            if a > b:
                if a < 256:
                    return True
                before, a = a, right[a]
            elif b < 256:
                return True
            else:
                before, b = b + 1, left[b]

    def stands(self, a: int, b: int) -> bool:
        """Whether b follows a in the encoding of their bytes."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def last(self, word: bytes, end: int, states: list[int] | array) -> tuple[int, int]:
        """The last token of word[:end] and where it begins, from the last tokens of shorter prefixes (states[n] of word[:n])."""
        step, token_at, pairs, state, at, ways = self.step, self.token_at, self.pairs, 0, end, []
        while at:
            state = step.get(state << 8 | word[at - 1])
            if state is None:
                break
            at -= 1
            if token_at[state] >= 0:
                ways.append(at)
                ways.append(token_at[state])
        while ways:
            token, at = ways.pop(), ways.pop()
            if not at:
                if self.whole[token]:
                    return token, at
                continue
            fits = pairs.get(states[at] << 20 | token)
            if self.stands(states[at], token) if fits is None else fits:
                return token, at
        raise ValueError("no token ends here")


class Trie:
    """Words' prefixes with their last tokens; node 0 is the empty prefix."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        #: Of each node the last token, and the node before that token.
        self.token, self.before = array("i", [-1]), array("i", [0])

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """ids of distinct words, as little-endian 32-bit integers."""
        if len(self.token) > MOST_NODES:
            self.clear()
        child, token, before, find = self.child, self.token, self.before, self.merges.last
        found: dict[bytes, bytes] = {}
        path, states, previous = [0], [-1], b""
        for word in sorted(words):
            if len(word) > LONGEST:
                found[word] = self._alone(word)
                continue
            shared = 0
            for x, y in zip(word, previous, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            node, previous = path[-1], word
            for depth in range(shared, len(word)):
                key = node << 8 | word[depth]
                node = child.get(key, 0)
                if not node:
                    last, at = find(word, depth + 1, states)
                    node = child[key] = len(token)
                    token.append(last)
                    before.append(path[at])
                path.append(node)
                states.append(token[node])
            found[word] = self._upwards(node)
        return found

    def _upwards(self, node: int) -> bytes:
        numbers = []
        while node:
            numbers.append(self.token[node])
            node = self.before[node]
        return self.merges.ids[numbers[::-1]].tobytes()

    def _alone(self, word: bytes) -> bytes:
        states, begins = array("i", [-1]), array("q", [0])
        for end in range(1, len(word) + 1):
            last, at = self.merges.last(word, end, states)
            states.append(last)
            begins.append(at)
        numbers, end = [], len(word)
        while end:
            numbers.append(states[end])
            end = begins[end]
        return self.merges.ids[numbers[::-1]].tobytes()


class TrieEncoder(Encoder):
    """ids of whole texts by a trie of their words; the library only cuts texts that the fixed pattern doesn't."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__(path, plain)
        self.trie = Trie(Merges(path))
        self.back = {ord(letter): byte for byte, letter in _byte_letters().items()}
        added = {} if plain else self.trie.merges.added
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _encoded(self, split: list[list[bytes]]) -> list[bytes]:
        """ids of each list of words."""
        ids = self.trie.encode(list(set().union(*split)))
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def _words(self, words: list[str]) -> list[bytes]:
        return self._encoded([[w.encode()] for w in words]) if words else []

    def _together(self, pieces: list[str]) -> list[bytes]:
        return self._encoded([[w.encode() for w in self.split(p)] for p in pieces]) if pieces else []

    def _cut_words(self, words: list[str]) -> list[bytes]:
        return self._words(words)

    def direct(self, text: str) -> bytes:
        out, added = [], self.trie.merges.added
        for part in self.apart.split(text) if self.apart else [text]:
            if self.apart and part in added:
                out.append(np.asarray([added[part]], dtype="<u4").tobytes())
            elif part:
                cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                out += self._encoded([[w.translate(self.back).encode("latin-1") for w, _ in cut]])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        raw = self.trie.merges.raw
        try:
            joined = b"".join(map(raw.__getitem__, ids))
        except KeyError:
            joined = b"".join(raw.get(i, b"") for i in ids)
        return joined.decode("utf-8", "replace")


_encoders: dict[tuple[str, bool], TrieEncoder] = {}


def trie_encoder(path: str, plain: bool = False) -> TrieEncoder:
    """One encoder for each file and worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = TrieEncoder(path, plain)
    return _encoders[path, plain]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, plain: bool) -> Iterator[pa.RecordBatch]:
    known = trie_encoder(path, plain)
    for batch in small_batches(batches, "text", 2 << 20):
        ids = [np.frombuffer(x, dtype="<u4") for x in known.encode_all([t or "" for t in batch.column("text").to_pylist()])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, plain: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids. With plain, names of added tokens are text like any other."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _encoded(b, path, plain), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = trie_encoder(path)
    for batch in batches:
        lists = batch.column("ids")
        edges, ids = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
        texts = [known.decode(ids[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """One row per row of tokens (doc_id, ids): doc_id, ids, text."""
    return tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(lambda b: _decoded(b, path), "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of the text that the ids give back."""
    import hashlib

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(batches, path):
            lists = batch.column("ids")
            edges, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4").tobytes()
            shas = [hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path).mapInArrow(told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
