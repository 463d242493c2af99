"""Whole-text encoding with a public tokenizer file, with each distinct piece of text encoded once per worker.

Both BPE files cut a text into words by a fixed pattern before any merge, so a text's ids are those of
its words in order. A plain text is cut at single blanks and line ends, and before points and commas
that follow a word, where the pattern always cuts too; a text with runs of blanks is cut by the pattern
itself. Pieces seen for the first time go to the tokenizers library, single words straight to its
merges, and so do all other texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from itertools import islice
from operator import attrgetter

import numpy as np
import regex

#: The split patterns of the two files, \s written as White_Space, and contractions of the lower-casing file in both cases.
PATTERNS = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+",
    "word_bpe_49k.json": r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+",
}
#: Latin letters, punctuation and common symbols, without control characters other than tab and line ends, and without the one capital whose lower case is two characters.
PLAIN = re.compile("[\t\n\r -\x7e\xa0-įı-ɏ‐-‧‰-⁞€]*")
#: A point or comma that may belong to a longer run, or to the blank before it.
JOINED = re.compile(r"[.,](?<!\w.)")
RUNS = re.compile("[ \n][ \n]|[\t\r\xa0    ]")
#: Stands between pieces that are encoded together: a line end, which no such piece holds, or a control character of its own.
LINE, MARK = "\n", " \x01 "
#: Pieces a worker keeps (about 200 bytes a piece). A full table stays as it is, as common pieces come early, and begins anew after so many more new ones.
KEPT, ANEW = 300_000, 4_000_000

TOKEN_ID = attrgetter("id")
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """ids of whole texts by one tokenizer file."""

    def __init__(self, path: str, plain: bool = False):
        """With plain, the names of special tokens are text like any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        name = os.path.basename(path)
        self.split = regex.compile(PATTERNS[name]).findall if name in PATTERNS else None
        self.blanks_count = name == "byte_bpe_50k.json"
        self.between = LINE if self.blanks_count else MARK
        if self.split:
            (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        #: ids of pieces known so far: those of texts cut at blanks, and those that the pattern cuts.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.ways = (self._blank_pieces if self.blanks_count else self._plain_pieces, self._cut_words)
        self.missed = 0

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece; none holds the mark between them, nor begins or ends with a blank that could join it."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            starts, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def _learned(self, table: int, new: list[str]) -> dict[str, bytes]:
        """ids of pieces that the table doesn't hold; they are kept while there is room."""
        found, known = dict(zip(new, self.ways[table](new), strict=True)), self.known[table]
        room = max(0, KEPT - len(known))
        known.update(found if len(found) <= room else islice(found.items(), room))
        if len(found) > room:
            self.missed += len(found) - room
            if self.missed > ANEW:
                known.clear()
                self.missed = 0
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of single words (after a blank or not) by the model's merges alone, each written in the bytes' letters."""
        merges, letters = self.merges, self.letters
        raw = " \n".join(words).encode().decode("latin-1").translate(letters).split(f"{letters[32]}{letters[10]}")
        return [array("I", map(TOKEN_ID, merges(w))).tobytes() for w in raw] if words else []

    def _mixed(self, texts: list[str], plain: list[bool]) -> list[bytes]:
        """ids of each text, in order: those that are one word, and the others."""
        words = iter(self._words([t for t, p in zip(texts, plain, strict=True) if p]))
        others = iter(self._together([t for t, p in zip(texts, plain, strict=True) if not p]) if not all(plain) else ())
        return [next(words) if p else next(others) for p in plain]

    def _blank_pieces(self, keys: list[str]) -> list[bytes]:
        """Pieces of a text whose blanks count: all follow a blank, but for those after a line end, a word, and the first."""
        line = np.asarray([self.mark], dtype="<u4").tobytes()
        ids = self._mixed([k[1:] if k[:1] in ("\n", "\x00", "\x02") else f" {k}" for k in keys], [k.isalpha() for k in keys])
        return [line + x if k[:1] == "\n" else x for k, x in zip(keys, ids, strict=True)]

    def _plain_pieces(self, keys: list[str]) -> list[bytes]:
        """Pieces of a text whose blanks don't count; letters lose their case first, as the file says."""
        plain = [k.isalpha() for k in keys]
        return self._mixed([k.lower() if p else k for k, p in zip(keys, plain, strict=True)], plain)

    def _cut_words(self, words: list[str]) -> list[bytes]:
        return [self.direct(w) for w in words]

    def _cut(self, text: str) -> tuple[int, list[str]] | None:
        """The table of a text's pieces, and the pieces in order; None for a text that is encoded as it is."""
        if self.split is None or "<|" in text or not PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return None
        apart = "_" not in text and not JOINED.search(text)
        if not self.blanks_count:
            return 0, (text.replace(",", " ,").replace(".", " .") if apart else text).split()
        if RUNS.search(text) or text[-1:] in (" ", "\n"):
            return 1, self.split(text)
        cut = text.replace("\n", " \n")
        keys = (cut.replace(",", " \x02,").replace(".", " \x02.") if apart else cut).split(" ")
        if text[:1] == "\n" or text[:1] == " ":
            del keys[0]
        else:
            keys[0] = f"\x00{keys[0]}"
        return 0, keys

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers; new pieces of all texts are encoded together."""
        out: list[bytes] = [b""] * len(texts)
        left: list[tuple[int, int, list[str], list[bytes | None]]] = []
        new: tuple[dict[str, None], dict[str, None]] = ({}, {})
        for i, text in enumerate(texts):
            cut = self._cut(text)
            if cut is None:
                out[i] = self.direct(text)
                continue
            table, keys = cut
            values = list(map(self.known[table].get, keys))
            try:
                out[i] = b"".join(values)
            except TypeError:  # some are not known yet
                new[table].update(dict.fromkeys([k for k, v in zip(keys, values, strict=True) if v is None]))
                left.append((i, table, keys, values))
        found = [self._learned(table, list(x)) if x else {} for table, x in enumerate(new)]
        for i, table, keys, values in left:
            own = found[table]
            out[i] = b"".join([own[k] if v is None else v for k, v in zip(keys, values, strict=True)])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next of those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each file and worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
