"""A semi-Markov conditional random field over personal-data segments, trained and decoded with numpy.

A text around digits or at-signs is cut into tokens. A labelling is a sequence of segments: single tokens
outside, or spans of at most MOST_TOKENS tokens with a type. Whole-span features (shape, digits, parts,
checksum, separators, context) score each candidate span, a matrix scores neighbouring types, and
dynamic programming over bounded spans chooses boundaries and types jointly.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|[^\S\n]+|\n")
TRIGGER = re.compile(r"[0-9]+|@|[\[(]\s?(?i:at)\s?[\])]")
#: Four groups of digits with three dots, which may be bracketed or between blanks.
DOTTED = re.compile(r"[0-9]+(?:(?:\s?\.\s?|\s?\[\s?\.\s?\]\s?|\s?\(\s?\.\s?\)\s?)[0-9]+){3}")
MOST_TOKENS, DIMS = 16, 1 << 12
NUMERIC = frozenset(" .-()+/:")
MAILISH = frozenset("._%+-@[]() ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Spans that may be an entity: numeric with plain separators (7 digits or more, or four dotted groups), or with one at-sign (or a bracketed at)."""
    out = []
    for i, first in enumerate(tokens):
        if not (first[0].isalnum() or first in "+("):
            continue
        digits = ats = groups = 0
        letters = blank = False
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            t = tokens[j]
            if t.isdigit():
                digits += len(t)
                groups += 1
            elif t[0].isalpha():
                letters = True
                ats += t.lower() == "at" and j > i and tokens[j - 1] in "[(" and j + 1 < len(tokens) and tokens[j + 1] in "])"
            elif t == "@":
                ats += 1
            elif t == "\n" or t not in NUMERIC and t not in MAILISH or len(t) > 1:
                break
            blank = blank or t.isspace() and tokens[j - 1] not in "])" and (j + 1 == len(tokens) or tokens[j + 1] not in "[(")
            if ats > 1 or ats and digits > 12 or letters and blank:
                break
            if not t[0].isalnum():
                continue
            if ats and letters and t.lower() != "at" and j > i + 1:
                out.append((i, j + 1))
            elif not letters and (7 <= digits <= 19 or groups == 4 and digits < 7 and DOTTED.fullmatch("".join(tokens[i : j + 1]))):
                out.append((i, j + 1))
            elif not letters and digits > 19:
                break
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMS


def features(tokens: list[str], i: int, j: int) -> list[int]:
    """Columns of the whole-span features of tokens i to j."""
    span = "".join(tokens[i:j])
    digits = "".join(c for c in span if c.isdigit())
    shape = re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 5)}", re.sub(r"[A-Za-z]+", "a", span))
    parts = re.split(r"[^0-9]+", span.strip("()+"))
    names = [
        "one",
        f"shape={shape[:24]}",
        f"digits={len(digits) if len(digits) < 20 else 20}",
        f"luhn={len(digits) >= 16 and luhn(digits)},{len(digits) >= 16}",
        f"parts={min(len(parts), 6)}",
        f"groups={'-'.join(str(min(len(p), 9)) for p in parts)[:20]}",
        f"seps={''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))}",
        f"start={span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'a'}",
        f"octets={len(parts) == 4 and all(p.isdigit() and int(p[:9]) < 256 for p in parts)},{span.count('.')}",
        f"at={'@' in span},{any(t.lower() == 'at' for t in tokens[i:j])},{tokens[j - 1].isalpha()},{min(len(tokens[j - 1]), 5)}",
        f"dot={'dot' in tokens[i:j]},{'.' in span}",
    ]
    at = i - 1
    while at >= 0 and not tokens[at].strip():
        at -= 1
    before = tokens[at] if at >= 0 else "^"
    left, right = (tokens[i - 1] if i else "^"), (tokens[j] if j < len(tokens) else "$")
    names += [f"word={before.lower() if before.isalpha() else 'num' if before.isdigit() else before}"]
    names += [f"left={'s' if left.isspace() else left if not left[0].isalnum() else 'w'}", f"right={'s' if right.isspace() else right if not right[0].isalnum() else 'w'}"]
    return [_hash(n) for n in names]


@dataclass
class Model:
    weights: np.ndarray  # kinds x DIMS
    moves: np.ndarray  # (1 + kinds) x (1 + kinds), 0 stands for outside

    def scores(self, columns: list[list[int]]) -> np.ndarray:
        return self.weights[:, np.asarray(columns)].sum(axis=2).T if columns else np.zeros((0, len(KINDS)))

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (first token, end token, kind number)."""
        spans = candidates(tokens)
        if not spans:
            return []
        by_end: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), s in zip(spans, self.scores([features(tokens, i, j) for i, j in spans]), strict=True):
            by_end.setdefault(j, []).append((i, s))
        n, k = len(tokens), len(KINDS) + 1
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back: list[list[tuple[int, int]]] = [[(0, 0)] * k for _ in range(n + 1)]
        for j in range(1, n + 1):
            from_out = best[j - 1] + self.moves[:, 0]
            p = int(np.argmax(from_out))
            best[j, 0], back[j][0] = from_out[p], (j - 1, p)
            for i, s in by_end.get(j, ()):
                reach = best[i][:, None] + self.moves[:, 1:] + s[None, :]
                for y in range(1, k):
                    p = int(np.argmax(reach[:, y - 1]))
                    if reach[p, y - 1] > best[j, y]:
                        best[j, y], back[j][y] = reach[p, y - 1], (i, p)
        out, j, y = [], n, int(np.argmax(best[n]))
        while j > 0:
            i, p = back[j][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, p
        return out[::-1]


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    m = x.max(axis=axis)
    safe = np.where(np.isfinite(m), m, 0)
    return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis)) + safe


def train(sentences: list[tuple[list[str], list[tuple[int, int, int]]]], rounds: int = 5, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad; each sentence's gradient comes from forward and backward sums over all segmentations."""
    k = len(KINDS) + 1
    model = Model(np.zeros((len(KINDS), DIMS)), np.zeros((k, k)))
    seen_w, seen_m = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    prepared = []
    for tokens, gold in sentences:
        spans = candidates(tokens)
        prepared.append((len(tokens), spans, np.asarray([features(tokens, i, j) for i, j in spans], dtype=np.int64), [g for g in gold if g[:2] in set(spans)]))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            for n, spans, columns, gold in prepared:
                if not spans:
                    continue
                s, m = model.scores(columns.tolist()), model.moves
                ends: dict[int, list[int]] = {}
                starts: dict[int, list[int]] = {}
                for a, (i, j) in enumerate(spans):
                    ends.setdefault(j, []).append(a)
                    starts.setdefault(i, []).append(a)
                fwd, bwd = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
                fwd[0, 0], bwd[n] = 0, 0
                for j in range(1, n + 1):
                    fwd[j, 0] = _lse(fwd[j - 1] + m[:, 0])
                    if j in ends:
                        fwd[j, 1:] = _lse(np.stack([_lse(fwd[spans[a][0]][:, None] + m[:, 1:]) + s[a] for a in ends[j]]))
                for i in range(n - 1, -1, -1):
                    ways = [m[:, 0] + bwd[i + 1, 0]]
                    ways += [_lse(m[:, 1:] + (s[a] + bwd[spans[a][1], 1:])[None, :], 1) for a in starts.get(i, ())]
                    bwd[i] = _lse(np.stack(ways))
                total = _lse(fwd[n])
                grad_m = np.zeros_like(m)
                for j in range(1, n + 1):
                    grad_m[:, 0] += np.exp(fwd[j - 1] + m[:, 0] + bwd[j, 0] - total)
                grad_s = np.zeros_like(s)
                for a, (i, j) in enumerate(spans):
                    p = np.exp(fwd[i][:, None] + m[:, 1:] + (s[a] + bwd[j, 1:])[None, :] - total)
                    grad_s[a] = p.sum(axis=0)
                    grad_m[:, 1:] += p
                number = {x: a for a, x in enumerate(spans)}
                at, last = 0, 0
                for i, j, y in [*gold, (n, n, -1)]:
                    for _ in range(at, i):
                        grad_m[last, 0] -= 1
                        last = 0
                    if y >= 0:
                        grad_s[number[(i, j)], y] -= 1
                        grad_m[last, y + 1] -= 1
                        at, last = j, y + 1
                grad_w = np.zeros_like(model.weights)
                for y in range(len(KINDS)):
                    np.add.at(grad_w[y], columns.ravel(), np.repeat(grad_s[:, y], columns.shape[1]))
                used = np.unique(columns)
                g = grad_w[:, used] + decay * model.weights[:, used]
                seen_w[:, used] += g * g
                model.weights[:, used] -= rate * g / np.sqrt(seen_w[:, used])
                seen_m += grad_m * grad_m
                model.moves -= rate * grad_m / np.sqrt(seen_m)
    return model


def examples(n: int = 500, seed: int = 11) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Made sentences with marked entities in many notations, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(1, 9)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        body = num(rng.choice((15, 15, 15, 16, 17, 18)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((body, f"{body[:4]} {body[4:8]} {body[8:12]} {body[12:]}", f"{body[:4]}.{body[4:8]}.{body[8:12]}.{body[12:]}", f"{body[:4]}-{body[4:8]}-{body[8:12]}-{body[12:]}"))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}.{b}.{c}"))

    def email() -> str:
        user, host = rng.choice((word(), f"{word()}.{num(2)}", f"{word()}_{word()}")), f"{word()}{rng.choice(('', num(1)))}"
        tail = rng.choice(("com", "org", "net", "de", "example.com"))
        return rng.choice((f"{user}@{host}.{tail}", f"{user}@{host}.{tail}", f"{user}[at]{host}.{tail}", f"{user} (at) {host}.{tail}", f"{user}@{host}[.]{tail}"))

    def ip() -> str:
        return rng.choice((".", ".", ".", " . ", "[.]")).join(octet() for _ in range(4))

    def other() -> str:
        bad = num(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return rng.choice((f"version {rng.randint(1, 9)}.0.", f"{num(4)}-{num(2)}-{num(2)}", bad, f'token = "{num(3)}a{num(6)}bc{num(9)}e{num(2)}"', f"{num(8)}", f"{num(10)}", f"{rng.randint(256, 999)}.{octet()}.{octet()}.{octet()}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"{num(3)},{num(3)},{num(3)}", "1 2 3 4 5 6 7 8", f"{num(4)} {num(4)}", f"{num(7)}", f"{num(3)} {num(3)} {num(3)}", f"{num(12)}", f"{num(1)}.{num(2)}.{num(2)}-{num(4)}", f"{word()} @ {word()}", f"{num(13)}"))

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, marks = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            y = rng.randrange(-4, len(makers))
            made = makers[y]() if y >= 0 else other()
            start = len(text)
            text += made
            if y >= 0:
                marks.append((start, len(text), y))
            text += rng.choice((" ", ". ", ", ", "\n", "%%% ", " "))
        tokens, at, edge = TOKEN.findall(text), 0, {}
        for i, t in enumerate(tokens):
            edge[at] = i
            at += len(t)
        edge[at] = len(tokens)
        out.append((tokens, [(edge[a], edge[b], y) for a, b, y in marks if a in edge and b in edge]))
    return out
