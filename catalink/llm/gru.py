"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input (of a run longer than 64 characters, an input for each of its pieces) joins an embedding of the whole word with the summed embeddings of its character 4- and
5-grams, both hashed. A window's states are pooled by attention into one logit; a text's logit is the
largest of its windows, one of which starts at every word (the last ones end at the text's end).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import regex

WORDS, GRAMS, WIDTH, HIDDEN = 1 << 15, 1 << 14, 8, 8
WINDOW = 24
#: Words whose gate inputs a worker keeps (about 350 bytes a word).
KEPT_WORDS = 150_000
STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¿¡"


#: Longest word taken as one; size and step of the pieces of a longer run, so that any PIECE - PIECE_STEP + 1 characters are in one piece.
LONGEST, PIECE, PIECE_STEP = 64, 32, 16
#: Punctuation and symbols; marks belong to the letters before them.
_JOINTS = regex.compile(r"(?:[^\w\p{M}]|_)+")


def words_of(text: str) -> list[str]:
    """The words of a text, in order. Of one longer than LONGEST the parts between punctuation, of a part that is still longer overlapping pieces."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [piece for w in words for piece in ([w] if len(w) <= LONGEST else _pieces(w))]


def _pieces(run: str) -> list[str]:
    out = []
    for part in [x for x in _JOINTS.split(run) if x] or [run]:
        out += [part] if len(part) <= LONGEST else [part[i : i + PIECE] for i in range(0, len(part) - PIECE + PIECE_STEP, PIECE_STEP)]
    return out


@dataclass
class Parts:
    """Hashed parts of a list of words: one word hash each, and grams[edges[i]:edges[i + 1]]."""

    words: np.ndarray
    grams: np.ndarray
    edges: np.ndarray

    def rows(self, at: np.ndarray) -> Parts:
        sizes = self.edges[at + 1] - self.edges[at]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.arange(edges[-1]) + np.repeat(self.edges[at] - edges[:-1], sizes)
        return Parts(self.words[at], self.grams[flat], edges)


#: Odd factors of the gram hash.
_FACTORS = np.asarray([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


def parts(words: list[str]) -> Parts:
    """Hashes of words without outer punctuation, and of their character grams."""
    cores = [(w.strip(STRIPPED) or w).encode("utf-8", "replace") for w in words]
    ids = np.fromiter((zlib.crc32(c) % WORDS for c in cores), dtype=np.int64, count=len(cores))
    marked = [b"<%b>" % c if len(c) > 1 else b"<%b>>>" % c for c in cores]
    raw = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    starts = np.cumsum(sizes) - sizes
    columns, owners = [], []
    for n in (4, 5):
        count = np.maximum(sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        h = np.full(len(at), n * 40503, dtype=np.uint32)
        for k in range(n):
            h = (h ^ (h >> np.uint32(13))) + raw[at + k] * _FACTORS[k]
        columns.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64) % GRAMS)
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return Parts(ids, np.concatenate(columns)[order], edges)


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """The windows at every start in a text's word numbers; a shorter text has one, filled up with 0."""
    return np.lib.stride_tricks.sliding_window_view(padded(numbers), WINDOW)


def padded(numbers: np.ndarray) -> np.ndarray:
    """A text's word numbers, filled up with 0 to one window at least."""
    return np.concatenate([numbers, np.zeros(max(0, WINDOW - len(numbers)), dtype=np.int64)])


def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the window starts of texts of the given sizes that lie one after another: those whose window ends within the text."""
    first = np.cumsum(sizes) - sizes
    return first, first + sizes - WINDOW + 1


def _highest(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each text's largest score; windows that reach into the next text don't count."""
    # The last text's end may lie one beyond the scores.
    bounds = np.stack(_starts(sizes), axis=1).ravel()
    return np.maximum.reduceat(np.append(scores, np.float32(-np.inf)), bounds)[::2]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    halves: list[np.ndarray] | None = None
    known: dict[str, int] = field(default_factory=dict)

    def inputs(self, split: Parts) -> np.ndarray:
        """Input vectors of words given by their hashed parts."""
        sizes = np.diff(split.edges)
        sums = np.add.reduceat(self.p["grams"][split.grams], split.edges[:-1], axis=0) if len(sizes) else np.zeros((0, WIDTH))
        return np.concatenate([self.p["words"][split.words], sums / np.sqrt(sizes)[:, None]], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["w"] + self.p["b"]

    def run(self, g: np.ndarray | None, at: np.ndarray, keep: bool = False):
        """Logits of windows (at: window, place -> row of g, or of the tables); with keep also what the gradient needs."""
        n, steps, h = len(at), at.shape[1], HIDDEN
        places = np.ascontiguousarray(at.T)
        states = np.zeros((steps, n, 2 * h), np.float32)
        kept: list[tuple] = []
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            s = np.zeros((n, h), np.float32)
            own = np.ascontiguousarray(g[:, side * 3 * h : (side + 1) * 3 * h]) if keep else self.halves[side]
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x, m = own.take(places[t], axis=0), s @ u
                zr = _sigmoid(x[:, : 2 * h] + m[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = 2 * _sigmoid(2 * (x[:, 2 * h :] + r * m[:, 2 * h :])) - 1
                if keep:
                    kept.append((side, t, s, z, r, c, m[:, 2 * h :]))
                s = s + z * (c - s)
                states[t, :, side * h : (side + 1) * h] = s
        a = np.tanh(states @ self.p["a"])
        e = a @ self.p["v"]
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, (states, kept, a, share, pooled)) if keep else logit

    def gradients(self, g: np.ndarray, at: np.ndarray, wrong: np.ndarray, saved: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of g, given the loss's gradient by logit."""
        states, kept, a, share, pooled = saved
        h, p = HIDDEN, self.p
        d = {"o": pooled.T @ wrong, "ob": np.asarray([wrong.sum()])}
        d_pooled = wrong[:, None] * p["o"][None, :]
        d_states = share[:, :, None] * d_pooled[None]
        d_share = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        d["v"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[:, :, None] * p["v"] * (1 - a * a)
        d["a"] = np.einsum("tnh,tnk->hk", states, d_a)
        d_states += d_a @ p["a"].T
        d_g = np.zeros_like(g)
        d["uf"], d["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
        carry = {0: np.zeros((len(at), h)), 1: np.zeros((len(at), h))}
        for side, t, s, z, r, c, mc in reversed(kept):
            u, name = (p["uf"], "uf") if side == 0 else (p["ub"], "ub")
            d_s = d_states[t, :, side * h : (side + 1) * h] + carry[side]
            d_c = d_s * z * (1 - c * c)
            d_z = d_s * (c - s) * z * (1 - z)
            d_r = d_c * mc * r * (1 - r)
            d_m = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d[name] += s.T @ d_m
            carry[side] = d_s * (1 - z) + d_m @ u.T
            np.add.at(d_g, (at[:, t][:, None], np.arange(side * 3 * h, (side + 1) * 3 * h)[None, :]), np.concatenate([d_z, d_r, d_c], axis=1))
        return d, d_g

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the worker's tables of gate inputs for words; new words are added."""
        known = self.known
        if self.halves is None:
            self.halves = [np.zeros((KEPT_WORDS, 3 * HIDDEN), np.float32) for _ in (0, 1)]
            self.fill(0, np.zeros((1, 2 * WIDTH), np.float32))
        new = list({w for w in words if w not in known})
        if new:
            at = len(known) + 1
            self.fill(at, self.inputs(parts(new)))
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def fill(self, at: int, x: np.ndarray) -> None:
        """Write gate inputs from row at, in tables that grow as needed."""
        g = self.gates(x)
        for side in (0, 1):
            more = at + len(g) - len(self.halves[side])
            if more > 0:
                self.halves[side] = np.concatenate([self.halves[side], np.zeros((more + 4096, 3 * HIDDEN), np.float32)])
            self.halves[side][at : at + len(g)] = g[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]

    def slide(self, flat: np.ndarray, most: int = 2048) -> np.ndarray:
        """Logits of the windows at every start in flat (rows of the tables), as run() gives them.

        Features are rows and windows columns, so that place t of neighbouring windows is a slice.
        """
        h, halved = HIDDEN, np.repeat(np.asarray([0.5, 1], np.float32), [2 * HIDDEN, HIDDEN])
        turned = [np.ascontiguousarray((self.p[k] * halved).T) for k in ("uf", "ub")]
        reads = np.concatenate([self.p["a"], self.p["o"][:, None]], axis=1).T
        reads = [np.ascontiguousarray(reads[:, side * h : (side + 1) * h]) for side in (0, 1)]
        out = np.zeros(len(flat) - WINDOW + 1, np.float32)
        for first in range(0, len(out), most):
            n = min(most, len(out) - first)
            own = flat[first : first + n + WINDOW - 1]
            seen = np.zeros((WINDOW, h + 1, n), np.float32)
            for side in (0, 1):
                g = np.ascontiguousarray((self.halves[side].take(own, axis=0) * halved).T)
                s = np.zeros((h, n), np.float32)
                for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                    x, m = g[:, t : t + n], turned[side] @ s
                    zr = m[: 2 * h]
                    zr += x[: 2 * h]
                    np.tanh(zr, out=zr)
                    zr *= 0.5
                    zr += 0.5
                    c = m[2 * h :]
                    c *= zr[h:]
                    c += x[2 * h :]
                    np.tanh(c, out=c)
                    c -= s
                    c *= zr[:h]
                    s += c
                    seen[t] += reads[side] @ s
            e = np.einsum("k,tkn->tn", self.p["v"], np.tanh(seen[:, :h]))
            e = np.exp(e - e.max(axis=0))
            out[first : first + n] = (e * seen[:, h]).sum(axis=0) / e.sum(axis=0) + self.p["ob"][0]
        return out

    def over(self, x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Logits of the windows at every start in flat, over words with the input vectors x."""
        self.halves = [np.zeros((len(x), 3 * HIDDEN), np.float32) for _ in (0, 1)]
        self.fill(0, x)
        return self.slide(flat)

    def logits(self, texts: list[str], most: int = 4096) -> np.ndarray:
        """Each text's logit over all its windows, before calibration."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.halves = {}, None
        split = [words_of(t) for t in texts]
        rows = self.numbers([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        each = np.split(rows, ends[:-1])
        sizes = np.asarray([len(x) for x in each])
        out = np.zeros(len(texts), np.float32)
        short, long = np.flatnonzero(sizes <= WINDOW), np.flatnonzero(sizes > WINDOW)
        with np.errstate(over="ignore"):
            for i in range(0, len(short), most):
                out[short[i : i + most]] = self.run(None, np.stack([padded(each[j]) for j in short[i : i + most]]))
            if len(long):
                out[long] = _highest(self.slide(np.concatenate([each[j] for j in long])), sizes[long])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        with np.errstate(over="ignore"):
            return _sigmoid(self.scale * self.logits(texts).astype(np.float64) + self.shift)


def _log_odds(split: Parts, docs: list[np.ndarray], labels: np.ndarray, size: int, grams: bool) -> np.ndarray:
    """Shrunken log-odds of label 1 for each hash, from the share of texts that hold it."""
    seen = np.zeros((2, size))
    for numbers, y in zip(docs, labels, strict=True):
        own = split.rows(np.unique(numbers))
        seen[y, np.unique(own.grams if grams else own.words)] += 1
    n = np.maximum(np.bincount(labels, minlength=2), 1)[:, None]
    share = (seen + 1) / (n + 2)
    return np.log(share[1] / share[0]) * seen.sum(axis=0) / (seen.sum(axis=0) + 8)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, slightly regularised."""
    xs, theta = np.stack([x, np.ones_like(x)], axis=1), np.asarray([1.0, 0.0])
    for _ in range(25):
        q = _sigmoid(np.clip(xs @ theta, -30, 30))
        grad = xs.T @ (weight * (q - y)) + 1e-2 * (theta - [1, 0])
        hess = (xs * (weight * q * (1 - q))[:, None]).T @ xs + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 4, seed: int = 5) -> Net:
    """Fit on labelled texts: in each round the window with the largest logit stands for its text, and a random one is added for texts of label 0.

    weights: how many rows of the table each text stands for, used in calibration only.
    """
    rng = np.random.default_rng(seed)
    h = HIDDEN
    near = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    p = {"words": near(WORDS, WIDTH) * 0.1, "grams": near(GRAMS, WIDTH) * 0.1, "w": near(2 * WIDTH, 6 * h), "b": np.zeros(6 * h, np.float32)}
    p |= {"uf": near(h, 3 * h), "ub": near(h, 3 * h), "a": near(2 * h, 8), "v": near(8), "o": near(2 * h), "ob": np.zeros(1, np.float32)}
    net = Net(p)
    if not len(texts) or len(set(labels.tolist())) < 2:
        net.p["o"] *= 0
        net.shift = -4.0 if not len(texts) or labels[0] == 0 else 4.0
        return net
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number) + 1) for w in words_of(t)), dtype=np.int64) for t in texts]
    split = parts(["", *number])
    p["words"][:, 0] = _log_odds(split, docs, labels, WORDS, False)
    p["grams"][:, 0] = _log_odds(split, docs, labels, GRAMS, True)
    each = [padded(x) for x in docs]
    flat, lengths = np.concatenate(each), np.asarray([len(x) for x in each])
    first, end = _starts(lengths)
    places = np.arange(WINDOW)
    filled = np.arange(len(split.words)) > 0
    m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    step = 0
    with np.errstate(over="ignore"):
        for round_no in range(rounds):
            x = net.inputs(split) * filled[:, None]
            if round_no:
                score = net.over(x, flat)
            else:
                score = np.lib.stride_tricks.sliding_window_view((x[:, 0] + x[:, WIDTH])[flat], WINDOW).max(axis=1)
            best = np.asarray([a + int(np.argmax(score[a:b])) for a, b in zip(first, end, strict=True)])
            extra = np.asarray([rng.integers(a, b) for a, b, y in zip(first, end, labels, strict=True) if y == 0])
            chosen = np.concatenate([best, extra])
            truth = np.concatenate([labels, np.zeros(len(extra))])
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), 128):
                pick = order[i : i + 128]
                rows, local = np.unique(flat[chosen[pick][:, None] + places], return_inverse=True)
                local = local.reshape(len(pick), -1)
                own = split.rows(rows)
                x = net.inputs(own) * (rows > 0)[:, None]
                g = net.gates(x)
                logit, saved = net.run(g, local, keep=True)
                wrong = ((_sigmoid(logit) - truth[pick]) / len(pick)).astype(np.float32)
                d, d_g = net.gradients(g, local, wrong, saved)
                d["w"], d["b"] = x.T @ d_g, d_g.sum(axis=0)
                d_x = (d_g @ p["w"].T) * (rows > 0)[:, None]
                step += 1
                for k, grad in d.items():
                    mean, square = m[k]
                    mean += 0.1 * (grad - mean)
                    square += 0.01 * (grad * grad - square)
                    p[k] -= (0.01 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                sizes = np.diff(own.edges)
                for k, ids, grad in (
                    ("words", own.words, d_x[:, :WIDTH]),
                    ("grams", own.grams, np.repeat(d_x[:, WIDTH:] / np.sqrt(sizes)[:, None], sizes, axis=0)),
                ):
                    used, where = np.unique(ids, return_inverse=True)
                    total = np.zeros((len(used), WIDTH))
                    np.add.at(total, where, grad)
                    square = m[k][1]
                    square[used] += total * total
                    p[k][used] -= (0.05 * total / (np.sqrt(square[used]) + 1e-6)).astype(np.float32)
        score = net.over(net.inputs(split) * filled[:, None], flat)
    top = _highest(score, lengths).astype(np.float64)
    net.scale, net.shift = _calibrate(top, labels, weights / weights.mean())
    net.halves = None
    return net
