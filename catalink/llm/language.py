"""Language by nearest centroid: normalised TF-IDF vectors of hashed byte trigrams, several clustered centroids per language, cosine.

Fitting takes a bounded sample of labelled rows (per_language of each), makes inverse document
frequencies and clusters each language's vectors by spherical k-means. Every whole text is then compared
with all centroids. A text whose cosine to its nearest centroid is below that language's floor for texts
of as many distinct trigrams is marked rejected. Floors come from the sample: each half and its prefixes,
measured by centroids of the other half; MARGIN times a low quantile. Where too few rows tell, the floor
of shorter texts holds, at last FLOOR: texts of a word or two can hardly be told from others.

Cases: a null text or one without a letter (Unicode category L) is `und`, score 0 and rejected; a table without labelled rows
gives `und` throughout; ties go to the language first in order; repeated rows are classified each; other
columns are ignored; texts of any length are counted whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, pick, small_batches

DIMS, CENTROIDS, PER_LANGUAGE, FLOOR = 8192, 4, 1000, 0.02
#: Quantile and share of it that make a floor, rows it needs, classes of distinct trigrams (by powers of 2).
QUANTILE, MARGIN, TELLING, CLASSES = 0.01, 0.6, 20, 14
#: Rows that are made dense at a time in fitting.
DENSE = 256
LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, dtype=np.uint32)
for _b in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
    _KEEP[_b] = _b


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def counts(texts: list[str]) -> np.ndarray:
    """Trigram counts of each text, hashed to DIMS columns; a run of non-letters counts as one blank."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
        blank = raw == 32
        raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))]
        for at in range(0, max(1, len(raw) - 2), 1 << 20):
            x = raw[at : at + (1 << 20) + 2]
            h = (x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(40503 * 65537) + x[2:] * np.uint32(0x9E3779B1 ^ 0x5BD1E995)) >> np.uint32(19)
            out[i] += np.bincount(h, minlength=DIMS)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class _Rows:
    """Unit TF-IDF rows of texts, held sparsely and made dense DENSE at a time, so that fitting takes little memory."""

    def __init__(self, texts: list[str]):
        self.columns: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        seen = np.zeros(DIMS, dtype=np.int64)
        for at in range(0, len(texts), DENSE):
            for row in counts(texts[at : at + DENSE]):
                held = np.flatnonzero(row)
                seen[held] += 1
                self.columns.append(held.astype(np.uint16))
                self.values.append(np.sqrt(row[held]))
        self.idf = (np.log((1 + len(texts)) / (1 + seen)) + 0.1).astype(np.float32)
        for held, x in zip(self.columns, self.values, strict=True):
            x *= self.idf[held]
            x /= max(float(np.linalg.norm(x)), 1e-12)

    def dense(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), DIMS), dtype=np.float32)
        for row, i in zip(out, at.tolist(), strict=True):
            row[self.columns[i]] = self.values[i]
        return out

    def cosines(self, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([self.dense(at[i : i + DENSE]) @ centres.T for i in range(0, len(at), DENSE)])

    def sums(self, at: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
        """Sum of the rows of each of k groups."""
        out = np.zeros((k, DIMS), dtype=np.float32)
        for i in range(0, len(at), DENSE):
            one = (group[i : i + DENSE, None] == np.arange(k)).astype(np.float32)
            out += one.T @ self.dense(at[i : i + DENSE])
        return out


def _clusters(rows: _Rows, at: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of the rows at the given places, begun at the rows farthest from those chosen before."""
    middle = rows.sums(at, np.zeros(len(at), dtype=np.int64), 1)
    centres = rows.dense(at[[int(np.argmax(rows.cosines(at, middle)[:, 0]))]])
    while len(centres) < min(k, len(at)):
        centres = np.concatenate([centres, rows.dense(at[[int(np.argmin(rows.cosines(at, centres).max(axis=1)))]])])
    for _ in range(rounds):
        nearest = np.argmax(rows.cosines(at, centres), axis=1)
        sums = rows.sums(at, nearest, len(centres))
        centres = _unit(np.where((np.bincount(nearest, minlength=len(centres)) > 0)[:, None], sums, centres))
    return centres


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    language_of: np.ndarray
    floors: np.ndarray | None = None  # languages x CLASSES

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and class of distinct trigrams of each text."""
        c = counts(texts)
        cosines = _unit(np.sqrt(c) * self.idf) @ self.centres.T
        best = np.argmax(cosines, axis=1)
        sizes = np.frexp((c > 0).sum(axis=1))[1]
        return self.language_of[best], cosines[np.arange(len(texts)), best], np.minimum(sizes, CLASSES - 1)


def fit(texts: list[str], langs: list[str], k: int = CENTROIDS) -> Model | None:
    if not texts:
        return None
    rows = _Rows(texts)
    names = sorted(set(langs))
    parts = [_clusters(rows, np.flatnonzero([x == n for x in langs]), k) for n in names]
    return Model(names, rows.idf, np.concatenate(parts), np.repeat(np.arange(len(names)), [len(p) for p in parts]))


def floors(texts: list[str], langs: list[str], names: list[str]) -> np.ndarray:
    """Least cosine of a text of each language and class of distinct trigrams, from texts that the measuring centroids don't know."""
    found: list[list[list[float]]] = [[[] for _ in range(CLASSES)] for _ in names]
    number = {n: i for i, n in enumerate(names)}
    for half in (0, 1):
        model = fit(texts[1 - half :: 2], langs[1 - half :: 2])
        cuts = [(t[:n], lang) for t, lang in zip(texts[half::2], langs[half::2], strict=True) for n in (*(k for k in (16 << j for j in range(16)) if k < len(t)), len(t))]
        cuts = [(t, lang) for t, lang in cuts if has_letter(t)]
        for at in range(0, len(cuts) if model else 0, 256):
            part = cuts[at : at + 256]
            best, cosines, classes = model.predict([t for t, _ in part])
            for (_, lang), b, x, k in zip(part, best.tolist(), cosines.tolist(), classes.tolist(), strict=True):
                if model.languages[b] == lang:
                    found[number[lang]][k].append(x)
    out = np.full((len(names), CLASSES), FLOOR)
    for row, lists in zip(out, found, strict=True):
        for k, xs in enumerate(lists):
            row[k] = max(row[k - 1] if k else FLOOR, MARGIN * float(np.quantile(xs, QUANTILE)) if len(xs) >= TELLING else 0)
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on the rows of docs (doc_id, text, lang) that are not held out and have a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = sorted((r for r in labelled_sample(rows, "lang", per_language, "text").collect() if has_letter(r.text)), key=lambda r: (str(r.doc_id), r.lang, r.text))
    texts, langs = [r.text for r in sample], [r.lang for r in sample]
    model = fit(texts, langs)
    if model:
        # Neighbours in order of id go to different halves, whatever ids mean.
        order = np.random.default_rng(3).permutation(len(texts)).tolist()
        model.floors = floors([texts[i] for i in order], [langs[i] for i in order], model.languages)
    return model


def _labels(batches: Iterator[pa.RecordBatch], model: Model | None, floor: float) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 20):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column("text").to_pylist()
            lettered = [has_letter(t) for t in texts]
            known = [i for i, x in enumerate(lettered) if model and x]
            names, scores, least = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), floor)
            if known:
                best, cosines, classes = model.predict([texts[i] for i in known])
                scores[known] = np.clip(cosines, 0, 1)
                least[known] = np.maximum(floor, model.floors[best, classes])
                for i, b in zip(known, best.tolist(), strict=True):
                    names[i] = model.languages[b]
            # Without any labelled language nothing speaks against a text with a letter.
            rejected = [not x or model is not None and s < y for x, s, y in zip(lettered, scores.tolist(), least.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])


def predictions(docs: DataFrame, per_language: int = PER_LANGUAGE, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = docs.sparkSession.sparkContext.broadcast(train(rows, per_language))
    out = rows.select("doc_id", "text").mapInArrow(lambda batches: _labels(batches, model.value, floor), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, per_language: int = PER_LANGUAGE, floor: float = FLOOR) -> DataFrame:
    """The rows of docs (with doc_id, text, lang and others) whose text is not rejected, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(pick(docs, doc_id="doc_id", text="text", lang="lang"), per_language))

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = pa.array(np.arange(len(batch)))
            rows = pa.RecordBatch.from_arrays([ids, batch], names=["doc_id", "text"])
            yield pa.concat_arrays([pc.invert(x.column("rejected")) for x in _labels([rows], model.value, floor)]) if len(batch) else pa.array([], pa.bool_())

    held.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return inner.where(F.arrow_udf(held, T.BooleanType())(F.col(f"c{names.index('text')}"))).toDF(*names)
