"""Toxicity of whole texts by the windowed recurrent network of `gru`.

The network learns from a bounded sample of labelled texts (about per_label of each label and
`common.SAMPLE_BYTES` of text, never held-out ones), on the driver; it is then sent to all tasks (about 2 MB) and scores the windows at every start in
every text, as in training. A text's score is that of its highest window, calibrated to the labels' frequencies.

Cases: a null text counts as empty and is scored as one empty window; documents without a label are
scored, too; without labels of both kinds all scores are alike, near the one label known; repeated rows
are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import held_out, labelled_sample, pick, small_batches

PER_LABEL = 1200


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> gru.Net:
    """Fit on docs (doc_id, text) joined with labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # At most about per_label rows of each of two labels are sent to the texts, which then are bounded by bytes, too.
    sample = F.broadcast(labelled_sample(known, "toxic", per_label).distinct())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    rows = labelled_sample(texts, "toxic", 1 << 30, "text", seed="bytes").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    y = np.asarray([int(r.toxic) for r in rows], dtype=np.int64)
    weights = np.asarray([counts[r.toxic] for r in rows], dtype=np.float64) / np.maximum(np.bincount(y, minlength=2), 1)[y] if len(y) else np.zeros(0)
    return gru.train([r.text for r in rows], y, weights)


def _scored(batches: Iterator[pa.RecordBatch], net: gru.Net) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 20):
        q = net.scores([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(q), pa.array((q >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    net = docs.sparkSession.sparkContext.broadcast(train(rows, pick(labels, doc_id=id_col, toxic=label_col), per_label))
    out = rows.mapInArrow(lambda batches: _scored(batches, net.value), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
