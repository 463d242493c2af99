"""Exact duplicate removal against immutable snapshots.

A snapshot is a written table with one row per distinct text (digest, the id that stays, number of
rows) and one static binary-fuse filter per bucket of digests. An incoming batch is first grouped on
its own; its digests are then screened by the filters, and only positives are joined with the
snapshot's exact buckets. Every row of a class with more than one row has its bytes compared with the
bytes of the row that stays, so the answer never rests on a digest alone.

Cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of
equal texts the largest doc_id stays (nulls last); of repeated rows with that very id one row is marked
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import parts_for, pick, written
from .screens import held_udf, screen_of

#: Digests to a bucket of a snapshot: a filter of about 0.5 MB, built in one task.
BUCKET_KEYS = 200_000
#: A filter of suspect digests is sent to all executors only up to so many keys (about 10 MB); beyond, texts are shuffled without this screen.
SENT_KEYS = 4_000_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha) of every row, written once."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return written(rows.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha")), "digests")


def key64(sha: Column) -> Column:
    return F.xxhash64(sha)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per distinct digest of a batch."""
    return rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


@dataclass
class Snapshot:
    """Immutable: classes (sha, keep_id, group_size, bucket) and filters (bucket, cells), both written."""

    classes: DataFrame
    filters: DataFrame
    buckets: int


def _fuse_of(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "cells": [fuse.build(group["key"].to_numpy())]})


def snapshot(rows: DataFrame) -> Snapshot:
    """Group a batch of digests and freeze it with its filters."""
    classes = written(grouped(rows), "classes")
    buckets = parts_for(classes.count(), BUCKET_KEYS)
    classes = classes.withColumn("bucket", F.pmod(key64("sha"), F.lit(buckets)).cast("int"))
    keys = classes.select("bucket", key64("sha").alias("key"))
    return Snapshot(classes, written(keys.groupBy("bucket").applyInPandas(_fuse_of, "bucket int, cells binary"), "filters"), buckets)


def _screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    held = fuse.contains(right["cells"].iloc[0], left["key"].to_numpy()) if len(right) and len(left) else np.zeros(len(left), bool)
    return pd.DataFrame({"sha": left["sha"], "keep_id": left["keep_id"], "group_size": left["group_size"], "positive": held})


def screened(batch: DataFrame, old: Snapshot) -> DataFrame:
    """The batch's classes with positive = whether the snapshot's filter may hold their digest."""
    sides = batch.withColumn("key", key64("sha")).withColumn("bucket", F.pmod("key", F.lit(old.buckets)).cast("int"))
    return sides.groupBy("bucket").cogroup(old.filters.groupBy("bucket")).applyInPandas(_screen, "sha string, keep_id long, group_size long, positive boolean")


def merged(old: Snapshot, batch: DataFrame) -> DataFrame:
    """Classes (sha, keep_id, group_size) over the snapshot and an incoming batch of digests."""
    new = written(screened(grouped(batch), old), "screened")
    positives, negatives = new.where("positive"), new.where("not positive")
    both = old.classes.alias("o").join(positives.alias("n"), F.col("o.sha") == F.col("n.sha"), "full_outer").select(
        F.coalesce("o.sha", "n.sha").alias("sha"),
        F.greatest("o.keep_id", "n.keep_id").alias("keep_id"),
        (F.coalesce("o.group_size", F.lit(0)) + F.coalesce("n.group_size", F.lit(0))).alias("group_size"),
    )
    return both.unionByName(negatives.select("sha", "keep_id", "group_size"))


def _suspects(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (doc_id, sha, text) that may share a class; texts of rows that certainly don't are not shuffled while the filter is small."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    screen = screen_of(classes.where("group_size > 1").select(key64("sha")), SENT_KEYS)
    return rows if screen is None else rows.where(held_udf(rows, screen)(key64("sha")))


def classes_of(docs: DataFrame, rows: DataFrame, old: Snapshot, batch: DataFrame) -> DataFrame:
    """Checked classes: (sha, variant, keep_id, group_size) and, for each variant above 0, texts of an equal digest but other bytes."""
    classes = written(merged(old, batch), "merged")
    plain = pick(docs, doc_id="doc_id", text="text")
    suspects = _suspects(plain, classes)
    stays = classes.where("group_size > 1").select(F.col("sha").alias("k_sha"), F.col("keep_id").alias("k_id"))
    first = suspects.join(stays, (F.col("sha") == F.col("k_sha")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    first = written(first.groupBy(F.col("sha").alias("f_sha")).agg(F.min("text").alias("f_text")), "stay-texts")
    checked = suspects.join(first, F.col("sha") == F.col("f_sha")).where(F.col("text") != F.col("f_text"))
    other = written(checked.select("doc_id", "sha", F.sha2(F.reverse("text").cast("binary"), 512).alias("variant")), "other-bytes")
    if other.isEmpty():
        return classes.withColumn("variant", F.lit("")), other
    apart = other.groupBy("sha", "variant").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    ids = rows.join(classes.select("sha"), "sha", "left_semi").join(other, ["doc_id", "sha"], "left_anti")
    same = ids.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("variant", F.lit(""))
    return same.unionByName(apart), other


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, over all batches.

    The table arrives as a first batch, frozen as the snapshot, and a second that is screened against it.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    rows = digests(docs)
    side = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    old, batch = snapshot(rows.where(side != 0)), rows.where(side == 0)
    classes, other = classes_of(docs, rows, old, batch)
    # Rows of one id and text are counted together, then dealt out again: one of them may stay.
    each = rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    each = each.join(other.distinct(), ["doc_id", "sha"], "left") if not other.isEmpty() else each.withColumn("variant", F.lit(None).cast("string"))
    each = each.select("doc_id", "sha", "times", F.coalesce("variant", F.lit("")).alias("variant"))
    out = each.join(classes, ["sha", "variant"])
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def first_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept (doc_id); of repeated rows with one id and text, one."""
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_col, text = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    k = kept.select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    inner = inner.withColumn("sha", F.sha2(normalised(F.col(text)).cast("binary"), 256))
    held = inner.join(k, F.col(id_col).eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    return held.dropDuplicates([id_col, "sha"]).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


