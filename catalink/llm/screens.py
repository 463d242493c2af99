"""Screens: a set of 64-bit keys as binary-fuse filters, small enough to be sent to all executors, or none.

Cases: no keys give a screen that lets nothing through; repeated keys count once; keys beyond the stated number give no screen,
and callers join instead; a key of the set always passes, another with a chance of about 1 in 256.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import parts_for

#: Keys to a filter, each built in one task.
BUCKET_KEYS = 100_000


def _built(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "cells": [fuse.build(group["key"].to_numpy())]})


def screen_of(keys: DataFrame, most: int) -> list[bytes] | None:
    """Filters of the single long column of keys (2.3 bytes a key), or None for more than most keys."""
    keys = keys.toDF("key")
    n = keys.count()
    if n > most:
        return None
    buckets = parts_for(n, BUCKET_KEYS, 1)
    dealt = keys.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)).cast("int"))
    found = {r.bucket: bytes(r.cells) for r in dealt.groupBy("bucket").applyInPandas(_built, "bucket int, cells binary").collect()}
    nothing = fuse.build(np.zeros(0, np.int64))
    return [found.get(i, nothing) for i in range(buckets)]


def held(screen: list[bytes], keys: np.ndarray) -> np.ndarray:
    """For each key, whether the screen lets it through."""
    bits = np.ascontiguousarray(keys).view(np.uint64)
    bucket = (bits >> np.uint64(20)) % np.uint64(len(screen))
    out = np.zeros(len(bits), dtype=bool)
    for i, cells in enumerate(screen):
        own = bucket == i
        if own.any():
            out[own] = fuse.contains(cells, bits[own])
    return out


def held_udf(df: DataFrame, screen: list[bytes]) -> Callable[[Column], Column]:
    """The screen as a column function, sent to executors once."""
    sent = df.sparkSession.sparkContext.broadcast(screen)
    return F.pandas_udf(lambda k: pd.Series(held(sent.value, k.to_numpy())), "boolean")
